"""Driver-side guards around a run: disk budget, output lock, configuration."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path


class BudgetExceeded(RuntimeError):
    """A reservation would pass the halt line."""


@dataclass
class DiskBudget:
    """Bytes reserved for writes under one root; warns at ``warn`` and halts at ``halt`` of the most."""

    most: int
    existing: int = 0
    warn: float = 0.9
    halt: float = 1.0
    reserved: dict[str, int] = field(default_factory=dict)

    def total(self) -> int:
        return self.existing + sum(self.reserved.values())

    def reserve(self, label: str, size: int) -> bool:
        """Whether the reservation passes the warning line."""
        if size < 0:
            raise ValueError("size must not be negative")
        if self.total() + size > self.halt * self.most:
            raise BudgetExceeded(f"{label}: {self.total() + size} bytes of {self.most}")
        self.reserved[label] = self.reserved.get(label, 0) + size
        return self.total() >= self.warn * self.most

    def settle(self, label: str, size: int) -> None:
        """What was written in place of what was reserved."""
        self.reserved[label] = size


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


@contextlib.contextmanager
def output_lock(root: str, name: str = ".lock") -> Iterator[Path]:
    """Held by one process; a lock whose process is gone is taken over."""
    path = Path(root, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    for _ in range(2):
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            held = path.read_text().strip()
            if held.isdigit() and _alive(int(held)):
                raise RuntimeError(f"{root} is locked by process {held}") from None
            path.unlink(missing_ok=True)
    else:
        raise RuntimeError(f"{root} could not be locked")
    os.write(fd, str(os.getpid()).encode())
    os.close(fd)
    try:
        yield path
    finally:
        path.unlink(missing_ok=True)


@dataclass(frozen=True)
class RunConfig:
    """What a diagnostic run is parameterised by; the values are the usual ones."""

    seed: int = 20260506
    ratios: tuple[float, ...] = (0.5, 0.2, 0.1, 0.2)
    shard_rows: int = 128
    bootstrap: int = 1000
    confidence: float = 0.95
    neighbours: int = 10
    least_positives: int = 50


def partial_reasons(cfg: RunConfig, *, subsets: set[str], wanted: set[str], limit: int = 0, skipped: tuple[str, ...] = ()) -> list[str]:
    """Why a run does not cover everything."""
    out = [f"subset {s} is missing" for s in sorted(wanted - subsets)]
    if limit:
        out.append(f"limited to {limit} rows a subset")
    out += [f"{s} skipped" for s in skipped]
    if cfg.bootstrap < RunConfig.bootstrap:
        out.append(f"{cfg.bootstrap} bootstrap replicates")
    return out
