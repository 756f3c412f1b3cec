"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Nothing is known of it: successive prefixes
of a conversation are rendered, consecutive outputs are compared, and what the longer one adds is the new turn's span.
If the longer output does not go on from the shorter one (apart from a suffix that moves to the new end), the template
rewrites history, and the conversation is marked so. Inside its span a turn's text is found by rendering the same turn
with two texts that differ in every character: what both share before and after is the template's, not the text's.

Each prefix is rendered whole, to the last turn: a template may begin to rewrite at any length. That holds a conversation
in its task and costs the square of its length. Only a template that its author declares ``local`` is spared this: beyond
``WINDOW`` turns the new turn is rendered after its last ``CONTEXT`` turns only, if that gave the very same spans for all
turns so far; else whole prefixes go on. Then a conversation is a stream: rows are dealt by conversation, sorted, and
formatted batch by batch; a task holds a few turns, however long a conversation is.

Null texts and roles count as empty. Rows without a conversation id form one conversation. Rows of a conversation are
taken by turn (nulls first), then role and text, so ties and repeated rows have a defined order and all stay. Other
columns are left out, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, CONTEXT = 64, 4
Turn = tuple[str, str]
_PROBES = ("\ue000", "\ue001")
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def local(template: Callable[[list[Turn]], str]) -> Callable[[list[Turn]], str]:
    """Declares that what a turn adds depends on it and the ``CONTEXT`` turns before it only, at any length, and that nothing before it changes."""
    template.local = True
    return template


@local
def plain_template(turns: list[Turn]) -> str:
    """``### role: text</turn>`` and a newline for each turn, control strings inside escaped by a backslash."""
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)}</turn>\n" for role, text in turns)


def plain_role(header: str) -> str:
    """The role that a turn's header names."""
    return unescape(header.removeprefix("### ").removesuffix(": ").replace("\\:", ":"))


@dataclass
class Span:
    """Of one turn, in code points of the whole output."""

    start: int
    piece: str
    text_start: int  # within the piece
    text_end: int
    rewrites: bool


def shared_prefix(a: str, b: str) -> int:
    """Length of what both start with; outputs that go on from each other are compared as a whole."""
    return len(a) if b.startswith(a) else len(commonprefix([a, b]))


def _common_suffix(a: str, b: str) -> int:
    return len(commonprefix([a[::-1], b[::-1]]))


@dataclass
class Renderer:
    """Takes a conversation's turns one by one and gives each one's span."""

    template: Callable[[list[Turn]], str]
    turns: list[Turn] = field(default_factory=list)  # all, or the last CONTEXT when windowed
    n: int = 0
    at: int = 0
    output: str | None = None  # of all turns so far, so that each prefix is rendered once; unknown when windowed
    local: bool = field(init=False)
    windowed: bool = False

    def __post_init__(self) -> None:
        self.local = getattr(self.template, "local", False)

    def added(self, shorter: str, before: list[Turn], turn: Turn) -> tuple[str, bool, str]:
        """What the turn adds to ``shorter``, the output of the turns before, whether that was rewritten, and the new output."""
        longer = self.template([*before, turn])
        same = shared_prefix(shorter, longer)
        tail = len(shorter) - same
        if tail == 0:
            return longer[same:], False, longer
        moved = longer.endswith(shorter[same:]) and len(longer) >= same + tail
        return longer[same : len(longer) - tail if moved else len(longer)], not moved, longer

    def text_place(self, shorter: str, before: list[Turn], turn: Turn, piece: str) -> tuple[int, int] | None:
        a, b = (self.added(shorter, before, (turn[0], x))[0] for x in _PROBES)
        head, foot = len(commonprefix([a, b])), _common_suffix(a, b)
        if len(piece) < head + foot or piece[:head] != a[:head] or piece[len(piece) - foot :] != a[len(a) - foot :]:
            return None
        return head, len(piece) - foot

    def add(self, turn: Turn) -> Span:
        before = self.turns[-CONTEXT:] if self.windowed else self.turns
        shorter = self.template(before) if self.output is None else self.output
        piece, rewrites, longer = self.added(shorter, before, turn)
        place = self.text_place(shorter, before, turn, piece)
        if not self.windowed and self.n >= CONTEXT and self.local:
            near = self.turns[-CONTEXT:]
            self.local = not rewrites and self.added(self.template(near), near, turn)[0] == piece
        span = Span(self.at, piece, *(place or (0, 0)), rewrites or place is None)
        self.turns.append(turn)
        self.n += 1
        self.at += len(piece)
        if self.n >= WINDOW and self.local:
            self.windowed = True
        self.output = None if self.windowed else longer
        if self.windowed:
            del self.turns[:-CONTEXT]
        return span


_PIECES = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("span_start", pa.int64()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_()), ("rewrites", pa.bool_())])
PIECES_DDL = "conv_id long, position long, role string, piece string, span_start long, text_start int, text_end int, loss boolean, rewrites boolean"


def format_turns(df: DataFrame, *, template: Callable[[list[Turn]], str] = plain_template, loss_roles: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn, in order within each conversation: what it adds to the output, where, where its text stands in that, and whether the text is under the loss mask."""
    rows = df.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, renderer = object(), None
        for batch in batches:
            out = {name: [] for name in _PIECES.names}
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if renderer is None or conv != current:
                    current, renderer = conv, Renderer(template)
                s = renderer.add((role, text))
                values = (conv, renderer.n - 1, role, s.piece, s.start, s.text_start, s.text_end, role in loss_roles and not s.rewrites, s.rewrites)
                for name, v in zip(_PIECES.names, values, strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    return rows.mapInArrow(run, PIECES_DDL)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])
DIGESTS_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def read_back(pieces: DataFrame, *, role_of: Callable[[str], str] = plain_role, unescape: Callable[[str], str] = unescape) -> DataFrame:
    """A row per conversation, from what ``format_turns`` gave, as it is partitioned and sorted: digests of roles and texts as the formatted text has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns, loss = None, None, None
        n = loss_chars = chars = 0
        rewrites = False
        done: list[tuple] = []

        def close() -> None:
            if turns is not None:
                done.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * len(_DIGESTS.names)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _DIGESTS, strict=True)], schema=_DIGESTS)

        for batch in batches:
            for r in batch.select(["conv_id", "position", "piece", "text_start", "text_end", "loss", "rewrites"]).to_pylist():
                if r["position"] == 0:
                    close()
                    current, turns, loss = r["conv_id"], hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = 0
                    rewrites = False
                piece = r["piece"]
                text = unescape(piece[r["text_start"] : r["text_end"]])
                turns.update(f"{role_of(piece[: r['text_start']])}\n{text}\n".encode())
                if r["loss"]:
                    loss.update(text.encode())
                    loss_chars += len(text)
                n += 1
                chars += len(piece)
                rewrites |= r["rewrites"]
            if done:
                yield batch_of()
                done.clear()
        close()
        yield batch_of()

    return pieces.mapInArrow(run, DIGESTS_DDL)


def rewrites_history(template: Callable[[list[Turn]], str], turns: list[Turn]) -> bool:
    """Whether the template changes what it has put out for earlier turns, on this conversation."""
    r = Renderer(template)
    return any([r.add(t).rewrites for t in turns])
