"""Byte-pair encoding and decoding of whole texts.

A word becomes a doubly linked list of symbols. Candidate merges wait in a priority queue ordered by merge rank, then
position; a popped entry whose symbols have changed meanwhile is stale and is skipped. Decoding joins the vocabulary's
strings. Words repeat a lot, so each worker keeps the ids of words it has met lately.

Text is prepared as the vocabulary's own file says: added tokens are cut out of the raw text first, then NFC, white
space to single spaces, lower case by character, and pieces by the split pattern.

Null texts count as empty (no ids, empty decoded text). Other columns pass through, repeated rows stay repeated, and an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Words whose ids a worker remembers in each of its two tables, and characters and bytes that these may hold; what is forgotten changes speed only.
REMEMBERED, HELD = 400_000, 32 << 20
#: Texts whose ids are held at a time, and go back to Spark as one batch.
STEP = 128

# The byte-level alphabet gives printable bytes themselves and the others code points from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[int, str]:
    others = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(others)}


class Words(dict):
    """Run of characters without white space -> ids as 32-bit numbers in bytes, filled by encoding what is missing.

    When full, the table becomes the older one, from which what is met again comes back; the older one before it goes.
    """

    def __init__(self, encode):
        self.encode, self.older, self.size = encode, {}, 0

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED or self.size >= HELD:
            self.older, self.size = self.copy(), 0
            self.clear()
        found = self.older.pop(word, None)
        if found is None:
            found = array("i", self.encode(word)).tobytes()
        self[word] = found
        self.size += len(word) + len(found)
        return found


class Bpe:
    """A vocabulary with its merges, from a ``tokenizers`` file of byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            if a in self.vocab and b in self.vocab and a + b in self.vocab:
                self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [""] * (1 + max(chain(self.vocab.values(), self.added.values())))
        for s, i in chain(self.vocab.items(), self.added.items()):
            self.strings[i] = s
        self.table = pa.array(self.strings, type=pa.string())
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(split.replace("\\s", "\\p{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}+")
        self.odd = regex.compile("[\x1c-\x1f]")  # str.split() takes these for white space
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = Words(self.run_ids)

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Merges of one word, lowest rank first and leftmost first among equals."""
        symbols = [self.alphabet[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive, ranks = [True] * n, self.ranks
        queue = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        queue = [(rank, i, new, a, b) for rank, new, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue  # stale: one of the two has been merged since
            ids[i], alive[j] = new, False
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if r := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (r[0], i, r[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((ids[h], new))):
                heapq.heappush(queue, (r[0], h, r[1], ids[h], new))
        return tuple(x for x, y in zip(ids, alive, strict=True) if y)

    def run_ids(self, run: str) -> tuple[int, ...]:
        """Of characters without white space among them: normal form, lower case, pieces, merges."""
        if run.isascii():
            return tuple(chain.from_iterable(map(self.word_ids, self.pieces.findall(run.lower()))))
        run = unicodedata.normalize("NFC", run).replace("\u03a3", "\u03c3").lower()
        # code points without a category as yet are neither letters nor digits
        shape = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in run)
        return tuple(chain.from_iterable(self.word_ids(run[slice(*m.span())]) for m in self.pieces.finditer(shape)))

    def plain_ids(self, text: str) -> bytes:
        """No piece goes across white space, and normalising does not either, so runs are taken one by one."""
        runs = self.space.split(text) if self.odd.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, filter(None, runs)))

    def ids_in_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or not any(x in text for x in self.added):
            return self.plain_ids(text)
        return b"".join(np.int32(self.added[x]).tobytes() if x in self.added else self.plain_ids(x) for x in self.cut.split(text))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.ids_in_bytes(text), dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """A bare file name is looked up among the public vocabularies. Loaded once a worker."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Bpe(path)


def encode_array(texts: pa.Array, bpe: Bpe) -> tuple[pa.Array, pa.Array]:
    """Ids and decoded texts of some texts; decoding looks the ids up and joins their strings."""
    part = [bpe.ids_in_bytes(x.as_py()) for x in texts]
    at = pa.array(np.cumsum([0, *(len(x) >> 2 for x in part)]), type=pa.int32())
    ids = pa.array(np.frombuffer(b"".join(part), dtype=np.int32))
    return pa.ListArray.from_arrays(at, ids), pc.binary_join(pa.ListArray.from_arrays(at, bpe.table.take(ids)), " ")


def encode(df: DataFrame, text_col: str = "text", *, path: str = "word_bpe_49k.json", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the ids of each text and what they decode to, in place of any columns of these names."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()  # what other stages left in this worker
        bpe = load(path)
        for x in batches:
            for k in range(0, len(x), STEP):
                yield pa.StructArray.from_arrays([*encode_array(x.slice(k, STEP), bpe)], names=["ids", "decoded"])
        give_back()

    both = f"__{ids_col}_{decoded_col}"
    out = df.withColumn(both, run(F.col(text_col)))
    return out.withColumn(ids_col, F.col(f"{both}.ids")).withColumn(decoded_col, F.col(f"{both}.decoded")).drop(both)


def decode(df: DataFrame, ids_col: str = "ids", *, path: str = "word_bpe_49k.json", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids; null ids give an empty text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for x in batches:
            yield pa.array([bpe.decode(r.as_py() or ()) for r in x], type=pa.string())

    return df.withColumn(decoded_col, run(F.col(ids_col)))
