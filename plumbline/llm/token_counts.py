"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of at most ``window`` characters is cut at all its stable boundaries (below), and the count of each piece is the
library's, remembered by the worker as pieces repeat (the table is emptied when full). A longer one is encoded in chunks that overlap; the counts
of two neighbours are spliced at a boundary that

* both encodings have (a token starts there in each), and
* is proven stable: the character before is no white space and the one there is. Byte-level pre-tokenisation has no
  match that goes from other characters on into white space, and it never looks behind, so a piece ends and another
  begins there whatever stands further left or right. What comes after the boundary is encoded alike in any chunk that
  holds it, and so is what comes before.

Both hold for the vocabularies in ``PROVEN``; with any other, texts are encoded whole.

If no such boundary lies in the overlap, the overlap is widened (doubled); once it is as wide as the chunk, the chunk
is doubled too, up to the rest of the text. So counts are those of the library on the whole text.

Nulls count as the empty text: 0 bytes, 0 tokens. Other columns pass through as they are, repeated rows stay repeated,
and an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, OVERLAP = 65_536, 1_024
#: Pieces whose counts a worker remembers at most, and their characters; the table is emptied when full, which changes speed only.
REMEMBERED, HELD = 500_000, 32 << 20
#: Public vocabularies whose pre-tokenisation was shown to have the stable boundaries that pieces and splices rest on.
PROVEN = ("byte_bpe_50k.json", "word_bpe_49k.json")
_PIECES, _ODD = re.compile(r"\s*\S+|\s+"), re.compile("[\x1c-\x1f]")


class Counts(dict):
    def __init__(self, encode: Callable[[str], list]):
        self.encode, self.size = encode, 0

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED or self.size >= HELD:
            self.size = 0
            self.clear()
        n = self[piece] = len(self.encode(piece))
        self.size += len(piece)
        return n


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer; a bare file name is looked up among the public vocabularies. Loaded once a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if os.sep not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def stable(text: str, p: int) -> bool:
    """Whether a piece starts at ``p`` in any context."""
    return 0 < p < len(text) and text[p].isspace() and not text[p - 1].isspace() and text[p] not in "\x1c\x1d\x1e\x1f" and text[p - 1] not in "\x1c\x1d\x1e\x1f"


def spliced_count(text: str, starts: Callable[[str], list[int]], window: int = WINDOW, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``. starts: gives the offset of each token of a piece of text."""
    total, at, begin = 0, 0, 0  # of the current chunk: where it starts, and from where its tokens count
    size, width = window, overlap
    left = starts(text[:size])
    while at + size < len(text):
        end = at + size
        low = max(end - width, begin + 1)
        right = starts(text[low : low + size])
        common = {s + at for s in left if s + at >= low}.intersection(s + low for s in right)
        p = max((x for x in common if low < x < end - (width >> 2) and stable(text, x)), default=None)
        if p is None:
            if low > begin + 1:
                width *= 2
            else:  # the whole chunk overlaps already
                size *= 2
                left = starts(text[at : at + size])
            continue
        total += sum(begin <= s + at < p for s in left)
        left, at, begin, size, width = right, low, p, max(window, size), overlap
        if size > window and at + window < len(text):
            size = window
            left = starts(text[at : at + size])
            if begin >= at + size:
                size *= 2
                left = starts(text[at : at + size])
    return total + sum(s + at >= begin for s in left)


@lru_cache(maxsize=4)
def counts(path: str) -> Counts:
    t = tokenizer(path)
    return Counts(lambda piece: t.encode(piece, add_special_tokens=False))


def count(text: str | None, path: str, window: int = WINDOW, overlap: int = OVERLAP) -> int:
    if not text:
        return 0
    t = tokenizer(path)
    if path not in PROVEN:  # another vocabulary may join tokens anywhere: the whole text
        return len(t.encode(text) if path.endswith(".model") else t.encode(text, add_special_tokens=False))
    if len(text) > window:
        return spliced_count(text, lambda s: [o[0] for o in t.encode(s, add_special_tokens=False).offsets], window, overlap)
    if _ODD.search(text):  # Python takes these for white space, the library does not
        return len(t.encode(text, add_special_tokens=False))
    return sum(map(counts(path).__getitem__, _PIECES.findall(text)))


def token_counts(df: DataFrame, text_col: str = "text", *, path: str = "byte_bpe_50k.json", limit: int = 1024, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` in place of any columns of these names."""

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([count(t.as_py(), path, window, overlap) for t in x], type=pa.int64())

    n = tokens(F.col(text_col))
    out = df.withColumn("n_bytes", F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long"))).withColumn("n_tokens", n)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
