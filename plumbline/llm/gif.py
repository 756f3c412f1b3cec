"""Media columns as GIF: texts stored losslessly as 8-bit samples, and a decoder of animated GIF into timed frames.

``to_gif`` stores a text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as grey samples 64 wide; frame
follows frame after 1,024 rows, each a full LZW code stream. ``with_frames`` decodes any GIF: LZW code streams with
variable widths and deferred clear codes, global and local palettes, interlacing, transparency and the four disposal
methods. Per frame it gives place, delay, disposal, the samples that the canvas shows in the frame's rectangle, and a
histogram of 64 colours (2 bits a channel) and of 16 grey levels.

A null text counts as empty (64 zero bytes). A null or broken medium gives null frames and an ``error``. Repeated rows
stay repeated, other columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, ROWS, DELAY_CS = 64, 1024, 10
_FULL = 4096  # codes have 12 bits at most
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


@lru_cache(maxsize=16)
def _code_places(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For the codes after a clear code: where each starts, in bits, and its width."""
    base = (1 << bits) + 2
    widths = np.array([min(12, max(bits + 1, (base + max(0, i - 1)).bit_length())) for i in range(_FULL + 2)], dtype=np.int64)
    return np.concatenate(([0], np.cumsum(widths)[:-1])), widths


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of samples below ``2**bits``; the table is cleared when it is full."""
    clear, first = 1 << bits, (1 << bits) + 2
    _, widths = _code_places(bits)
    codes, lengths = [clear << 8], []  # codes are kept shifted, ready to take the next sample
    table: dict[int, int] = {}
    find, put, n = table.get, codes.append, first << 8
    it = iter(data)
    current = next(it, -1) << 8
    for b in it:
        found = find(current | b)
        if found is not None:
            current = found
            continue
        put(current)
        table[current | b] = n
        n += 256
        current = b << 8
        if n == _FULL << 8:
            put(clear << 8)
            lengths.append(_FULL - first + 1)
            table.clear()
            n = first << 8
    if current >= 0:
        put(current)
    put(clear + 1 << 8)
    c = np.array(codes, dtype=np.uint32) >> np.uint32(8)
    w = np.concatenate([widths[:1], *(widths[:k] for k in lengths), widths[: len(codes) - 1 - sum(lengths)]])
    at = np.arange(12, dtype=np.uint16)
    each_bit = ((c.astype(np.uint16)[:, None] >> at) & np.uint16(1)).astype(np.uint8)
    return np.packbits(each_bit[at < w[:, None]], bitorder="little").tobytes()


def _expand(run: np.ndarray, first: int) -> np.ndarray:
    """Samples of the codes between two clear codes.

    The entry that code ``k`` adds is what code ``k`` stands for and the sample after it, so a later code that names it
    copies from where ``k`` was written. Lengths and sources are chains through earlier codes; each is followed to its
    root by doubling steps.
    """
    m = len(run)
    of = run.astype(np.int64) - first
    copied = of >= 0
    if (of >= np.arange(m)).any() or ((run >= first - 2) & ~copied).any():
        raise ValueError("a code has no entry")
    up = parent = np.where(copied, of, np.arange(m))
    longer = copied.astype(np.int64)
    while (step := longer[up]).any():
        longer += step
        up = up[up]
    lengths = longer + 1
    starts = np.cumsum(lengths) - lengths
    source = np.arange(int(starts[-1] + lengths[-1]))
    source += np.repeat(starts[parent] - starts, lengths)
    while not np.array_equal(further := source[source], source):
        source = further
    return np.repeat(run, lengths)[source].astype(np.uint8)


def lzw_decode(stream: bytes, bits: int, n_samples: int) -> bytes:
    """Samples of a code stream. Ends at the end code, at ``n_samples``, or with the stream."""
    clear, end, first = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    starts, widths = _code_places(bits)
    ends = starts + widths
    b = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    words = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    n_bits = len(stream) * 8
    masks = ((1 << widths) - 1).astype(np.uint32)
    out: list[np.ndarray] = []
    have, at, ended = 0, 0, False
    while have < n_samples and not ended and at + bits + 1 <= n_bits:
        run: list[np.ndarray] = []
        places, closes, mask = starts, ends, masks
        while True:  # a table's codes; after those, where the clear code is deferred, codes of 12 bits
            k = int(np.searchsorted(closes, n_bits - at, side="right"))
            off = at + places[:k]
            codes = (words[off >> 3] >> (off & 7).astype(np.uint32)) & mask[:k]
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops):
                k = int(stops[0])
                at += int(closes[k])
                ended = codes[k] == end
                run.append(codes[:k])
                break
            run.append(codes)
            if k < len(places):
                ended = True
                break
            at += int(closes[-1])
            places, mask = np.arange(len(starts)) * 12, np.full(len(starts), _FULL - 1, dtype=np.uint32)
            closes = places + 12
        codes = np.concatenate(run)
        if len(codes):
            out.append(_expand(codes, first))
            have += len(out[-1])
    got = np.concatenate(out).tobytes() if out else b""
    if len(got) < n_samples:
        raise ValueError(f"a code stream has {len(got)} of {n_samples} samples")
    return got[:n_samples]


def encode_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """An animation whose frames hold the samples in order; every colour of its palette is the grey of its index."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREY.tobytes()]
    if len(samples) > width * rows:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for i in range(0, len(samples), width * rows):
        part = samples[i : i + width * rows]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8))
        stream = lzw_encode(part)
        out += [x for k in range(0, len(stream), 255) for x in (bytes([len(stream[k : k + 255])]), stream[k : k + 255])]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    canvas: np.ndarray  # rows, columns, RGBA: what shows while the frame does

    def samples(self) -> bytes:
        """The red channel of the frame's rectangle."""
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width, 0].tobytes()

    def histograms(self) -> tuple[np.ndarray, np.ndarray]:
        seen = self.canvas[self.top : self.top + self.height, self.left : self.left + self.width].reshape(-1, 4)
        if not (full := seen[:, 3] > 0).all():
            seen = seen[full]
        r, g, b = (seen[:, k].astype(np.uint32) for k in range(3))
        colour = np.bincount((r >> 6) << 4 | (g >> 6) << 2 | b >> 6, minlength=64)
        return colour, np.bincount((r * 299 + g * 587 + b * 114) // 16000, minlength=16)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _interlaced_rows(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> list[Frame]:
    """All frames, each with the canvas after it was drawn."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay, disposal, clear_index = 0, 0, -1
    out: list[Frame] = []
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                f, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = f >> 2 & 7, index if f & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if f & 0x80:
            n = 2 << (f & 7)
            colours = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
            at += 3 * n
        if colours is None:
            raise ValueError("a frame has no palette")
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        index = np.frombuffer(lzw_decode(stream, bits, w * h), dtype=np.uint8).reshape(h, w)
        if f & 0x40:
            rows = np.empty_like(index)
            rows[_interlaced_rows(h)] = index
            index = rows
        if index.size and int(index.max()) >= len(colours):
            raise ValueError("a sample has no colour")
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        index = index[: area.shape[0], : area.shape[1]]
        if clear_index < 0:
            area[..., :3] = colours[index]
            area[..., 3] = 255
        else:
            drawn = index != clear_index
            area[drawn, :3] = colours[index[drawn]]
            area[drawn, 3] = 255
        out.append(Frame(left, top, w, h, delay * 10, disposal, canvas.copy()))
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, -1
    return out


def padded(text: str | None, width: int = WIDTH) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (-len(raw) % width or (0 if raw else width))


def to_gif(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``df`` with each text's GIF."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([encode_gif(padded(t.as_py())) for t in x], type=pa.binary())

    return df.withColumn(media_col, run(F.col(text_col)))


_FRAME = pa.struct(
    [("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("samples", pa.binary()), ("colours", pa.list_(pa.int64())), ("greys", pa.list_(pa.int64()))]
)
_FRAMES = pa.struct([("frames", pa.list_(_FRAME)), ("error", pa.string())])
FRAMES_DDL = "struct<frames: array<struct<left: int, top: int, width: int, height: int, delay_ms: int, disposal: int, samples: binary, colours: array<bigint>, greys: array<bigint>>>, error: string>"


def frame_rows(data: bytes | None) -> dict:
    if data is None:
        return {"frames": None, "error": None}
    try:
        rows = []
        for f in decode_gif(data):
            colours, greys = f.histograms()
            rows.append({"left": f.left, "top": f.top, "width": f.width, "height": f.height, "delay_ms": f.delay_ms, "disposal": f.disposal, "samples": f.samples(), "colours": colours.tolist(), "greys": greys.tolist()})
        return {"frames": rows, "error": None}
    except (ValueError, IndexError, struct.error) as e:
        return {"frames": None, "error": str(e) or type(e).__name__}


def with_frames(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with ``frames`` and ``error`` of each medium, in place of any columns of these names."""

    @F.arrow_udf(FRAMES_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([frame_rows(m.as_py()) for m in x], type=_FRAMES)

    out = df.withColumn("__decoded", run(F.col(media_col)))
    return out.withColumn("frames", F.col("__decoded.frames")).withColumn("error", F.col("__decoded.error")).drop("__decoded")
