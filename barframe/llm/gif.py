"""Operator 7, media columns: GIF.

write_gif() stores samples as an animated GIF: 8-bit indices into a grey palette, cut
into timed frames, LZW-coded. read_gif() is a general reader: it decodes LZW code
streams, global and local palettes, interlacing, transparency and disposal, and gives
timed frames with the whole canvas of each. frames() stores these as columns with a
colour histogram per frame (4 levels of red, green and blue each, 64 bins).

The query stores each text's bytes as such a file, reads it back and takes digests.

Null text: empty, stored as 64 zero bytes. Equal texts give equal values, also in
repeated rows. An empty table gives an empty result. A long text becomes many frames and
is handled alone; a task holds one file and one canvas at a time. Columns besides doc_id
and text are left out. Ill-formed files: read_gif() raises ValueError, frames() gives a
row with no frames and the error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import arrow_map, documents, pick, utf8

WIDTH, HEIGHT = 64, 1024
DELAY = 10
#: Parts of a GIF file (fixed by the format).
SIGNATURE, EXTENSION, IMAGE, TRAILER = b"GIF89a", 0x21, 0x2C, 0x3B
CONTROL_LABEL, MOST_CODES = 0xF9, 4096
_GREY = bytes(v for k in range(256) for v in (k, k, k))


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream, codes packed from the low bit on, between a clear code and an end code."""
    clear = 1 << bits
    codes, sizes = [clear], []
    table: dict[int, int] = {}
    find, fresh, since = table.get, clear + 2, len(codes)
    prefix = data[0] if data else -1
    for b in memoryview(data)[1:]:
        key = prefix << 8 | b
        if (code := find(key)) is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = b
        if fresh < MOST_CODES:
            table[key] = fresh
            fresh += 1
        else:
            codes.append(clear)
            sizes.append(len(codes) - since)
            since = len(codes)
            table = {}
            find = table.get
            fresh = clear + 2
    if prefix >= 0:
        codes.append(prefix)
    codes.append(clear + 1)
    sizes.append(len(codes) - since)
    ramp = _ramp(bits)[0]
    widths = np.concatenate([[bits + 1], *(ramp[:n] for n in sizes)])
    ends = np.cumsum(widths)
    starts = ends - widths
    # a code lies in three bytes at most; no two codes share a bit, so adding is joining
    shifted = np.asarray(codes, np.int64) << (starts & 7)
    out = sum(np.bincount((starts >> 3) + k, shifted >> 8 * k & 255, (int(ends[-1]) >> 3) + 4) for k in range(3))
    return out[: int(ends[-1]) + 7 >> 3].astype(np.uint8).tobytes()


@cache
def _ramp(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code, and the places where each begins.

    Before code k of a run, a reader's table ends at clear + 2 + k - 1.
    """
    ends = (1 << bits) + 2 + np.maximum(np.arange(2 * MOST_CODES) - 1, 0)
    widths = np.minimum(np.floor(np.log2(ends)).astype(np.int64) + 1, 12)
    return widths, np.concatenate([[0], np.cumsum(widths)])


def _codes(stream: np.ndarray, offsets: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """The codes of these widths that begin at these bits."""
    first = offsets >> 3
    window = stream[first] | stream[first + 1] << 8 | stream[first + 2] << 16
    return (window >> (offsets & 7)) & ((1 << widths) - 1)


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """The first size samples of a code stream. A full table stays until a clear code comes, however late."""
    clear, stop = 1 << bits, (1 << bits) + 1
    stream = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    total = 8 * len(data)
    ramp, places = _ramp(bits)
    out: list[np.ndarray] = []
    made, at = 0, 0
    table = None  # of the run that is open; full once the first codes of a run, all in one window, are read
    while at < total and made < size:
        if table is None:
            n = int(np.searchsorted(places, total - at, "right")) - 1
            codes = _codes(stream, places[:n] + at, ramp[:n])
        else:
            n = min((total - at) // 12, len(ramp))
            codes = _codes(stream, at + 12 * np.arange(n), 12)
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        run = codes[: ends[0]] if len(ends) else codes
        read = len(run) + bool(len(ends))
        at += int(places[read]) if table is None else 12 * read
        if table is None:
            samples, table = _expanded(run, clear)
        else:
            samples = _looked_up(run, clear, *table)
        out.append(samples)
        made += len(samples)
        if not n or len(ends) and codes[ends[0]] == stop:
            break
        if len(ends):
            table = None
    if made < size:
        raise ValueError("LZW stream ends early")
    return b"".join(x.tobytes() for x in out)[:size]


def _expanded(codes: np.ndarray, clear: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The samples of a run of codes without clear and end; and with these, where each code's begin and how many there are.

    The table's entry k is what code k gave and the sample after that, so code
    clear + 2 + k repeats the output from where code k began, one sample longer.
    Lengths, then the literal that each sample comes from, follow by pointer doubling.
    """
    n = len(codes)
    back = codes - (clear + 2)
    if (back >= np.arange(n)).any():
        raise ValueError("LZW code out of range")
    repeats = back >= 0
    to = np.where(repeats, back, n)
    lengths = np.append(repeats.astype(np.int64), 0)
    to = np.append(to, n)
    while (to < n).any():
        lengths = lengths + lengths[to]
        to = to[to]
    lengths = lengths[:n] + 1
    starts = np.cumsum(lengths) - lengths
    shift = np.where(repeats, starts[np.maximum(back, 0)] - starts, 0)
    source = np.arange(int(lengths.sum())) + np.repeat(shift, lengths)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    literal = np.zeros(len(source), np.uint8)
    literal[starts[~repeats]] = codes[~repeats]
    return (samples := literal[source]), (samples, starts, lengths)


def _looked_up(codes: np.ndarray, clear: int, samples: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The samples of codes of a full table."""
    entries = MOST_CODES - (clear + 2)
    whole = np.concatenate([np.arange(clear, dtype=np.uint8), samples])
    begin = np.concatenate([np.arange(clear + 2), clear + starts[:entries]])
    size = np.concatenate([np.ones(clear + 2, np.int64), lengths[:entries] + 1])[codes]
    return whole[np.arange(int(size.sum())) + np.repeat(begin[codes] - (np.cumsum(size) - size), size)]


def write_gif(samples: bytes, width: int = WIDTH, height: int = HEIGHT, delay: int = DELAY) -> bytes:
    """Samples, a multiple of width, as frames of height rows; the last may be lower."""
    rows = len(samples) // width
    tall = min(rows, height)
    parts = [SIGNATURE, struct.pack("<HHBBB", width, tall, 0xF7, 0, 0), _GREY]
    for top in range(0, rows, height):
        n = min(height, rows - top)
        parts.append(bytes([EXTENSION, CONTROL_LABEL, 4, 1 << 2]) + struct.pack("<HBB", delay, 0, 0))
        parts.append(bytes([IMAGE]) + struct.pack("<HHHHB", 0, 0, width, n, 0) + b"\x08")
        stream = lzw_encode(samples[top * width : (top + n) * width])
        parts += [bytes([len(x := stream[k : k + 255])]) + x for k in range(0, len(stream), 255)]
        parts.append(b"\0")
    return b"".join([*parts, bytes([TRAILER])])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    indices: bytes
    canvas: np.ndarray


def read_gif(data: bytes) -> Iterator[Frame]:
    """The frames in turn; canvas is height x width x (red, green, blue, alpha) as shown."""
    if data[:6] not in (b"GIF87a", SIGNATURE):
        raise ValueError("not a GIF file")
    try:
        yield from _frames(data)
    except (struct.error, IndexError) as e:
        raise ValueError("GIF file ends early") from e


def _frames(data: bytes) -> Iterator[Frame]:
    wide, tall, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3) if len(data) >= at + 3 * n else None
        if colours is None:
            raise ValueError("GIF file ends early")
        at += 3 * n
        return colours

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    common = palette(flags) if flags & 0x80 else None
    canvas = np.zeros((tall, wide, 4), np.uint8)
    disposal = delay = 0
    clear = None
    while data[at] != TRAILER:
        kind = data[at]
        at += 1
        if kind == EXTENSION:
            label = data[at]
            at += 1
            body = blocks()
            if label == CONTROL_LABEL:
                disposal, clear = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
                delay = struct.unpack_from("<H", body, 1)[0]
        elif kind == IMAGE:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = palette(flags) if flags & 0x80 else common
            if colours is None:
                raise ValueError("a frame has no palette")
            bits = data[at]
            at += 1
            if not 2 <= bits <= 8:
                raise ValueError("bad LZW code size")
            raw = lzw_decode(blocks(), bits, w * h)
            picture = np.frombuffer(raw, np.uint8).reshape(h, w)
            if flags & 0x40:
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                straight = np.empty_like(picture)
                straight[order] = picture
                picture, raw = straight, straight.tobytes()
            if len(picture) and int(picture.max(initial=0)) >= len(colours):
                raise ValueError("index beyond the palette")
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            seen = picture[: area.shape[0], : area.shape[1]]
            paint = np.concatenate([colours[seen], np.full((*seen.shape, 1), 255, np.uint8)], axis=2)
            if clear is None:
                area[...] = paint
            else:
                area[seen != clear] = paint[seen != clear]
            yield Frame(left, top, w, h, delay, disposal, raw, canvas.copy())
            if disposal == 2:
                area[...] = 0
            elif disposal == 3:
                canvas = before
            disposal = delay = 0
            clear = None
        else:
            raise ValueError("unknown block")


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colours, 4 levels of red, green and blue; clear pixels don't count."""
    levels = canvas >> 6
    colour = levels[..., 0] << 4 | levels[..., 1] << 2 | levels[..., 2]
    return np.bincount(colour[canvas[..., 3] > 0], minlength=64)


def frames(media: DataFrame) -> DataFrame:
    """(doc_id, media) to (doc_id, frame, delay_cs, disposal, width, height, rgba, histogram, error): a row a frame."""
    slim = pick(media, "doc_id", "media")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "frame", "delay_cs", "disposal", "width", "height", "rgba", "histogram", "error"]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string())
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                row = lambda *x, key=batch.column(0).slice(i, 1): pa.RecordBatch.from_arrays([key, *(pa.array([v], t) for v, t in zip(x, types, strict=True))], names=names)
                try:
                    for k, f in enumerate(read_gif(data or b"")):
                        yield row(k, f.delay, f.disposal, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), histogram(f.canvas).tolist(), None)
                except ValueError as e:
                    yield row(None, None, None, None, None, None, None, str(e))

    return arrow_map(slim, work, f"doc_id {dict(slim.dtypes)['doc_id']}, frame int, delay_cs int, disposal int, width int, height int, rgba binary, histogram array<long>, error string")


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's bytes, filled with zero bytes to a positive multiple of 64, as a GIF file."""
    slim = pick(docs, "doc_id", "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(utf8(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([write_gif(padded(data))], pa.binary())], names=["doc_id", "media"])

    return arrow_map(slim, work, f"doc_id {dict(slim.dtypes)['doc_id']}, media binary")


def padded(data: bytes) -> bytes:
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def measured(data: bytes) -> tuple:
    """What the query returns of one text: stored, read back, and then measured."""
    media = write_gif(padded(data))
    whole, tail, n, colours, shown = hashlib.sha256(), b"", 0, np.zeros(64, np.int64), []
    for f in read_gif(media):
        whole.update(f.indices)
        n += len(f.indices)
        tail = (tail + f.indices)[-64:]
        colours += histogram(f.canvas)
        shown.append(f.delay)
    feature = f"frames={len(shown)};cs={sum(shown)};colours=" + ",".join(f"{k}:{v}" for k, v in enumerate(colours.tolist()) if v)
    return len(data), n, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(docs: DataFrame) -> DataFrame:
    slim = pick(docs, "doc_id", "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            cols = list(zip(*map(measured, utf8(batch.column(1))), strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return arrow_map(slim, work, f"doc_id {dict(slim.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
