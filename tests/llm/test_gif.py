import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from barframe.llm.gif import digests, frames, lzw_decode, lzw_encode, op7_media_columns, padded, read_gif, store, write_gif


def test_lzw_round_trip():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 64, 255, 4000, 70000):
        for data in (bytes(n), r.randbytes(n), bytes(r.choice(b"ab ") for _ in range(n))):
            assert lzw_decode(lzw_encode(data), 8, n) == data


def test_lzw_by_hand():
    """Codes of 3 bits: clear 4, then 0, 0 0 (code 6, not yet known), end 5."""
    bits = [(4, 3), (0, 3), (6, 3), (5, 3)]
    value = shift = 0
    for v, n in bits:
        value |= v << shift
        shift += n
    assert lzw_decode(value.to_bytes(2, "little"), 2, 3) == b"\0\0\0"
    with pytest.raises(ValueError):
        lzw_decode(value.to_bytes(2, "little"), 2, 4)


def plain_encode(data, bits=8, defer=False):
    """Code by code, bit by bit. With a full table: a clear code, or, if defer, none ever."""
    clear = 1 << bits
    out, width, table, prefix = [], bits + 1, {bytes([k]): k for k in range(clear)}, b""
    put = lambda c: out.extend(c >> k & 1 for k in range(width))
    put(clear)
    fresh = clear + 2
    for b in data:
        if prefix + bytes([b]) in table:
            prefix += bytes([b])
            continue
        put(table[prefix])
        if fresh < 4096:
            table[prefix + bytes([b])] = fresh
            # the reader knows an entry one code later
            width = max(width, min(12, fresh.bit_length()))
            fresh += 1
        elif not defer:
            put(clear)
            fresh, width, table = clear + 2, bits + 1, {bytes([k]): k for k in range(clear)}
        prefix = bytes([b])
    if prefix:
        put(table[prefix])
        width = max(width, min(12, fresh.bit_length())) if fresh < 4096 else width
    put(clear + 1)
    return bytes(sum(x << k for k, x in enumerate(out[i : i + 8])) for i in range(0, len(out), 8))


def test_lzw_full_table():
    """A writer that never clears: the full table stays, for any length."""
    r = random.Random(4)
    for n in (3000, 6000, 8000, 9000, 20_000, 60_000, 300_000):
        for data in (r.randbytes(n), bytes(r.choice(b"abcd ") for _ in range(n))):
            assert lzw_decode(plain_encode(data, defer=True), 8, n) == data
            small = bytes(x & 3 for x in data)
            assert lzw_decode(plain_encode(small, 2, defer=True), 2, n) == small
    # a clear code long after the table is full
    data = r.randbytes(30_000)
    bits = lambda x: "".join(format(b, "08b")[::-1] for b in x)
    long, short = bits(plain_encode(data, defer=True)), bits(plain_encode(b"after", defer=True))
    stop = long.rindex(format(257, "012b")[::-1])
    both = long[:stop] + format(256, "012b")[::-1] + short[9:]
    stream = bytes(int(both[k : k + 8][::-1], 2) for k in range(0, len(both), 8))
    assert lzw_decode(stream, 8, 30_005) == data + b"after"


def plain_gif(data):
    """The file of grey frames of 64 x 1024 samples, put together plainly, and what the query says of it."""
    out = b"GIF89a" + struct.pack("<HHBBB", 64, min(len(data) // 64, 1024), 0xF7, 0, 0) + bytes(k for v in range(256) for k in (v, v, v))
    n = 0
    for k in range(0, len(data), 65536):
        part = data[k : k + 65536]
        out += b"\x21\xf9\4\4" + struct.pack("<HBB", 10, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 64, len(part) // 64, 0) + b"\x08"
        stream = plain_encode(part)
        for j in range(0, len(stream), 255):
            out += bytes([len(stream[j : j + 255])]) + stream[j : j + 255]
        out += b"\0"
        n += 1
    # a frame shows its own samples; below a lower last frame the one before stays
    shown = {}
    for k in range(0, len(data), 65536):
        part = data[k : k + 65536]
        whole = part + (data[k - 65536 + len(part) : k] if k else b"")
        for b in whole:
            c = (b >> 6) * 21
            shown[c] = shown.get(c, 0) + 1
    return out + b";", f"frames={n};cs={10 * n};colours=" + ",".join(f"{k}:{shown[k]}" for k in sorted(shown))


def test_gif_round_trip():
    r = random.Random(2)
    for n in (1, 64, 65, 64 * 1024, 64 * 1024 + 1, 200_000):
        data = padded(r.randbytes(n // 2) + b"words " * (n // 12))
        got = list(read_gif(write_gif(data)))
        assert b"".join(f.indices for f in got) == data and all(f.delay == 10 for f in got)
        grey = got[0].canvas
        assert (grey[..., 0] == grey[..., 2]).all() and grey[..., 0].tobytes() == got[0].indices


def _image(left, top, w, h, pixels, flags=0, local=b""):
    s = lzw_encode(bytes(pixels), 2)
    return bytes([0x2C]) + struct.pack("<HHHHB", left, top, w, h, flags) + local + b"\x02" + bytes([len(s)]) + s + b"\0"


def _control(disposal, delay, clear=None):
    return bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None)]) + struct.pack("<HBB", delay, clear or 0, 0)


def test_disposal_transparency_interlace_palettes():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    local = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 4, 0x81, 0, 0) + palette
    data += _control(1, 5) + _image(0, 0, 2, 4, [1] * 8)
    data += bytes([0x21, 0xFE, 2]) + b"hi\0"
    data += _control(3, 6, 0) + _image(0, 0, 2, 2, [0, 2, 2, 0])
    data += _control(2, 7) + _image(1, 2, 1, 1, [3], 0x81, local)
    data += _control(0, 0) + _image(0, 0, 1, 4, [0, 1, 2, 3], 0x40)
    a, b, c, d = read_gif(data + b";")
    red, green, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 0, 0]
    assert (a.canvas == red).all() and (a.delay, a.disposal) == (5, 1)
    assert b.canvas[0].tolist() == [red, green] and b.canvas[1].tolist() == [green, red]
    assert c.canvas[0].tolist() == [red, red] and c.canvas[2, 1].tolist() == [6, 6, 6, 255]
    assert d.canvas[2, 1].tolist() == none
    assert d.indices == bytes([0, 2, 1, 3])
    with pytest.raises(ValueError):
        list(read_gif(data))
    with pytest.raises(ValueError):
        list(read_gif(b"no"))


def test_rows(spark):
    df = spark.createDataFrame([(1, "abc", 0), (1, "abc", 0), (None, None, 0), (3, "", 0), (4, "long é " * 20000, 0)], "doc_id long, text string, media int")
    got = digests(df).collect()
    assert len(got) == 5 and len({tuple(r) for r in got}) == 4
    zero = hashlib.sha256(bytes(64)).hexdigest()
    assert {(r.n_bytes, r.payload_bytes, r.payload_sha256) for r in got if r.doc_id in (None, 3)} == {(0, 64, zero)}
    f = frames(store(df)).orderBy("doc_id", "frame").collect()
    assert [r.frame for r in f if r.doc_id == 4] == [0, 1, 2] and all(r.error is None for r in f)
    assert all(sum(r.histogram) == r.width * r.height for r in f)
    bad = frames(spark.createDataFrame([(1, b"GIF89a"), (2, None)], "doc_id long, media binary")).collect()
    assert len(bad) == 2 and all(r.error for r in bad)
    assert digests(df.limit(0)).collect() == []


def test_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_media_columns(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        media, feature = plain_gif(padded(docs[r.doc_id]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), feature), r.doc_id
        p = padded(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert np.all([r.media_bytes > 0 for r in got])
