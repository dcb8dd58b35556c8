import random
import struct

import numpy as np
import pytest

from barframe.llm.packing import Tokenizer, cuts, digest, op8_packing, pack, public_path, write_buckets
from barframe.llm.pieces import CharacterMap, Model, encode, model, op5_sentencepiece, round_trip

TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a \nb", "x\t y", "\n\n", "it's we'll  I'd", "<|endoftext|> <s> </s>", "▁x ▁", "日本語 €\U0001f600 é", "a\0b", "ﬁ １ ½", "  hello  world  ", "a  b  c", "x " * 50, "nospace" * 500, "　  x", "é ͅ", "0x41 <0x41> �"]


def noise(n=300):
    r = random.Random(5)
    return ["".join(r.choice("ab the\n\t  éß▁日\U0001f600'sll<0x> ") for _ in range(r.randrange(40))) for _ in range(n)]


def test_tokenizer_equals_library():
    """Against a library as it comes, with the mark that the file adds in many places."""
    from tokenizers import Tokenizer as Library

    path = public_path("byte_bpe_50k.json")
    t, library = Tokenizer(path), Library.from_file(path)
    mark = "<|endoftext|>"
    r = random.Random(9)
    marked = ["".join(r.choice([mark, mark[:-1], " ", "  ", "\n", "a", "it's", "é", "<|"]) for _ in range(r.randrange(1, 12))) for _ in range(300)]
    assert np.frombuffer(t.ids(f"hello {mark} x"), "<u4").tolist() == [31373, 220, 50256, 2124]
    for x in [*TEXTS, *noise(), *marked, " " * 3000 + "x", " " * 3000 + mark, "a" + "\n \t" * 1000, "日本" * 2000]:
        assert np.frombuffer(t.ids(x), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids, repr(x)


def test_cuts():
    assert cuts(0, 8) == [] and cuts(1, 8) == [1] and cuts(27, 8) == [8, 8, 8, 2, 1]
    for n in range(1, 300):
        c = cuts(n, 16)
        assert sum(c) == n and c == sorted(c, reverse=True) and all(x & (x - 1) == 0 for x in c)


def test_pieces_equal_library():
    import sentencepiece

    path = public_path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), model(path)
    for x in TEXTS + noise():
        ids, bounds = m.encode(x)
        want = sp.encode(x)
        assert ids.tolist() == want, repr(x)
        assert m.decode(ids).decode() == sp.decode(want), repr(x)
        data = x.encode()
        assert bounds[0] == 0 and bounds[-1] == len(data) and (np.diff(bounds) >= 0).all(), repr(x)
        for k, p in enumerate(ids.tolist()):
            if not m.is_byte[p]:
                assert data[bounds[k] : bounds[k + 1]].replace("▁".encode(), b" ") == m.surface[p][k == 0 and m.surface[p][:1] == b" " :], (x, k)


def fresh(n, seed):
    """Words of many lengths from letters, marks and characters without a piece."""
    r = random.Random(seed)
    return ["".join(r.choice("etaoinshrdlu,.'\né日😀▁"[: r.choice([12, 12, 15, 20])]) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 13, 18, 30, 60, 70, 130]))) for _ in range(n)]


def test_new_words_are_merged_together():
    """As the library does, and with few calls for a word: one by one they took dozens."""
    import sys

    import sentencepiece

    path = public_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in [" ".join(fresh(4000, 1)), "  ".join(fresh(500, 2)), "".join(fresh(40, 3))]:
        m = Model(open(path, "rb").read())
        ids, bounds = m.encode(text)
        want = sp.encode(text)
        assert ids.tolist() == want and bounds[-1] == len(text.encode()) and len(bounds) == len(ids) + 1
    r = random.Random(4)
    text = " ".join({"".join(r.choice("etaoinshrdlu") for _ in range(9)) for _ in range(5000)})
    m, calls = Model(open(path, "rb").read()), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids, _ = m.encode(text)
    finally:
        sys.setprofile(None)
    assert ids.tolist() == sp.encode(text) and calls < 10 * 5000, calls


@pytest.mark.parametrize("seed", range(4))
def test_block_of_words_equals_one_by_one(seed):
    """Pieces with equal scores, pieces that no pair makes, characters that only longer pieces hold."""
    r = random.Random(seed)
    pieces = {"".join(r.choice("abcd") for _ in range(r.choice([1, 2, 2, 2, 3, 3, 4, 6]))) for _ in range(60)} | {"ab", "é"}
    m = Model.__new__(Model)
    m.rank = {p: (r.randrange(8), 300 + k) for k, p in enumerate(sorted(pieces))}
    m.cost, m.byte = {p: c for p, (c, _) in m.rank.items()}.get, {b: b for b in range(256)}
    m._tabulate()
    words = ["".join(r.choice("abcdéz日") for _ in range(r.randrange(1, 70))) for _ in range(1500)] + ["a" * n for n in range(1, 65)]
    assert m.learn(words) == {w: m._spelt(m.merged(w)) for w in words}


def test_texts_together_equal_texts_alone(monkeypatch):
    """Whatever is remembered, and however many texts are taken at once."""
    from barframe.llm import pieces

    data = open(public_path("piece_bpe_32k.model"), "rb").read()
    texts = [*TEXTS, *noise(100), *(" ".join(fresh(60, k)) for k in range(5)), *TEXTS]
    alone = [(i.tolist(), b.tolist()) for i, b in map(Model(data).encode, texts)]
    for together, remembered in ((1, 0), (300, 50), (10**6, 10**6)):
        monkeypatch.setattr(pieces, "TOGETHER", together)
        monkeypatch.setattr(pieces, "REMEMBERED", remembered)
        m = Model(data)
        assert [(i.tolist(), b.tolist()) for i, b in m.encode_all(texts)] == alone
        assert all(len(p) <= pieces.WIDTHS[-1] for p in m.known)
    assert list(m.encode_all([])) == []


def test_decode_ill_formed_bytes():
    import sentencepiece

    path = public_path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), model(path)
    r = random.Random(3)
    for _ in range(200):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randrange(1, 8))]
        assert m.decode(np.array(ids)).decode() == sp.decode(ids), ids


def test_character_map_and_alignment():
    """A real compiled map, from the library's normaliser, against that normaliser."""
    import sentencepiece

    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        blob = library.serialized_model_proto()
    except Exception:
        pytest.skip("this build has no normaliser")
    from barframe.llm.pieces import _fields

    spec = next((v for f, v in _fields(blob) if f == 3), None)
    charsmap = dict(_fields(spec))[2]
    m = Model.__new__(Model)
    m.map, m.squeeze, m.dummy = CharacterMap(charsmap), True, True
    for x in [*TEXTS, "ｶﾞ ㍿ ①", *noise(100)]:
        norm, align = m.normalised(x)
        assert norm == library.normalize(x), repr(x)
        assert len(align) == len(norm.encode()) + 1 and (np.diff(align) >= 0).all()


def plain_normalised(m, text):
    """Character by character, with the longest key of a dictionary first."""
    data, parts, at = text.encode("utf-8", "replace"), [], 0
    while at < len(data):
        key = max((k for k in m.keys if data.startswith(k, at)), key=len, default=None)
        if key:
            parts += [(c, at, False) for c in m.keys[key].decode()]
            at += len(key)
        else:
            n = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
            parts.append((data[at : at + n].decode(), at, True))
            at += n
    if m.squeeze:
        parts = [p for k, p in enumerate(parts) if p[0] != " " or k and parts[k - 1][0] != " "]
        while parts and parts[-1][0] == " ":
            parts.pop()
    if m.dummy and parts:
        parts.insert(0, (" ", parts[0][1], False))
    norm = "".join("▁" if c == " " else c for c, *_ in parts)
    return norm, [*(start + k if copied and c != " " else start for c, start, copied in parts for k in range(3 if c == " " else len(c.encode()))), len(data)]


def trie(keys):
    """A compiled map of these keys, laid out with a block of 256 units for each node."""
    nodes, texts = {b"": 0}, b""
    for k in sorted(keys):
        for n in range(1, len(k) + 1):
            nodes.setdefault(k[:n], len(nodes))
    base = {p: 256 * (2 * j + 1) for p, j in nodes.items()}
    units = [255] * (256 * (2 * len(nodes) + 2))  # a label that no text has
    units[0] = base[b""] << 10
    for p in nodes:
        if p:
            at = base[p[:-1]] ^ p[-1]
            units[at] = p[-1] | (p in keys) << 8 | (at ^ base[p]) << 10
        if p in keys:
            units[base[p]] = 1 << 31 | len(texts)
            texts += keys[p] + b"\0"
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("dummy", [False, True])
@pytest.mark.parametrize("keys", [{}, {b"a": b"a"}, {b"a": b"bc", b"ab": b" ", "é".encode(): b"e", b"th": "▁x".encode(), b"\t": b" ", b"\n": b"", "日".encode(): "本本".encode(), b"  ": b"q"}])
def test_normalised_against_plain(keys, squeeze, dummy):
    m = Model.__new__(Model)
    m.keys, m.squeeze, m.dummy = keys, squeeze, dummy
    m.map = CharacterMap(trie(keys)) if keys else None
    for x in [*TEXTS, *noise(200)]:
        norm, align = m.normalised(x)
        assert (norm, align.tolist()) == plain_normalised(m, x), repr(x)


def test_identity_map_changes_nothing():
    """The model as it is, and with a map of each letter to itself: same ids, same spans."""
    path = public_path("piece_bpe_32k.model")
    m, same = model(path), Model(open(path, "rb").read())
    same.map = CharacterMap(trie({bytes([c]): bytes([c]) for c in b"abcdefghijklmnopqrstuvwxyz "}))
    for x in [*TEXTS, *noise(100)]:
        (ids, bounds), (also, spans) = m.encode(x), same.encode(x)
        assert ids.tolist() == also.tolist() and bounds.tolist() == spans.tolist(), repr(x)


def test_character_map_by_hand():
    """A trie made by hand: one key, the byte A, which becomes bc."""
    units = [0] * 512
    units[0] = 256 << 10
    units[256 ^ 65] = 65 | 1 << 8 | 3 << 10
    units[(256 ^ 65) ^ 3] = 1 << 31 | 0
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"bc\0"
    c = CharacterMap(blob)
    assert c.longest(b"xAA", 1) == (1, b"bc") and c.longest(b"x", 0) is None


def rows(spark):
    return spark.createDataFrame([(1, "the end of it", "z"), (1, "the end of it", "z"), (None, None, None), (3, "", "z"), (4, "long " * 30000, "z")], "doc_id long, text string, ids string")


def test_pack_and_encode_rows(spark, tmp_path):
    path = public_path("byte_bpe_50k.json")
    got = pack(rows(spark), path).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    assert sorted((r.length, r.doc_tokens) for r in got if r.doc_id in (None, 3)) == [(1, 1), (1, 1)]
    long = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.start)
    assert sum(r.length for r in long) == long[0].doc_tokens and all(r.length & (r.length - 1) == 0 for r in long)
    want = Tokenizer(path).library.encode("long " * 30000, add_special_tokens=False).ids + [1]
    assert np.frombuffer(b"".join(bytes(r.ids) for r in long), "<u4").tolist() == want
    assert all(r.length == 1 << r.bucket for r in got)
    assert digest(pack(rows(spark).limit(0), path)).collect() == []
    write_buckets(pack(rows(spark), path), str(tmp_path / "out"))
    for b in {r.bucket for r in got}:
        one = spark.read.parquet(str(tmp_path / "out" / f"bucket={b}"))
        assert one.count() == sum(r.bucket == b for r in got) and {len(r.ids) for r in one.collect()} == {4 << b}
    spm = public_path("piece_bpe_32k.model")
    e = encode(rows(spark), spm).collect()
    assert len(e) == 5 and [r.ids for r in e if r.doc_id == 3] == [[1, 2]]
    assert all(len(r.ids) == len(r.begins) == len(r.ends) for r in e)
    assert round_trip(rows(spark).limit(0), spm).collect() == [] and round_trip(rows(spark), spm).count() == 5


def test_queries_against_libraries(spark, sf):
    import hashlib
    import zlib

    import sentencepiece
    from tokenizers import Tokenizer as Library

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    for r in op5_sentencepiece(spark, sf).collect():
        ids = sp.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    library = Library.from_file(public_path("byte_bpe_50k.json"))
    got = op8_packing(spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        ids = np.asarray([*library.encode(docs[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
