import itertools
import random
from collections import Counter

import numpy as np

from barframe.llm import jaccard
from barframe.llm.jaccard import SLOTS, band, bands, blocks, candidates, cluster, components, differ, filter_near, instance, key_of, links, most_apart, named, op6_ngram_jaccard, packs, shingles, signatures, slots_of, text_key


def exact(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """doc_id -> (set size, component), by comparing all pairs."""
    sets = {k: exact(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for k, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for v in by.values() for a, b in itertools.combinations(sorted(v), 2)} if len(sets) < 4000 else set()
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_bounds():
    ends = bands(100_000)
    for a in range(1, 3000):
        for b in {a, a + 1, (5 * a) // 4}:
            if 5 * a < 4 * b:
                continue
            j = band(a)
            assert ends[j - 1] < a <= ends[j] and band(b) - j in (0, 1)
            u, k, k2, n1, n2 = instance(j)
            d = differ(a, b)
            assert d <= k < n1 * (k2 + 1) and n2 > k2 and d <= most_apart(a, u) and (b <= u or d <= most_apart(b, u))
            if band(b) == j + 1:
                assert 4 * b <= 5 * u


def test_signatures_miss_no_link():
    r = np.random.default_rng(7)
    for n in [*range(1, 60), 100, 130, 333, 800, 2500]:
        for _ in range(12):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            extra = int(r.integers(0, n // 4 + 1))
            most = differ(n, n + extra)
            drop = min((most - extra) // 2, n - 1) if most >= extra else -1
            if drop < 0:
                continue
            b = np.concatenate([a[drop:], r.integers(0, 1 << 63, drop + extra, dtype=np.uint64)])
            i = n - drop
            assert 100 * i >= 80 * (len(a) + len(b) - i)
            assert set(signatures(np.unique(a)).tolist()) & set(signatures(np.unique(b)).tolist()), (n, extra)


def joined(pairs):
    """node -> the least of its component."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {k: find(k) for k in list(root)}


def test_candidates(spark):
    """Chains of shared signatures, with frequent ones, copies and several tasks, against a dictionary."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: r.randrange(30, 60)] + [f"x{r.randrange(40)}"]) for _ in range(150)] + [f"a b c d e f{i}" for i in range(30)]
    texts += [" ".join(f"{w}{g}" for w in base[: 40 + k]) for g in range(9) for k in range(3)]
    texts += [texts[3]] * 20 + [None, ""]
    r.shuffle(texts)
    by = {}
    for t in texts:
        items = shingles((t or "").encode())
        if len(items):
            for x in signatures(items).tolist():
                by.setdefault(x, set()).add(key_of(named(items)))
    want = joined((a, min(ks)) for ks in by.values() if len(ks) > 1 for a in ks)
    assert any(len(ks) > 8 for ks in by.values()) and len(set(want.values())) > 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = candidates(packs(df, 7), 7).collect()
    assert joined((x.a, x.b) for x in got if x.a is not None) == want
    rows = [x for x in got if x.a is None]
    assert sorted(x.doc_id for x in rows) == list(range(len(texts)))
    assert all(x.n_shingles == len(exact(texts[x.doc_id])) and (x.node is None) == (not x.n_shingles) and x.text == text_key((texts[x.doc_id] or "").encode()) for x in rows)


def test_slots(spark):
    keys = spark.range(500).selectExpr("xxhash64(id) AS key")
    slots = slots_of(keys)
    held = {x.key % SLOTS for x in keys.collect()}
    assert np.unpackbits(slots, bitorder="little").sum() == len(held) and all(slots[x >> 3] >> (x & 7) & 1 for x in held)


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    """Groups of any size give the same: all that can link meet in a block, none of which is large."""
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in cluster(df).collect()} == brute(docs)
    sizes = [10 + k % 40 for k in range(400)]
    grouped = spark.createDataFrame([(str(k).encode(), 1, band(n), n) for k, n in enumerate(sizes)], "node binary, cc long, band int, n_shingles long")
    monkeypatch.setattr(jaccard, "CHUNK", 20)
    of = {int(r.node): set(r.blocks) for r in blocks(grouped).collect()}
    for a, b in itertools.combinations(range(400), 2):
        low, high = sorted((sizes[a], sizes[b]))
        assert of[a] & of[b] or 4 * high > 5 * low
    held = Counter(x for v in of.values() for x in v)
    assert max(held.values()) <= 90 and len(held) > 20


def test_links():
    r = random.Random(8)
    for n in (2, 3, 9, 60):
        base = r.sample(range(1 << 40), 60)
        sets = {bytes([k]) * 16: np.array(sorted(set(base[r.randrange(9) :]) | set(r.sample(range(1 << 40), r.randrange(9)))), np.int64) for k in range(n)}
        want = joined((a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(i := np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - len(i)))
        got = joined(zip(*links(list(sets), list(sets.values())), strict=True))
        assert got == want
    assert links([b"a", b"b"], [np.array([1]), np.array([2])]) == ([], [])


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {k: find(k) for k in root if find(k) != k}


def fixture():
    r = random.Random(11)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + str(r.randrange(60))
    docs = []
    for g in range(12):
        base = [word() for _ in range(r.choice([3, 6, 12, 40, 150, 400]))]
        for _ in range(r.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 60) + 1)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w[: max(1, len(w) - r.randrange(0, len(w) // 8 + 1))]
            docs.append(" ".join(w))
    passage = " ".join(word() for _ in range(60))
    docs += [f"{' '.join(word() for _ in range(r.randrange(60, 200)))} {passage}" for _ in range(60)]
    docs += [None, "", "  \n", "A b", "a B", "a b c", "one " * 3000, "ONE " * 2000]
    # a chain: neighbours link, ends don't
    chain = [word() for _ in range(100)]
    for k in range(12):
        docs.append(" ".join(chain[: 100 - 0] if not k else [*[f"z{i}" for i in range(4 * k)], *chain[4 * k :]]))
    r.shuffle(docs)
    return list(enumerate(docs, 100))


def test_against_brute_force(spark):
    docs = fixture()
    want = brute(docs)
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, node int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in cluster(df).collect()}
    assert got == want and len({v[1] for v in want.values()}) < len(want)
    kept = filter_near(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({v[1] for v in want.values()})


def test_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in cluster(df).collect()))
    assert got == [(-1, 0, -1), (-1, 2, 5), (2, 0, 2), (5, 2, 5), (5, 2, 5)]
    assert filter_near(df).count() == 3
    assert cluster(df.limit(0)).collect() == [] and filter_near(df.limit(0)).collect() == []


def test_shingles():
    assert len(shingles(b"a b c d e f")) == 2 and len(shingles(b"x")) == 1 and not len(shingles(b" \t"))
    assert (shingles(b"A b\tC") == shingles(b"a B c")).all() and (shingles(b"a b") != shingles(b"a  c")).all()


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op6_ngram_jaccard(spark, sf).collect()} == brute(docs)
