"""Operator 6, n-gram Jaccard join: two-level PartEnum signatures, exact checks, components.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Sets fall into size
bands so that linked sets lie in one band or in neighbours. For each band there is an
instance, for its sets and those of the band above. There, two linked sets differ in at
most k elements. The instance deals the domain to n1 partitions by hash, and each of them
to n2 parts. At least n1 - k // (k2 + 1) partitions differ in at most k2 elements, so in
each of those all parts but k2 are equal. The signatures of a partition are the subsets
of n2 - k2 of its parts: the hash of what the set has in them, all parts of a subset at
once. A subset with fewer than `least` elements gives none; a partition with such a subset
is weak. While a set has fewer weak partitions than must agree, linked sets share a
signature. A set for which that fails enumerates a further partitioning, with another seed
and at last with least = 0, which never fails. So the candidates miss no link.

Equal sets are one node, named by 128 bits of hash. Signatures move in packs, a pack for
each partition of the shuffle, with 64 of those bits. A signature that many nodes of a
batch have sends two to its home; the rest are linked to the first at once, so no task
gets all of a frequent one. Nodes that share a signature are candidates, and a chain of
candidates is a group. The sets of a group of at most GROUP nodes meet in one block, which
compares them exactly. A larger group is dealt, band by band, to chunks of about CHUNK
nodes; a block holds two chunks of one band or of neighbours, so every two nodes that can
link meet, no task holds more than a block, and a block gives fewer links than it has
nodes. What moves for a group of n nodes is its sets n / CHUNK times. Components are found
by alternating large and small stars.

Null or empty text: an empty set, linked with nothing, its own component. Repeated rows
are linked as equal sets; component_id is the smallest doc_id, nulls apart. An empty
table gives an empty result. Long texts are cut into shingles whole. Columns besides
doc_id and text are ignored, by filter_near kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, documents, dropped, pick, swept, utf8, written

WORDS = 5
#: Elements in which a partition may differ, and the parts of a partition.
K2, N2 = 1, 3
#: Partitions beyond those that differences can spoil, as a share.
SPARE = 0.15
#: (seed, least): what a set enumerates in turn until its links are certain.
TRIES = ((0, 2), (1, 2), (2, 1), (3, 1), (4, 0))
#: Bytes of a signature that move; the partition that it moves to stands for more.
MOVED = 6
#: Sets that a task remembers, so that copies send their signatures once.
REMEMBERED = 200_000
#: Signatures of a batch of packs; how many nodes of a batch make a signature frequent.
BATCH, FREQUENT = 500_000, 8
#: Characters of text for a partition of the signatures, at most; that is about 8 million of them, 112 MB.
PART_CHARS = 64 << 20
#: Signatures of a partition that are sorted at once.
RANGE = 500_000
#: Nodes and shingles of a group that one block holds, and of a chunk of a larger one.
GROUP, GROUP_ITEMS = 512, 1 << 21
CHUNK, CHUNK_ITEMS = 256, 1 << 20
#: Shingles that a block compares at once.
COLUMNS = 4096
#: Bits of the filter that keeps most texts without a candidate from being read again: 1 MB.
SLOTS = 1 << 23

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """The set of a text: sorted hashes of its shingles; A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            out = mix(out * _A + h[j : len(h) - width + 1 + j])
    return np.unique(out)


@cache
def bands(most: int) -> tuple[int, ...]:
    """Upper ends of the bands up to the one that holds most: a set and one a quarter larger are neighbours at farthest."""
    ends = [0]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, 5 * (ends[-1] + 1) // 4))
    return tuple(ends)


def band(size: int) -> int:
    return int(np.searchsorted(bands(1 << (max(size, 2) - 1).bit_length()), size))


def differ(a: int, b: int) -> int:
    """The most elements in which linked sets of these sizes differ: with I in common, 9 I >= 4 (a + b)."""
    return a + b - 2 * -(-4 * (a + b) // 9)


@cache
def instance(j: int) -> tuple[int, int, int, int, int]:
    """(upper end of band j, k, k2, n1, n2)."""
    ends = bands(1 << 40)
    u = ends[j]
    k = max(differ(u, b) for b in range(u, 5 * u // 4 + 1)) if u < 100 else (u + 5 * u // 4) // 9
    k2 = min(K2, k)
    spoiled = k // (k2 + 1)
    return u, k, k2, spoiled + 1 + int(SPARE * spoiled), N2 if k2 else 1


@cache
def subsets(n2: int, k2: int) -> np.ndarray:
    """A column for each subset of n2 - k2 of the parts: which parts it has."""
    return np.array([[x in s for s in combinations(range(n2), n2 - k2)] for x in range(n2)], np.uint64)


def most_apart(size: int, u: int) -> int:
    """The most elements in which a set of this size differs from a linked one in the instance of upper end u."""
    if size <= u:
        return (size + 5 * size // 4) // 9
    return (size + u) // 9


def signatures(items: np.ndarray) -> np.ndarray:
    """All signatures of a set that isn't empty."""
    size = len(items)
    own = band(size)
    out = []
    with np.errstate(over="ignore"):
        for j in (own, own - 1):
            if j < 1:
                continue
            u, _, k2, n1, n2 = instance(j)
            if j < own and 4 * size > 5 * u:
                continue  # too large for any set of the band below
            agree = n1 - most_apart(size, u) // (k2 + 1)
            chosen = subsets(n2, k2)
            for seed, least in TRIES:
                salted = mix(items + np.uint64(seed + 1) * _A)
                part = (salted >> np.uint64(33)).astype(np.int64) % (n1 * n2)
                total = np.zeros(n1 * n2, np.uint64)
                np.add.at(total, part, mix(salted ^ _C))
                n = np.bincount(part, minlength=n1 * n2).astype(np.uint64)
                total, n = total.reshape(n1, n2) @ chosen, n.reshape(n1, n2) @ chosen
                strong = n >= (1 if n1 * n2 == 1 else least)
                where = (np.uint64(j) << np.uint64(44)) + (np.uint64(seed) << np.uint64(40)) + np.arange(n.size, dtype=np.uint64).reshape(n.shape)
                out.append(mix(total + mix(where * _A + n))[strong])
                if int((~strong.all(1)).sum()) < agree:
                    break
    return np.concatenate(out).view(np.int64)


def named(items: np.ndarray) -> bytes:
    """The name of a set: 128 bits of hash."""
    return xxhash.xxh3_128_digest(items.tobytes())


def key_of(node: bytes) -> int:
    """64 bits of a name."""
    return int.from_bytes(node[:8], "little", signed=True)


def packs(docs: DataFrame, parts: int) -> DataFrame:
    """Rows for partition p of three kinds, other columns null.

    a, b: packs of signatures and of the keys of their nodes, 64-bit numbers; if sure, of
    keys of nodes and of others that they share a signature with.
    doc_id, n_shingles, node, key, band, text: a document; node names the set, null if it
    is empty; text is a hash of the text.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def pack(a: np.ndarray, b: np.ndarray, sure: bool) -> Iterator[pa.RecordBatch]:
        p = (mix(a.view(np.uint64) ^ _B) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(p, kind="stable")
        p, a, b = p[order], a[order].view(np.uint8).reshape(-1, 8), b[order]
        if not sure:
            a = a[:, :MOVED]
        ends = [*np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)]
        rows = [(p[x], a[x:y].tobytes(), b[x:y].tobytes()) for x, y in zip([0, *ends], ends, strict=False)]
        for k in range(0, len(rows), 256):
            at, left, right = zip(*rows[k : k + 256], strict=True)
            yield batch_of({"p": pa.array(at, pa.int32()), "a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary()), "sure": pa.array([sure] * len(at))}, len(at))

    def out(sigs: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
        sig, key = np.concatenate(sigs), np.repeat(np.array(keys, np.int64), [len(x) for x in sigs])
        order = np.argsort(sig, kind="stable")
        runs = sig[order]
        first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        count = np.diff(np.append(first, len(runs)))
        away = np.zeros(len(sig), bool)
        anchor = np.empty(len(sig), np.int64)
        nth = np.arange(len(runs)) - np.repeat(first, count)
        away[order] = np.repeat(count >= FREQUENT, count) & (nth >= 2)
        anchor[order] = np.repeat(key[order[first]], count)
        yield from pack(sig[~away], key[~away], False)
        if away.any():
            yield from pack(*_pairs(key[away], anchor[away]), True)

    fields = {"p": pa.int32(), "a": pa.binary(), "b": pa.binary(), "sure": pa.bool_(), "doc_id": None, "n_shingles": pa.int64(), "node": pa.binary(), "key": pa.int64(), "band": pa.int32(), "text": pa.int64()}

    def batch_of(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in fields.items()], names=list(fields))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        sigs, keys, held = [], [], 0
        for batch in batches:
            fields["doc_id"] = batch.column(0).type
            sizes, nodes, codes = [], [], []
            texts = utf8(batch.column(1))
            for text in texts:
                items = shingles(text)
                sizes.append(len(items))
                nodes.append(named(items) if len(items) else None)
                codes.append(key_of(nodes[-1]) if len(items) else None)
                if not len(items) or codes[-1] in sent:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(codes[-1])
                sigs.append(signatures(items))
                keys.append(codes[-1])
                held += len(sigs[-1])
                if held >= BATCH:
                    yield from out(sigs, keys)
                    sigs, keys, held = [], [], 0
            if texts:
                n = len(texts)
                yield batch_of({
                    "p": pa.array(np.arange(n) % parts, pa.int32()), "doc_id": batch.column(0), "n_shingles": pa.array(sizes, pa.int64()), "node": pa.array(nodes, pa.binary()),
                    "key": pa.array(codes, pa.int64()), "band": pa.array([band(x) for x in sizes], pa.int32()), "text": pa.array([text_key(x) for x in texts], pa.int64()),
                }, n)
        if held:
            yield from out(sigs, keys)

    return arrow_map(docs.select("doc_id", "text"), work, f"p int, a binary, b binary, sure boolean, doc_id {kind}, n_shingles long, node binary, key long, band int, text long")


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of different numbers."""
    a, b = a[a != b], b[a != b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[fresh], b[fresh]


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def candidates(packed: DataFrame, parts: int) -> DataFrame:
    """(a, b, doc_id, ...): pairs of keys of nodes that share a signature, and the documents, whose a is null.

    A node is paired with the first of its signature. A task holds the packs of a partition, as they came, and
    sorts RANGE signatures or so at a time.
    """
    names = ["doc_id", "n_shingles", "node", "key", "band", "text"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, keys = [], []
        kind = None

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            a, b = _pairs(a, b)
            empty = [pa.nulls(len(a), t) for t in (kind, pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *empty], names=["a", "b", *names])

        for batch in batches:
            kind = batch.column("doc_id").type
            docs = batch.filter(pc.is_null(batch.column("a")))
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(docs), pa.int64())] * 2 + [docs.column(k) for k in names], names=["a", "b", *names])
            for a, b, sure in zip(*(batch.column(k) for k in ("a", "b", "sure")), strict=True):
                if not a.is_valid:
                    continue
                key = np.frombuffer(b.as_buffer(), np.int64)
                if sure.as_py():
                    yield pairs(np.frombuffer(a.as_buffer(), np.int64), key)
                else:
                    sigs.append(np.frombuffer(a.as_buffer(), np.uint8).reshape(-1, MOVED))
                    keys.append(key)
        ranges = min(256, -(-sum(map(len, keys)) // RANGE))
        for k in range(ranges):
            low, high = 256 * k // ranges, 256 * (k + 1) // ranges
            here = [(x[:, -1] >= low) & (x[:, -1] < high) for x in sigs]
            key = np.concatenate([x[m] for x, m in zip(keys, here, strict=True)])
            sig = np.zeros((len(key), 8), np.uint8)
            sig[:, :MOVED] = np.concatenate([x[m] for x, m in zip(sigs, here, strict=True)])
            order = np.argsort(sig := sig.view(np.int64).ravel())
            sig, key = sig[order], key[order]
            fresh = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), 0))
            yield pairs(key[~fresh], key[first[~fresh]])

    kinds = dict(packed.dtypes)
    dealt = packed.repartitionById(parts, "p").drop("p")
    return arrow_map(dealt, work, f"a long, b long, {', '.join(f'{k} {kinds[k]}' for k in names)}")


def slots_of(keys: DataFrame) -> np.ndarray:
    """A bit for each slot that a key falls into: a table of SLOTS bits, whatever the keys."""
    slot = F.pmod("key", F.lit(SLOTS)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    size = 8 * 4096
    table = np.zeros(SLOTS // 8, np.uint8)
    for r in rows:
        table[(r.b - 1) * size // 8 : r.b * size // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return table


def sets(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """(node, items) of the documents whose text's hash falls into one of the slots."""
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for text in utf8(batch.column(0)):
                slot = text_key(text) % SLOTS
                if not shared.value[slot >> 3] >> (slot & 7) & 1:
                    continue
                items = shingles(text)
                if not len(items) or (node := named(items)) in sent:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(node)
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([items.view(np.int64)], pa.list_(pa.int64()))], names=["node", "items"])

    return arrow_map(docs.select("text"), work, "node binary, items array<long>")


def blocks(grouped: DataFrame) -> DataFrame:
    """(node, blocks) of (node, cc, band, n_shingles): the blocks that each node of a group goes to."""
    sizes = grouped.groupBy("cc", "band").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    whole = sizes.groupBy("cc").agg(((F.sum("c") > GROUP) | (F.sum("s") > GROUP_ITEMS)).alias("large"))
    chunks = F.greatest(F.ceil(F.col("c") / CHUNK), F.ceil(F.col("s") / CHUNK_ITEMS)).cast("int")
    sizes = sizes.join(whole, "cc").select("cc", "band", F.when(F.col("large"), chunks).otherwise(0).alias("own"))
    beside = lambda d, name: sizes.select("cc", (F.col("band") - d).alias("band"), F.col("own").alias(name))
    known = grouped.join(sizes, ["cc", "band"]).join(beside(-1, "below"), ["cc", "band"], "left").join(beside(1, "above"), ["cc", "band"], "left")
    i = F.pmod(F.xxhash64("node"), F.greatest("own", F.lit(1))).cast("int")
    up_to = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # a block's name is a hash; two of one name only become a larger block
    name = lambda low, x, high, y: F.xxhash64("cc", low, x, high, y)
    here = F.transform(up_to(F.col("own")), lambda j: name("band", F.least("i", j), "band", F.greatest("i", j)))
    below = F.transform(up_to(F.col("below")), lambda j: name(F.col("band") - 1, j, "band", F.col("i")))
    above = F.transform(up_to(F.col("above")), lambda j: name("band", F.col("i"), F.col("band") + 1, j))
    return known.withColumn("i", i).select("node", F.when(F.col("own") == 0, F.array(F.xxhash64("cc"))).otherwise(F.concat(here, below, above)).alias("blocks"))


def links(nodes: list[bytes], items: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
    """Pairs of a node and the least of the component that it has among these sets."""
    n = len(nodes)
    size = np.array([len(x) for x in items])
    flat, row = np.concatenate(items), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])[: len(column)]) - 1
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        have = np.zeros((n, COLUMNS), np.float32)
        have[row[a:b], column[a:b] - first] = 1
        common += have @ have.T
    common = common.astype(np.int64)
    linked = 100 * common >= 80 * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, True)
    rank = np.argsort(np.argsort(np.array(nodes, object)))
    label = rank.copy()
    while True:
        least = np.where(linked, label[None, :], n).min(1)
        if (least == label).all():
            break
        label = least
    of = sorted(nodes)
    return [x for x, k, r in zip(nodes, label, rank, strict=True) if k != r], [of[k] for k, r in zip(label, rank, strict=True) if k != r]


def compared(items: DataFrame, plan: DataFrame) -> DataFrame:
    """(a, b): links that join the components of all blocks."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def solved() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                a, b = links(list(held), list(held.values()))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            held.clear()

        for batch in batches:
            for block, node, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if block != now:
                    yield from solved()
                    now = block
                if node not in held:
                    held[node] = row.values.to_numpy()
        yield from solved()

    met = items.join(plan, "node").select(F.explode("blocks").alias("block"), "node", "items")
    return arrow_map(met.repartition("block").sortWithinPartitions("block"), work, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) of the nodes with an edge and a smaller node: root is the smallest node reachable. None without an edge."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.select(high.alias("hi"), low.alias("lo")).where("hi > lo").distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if not found[0]:
            dropped(now)
            return None
        if found == mark:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = found
        sym = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi > lo").distinct()
        old, now = now, written(small, "edges")
        dropped(old)


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row a document."""
    docs = pick(docs, "doc_id", "text")
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    found = written(candidates(packs(docs, parts), parts), "candidates")
    swept(spark)
    rows = found.where("a IS NULL").select("doc_id", "n_shingles", "node", "key", "band", "text")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("m"), *(F.first(c).alias(c) for c in ("key", "band", "n_shingles")), F.min("text").alias("text"))
    nodes = written(nodes, "nodes")
    groups = components(found.where("a IS NOT NULL").select("a", "b"))
    roots = None
    if groups is not None:
        cc = groups.select(F.col("node").alias("key"), F.col("root").alias("cc"))
        cc = cc.unionByName(groups.select(F.col("root").alias("key"), F.col("root").alias("cc")).distinct())
        grouped = written(nodes.join(cc, "key").select("node", "cc", "band", "n_shingles", "text"), "groups")
        dropped(groups)
        items = sets(docs, slots_of(grouped.select(F.col("text").alias("key"))))
        met = written(compared(items, blocks(grouped)), "links")
        dropped(grouped)
        swept(spark)
        roots = components(met)
        dropped(met)
    if roots is not None:
        least = nodes.select("node", "m").join(roots, "node", "left").select("node", "m", F.coalesce("root", "node").alias("root"))
        first = least.groupBy("root").agg(F.min("m").alias("component_id"))
        least = least.join(first, "root").select("node", "component_id")
    else:
        least = nodes.select("node", F.col("m").alias("component_id"))
    known = rows.select("doc_id", "n_shingles", "node").join(least, "node", "left")
    return known.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def placed(docs: DataFrame) -> DataFrame:
    """(d, text, o, doc_id): a row as it came, its text and key, and a name of the row that holds in every reading.

    Rows of files are named by file and place. Others get numbers and are written, so that these hold.
    """
    have = set(docs.columns)
    text = F.col("text").cast("string") if "text" in have else F.lit(None).cast("string")
    order = F.col("doc_id") if "doc_id" in have else F.lit(None).cast("long")
    cells = [F.struct("*").alias("d"), text.alias("text"), order.alias("o")]
    if "_metadata" not in {c.lower() for c in have}:
        with suppress(AnalysisException):
            place = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
            return docs.select(*cells, place.alias("doc_id"))
    return written(docs.select(*cells, F.monotonically_increasing_id().alias("doc_id")), "rows")


def filter_near(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest key, with its columns as they came."""
    base = placed(docs)
    found = written(cluster(base), "found")
    keyed = found.join(base.select("doc_id", "o"), "doc_id")
    first = keyed.groupBy("component_id").agg(F.min(F.struct(F.col("o").isNull().alias("n"), "o", "doc_id")).alias("m"))
    gone = found.select("doc_id").join(first.select("m.doc_id"), "doc_id", "left_anti")
    return base.join(written(gone, "gone"), "doc_id", "left_anti").select("d.*")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir))
