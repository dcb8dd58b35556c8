"""Operator 2, LM scoring: prediction by partial matching over bytes, pretrained.

A text is its words, in lower case, with one space between, and an end byte. Each byte is
predicted from the ORDER bytes before it, spaces included, so contexts reach from one word
into the next; before a text stand end bytes. The contexts of all lengths are a trie, whose
counts are those of the training texts. A byte that a context has seen n times, of total
with kinds different ones, has n / (total + kinds); the rest, kinds / (total + kinds), is the
escape to the next shorter context, in which the bytes that the longer ones know are
excluded; after the empty context all bytes left are equally likely. A text's score is the
sum of the logarithms over its bytes: its code length.

So a byte's worth depends on the gram of ORDER + 1 bytes that it ends. All grams of the
training texts are counted and valued, in tables that are as large as the corpus makes them.
For the texts, the values of the TABLE most frequent grams are broadcast, 16 bytes each; the
other grams of a text are joined to the values. Those that training has not seen, which
escape, are valued once each: they are joined to the followers of their contexts; only
contexts of up to SHORT bytes are broadcast, at most 65,536 counts. For the base score, the
words that are not among the WORDS most frequent are joined to the counts. What is broadcast
changes no result.

Null or empty text: only the end token. Repeated rows are scored each for itself. A null
doc_id counts as the empty text when rows are held out. An empty table gives an empty
result; with no training text, every byte is equally likely. Long texts and words are
coded whole. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, crc_of, documents, pick, swept, utf8, written

ORDER, SHORT = 5, 1
END = 0x0A
#: Bytes that a word and its end can hold, and the space: all but five of white space, one of which is the end.
ALPHABET = 252
#: Grams and words that are broadcast, and the most bytes of such a word.
TABLE, WORDS, WORD_BYTES = 1 << 20, 1 << 17, 64
#: Words, and bytes of text, that a task counts before it sends them on or sorts them.
COUNTED, SORTED = 400_000, 2 << 20
#: Grams that a task holds before it sends them on.
HELD = 2_000_000


# ---- counts -------------------------------------------------------------------------------


def grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The grams that end in each byte of the texts, as numbers, and where each text's begin."""
    pad = bytes([END]) * ORDER
    parts = [pad + b" ".join(words) + bytes([END]) for words in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    code = flat.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= flat[: len(flat) - k] << 8 * k
    first = np.cumsum(size) - size
    inside = np.ones(len(flat), bool)
    for k in range(ORDER):
        inside[first + k] = False
    return code[inside], first - ORDER * np.arange(len(parts))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(code, n): the grams of the texts."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        waits: list[list[bytes]] = []
        size = 0

        def settle() -> None:
            nonlocal codes, counts, size
            if waits:
                kinds, n = np.unique(grams(waits)[0], return_counts=True)
                codes, counts = _summed(np.concatenate([codes, kinds]), np.concatenate([counts, n]))
            waits.clear()
            size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

        for batch in batches:
            for text in utf8(batch.column(0)):
                waits.append(text.lower().split())
                size += len(text)
                if size >= SORTED:
                    settle()
                    if len(codes) >= HELD:
                        yield out()
                        codes, counts = codes[:0], counts[:0]
        settle()
        yield out()

    return arrow_map(docs.select("text"), work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of the texts."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            block = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return block

        for batch in batches:
            for text in utf8(batch.column(0)):
                seen.update(text.lower().split())
                if len(seen) > COUNTED:
                    yield out()
        yield out()

    return arrow_map(docs.select("text"), work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- values -------------------------------------------------------------------------------


def suffixes(counted: DataFrame, size: int) -> DataFrame:
    """(code, n): the counts of the last size bytes of the grams."""
    return counted.groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("code")).agg(F.sum("n").alias("n"))


def _context(code: str = "code"):
    return F.shiftright(code, 8)


def followers(counted: DataFrame, size: int) -> DataFrame:
    """(context, next): what follows the contexts of size bytes, at most ALPHABET counts each, as count << 8 | byte."""
    return suffixes(counted, size + 1).groupBy(_context().alias("context")).agg(F.collect_list(F.shiftleft("n", 8).bitwiseOR(F.col("code").bitwiseAND(F.lit(255)))).alias("next"))


def escaped(contexts: Iterable[dict[int, int] | None], symbol: int) -> float:
    """log10 of the probability of symbol; contexts: the counts that follow in each, longest first."""
    chance, gone = 1.0, set()
    for seen in contexts:
        left = {s: n for s, n in seen.items() if s not in gone} if seen and gone else seen
        if not left:
            continue
        total, kinds = sum(left.values()), len(left)
        if symbol in left:
            return float(np.log10(chance * left[symbol] / (total + kinds)))
        chance *= kinds / (total + kinds)
        gone.update(left)
    return float(np.log10(chance / max(1, ALPHABET - len(gone))))


def values(known: DataFrame) -> DataFrame:
    """(code, n, value): log10 of the probability of the last byte of each known gram after the others."""
    total = known.groupBy(_context().alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return known.withColumn("context", _context()).join(total, "context").select("code", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("value"))


def escapes(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(code, value) of grams (code) that are not known."""
    shorter = suffixes(known, SHORT + 1).collect()  # at most 65,536 counts
    short: dict[int, dict[int, dict[int, int]]] = {k: {} for k in range(SHORT + 1)}
    for r in shorter:
        for k in short:
            here = short[k].setdefault((r.code >> 8) & ((1 << 8 * k) - 1), {})
            here[r.code & 255] = here.get(r.code & 255, 0) + r.n
    model = known.sparkSession.sparkContext.broadcast(short)
    sizes = range(ORDER, SHORT, -1)
    for k in sizes:
        side = followers(known, k).select(F.col("context").alias(f"c{k}"), F.col("next").alias(f"f{k}"))
        asked = asked.withColumn(f"c{k}", _context().bitwiseAND(F.lit((1 << 8 * k) - 1))).join(side, f"c{k}", "left")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.value
        for batch in batches:
            found = []
            for code, *sides in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                longer = ({v & 255: v >> 8 for v in flat or ()} for flat in sides)
                found.append(escaped(chain(longer, (of[k].get((code >> 8) & ((1 << 8 * k) - 1)) for k in range(SHORT, -1, -1))), code & 255))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["code", "value"])

    return arrow_map(asked.select("code", *(f"f{k}" for k in sizes)), work, "code long, value double")


def fit(docs: DataFrame) -> dict:
    """Grams and words of the training texts as tables, and the numbers of the corpus; docs: (text, held_out)."""
    train = docs.where(~F.col("held_out"))
    words, known = written(word_counts(train), "words"), written(gram_counts(train), "grams")
    swept(docs.sparkSession)
    facts, ends = words.agg(F.sum("n"), F.count("*")).first(), train.count()
    return {"words": words, "grams": known, "values": written(values(known), "values"), "ends": ends, "tokens": (facts[0] or 0) + ends, "kinds": facts[1] + (ends > 0)}


class Values:
    """Values of grams by a table of slots; those whose slot is taken come from a sorted array."""

    def __init__(self, codes: np.ndarray, worth: np.ndarray):
        self.bits = max(4, int(len(codes) * 2).bit_length())
        self.code, self.worth = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slot = self._slot(codes)
        # the first of a slot, the most frequent, has it
        slot, first = np.unique(slot, return_index=True)
        self.code[slot], self.worth[slot] = codes[first], worth[first]
        rest = np.ones(len(codes), bool)
        rest[first] = False
        order = np.argsort(codes[rest])
        self.rest, self.rest_worth = np.append(codes[rest][order], 1 << 62), np.append(worth[rest][order], 0.0)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where unknown, and which are known."""
        slot = self._slot(codes)
        known = self.code[slot] == codes
        worth = np.where(known, self.worth[slot], 0.0)
        away = np.flatnonzero(~known)
        at = np.searchsorted(self.rest, codes[away])
        hit = self.rest[at] == codes[away]
        worth[away[hit]], known[away[hit]] = self.rest_worth[at[hit]], True
        return worth, known


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs: (doc_id, text, held_out)."""
    spark = docs.sparkSession
    words, valued, total, kinds, ends = (model[k] for k in ("words", "values", "tokens", "kinds", "ends"))
    often = words.where(F.length("word") <= WORD_BYTES).orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    top = valued.orderBy(F.desc("n"), "code").limit(TABLE).select("code", "value").toArrow()
    base_of = lambda c: np.log10((c + 1) / (total + kinds + 1))
    known = spark.sparkContext.broadcast((often.column("word").to_pylist(), base_of(often.column("n").to_numpy().astype(float)), top.column("code").to_numpy(), top.column("value").to_numpy()))
    end_base, end_known = float(base_of(float(ends))), int(ends > 0)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    kind = dict(docs.dtypes)["doc_id"]
    types = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "worth": pa.float64(), "rest": pa.list_(pa.binary()), "times": pa.list_(pa.int64()), "codes": pa.list_(pa.int64()), "often": pa.list_(pa.int64())}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bases, codes, worths = known.value
        place, table = {w: k for k, w in enumerate(names)}.get, Values(codes, worths)
        for batch in batches:
            waits: list[tuple[int, list[bytes]]] = []
            size, last = 0, batch.num_rows - 1
            for i, text in enumerate(utf8(batch.column(3))):
                waits.append((i, text.lower().split()))
                size += len(text)
                if size < SORTED and i < last:
                    continue
                mine, first = grams([w for _, w in waits])
                worth, hit = table.of(mine)
                ends_at = np.append(first[1:], len(mine))
                sums = np.add.reduceat(worth, first)
                cols: list[list] = [[] for _ in types]
                for (_, own), a, b, s in zip(waits, first.tolist(), ends_at.tolist(), sums.tolist(), strict=True):
                    at = np.fromiter((place(w, -1) for w in own), np.int64, len(own))
                    there = at >= 0
                    rest = Counter([own[k] for k in np.flatnonzero(~there).tolist()])
                    tail, often_ = np.unique(mine[a:b][~hit[a:b]], return_counts=True)
                    for c, v in zip(cols, (len(own) + 1, int(there.sum()) + end_known, float(bases[at[there]].sum()) + end_base, s, list(rest), list(rest.values()), tail, often_), strict=True):
                        c.append(v)
                rows = batch.slice(waits[0][0], len(waits))
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], *(pa.array(c, t) for c, t in zip(cols, types.values(), strict=True))], names=["row", "doc_id", "held_out", *types])
                waits, size = [], 0

    rows = written(arrow_map(numbered, work, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, worth double, rest array<binary>, times array<long>, codes array<long>, often array<long>"), "texts")
    rare = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    of_words = rare.join(words, "word", "left").groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(total + kinds + 1)))).alias("b"))
    tails = rows.select("row", F.explode(F.arrays_zip("codes", "often")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.often").alias("often"))
    found = written(tails.join(valued.select("code", "value"), "code", "left"), "tails")
    strange = found.where("value IS NULL")
    new = escapes(strange.select("code").distinct(), model["grams"])
    both = found.where("value IS NOT NULL").select("row", "often", "value").unionByName(strange.select("row", "code", "often").join(new, "code").select("row", "often", "value"))
    of_grams = both.groupBy("row").agg(F.sum(F.col("often") * F.col("value")).alias("g"))
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    out = rows.drop("rest", "times", "codes", "often").join(of_words, "row", "left").join(of_grams, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("worth", "g").alias("score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(documents(spark, sf_dir), "doc_id", "text").withColumn("held_out", crc_of("doc_id") % 7 == 2)
    return score(docs, fit(docs))
