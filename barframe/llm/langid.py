"""Operator 9, language ID: script ranges, then Viterbi over per-word scores.

Training counts the hashed letter trigrams of words and the scripts of letters, per
language, over all labelled rows. Partial sums leave each task, those of HELD languages at
most at a time. fit() learns the languages with the most letters, at most max_langs of
them (256, a parameter; the first by name of equals), so that a dirty lang column doesn't
make a model of any size: it has max_langs * (BUCKETS + scripts) numbers at most, which is
why it is collected and broadcast. Prediction takes the words of a text: runs of letters
and the marks that combine with them. The script of a word narrows its candidates to the languages that were seen in that script; a word scores the
sum of its trigrams' log probabilities in each. Viterbi finds the labelling of the words
that is best after a penalty for each switch, so mixed text falls into spans.

lang_pred is the language with the most letters in its spans, the first by name of
equals; score is its share of the letters. Null text, or one without a letter: `und`,
score 0, also if nothing could be learned. Repeated rows get equal results; a null doc_id counts as the empty
text when rows are held out. An empty table gives an empty result. Long texts are
labelled whole. Columns besides doc_id, text and lang are ignored, by filter_language kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, crc_of, documents, dropped, pick, reach, strings, written

BUCKETS = 1 << 16
MAX_LANGS, HELD = 256, 32
SWITCH = 20.0
SMOOTH = 0.1
#: A language uses a script that has this share of its letters.
USES = 0.001
OUTSIDE = -1e4
REMEMBERED = 400_000
#: Characters of texts whose words are scored together.
AHEAD_CHARS = 300_000
MIN_SCORE = 0.5
#: Ranges of code points of scripts (fixed values, from the Unicode blocks).
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("indic", ((0x900, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("han", ((0x2E80, 0x2FDF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))),
)
OTHER = len(SCRIPTS)


def _marks() -> str:
    """A class of the characters that combine with letters."""
    points = [k for k in range(0x300, 0x20000) if unicodedata.category(chr(k))[0] == "M"]
    edges = [k for k, (a, b) in enumerate(pairwise(points), 1) if b - a > 1]
    return "".join(f"{chr(points[a])}-{chr(points[b - 1])}" for a, b in zip([0, *edges], [*edges, len(points)], strict=True))


_WORD = re.compile(rf"[^\W\d_]+(?:[{_marks()}]+[^\W\d_]*)*")


class _Scripts(dict):
    """Character -> script, -1 for what isn't a letter."""

    def __missing__(self, c: str) -> int:
        k = next((k for k, (_, ranges) in enumerate(SCRIPTS) if any(a <= ord(c) <= b for a, b in ranges)), OTHER) if c.isalpha() else -1
        if len(self) < 1 << 16:
            self[c] = k
        return k


_script_of = _Scripts()


def script(word: str) -> int:
    """The script of most of a word's letters, the first listed of equals; -1 without a letter."""
    if word.isascii():
        return 0
    found = {_script_of[c] for c in word}
    if len(found) == 1:
        return found.pop()
    n = Counter(_script_of[c] for c in word)
    del n[-1]
    return min(n, key=lambda k: (-n[k], k)) if n else -1


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed byte trigrams of all words in turn, each word between spaces, and where each word's begin."""
    parts = [f" {w.lower()} ".encode() for w in words]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts) + b"  ", np.uint8).astype(np.uint32)
    code = flat[:-2] | flat[1:-1] << np.uint32(8) | flat[2:] << np.uint32(16)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    ends = np.cumsum(size)
    inside = np.ones(len(bucket), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return bucket[inside].astype(np.int64), ends - size - 2 * np.arange(len(parts))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): bucket BUCKETS + k holds the letters in script k."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        total: dict[str, np.ndarray] = {}

        def settle() -> None:
            for lang, words in seen.items():
                grams = total.setdefault(lang, np.zeros(BUCKETS + OTHER + 1, np.int64))
                scripts = np.fromiter(map(script, words), np.int64, len(words))
                times = np.fromiter(words.values(), np.int64, len(words))
                letters = times * np.fromiter(map(len, words), np.int64, len(words))
                lettered = scripts >= 0
                bucket, start = trigrams(list(words))
                weight = np.repeat(np.where(lettered, times, 0), np.diff(np.append(start, len(bucket))))
                grams[:BUCKETS] += np.bincount(bucket, weight, BUCKETS).astype(np.int64)
                grams[BUCKETS:] += np.bincount(scripts[lettered], letters[lettered], OTHER + 1).astype(np.int64)
            seen.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, grams in total.items():
                at = np.flatnonzero(grams)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(grams[at], pa.int64())], names=["lang", "bucket", "n"])
            total.clear()

        for batch in batches:
            for text, lang in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(_WORD.findall(text))
                if len(seen) > HELD or sum(map(len, seen.values())) > REMEMBERED:
                    settle()
                    if len(total) > HELD:
                        yield from out()
        settle()
        yield from out()

    return arrow_map(docs.select("text", F.col("lang").cast("string").alias("lang")), work, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], grams: np.ndarray):
        self.langs = langs
        n, letters = grams[:, :BUCKETS].astype(float), grams[:, BUCKETS:].astype(float)
        self.logs = np.log((n + SMOOTH) / (n.sum(1, keepdims=True) + SMOOTH * BUCKETS)).T.astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
        uses = letters >= USES * letters.sum(1, keepdims=True)
        uses &= letters > 0
        none = ~uses.any(0)
        uses[:, none] = True
        self.closed = np.where(uses, 0, OUTSIDE).T.astype(np.float32)

    def __getstate__(self):
        return {"langs": self.langs, "logs": self.logs, "closed": self.closed}

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores a word, and its script."""
        scripts = np.fromiter(map(script, words), np.int64, len(words))
        bucket, start = trigrams(words)
        return np.add.reduceat(self.logs[bucket], start, axis=0) + self.closed[np.maximum(scripts, 0)], scripts


class Labeller:
    """Scores words through a bounded table, and labels them."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.used = 0
        self.table = np.zeros((1024, len(self.model.langs)), np.float32)

    def learn(self, new: set[str]) -> None:
        """Score words that aren't known yet; all are forgotten first when they are too many."""
        fresh = list(new.difference(self.at))
        if len(self.at) + len(fresh) > max(REMEMBERED, len(fresh)):
            self.clear()
            fresh = list(new)
        if not fresh:
            return
        while len(self.table) < self.used + len(fresh):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        rows, scripts = self.model.words(fresh)
        self.table[self.used : self.used + len(fresh)] = rows
        self.at.update(zip(fresh, np.where(scripts < 0, -1, np.arange(self.used, self.used + len(fresh))).tolist(), strict=True))
        self.used += len(fresh)

    def label(self, words: list[str]) -> np.ndarray:
        """The language of each learned word, -1 for words without a letter."""
        where = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        lettered = where >= 0
        out = np.full(len(words), -1)
        out[lettered] = viterbi(self.table[where[lettered]].astype(float))
        return out


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The labels with the largest sum of scores less switch for each change; of equals, staying and then the first language."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, [best]], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros(k), gain[:-1]]), axis=0)
    most = float((gain - low).max())
    # m stretches in other languages beside the best have m switches at least, so none pays if none gains a switch;
    # without the best they have m - 1, and can't pay if none gains half a switch or they lose in sum anyway
    others = np.delete(scores, best, axis=1)
    if k == 1 or most <= switch / 2 or (most <= switch and (others.max(1) - scores[:, best]).sum() <= 0):
        return np.full(n, best)
    # a step stays in each language, or comes from the best one at the cost of a switch
    rows = scores.tolist()
    value = rows[0]
    came: list[tuple[int, list[bool]] | None] = [None]
    for row in rows[1:]:
        top = max(value)
        moved = top - switch
        if min(value) >= moved:
            came.append(None)
            value = [v + s for v, s in zip(value, row, strict=True)]
        else:
            came.append((value.index(top), [v < moved for v in value]))
            value = [(v if v >= moved else moved) + s for v, s in zip(value, row, strict=True)]
    at = value.index(max(value))
    out = [at] * n
    for t in range(n - 1, 0, -1):
        step = came[t]
        if step and step[1][at]:
            at = step[0]
        out[t - 1] = at
    return np.array(out)


def fit(docs: DataFrame, max_langs: int = MAX_LANGS) -> Model:
    """A model of (text, lang) rows; rows without a lang, or with one that isn't learned, teach nothing."""
    rows = written(counts(docs.where(F.col("lang").isNotNull())), "trigrams")
    letters = rows.groupBy("lang").agg(F.sum(F.when(F.col("bucket") >= BUCKETS, F.col("n")).otherwise(0)).alias("n"))
    langs = sorted(r.lang for r in letters.orderBy(F.desc("n"), "lang").limit(max_langs).collect())
    found = rows.where(F.col("lang").isin(langs)).toArrow().to_pydict()
    dropped(rows)
    grams = np.zeros((len(langs), BUCKETS + OTHER + 1))
    place = {x: k for k, x in enumerate(langs)}
    np.add.at(grams, ([place[x] for x in found["lang"]], found["bucket"]), found["n"])
    return Model(langs, grams)


def held_out() -> Column:
    return crc_of("doc_id") % 4 == 2


def training(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text", "lang").where(~held_out())


def _ahead(texts: list[str], labeller: Labeller) -> Iterator[tuple[str, list[str]]]:
    """Texts with their words, which the labeller has learned, several texts at a time."""
    held: list[tuple[str, list[str]]] = []
    size = 0
    for k, text in enumerate(texts):
        held.append((text, _WORD.findall(text) if labeller.model.langs else []))
        size += len(text)
        if size >= AHEAD_CHARS or k == len(texts) - 1:
            labeller.learn(set().union(*(words for _, words in held)))
            yield from held
            held, size = [], 0


def predict(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """(d, lang_pred, score, spans): d holds the row, or its carried columns; spans of characters with their languages."""
    reach(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*carried or "*").alias("d"), text.alias("t"))
    kind = rows.schema["d"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        langs = shared.value.langs
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
        for batch in batches:
            pred, score, spans = [], [], []
            for text, words in _ahead(strings(batch.column(1)), labeller):
                labels = labeller.label(words)
                on = labels >= 0
                if not on.any():
                    pred.append("und"), score.append(0.0), spans.append([])
                    continue
                size = np.fromiter(map(len, words), np.int64, len(words))
                share = np.bincount(labels[on], size[on], len(langs))
                top = int(share.argmax())
                pred.append(langs[top])
                score.append(float(share[top] / share.sum()))
                place = labels[on]
                turns = np.flatnonzero(np.diff(place)) + 1
                if not len(turns):
                    spans.append([(0, len(text), langs[place[0]])])
                else:
                    begins = np.array([m.start() for m in _WORD.finditer(text)])[on]
                    edges = [0, *begins[turns].tolist(), len(text)]
                    spans.append([(a, b, langs[place[k]]) for a, b, k in zip(edges[:-1], edges[1:], [0, *turns.tolist()], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in x] for x in spans], pa.list_(span))], names=["d", "lang_pred", "score", "spans"])

    return arrow_map(rows, work, f"d {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def filter_language(docs: DataFrame) -> DataFrame:
    """The documents in which one language has at least MIN_SCORE of the letters, with their columns as they came."""
    kept = predict(docs, fit(training(docs))).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.select("d.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs.select("doc_id", "text"), fit(training(docs)), "doc_id")
    return out.select("d.doc_id", (crc_of("d.doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
