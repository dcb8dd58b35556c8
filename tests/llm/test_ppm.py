import math
import random
import zlib
from collections import Counter

import numpy as np

from barframe.llm.ppm import Values, fit, op2_lm_scoring, score


def tokens(text):
    return (text or "").encode().lower().split()


class Plain:
    """Prediction by partial matching with dictionaries, byte by byte; it shares nothing with the code."""

    order = 5
    #: All bytes but the six of white space; a space between words and an end byte count beside them.
    symbols = [b for b in range(256) if b not in b" \t\n\v\f\r"] + [0x20, 0x0A]

    def __init__(self, texts):
        self.n = Counter(w for t in texts for w in tokens(t))
        self.ends = len(texts)
        self.total, self.kinds = sum(self.n.values()) + self.ends, len(self.n) + (self.ends > 0)
        self.seen, self.worth = {}, {}
        for t in texts:
            s = self.bytes_of(t)
            for j in range(self.order, len(s)):
                for k in range(self.order + 1):
                    self.seen.setdefault(s[j - k : j], Counter())[s[j]] += 1

    def bytes_of(self, text):
        return b"\n" * self.order + b" ".join(tokens(text)) + b"\n"

    def chance(self, context, symbol):
        if (context, symbol) not in self.worth:
            chance, gone = 1.0, set()
            for k in range(len(context) + 1):
                left = {a: b for a, b in self.seen.get(context[k:], {}).items() if a not in gone}
                if left:
                    t = sum(left.values()) + len(left)
                    if symbol in left:
                        chance *= left[symbol] / t
                        break
                    chance *= len(left) / t
                    gone |= set(left)
            else:
                chance /= len(self.symbols) - len(gone)
            self.worth[context, symbol] = chance
        return self.worth[context, symbol]

    def text(self, t):
        w, s = tokens(t), self.bytes_of(t)
        base = [math.log10((self.n[x] + 1) / (self.total + self.kinds + 1)) for x in w] + [math.log10((self.ends + 1) / (self.total + self.kinds + 1))]
        worth = math.fsum(math.log10(self.chance(s[j - self.order : j], s[j])) for j in range(self.order, len(s)))
        return len(w) + 1, sum(x in self.n for x in w) + (self.ends > 0), sum(base), worth


def agree(got, docs):
    model = Plain([t for k, t in docs if zlib.crc32(str("" if k is None else k).encode()) % 7 != 2])
    want = Counter()
    for k, t in docs:
        a, b, c, d = model.text(t)
        want[k, zlib.crc32(str("" if k is None else k).encode()) % 7 == 2, a, b, model.total, round(c, 5), round(d, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    return model


def frame(spark, docs):
    from pyspark.sql import functions as F

    from barframe.llm.shared import crc_of

    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("held_out", crc_of("doc_id") % 7 == 2).select("doc_id", "text", F.col("held_out"))


def fixture():
    r = random.Random(6)
    syllables = ["th", "er", "on", "é", "st", "a", "日", "\0", "x" * 30]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    docs = [(k, " ".join(word() for _ in range(r.randrange(60)))) for k in range(60)]
    return docs + [(900, None), (901, ""), (None, "The end"), (7, "twice the same"), (7, "twice \n the  same"), (902, "long " * 20000 + "y" * 5000), (903, " \t")]


def test_against_plain_model(spark):
    docs = fixture()
    df = frame(spark, docs).repartition(3)
    agree(score(df, fit(df)).collect(), docs)


def test_tables_change_nothing(spark, monkeypatch):
    """The same scores whether grams and words are in the broadcast tables or not, also for long and repeated words."""
    docs = [*fixture(), *((k, " ".join(["é" * 40, "new", "new", f"w{k % 9}", "é" * 40])) for k in range(1000, 1030))]
    df = frame(spark, docs)
    whole = sorted((str(r.doc_id), round(r.score, 6), round(r.base_score, 6), r.n_known) for r in score(df, fit(df)).collect())
    for size in (0, 3):
        monkeypatch.setattr("barframe.llm.ppm.TABLE", size)
        monkeypatch.setattr("barframe.llm.ppm.WORDS", size)
        got = score(df, fit(df)).collect()
        assert sorted((str(r.doc_id), round(r.score, 6), round(r.base_score, 6), r.n_known) for r in got) == whole
    agree(got, docs)


def test_all_contexts_count(spark):
    """Many contexts, most seen once: the texts held out repeat the rarest ones."""
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789éøñß"
    known = ["".join(r.choice(letters) for _ in range(12)) for _ in range(21000)]
    docs = [(k, " ".join(known[k * 300 : k * 300 + 300])) for k in range(70)]
    docs += [(k, " ".join("=" + w[1:] for w in r.sample(known, 40))) for k in range(1000, 1020) if zlib.crc32(str(k).encode()) % 7 == 2]
    df = frame(spark, docs)
    m = agree(score(df, fit(df)).collect(), docs)
    assert sum(len(seen) for context, seen in m.seen.items() if len(context) > 2) > 300_000


def test_chances_sum_to_one():
    m = Plain(["a b ab abc", "b ba", "ab ab ab"])
    for context in (b"\n" * 5, b"a b a", b"zzzzz", b"\n\n\n\na", b"b ab "):
        assert abs(sum(m.chance(context, s) for s in m.symbols) - 1) < 1e-12


def test_values():
    r = np.random.default_rng(1)
    codes = np.unique(r.integers(0, 1 << 48, 5000))
    r.shuffle(codes)
    worth = r.normal(size=len(codes))
    for n in (0, 1, 7, len(codes)):
        got, known = Values(codes[:n], worth[:n]).of(codes)
        assert known.tolist() == [True] * n + [False] * (len(codes) - n) and (got[:n] == worth[:n]).all() and (got[n:] == 0).all()


def test_word_order_counts(spark, sf):
    """Contexts reach over spaces: a text is worth more than its words shuffled."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    df = frame(spark, [(r.doc_id, r.text) for r in docs.collect()])
    model = fit(df)
    r = random.Random(3)
    held = [x for x in df.where(F.col("held_out")).collect() if len(tokens(x.text)) >= 30]
    mixed = spark.createDataFrame([(x.doc_id, " ".join(r.sample(x.text.split(), len(x.text.split()))), True) for x in held], df.schema)
    one, two = ({x.doc_id: x.score for x in score(d, model).collect()} for d in (df, mixed))
    assert len(held) > 5 and sum(one[k] > two[k] for k in two) > 0.8 * len(two)


def test_empty_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = frame(spark, [(1, "a")])
    assert score(df.limit(0), fit(df)).collect() == []
    none = frame(spark, [(k, "a b") for k in range(50)]).where("held_out")
    assert all(math.isclose(r.score, 4 * math.log10(1 / 252)) and r.n_known == 0 for r in score(none, fit(none)).collect())
    more = df.select("*", *(F.lit(5).alias(c) for c in ("row", "score", "words", "worth", "code")))
    assert [r.score for r in score(more, fit(more)).collect()] == [r.score for r in score(df, fit(df)).collect()]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op2_lm_scoring(spark, sf).collect()
    agree(got, docs)
    held = [r for r in got if r.held_out]
    assert held and all(r.score < 0 for r in held)


def test_held_out_beats_base(spark):
    """The base gives all unknown words one chance each, whatever their number, and so is no distribution; it is beaten even so."""
    held = [r for r in op2_lm_scoring(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in held) > 0.98 * sum(r.base_score for r in held)
