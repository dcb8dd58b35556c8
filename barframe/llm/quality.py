"""Operator 3, quality rules: fixed base rules, then thresholds that the corpus sets.

DataFrame functions only. One pass turns each text into integer features and the
features into ratios, whole numbers from 0 to 1000. A sketch of a ratio is its histogram
over these 1001 values, so a quantile is right to a thousandth (of a mean word length, to
a tenth of a character). Sketches merge by adding counts: partial aggregation builds them
before the shuffle, and a hot source costs as many rows as any other. From the sketches of
a language and source, of the language and of all come quantiles, and from these a cutoff:

    q50 + max(STEP, FENCE * (q50 - q25)) + min(STEP, q95 - q50)

STEP is what a ratio may vary by where most texts have the same. The median and the
spread below it stand as long as half of the group is sound, and the tail adds a step at
most, so junk doesn't lift its own cutoff. The fewer documents a group has, the more its
cutoff is drawn to its parent's, by n * n to TRUST * TRUST; there is no size at which that
switches. A document with a ratio over its group's cutoff is rejected.

Null or empty text: no words, base_failed, not kept. A null language or source is a
group of its own. Repeated rows count as often as they come. An empty table gives an
empty result. Without any document that passes the base rules, cutoffs are 1000. Input
columns besides those used pass through filter_quality unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, dropped, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Documents at which a group's own cutoff weighs as much as its parent's, and the most that count.
TRUST, MOST = 50, 10_000
FENCE = 6
RATIOS = ("symbol", "dup", "repeat", "word_len")
#: Thousandths; of a mean word length, tenths of a character.
STEP = {"symbol": 20, "dup": 150, "repeat": 100, "word_len": 20}
#: What a ratio divides, and its scale: thousandths, for the mean length of a word tenths of a character.
_PARTS = {"symbol": ("n_symbols", "word_chars", 1000), "dup": ("n_dup_lines", "n_lines", 1000), "repeat": ("n_repeat_words", "n_words", 1000), "word_len": ("word_chars", "n_words", 10)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for the row, also where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more."""

    def covered(hashes: Column) -> Column:
        size = F.size(hashes)
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(p, k - 1)["h"] == x["h"]).otherwise(False)
                after = F.when(k < size - 1, F.get(p, k + 1)["h"] == x["h"]).otherwise(False)
                return before | after

            return F.sort_array(F.transform(F.filter(p, twin), lambda x: x["i"]))

        def spread(s: Column) -> Column:
            zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
            return F.aggregate(s, zero, step, lambda a: a["n"])

        return F.when(size == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(_let(_let(pairs, starts), spread))

    def windows(h: Column) -> Column:
        """A hash for each window: the array zipped with its own tails, cut to the same length."""
        n = F.size(h) - (WINDOW - 1)
        return F.transform(F.arrays_zip(*(F.slice(h, k + 1, n).alias(f"w{k}") for k in range(WINDOW))), lambda x: F.xxhash64(x))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(_let(hashed, windows), covered))


def _without(text: Column, chars: str, by: str = "") -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def features(text: Column) -> dict[str, Column]:
    """Integer features of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    spaced = _without(text, "\t\n\x0b\f\r", " ")
    words = F.array_remove(F.split(spaced, " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    return {
        "by_words": _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))),
        "by_lines": _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))),
        "word_chars": F.length(F.replace(spaced, F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, "#*$%&|<>"))).cast("long"),
    }


def _ratio(part: Column, whole: Column, scale: int) -> Column:
    """scale * part / whole as a whole number, 0 to 1000."""
    value = F.when(whole > 0, F.least(F.lit(1000), scale * part / whole)).otherwise(0)
    return F.floor(value).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(d, lang, source, counts, ratios): d holds the row as it came."""
    own = lambda n: (F.col(f"`{n}`").cast("string") if n in docs.columns else F.lit(None).cast("string"))
    raw = docs.select(F.struct("*").alias("d"), own("lang").alias("g_lang"), own("source").alias("g_source"), *(v.alias(k) for k, v in features(own("text")).items()))
    c = F.col
    flat = raw.select("d", "g_lang", "g_source", c("by_words.n").cast("long").alias("n_words"), "word_chars", "n_symbols", c("by_lines.d").cast("long").alias("n_dup_lines"), c("by_words.r").cast("long").alias("n_repeat_words"), c("by_lines.n").cast("long").alias("n_lines"))
    ratios = [_ratio(c(_PARTS[k][0]), c(_PARTS[k][1]), _PARTS[k][2]).alias(f"r_{k}") for k in RATIOS]
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    return flat.select("*", failed.alias("base_failed"), *ratios)


def sketches(rows: DataFrame) -> DataFrame:
    """(g_lang, g_source, ratio, value, n): the histograms of each language and source.

    Base failures count 0, so junk doesn't set the thresholds, but its groups are known.
    """
    each = F.posexplode(F.array(*(F.col(f"r_{k}") for k in RATIOS))).alias("ratio", "value")
    long = rows.select("g_lang", "g_source", (~F.col("base_failed")).cast("long").alias("one"), each)
    return long.groupBy("g_lang", "g_source", "ratio", "value").agg(F.sum("one").alias("n"))


def cutoffs(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio, n, cut): the cutoffs that the groups have by themselves, null without a document; from at most 1001 counts a ratio."""
    merged = hist.groupBy(*keys, "ratio", "value").agg(F.sum("n").alias("n"))
    per = merged.groupBy(*keys, "ratio").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("h"), F.sum("n").alias("n"))

    def quantile(percent: int) -> Column:
        """The least value that at least percent % of the group do not exceed."""
        step = lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when((a["q"] < 0) & (a["c"] + x["n"] > 0) & (100 * (a["c"] + x["n"]) >= percent * F.col("n")), x["value"]).otherwise(a["q"]).alias("q"))
        return F.aggregate("h", F.struct(F.lit(0).cast("long").alias("c"), F.lit(-1).cast("long").alias("q")), step, lambda a: a["q"])

    q = per.select(*keys, "ratio", "n", quantile(25).alias("q25"), quantile(50).alias("q50"), quantile(95).alias("q95"))
    step = F.element_at(F.array(*(F.lit(STEP[k]).cast("long") for k in RATIOS)), F.col("ratio") + 1)
    cut = F.col("q50") + F.greatest(step, FENCE * (F.col("q50") - F.col("q25"))) + F.least(step, F.col("q95") - F.col("q50"))
    return q.select(*keys, "ratio", "n", F.when(F.col("n") > 0, cut).alias("cut"))


def _drawn(own: DataFrame, parent: Column) -> DataFrame:
    """own with cut drawn to the parent's cutoff."""
    w = F.least("n", F.lit(MOST))
    both = F.expr(f"(least(n, {MOST}) * least(n, {MOST}) * cut + {TRUST * TRUST} * parent) div (least(n, {MOST}) * least(n, {MOST}) + {TRUST * TRUST})")
    return own.withColumn("parent", parent).withColumn("cut", F.when(w > 0, both).otherwise(F.col("parent"))).drop("parent")


def thresholds(hist: DataFrame) -> DataFrame:
    """(g_lang, g_source, t_<ratio>...): a row for each language and source; hist is read four times."""
    top = {r.ratio: r.cut for r in cutoffs(hist, []).collect()}  # one row a ratio
    whole = F.element_at(F.array(*(F.lit(1000 if top.get(k) is None else top[k]).cast("long") for k in range(len(RATIOS)))), F.col("ratio") + 1)
    langs = _drawn(cutoffs(hist, ["g_lang"]), whole).select(F.col("g_lang").alias("p_lang"), F.col("ratio").alias("p_ratio"), F.col("cut").alias("p_cut"))
    own = cutoffs(hist, ["g_lang", "g_source"])
    all_ = _drawn(own.join(langs, own["g_lang"].eqNullSafe(langs["p_lang"]) & (own["ratio"] == langs["p_ratio"])), F.col("p_cut"))
    cut = lambda k: F.max(F.when(F.col("ratio") == RATIOS.index(k), F.col("cut"))).alias(f"t_{k}")
    return all_.groupBy("g_lang", "g_source").agg(*(cut(k) for k in RATIOS))


def judged(rows: DataFrame) -> DataFrame:
    """measured() rows, written already, with kept and the thresholds that held.

    The table of thresholds has no hint: Spark broadcasts it only while it is small.
    """
    hist = written(sketches(rows), "sketches")
    t = written(thresholds(hist), "thresholds").withColumnsRenamed({"g_lang": "j_lang", "g_source": "j_source"})
    dropped(hist)
    out = rows.join(t, rows["g_lang"].eqNullSafe(t["j_lang"]) & rows["g_source"].eqNullSafe(t["j_source"]), "left")
    within = F.lit(True)
    for k in RATIOS:
        within = within & (F.col(f"r_{k}") <= F.col(f"t_{k}"))
    return out.select(*rows.columns, *(f"t_{k}" for k in RATIOS), (~F.col("base_failed") & within).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, features, base_failed, the thresholds and kept."""
    slim = measured(docs).withColumn("d", F.struct("d.doc_id"))
    out = judged(written(slim, "quality"))
    return out.select("d.doc_id", *COUNTS, *(f"r_{k}" for k in RATIOS), *(f"t_{k}" for k in RATIOS), "base_failed", "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they came."""
    return judged(written(measured(docs), "quality")).where("kept").select("d.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


_W = "regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+')"


def _oracle() -> str:
    ratio = lambda k: f"CASE WHEN {_PARTS[k][1]} > 0 THEN least(1000, ({_PARTS[k][2]} * {_PARTS[k][0]}) // {_PARTS[k][1]}) ELSE 0 END"
    levels = {"own": "lang, source", "langs": "lang", "whole": "1"}
    step = "CASE k " + " ".join(f"WHEN '{k}' THEN {STEP[k]}" for k in RATIOS) + " END"
    tables = "".join(
        f"""
{name} AS (SELECT {by.replace("1", "0 AS g")}, k, max(n) AS n, q50 + greatest({step}, {FENCE} * (q50 - q25)) + least({step}, q95 - q50) AS cut
  FROM (SELECT {by.replace("1", "1 AS g")}, k, max(n) AS n, min(r) FILTER (100 * i >= 25 * n) AS q25, min(r) FILTER (100 * i >= 50 * n) AS q50, min(r) FILTER (100 * i >= 95 * n) AS q95
        FROM (SELECT *, row_number() OVER (PARTITION BY {by}, k ORDER BY r) AS i, count(*) OVER (PARTITION BY {by}, k) AS n FROM x) GROUP BY ALL)
  GROUP BY ALL),"""
        for name, by in levels.items()
    )
    w = lambda a: f"(least(coalesce({a}.n, 0), {MOST}) * least(coalesce({a}.n, 0), {MOST}))"
    drawn = lambda a, parent: f"(({w(a)} * coalesce({a}.cut, 0) + {TRUST * TRUST} * {parent}) // ({w(a)} + {TRUST * TRUST}))"
    held = lambda k: f"max(cut) FILTER (k = '{k}')"
    t = f"""
x AS (SELECT lang, source, k, r FROM (UNPIVOT (SELECT lang, source, {", ".join(f"r_{k} AS {k}" for k in RATIOS)} FROM f WHERE NOT base_failed) ON {", ".join(RATIOS)} INTO NAME k VALUE r)),{tables}
g AS (SELECT DISTINCT f.lang, f.source, u.k FROM f, (SELECT unnest({list(RATIOS)}) AS k) u),
t AS (SELECT lang, source, {", ".join(f"{held(k)}::BIGINT AS t_{k}" for k in RATIOS)} FROM (
  SELECT g.lang, g.source, g.k, {drawn("own", drawn("langs", "coalesce(whole.cut, 1000)"))} AS cut FROM g
  LEFT JOIN own ON own.k = g.k AND own.lang IS NOT DISTINCT FROM g.lang AND own.source IS NOT DISTINCT FROM g.source
  LEFT JOIN langs ON langs.k = g.k AND langs.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN whole ON whole.k = g.k) GROUP BY lang, source)"""
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter({_W}, lambda x: x <> '') AS w,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words,
       length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
       len(l)::BIGINT AS n_lines
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
      {", ".join(f"({ratio(k)})::BIGINT AS r_{k}" for k in RATIOS)} FROM c),{t}
SELECT f.doc_id, {", ".join(f"f.{k}" for k in COUNTS)}, {", ".join(f"f.r_{k}" for k in RATIOS)}, {", ".join(f"t.t_{k}" for k in RATIOS)}, f.base_failed,
       (NOT f.base_failed AND {" AND ".join(f"f.r_{k} <= t.t_{k}" for k in RATIOS)}) AS kept
FROM f JOIN t ON t.lang IS NOT DISTINCT FROM f.lang AND t.source IS NOT DISTINCT FROM f.source
"""


ORACLE_SQL = _oracle()
