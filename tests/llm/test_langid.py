import itertools
import math
import random
import unicodedata
from collections import Counter

import numpy as np

from barframe.llm.langid import SCRIPTS, SWITCH, filter_language, fit, op9_language_id, predict, script, training, viterbi


def test_viterbi_against_all_labellings():
    r = np.random.default_rng(1)
    for _ in range(200):
        n, k = r.integers(1, 7), r.integers(1, 4)
        s = r.normal(0, 6, (n, k))
        worth = lambda p, s=s: sum(s[t, x] for t, x in enumerate(p)) - SWITCH / 2 * sum(a != b for a, b in itertools.pairwise(p))
        assert np.isclose(worth(viterbi(s, SWITCH / 2)), max(worth(p) for p in itertools.product(range(k), repeat=n)))


def test_scripts():
    assert [script(w) for w in ("word", "été", "слово", "λόγος", "漢字", "かな", "½")] == [0, 0, 2, 1, 11, 10, -1]


def corpus(spark):
    r = random.Random(4)
    words = {"aa": ["thon", "reth", "eand", "ing"], "bb": ["quoi", "eaux", "leur", "dans"], "ру": ["слово", "дело", "мир"]}
    text = lambda x, n: " ".join(r.choice(words[x]) for _ in range(n))
    rows = [(i, text(x, 40), x, 1) for i, x in enumerate(itertools.islice(itertools.cycle(words), 120))]
    mixed = text("aa", 30) + ". " + text("bb", 20) + " " + text("ру", 5)
    rows += [(1000, mixed, None, 1), (1001, None, "aa", 1), (1002, "12 !! ½", "bb", 1), (1003, "", None, 1), (None, text("bb", 9), None, 1), (1004, text("aa", 60000), None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), mixed


def test_predict(spark):
    df, mixed = corpus(spark)
    model = fit(training(df))
    assert model.langs == ["aa", "bb", "ру"]
    got = {r.d.doc_id: r for r in predict(df, model).collect()}
    assert all(got[r.doc_id].lang_pred == r.lang for r in df.collect() if r.doc_id is not None and r.doc_id < 1000)
    m = got[1000]
    assert m.lang_pred == "aa" and 0 < m.score < 1 and [s.lang for s in m.spans] == ["aa", "bb", "ру"]
    assert m.spans[0].start == 0 and m.spans[-1].end == len(mixed) and all(a.end == b.start for a, b in itertools.pairwise(m.spans))
    assert {got[k].lang_pred for k in (1001, 1002, 1003)} == {"und"} and got[None].lang_pred == "bb" and got[1004].score == 1
    kept = filter_language(df)
    assert kept.columns == df.columns and {1001, 1002, 1003} & {r.doc_id for r in kept.collect()} == set() and kept.count() == df.count() - 3


def test_empty_and_unlabelled(spark):
    df, _ = corpus(spark)
    assert predict(df.limit(0), fit(training(df))).collect() == []
    model = fit(training(df.limit(0)))
    assert model.langs == [] and {r.lang_pred for r in predict(df, model).collect()} == {"und"}


class Plain:
    """Trigrams, scripts and labellings in the plainest way; nothing but the constants is shared with the code."""

    def __init__(self, rows):
        self.grams, self.letters = {}, {}
        for text, lang in rows:
            if lang is not None and (words := self.words(text)):
                self.grams.setdefault(lang, Counter()).update(g for w in words for g in self.keys(w))
                self.letters.setdefault(lang, Counter()).update({k: sum(len(w) for w in words if self.script(w) == k) for k in {self.script(w) for w in words}})
        self.langs = sorted(self.grams)

    def words(self, text):
        out, now = [], ""
        for c in (text or "") + " ":
            if c.isalpha() or now and unicodedata.category(c)[0] == "M":
                now += c
            elif now:
                out.append(now)
                now = ""
        return out

    def keys(self, word):
        b = f" {word.lower()} ".encode()
        return [((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 0x9E3779B1 % (1 << 32)) >> 16 for i in range(len(b) - 2)]

    def script(self, word):
        n = Counter()
        for c in word:
            if c.isalpha():
                n[next((k for k, (_, rs) in enumerate(SCRIPTS) if any(a <= ord(c) <= b for a, b in rs)), len(SCRIPTS))] += 1
        return min(n, key=lambda k: (-n[k], k))

    def row(self, word):
        out = []
        for x in self.langs:
            total = sum(self.grams[x].values())
            s = sum(math.log((self.grams[x][g] + 0.1) / (total + 0.1 * 65536)) for g in self.keys(word))
            k = self.script(word)
            used = lambda y, k=k: self.letters[y][k] > 0 and self.letters[y][k] >= 0.001 * sum(self.letters[y].values())
            out.append(s if used(x) or not any(map(used, self.langs)) else s - 1e4)
        return out

    def predict(self, text):
        words = self.words(text)
        if not words or not self.langs:
            return "und", 0.0
        value, paths = None, None
        for w in words:
            row = self.row(w)
            if value is None:
                value, paths = row, [[k] for k in range(len(row))]
                continue
            top = max(range(len(row)), key=value.__getitem__)
            new = []
            for k in range(len(row)):
                at = k if value[k] >= value[top] - SWITCH else top
                new.append((value[at] - SWITCH * (at != k) + row[k], paths[at] + [k]))
            value, paths = [v for v, _ in new], [p for _, p in new]
        share = Counter()
        for w, k in zip(words, paths[max(range(len(value)), key=value.__getitem__)], strict=True):
            share[k] += len(w)
        top = max(sorted(share), key=share.__getitem__)
        return self.langs[top], share[top] / sum(share.values())


def test_against_plain(spark, sf):
    df, _ = corpus(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").selectExpr("doc_id + 10000 AS doc_id", "text", "lang").limit(150)
    marks = [(2000, "हिन्दी में लिखा हुआ", "hi"), (2001, "भाषा हिन्दी ภาษาไทย", None), (2002, "ภาษาไทย นี้เป็น", "th"), (2004, "e\u0301te\u0301 word ½", None)]
    rows = df.where("doc_id < 1004").select("doc_id", "text", "lang").unionByName(docs).unionByName(spark.createDataFrame(marks, docs.schema))
    plain = Plain([(r.text, r.lang) for r in training(rows).collect()])
    got = {r.d.doc_id: (r.lang_pred, r.score) for r in predict(rows, fit(training(rows))).collect()}
    for r in rows.collect():
        lang, score = plain.predict(r.text)
        assert got[r.doc_id][0] == lang and math.isclose(got[r.doc_id][1], score), r.doc_id


def test_ties_and_many_labels(spark):
    """Of equal shares the first by name; more labels than are learned don't stop the job."""
    rows = [(k, t, x) for k, (t, x) in enumerate([("αααα ββββ", "gr"), ("слово мирр", "ру"), ("αααα мирр", None), ("мирр αααα", None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = predict(df, fit(df)).orderBy("d.doc_id").collect()
    assert [(r.lang_pred, r.score, len(r.spans)) for r in got[2:]] == [("gr", 0.5, 2)] * 2
    many = [(k, "word " * (k % 7 + 1), f"x{k:03d}") for k in range(300)]
    model = fit(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    assert len(model.langs) == 256 and all(f"x{k:03d}" in model.langs for k in range(300) if k % 7 > 1)
    assert fit(df, max_langs=1).langs == ["ру"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in op9_language_id(spark, sf).collect()]
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
