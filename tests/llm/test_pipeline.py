import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from barframe.llm import jaccard, langid, packing, quality
from tests.llm.test_jaccard import brute
from tests.llm.test_native import plain


def test_stages(spark, sf):
    """Each stage against a plain reading of what its predecessor kept."""
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept}
    assert {r.doc_id for r in one.collect()} == kept
    assert all((n := plain(rows[k].text))[0] >= 10 and 100 * n[4] <= 20 * n[0] for k in kept)
    two = corpus_pipeline.language_id(spark, one, sf)
    judged = langid.predict(one, langid.fit(langid.training(one))).collect()
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == {r.d.doc_id for r in judged if r.lang_pred != "und" and r.score >= langid.MIN_SCORE}
    three = corpus_pipeline.ngram_jaccard_join(spark, two, sf)
    groups = brute([(r.doc_id, r.text) for r in two.collect()])
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == sorted({c for _, c in groups.values()})
    got = corpus_pipeline.pack(spark, three, sf).collect()
    t = packing.Tokenizer(packing.public_path("byte_bpe_50k.json"))
    want = {r.doc_id: len(np.frombuffer(t.ids(r.text), "<u4")) + 1 for r in three.collect()}
    assert {r.doc_id: r.doc_tokens for r in got} == want and sum(r.length for r in got) == sum(want.values())
    whole = corpus_pipeline.run(spark, sf).collect()
    drop = lambda rs: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rs)
    assert drop(whole) == drop(got)
    assert jaccard.WORDS == 5


def test_entry(spark, sf):
    q, o = entry.queries(), entry.oracle_sql()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert "pipeline" in q and set(o) <= set(q)


def edge_cases(spark):
    prose = " ".join(f"word{k % 97} und{k} le{k * 7}" for k in range(60))
    rows = [
        (1, prose, "en", "a", 5, "x"), (1, prose, "en", "a", 5, "x"), (2, prose, None, None, 5, "x"), (None, prose + " more", "en", "a", None, None),
        (3, None, "en", "a", 5, "x"), (4, "", None, "a", 5, "x"), (5, " \t\n", "en", "a", 5, "x"), (6, "1 2 3 4 5 6 7 8 9 10 11 12", "en", "a", 5, "x"),
        (7, " ".join(f"t{k}x" for k in range(60_000)), "en", "a", 5, "x"), (8, " ".join(f"other{k}" for k in range(40)), "en", "a", 5, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, score string").repartition(3)


def test_edge_cases(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, stage by stage and through all."""
    docs, sf = edge_cases(spark), "unused"
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "1", "2", "6", "7", "8", "None"]
    two = corpus_pipeline.language_id(spark, docs, sf)
    assert two.columns == docs.columns and not {3, 4, 5, 6} & {r.doc_id for r in two.collect()}
    three = corpus_pipeline.ngram_jaccard_join(spark, docs, sf)
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == [1, 3, 4, 5, 6, 7, 8]
    four = corpus_pipeline.pack(spark, docs, sf).collect()
    assert sorted(r.doc_tokens for r in four if r.doc_id in (3, 4)) == [1, 1] and {r.doc_id for r in four} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    whole = docs
    for _, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / f"{stage.__name__}.parquet")
        stage(spark, whole, sf).write.parquet(path)
        whole = spark.read.parquet(path)
    assert {r.doc_id for r in whole.collect()} == {1, 7, 8}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []
