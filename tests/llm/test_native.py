import random
import re
from collections import Counter

import duckdb
import pytest

from barframe.llm import chat, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def texts():
    r = random.Random(2)
    out = [None, "", " \t\n\x0b", "one", "a b c d e", "a b c d e " * 2, "a a a a a a a", "x\ny\nx\n\n\n y", "#$% é日\U0001f600 <|>", "w " * 30000]
    for _ in range(120):
        n = r.randrange(1, 80)
        out.append("".join(r.choice(["al", "be", "é", "#x"]) + r.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(n)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], f"s{k % 2}", 7, "x") for k, t in enumerate(texts())]
    rows += [rows[20], (None, "null id text of more than ten words so that the base rule lets it go on", "en", None, 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept string")


def test_quality_counts(docs):
    want = Counter((r.doc_id, *plain(r.text)) for r in docs.collect())
    got = quality.quality_rules(docs).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept <= (not r.base_failed)


def test_quality_filter(spark, docs):
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns
    good = Counter(r.doc_id for r in quality.quality_rules(docs).collect() if r.kept)
    assert Counter(r.doc_id for r in kept.collect()) == good
    assert quality.filter_quality(docs.limit(0)).collect() == []


def kinds():
    """A maker of texts for each kind: plain, and one that is far out in each ratio."""
    r = random.Random(1)
    word = lambda n=5: "".join(r.choice("abcdefgh") for _ in range(n))
    line = lambda n=40, size=5: " ".join(word(size) for _ in range(n))

    def dup():
        lines = [line(4) for _ in range(18)]
        return "\n".join(x for k in range(6) for x in (*lines[3 * k : 3 * k + 3], lines[k]))

    def repeat():
        phrase = line(r.randrange(14, 17))
        return f"{line(90)} {phrase} {line(80)} {phrase}"

    return {
        "plain": line,
        "symbol": lambda: " ".join(f"{word()} {'|' * r.randrange(1, 4)}" for _ in range(40)),
        "dup": dup,
        "repeat": repeat,
        "word_len": lambda: line(40, 9),
    }


def test_quality_adapts(spark):
    """In each ratio, a text that is far out goes, but stays in a source where all are like it."""
    make = kinds()
    rows = [(1000 * k + n, make[kind](), "en", kind) for k, kind in enumerate(make) for n in range(200)]
    rows += [(9000 + 10 * k + n, make[kind](), "en", "plain") for k, kind in enumerate(make) if k for n in range(3)]
    got = {x.doc_id: x for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(x.base_failed for x in got.values())
    assert all(x.kept for k, x in got.items() if k < 9000) and not any(x.kept for k, x in got.items() if k >= 9000)
    for k, kind in enumerate(quality.RATIOS, 1):
        assert got[9000 + 10 * k][f"r_{kind}"] > got[0][f"t_{kind}"] and len({got[1000 * n][f"t_{kind}"] for n in range(5)}) > 1


def test_quality_junk_does_not_lift_its_cutoff(spark):
    """Up to nearly half of a source may be junk; in a small source, its language helps."""
    make = kinds()
    rows = [(k, make["plain"](), "en", "good") for k in range(300)]
    rows += [(1000 + k, make["symbol" if k % 9 < 4 else "plain"](), "en", "dirty") for k in range(300)]
    rows += [(2000 + k, make["symbol" if k == 0 else "plain"](), "en", "small") for k in range(3)] + [(3000, make["symbol"](), "en", None)]
    got = {x.doc_id: x.kept for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {k: "|" not in t for k, t, _, _ in rows}


def test_quality_is_native(docs):
    plan = quality.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    t = sharding.lookup_table(names, 101)
    share = Counter(t)
    assert set(share) == set(range(7)) and max(share.values()) - min(share.values()) <= 1
    # step by step, with whole permutations
    order = {k: [(sharding._number(f"offset:{s}") % 101 + j * (sharding._number(f"skip:{s}") % 100 + 1)) % 101 for j in range(101)] for k, s in enumerate(names)}
    assert all(sorted(p) == list(range(101)) for p in order.values())
    slow = {}
    while len(slow) < 101:
        for k in range(7):
            if len(slow) < 101:
                slow[next(x for x in order[k] if x not in slow)] = k
    assert [slow[x] for x in range(101)] == t
    fewer = sharding.lookup_table(names[:-1], 101)
    moved = sum(names[a] != names[b] for a, b in zip(t, fewer, strict=True) if names[a] != "s6")
    assert moved < 30
    for bad in (([], 101), (["a", "a"], 101), (["a"], 100), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_place(spark, docs, sf, tmp_path):
    names = ["a", "b", "c"]
    got = sharding.place(docs.withColumnRenamed("n_words", "slot"), ["doc_id"], names, 101).collect()
    assert len(got) == docs.count()
    table = sharding.lookup_table(names, 101)
    for r in got:
        key = "" if r.d.doc_id is None else str(r.d.doc_id)
        assert r.slot == sharding._number(key) % 101 and r.shard == names[table[r.slot]] and r.d.slot == 7
    assert sharding.place(docs.limit(0), ["doc_id"], names, 101).collect() == []
    sharding.write_shards(docs, ["doc_id"], names, str(tmp_path / "out"), 101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    q = sharding.op4_sharding(spark, sf).collect()
    table = sharding.lookup_table([f"shard-{k:03d}" for k in range(sharding.SHARDS)])
    assert len(q) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.slot == sharding._number(str(r.doc_id)) % sharding.SLOTS and r.shard == f"shard-{table[r.slot]:03d}" for r in q)


def test_chat(spark, sf):
    rows = [(1, 1, "assistant", "A1", 0), (1, 0, "user", "Q", 0), (1, 2, "user", "Q2", 0), (1, 3, "assistant", "A2", 0), (1, 4, "user", "bye", 0), (2, 0, "user", "only", 0), (3, 0, "assistant", None, 0), (3, None, None, "é", 0), (None, 0, "assistant", "x", 0), (4, 0, "user", "u", 0), (4, 0, "user", "u", 0), (4, 1, "assistant", "same", 0), (4, 2, "assistant", "same", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt int")
    got = {r.conv_id: r for r in chat.format_pairs(chat.pairs(df)).collect()}
    assert set(got) == {1, 3, 4}
    t = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    one = got[1]
    assert one.n_prompt_turns == 3 and one.prompt == t("user", "Q") + t("assistant", "A1") + t("user", "Q2")
    assert one.chosen == t("assistant", "A2") + t("user", "bye") and one.rejected == t("assistant", "A1") + t("user", "bye")
    assert "".join(one.chosen[s.start : s.end] for s in one.chosen_mask) == one.chosen
    assert "".join(one.chosen[s.start : s.end] for s in one.chosen_mask if s.train) == "A2<|im_end|>\n"
    assert got[3].prompt == t("", "é") + t("assistant", "") and got[3].chosen == "" == got[3].rejected and got[3].chosen_mask == []
    assert got[4].n_prompt_turns == 4 and got[4].chosen == ""
    assert chat.format_pairs(chat.pairs(df.limit(0))).collect() == []


def test_chat_is_native_and_takes_long_conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.format_pairs(chat.pairs(df))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    got = out.first()
    assert got.n_prompt_turns == 19_999 and got.chosen == "<|im_start|>assistant\nt19999<|im_end|>\n" and got.rejected == "<|im_start|>assistant\nt19997<|im_end|>\n" and got.prompt.count("<|im_start|>") == 19_999


def test_against_sql(spark, sf):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for f, sql in ((quality.op3_quality_rules, quality.ORACLE_SQL), (sharding.op4_sharding, sharding.ORACLE_SQL), (chat.op10_chat_formatting, chat.ORACLE_SQL)):
        df = f(spark, sf)
        want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, df.collect())) == Counter(want)
