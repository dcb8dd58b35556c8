import pytest

from barframe import keys
from barframe.errors import BarframeError
from barframe.functions import features as fx
from barframe.functions import predicate as p
from barframe.operators import backtest, index, overlaps, predicates, reads
from barframe.operators import sequences as seq

T, M = 1706745600000, 60000
SIX = [(T + k * M, v) for k, v in enumerate((10, 15, 20, 30, 40, 50))]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(*r, "2024-02") for r in SIX], "ts long, value long, part string")


def code(f):
    with pytest.raises(BarframeError) as e:
        f()
    return e.value.code


def ts(df):
    return [r.ts for r in df.collect()]


def test_predicates_on_six(six):
    all_ = (T, T + 10 * M)
    assert ts(predicates.find(six, p.legacy("between", 40, 20), *all_)) == [T + 2 * M, T + 3 * M, T + 4 * M]
    assert ts(predicates.find(six, p.gte(30), *all_)) == [T + 3 * M, T + 4 * M, T + 5 * M]
    got = predicates.matches(six, p.eq(30), *all_, values=False).collect()
    assert [(r.ts, r.value) for r in got] == [(T + 3 * M, None)]
    assert [r.value for r in predicates.points(six, p.in_set(10, 40), *all_).collect()] == [10, 40]
    assert [r.value for r in predicates.points(six, p.not_in_set(10, 50), *all_).collect()] == [15, 20, 30, 40]
    assert predicates.points(six, p.in_set(), *all_).count() == 0 and predicates.points(six, p.not_in_set(), *all_).count() == 6
    assert [r.value for r in predicates.points(six, p.between(15, 40, False), *all_).collect()] == [20, 30]
    assert code(lambda: predicates.matches(six, p.gt(1), T + 1, T)) == "INVALID_INPUT"
    assert code(lambda: predicates.matches(six, p.between(3, 1), *all_)) == "INVALID_INPUT"
    assert predicates.find(six, p.gt(1), T + 1, T).count() == 0
    assert predicates.matches(six, p.gt(1), T + 100 * M, T + 200 * M).count() == 0


def test_statistics_on_six(six):
    s = lambda q, **k: predicates.statistics(six, q, T, T + 10 * M, block=2, **k).first().asDict()
    z = s(p.gte(30))
    assert (z["index_used"], z["chunks_considered"], z["blocks_considered"], z["blocks_pruned"], z["blocks_scanned"], z["rows_checked"], z["rows_matched"]) == ("ZoneMap", 1, 3, 1, 1, 4, 3)
    v = s(p.eq(30))
    assert (v["index_used"], v["rows_checked"], v["rows_matched"], v["fallback_scan"]) == ("ValueIndex", 1, 1, False)
    f = s(p.not_in_set(10, 50))
    assert (f["index_used"], f["rows_checked"], f["rows_matched"], f["fallback_scan"]) == ("FullScan", 6, 4, True)
    assert s(p.gt(30), has_zone_map=False)["index_used"] == "FullScan"
    none = s(p.gt(1000))
    assert (none["chunks_pruned"], none["rows_checked"]) == (1, 0)
    assert predicates.merged_index(["FullScan", "ZoneMap"]) == "ZoneMap" and predicates.merged_index(["FullScan"]) == "FullScan"


def test_zone_map_tests_are_conservative(six):
    zones = index.zone_map(six, ["part"], 2)
    for q in (p.eq(15), p.ne(10), p.gt(40), p.gte(50), p.lt(15), p.lte(10), p.between(16, 29), p.between(20, 30, False), p.in_set(1, 50), p.not_in_set(10), p.in_set(), p.not_in_set()):
        blocks = {r.block for r in index.candidates(zones, q, T, T + 9 * M).collect()}
        hits = {(r.ts - T) // M // 2 for r in predicates.points(six, q, T, T + 9 * M).collect()}
        assert hits <= blocks


def test_grammar_and_keys():
    assert p.parse("in-set", "1, 2") == p.in_set(1, 2) and p.parse("not-in", "") == p.not_in_set()
    assert p.parse("between-exclusive", "1,2") == p.between(1, 2, False)
    for bad in (("eq", ""), ("eq", "1,2"), ("like", "1"), ("gt", "x"), ("between", "2,1")):
        assert code(lambda b=bad: p.parse(*b)) == "INVALID_INPUT"
    assert code(lambda: p.legacy("between", 1)) == "INVALID_INPUT" and code(lambda: p.legacy("ne", 1)) == "INVALID_INPUT"
    assert keys.unscoped(keys.scoped("1m", "a@@b")) == ("1m", "a@@b") and keys.unscoped("plain") is None
    assert code(lambda: keys.Key(" ", "a", "b").checked()) == "INVALID_INPUT"
    assert keys.fnv1a64(b"") == 0xCBF29CE484222325 and keys.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_reads(six):
    assert ts(reads.latest(six, 2)) == [T + 4 * M, T + 5 * M] and reads.latest(six, 0).count() == 0 and reads.latest(six, 99).count() == 6
    assert ts(reads.between(six, T + M, T + 2 * M)) == [T + M, T + 2 * M] and reads.between(six, T + 1, T).count() == 0
    assert reads.at(six, T + 1).count() == 0


def test_sequences(spark):
    rows = [("x", T + k * M, n, k) for k, n in enumerate((1, 2, 4, 4, 3))]
    seen = seq.observed(spark.createDataFrame(rows, "s string, ts long, sequence long, ordinal long"), "sequence", T, T + 9 * M, ["s"])
    g = seq.gaps(seen, ["s"]).collect()
    assert [(r.previous_sequence, r.expected_sequence, r.next_sequence, int(r.missing_count)) for r in g] == [(2, 3, 4, 1)]
    assert [r.sequence for r in seq.duplicates(seen, ["s"]).collect()] == [4]
    assert [(r.previous_sequence, r.next_sequence) for r in seq.violations(seen, ["s"]).collect()] == [(4, 3)]
    r = seq.report(seen, ["s"]).first()
    assert (r.records, r.first_sequence, r.last_sequence, r.is_clean) == (5, 1, 3, False)
    assert code(lambda: seq.observed(seen, "sequence", 2, 1, ["s"])) == "INVALID_INPUT"
    wide = spark.createDataFrame([("x", 1, -(1 << 63), 0), ("x", 2, (1 << 63) - 1, 1)], "s string, ts long, sequence long, ordinal long")
    assert int(seq.gaps(seq.observed(wide, "sequence", 0, 9, ["s"]), ["s"]).first().missing_count) == (1 << 64) - 2


def test_floor_means(spark):
    rows = [("x", k, v, v) for k, v in enumerate((-7, 2, 5, 9007199254740993, 3))]
    df = spark.createDataFrame(rows, "s string, ts long, close long, volume long")
    got = [r.m for r in df.select("ts", fx.rolling_mean("close", 3, ["s"]).alias("m")).orderBy("ts").collect()]
    want, seen = [], []
    for _, _, v, _ in rows:
        seen = [*seen, v][-3:]
        want.append(sum(seen) // len(seen))
    assert got == want


def test_overlaps(spark):
    rows = [("a", 100, 109, 5, 1, "p1"), ("a", 105, 130, 5, 2, "p2"), ("a", 100, 140, 9, 2, "p3"), ("a", 200, 210, 1, 1, "p4"), ("b", 1, 5, 1, 1, "q1"), ("b", 4, 9, 1, 1, "q2")]
    df = spark.createDataFrame(rows, "s string, start_ts long, end_ts long, count long, generation long, relative_path string")
    got = {r.s: (r.participants, r.winner) for r in overlaps.winners(df, ["s"]).collect()}
    assert got == {"a": (3, "p3"), "b": (2, None)}


def plain_strength(closes):
    """Wilder's strength by its definition: means of the first 14 rises and falls, then 13 parts old and one new."""
    out = []
    for n in range(len(closes)):
        if n < 14:
            out.append(None)
            continue
        moves = [b - a for a, b in zip(closes[n - 14 : n], closes[n - 13 : n + 1], strict=True)]
        if n == 14:
            up, down = sum(x for x in moves if x > 0) / 14, -sum(x for x in moves if x < 0) / 14
        else:
            up, down = up + (max(moves[-1], 0) - up) / 14, down + (max(-moves[-1], 0) - down) / 14
        out.append(100 * up / (up + down) if up + down else 50.0)
    return out


def plain_backtest(bars, case, cash):
    """One symbol, step by step."""
    units, pending, closes, fills, worth = 0.0, False, [], [], []
    strength = plain_strength([c for *_, c in bars])
    for k, (ts, o, c) in enumerate(bars):
        if pending != bool(units):
            price = o / 100 * (1.0001 if pending else 0.9999)
            if pending:
                units, cash = cash / (price * 1.001), 0.0
                fills.append((ts, "buy", price, units, units * price * 0.001))
            else:
                fills.append((ts, "sell", price, units, units * price * 0.001))
                cash, units = units * price * 0.999, 0.0
        closes.append(c)
        if case == "sma":
            pending = len(closes) >= 60 and sum(closes[-20:]) * 60 > sum(closes[-60:]) * 20
        elif case == "momentum":
            pending = len(closes) > 60 and c > closes[-61]
        elif strength[k] is not None:
            pending = strength[k] <= 30 or (pending and strength[k] < 70)
        worth.append(cash + units * c / 100)
    return fills, worth, bool(units), pending != bool(units)


def walks(n=900, flat=range(0)):
    import random

    r = random.Random(8)
    data = {}
    for s in ("x", "y"):
        price, rows = 10000, []
        for k in range(n):
            price = max(100, price + (0 if k in flat else r.randrange(-300, 301)))
            rows.append((k * 86_400_000, price + r.randrange(-5, 6), price))
        data[s] = rows
    return data


@pytest.mark.parametrize("case", backtest.CASES)
def test_backtest(spark, case):
    data = walks()
    df = spark.createDataFrame([(s, *row) for s, rows in data.items() for row in rows], "symbol string, ts long, open long, close long")
    account = backtest.accounts(df, case, 100).cache()
    got = backtest.summary(account, case).first()
    plain = {s: plain_backtest(data[s], case, 50_000.0) for s in data}
    equity = [a + b for a, b in zip(*(v[1] for v in plain.values()), strict=True)]
    peak, worst, curve = 0.0, 0.0, []
    for e in equity:
        peak = max(peak, e)
        worst = max(worst, 1 - e / peak)
        curve.append((e, peak))
    fills = [(s, *f) for s, v in plain.items() for f in v[0]]
    assert got.rows == 1800 and got.fills == len(fills) > 0 and got.completed_round_trips == sum(f[2] == "sell" for f in fills)
    assert got.final_equity == pytest.approx(equity[-1], rel=1e-11) and got.max_drawdown == pytest.approx(worst, abs=1e-11) and got.fees == pytest.approx(sum(f[5] for f in fills))
    assert (got.open_positions, got.pending_targets) == tuple(sum(v[k] for v in plain.values()) for k in (2, 3))
    rows = account.where("side is not null").select("symbol", "ts", "side", "price", "quantity", "fee").orderBy("symbol", "ts").collect()
    assert [r[:3] for r in rows] == [f[:3] for f in fills] and all(r[3:] == pytest.approx(f[3:]) for r, f in zip(rows, fills, strict=True))
    assert [r[:] for r in backtest.curve(account).orderBy("ts").select("equity", "peak").collect()] == [pytest.approx(c) for c in curve]
    again = backtest.digest(backtest.accounts(df.repartition(7), case, 100)).first()
    assert again == backtest.digest(account).first() and again != backtest.digest(account.where("ts > 43200000000")).first()


def test_backtest_rejects(spark):
    data = walks(70)
    df = spark.createDataFrame([(s, *row) for s, rows in data.items() for row in rows], "symbol string, ts long, open long, close long")
    assert code(lambda: backtest.accounts(df.where("symbol = 'x' or ts > 3"), "sma", 100)) == "INVALID_DATA"
    with pytest.raises(Exception, match="INVALID_DATA: a symbol has two bars of one time"):
        backtest.accounts(df.unionByName(df.where("ts = 0")), "sma", 100).collect()
    assert code(lambda: backtest.accounts(df.selectExpr("symbol", "ts", "0 AS open", "close"), "sma", 100)) == "INVALID_DATA"
    assert code(lambda: backtest.accounts(df.limit(0), "sma", 100)) == "INVALID_INPUT"
    for bad in ({"case": "other"}, {"scale": 0}, {"capital": 0}, {"fee_bps": -1}, {"slippage_bps": 10_000}):
        assert code(lambda bad=bad: backtest.accounts(df, **({"case": "sma", "scale": 100} | bad))) == "INVALID_INPUT"


@pytest.mark.parametrize("flat", [range(0), range(50, 1500), range(2, 40), range(0, 2000)])
def test_strength(spark, flat):
    """Against the definition, over many runs, and where nothing moves for long."""
    rows = walks(2000, flat)["x"]
    df = spark.createDataFrame([("x", *r) for r in rows], "symbol string, ts long, open long, close long")
    got = [r.rsi for r in backtest.strength(df).orderBy("ts").collect()]
    want = plain_strength([c for *_, c in rows])
    assert got[:14] == [None] * 14 and got[14:] == pytest.approx(want[14:], rel=1e-9)


def test_streaming(spark, tmp_path):
    from barframe.streaming import ingest

    rows = [("x", 1000 * k, n, n, 100 + k, 1) for k, n in enumerate((1, 2, 4, 4, 3))]
    spark.createDataFrame(rows, "symbol string, ts long, ordinal long, sequence long, price long, qty long").repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("symbol string, ts long, ordinal long, sequence long, price long, qty long").parquet(str(tmp_path / "in"))
    for name, df, mode in (("faults", ingest.sequence_faults(live), "append"), ("live_bars", ingest.bars(live, "3 seconds"), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.kind for r in spark.table("faults").collect()) == ["duplicate", "gap", "violation"]
    got = sorted((r.ts, r.open, r.high, r.low, r.close, r.volume) for r in spark.table("live_bars").collect())
    assert got == [(0, 100, 102, 100, 102, 3), (3000, 103, 104, 103, 104, 2)]
