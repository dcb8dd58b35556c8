import json
import shutil
import socket
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barframe import keys
from barframe.errors import BarframeError
from barframe.functions import predicate as p
from barframe.operators import predicates
from barframe.operators import sequences as seq
from barframe.store import admin
from barframe.store.bridge import VERBS, call
from barframe.store.store import Policy, Store

T, M, H = 1706745600000, 60000, 3600000
MARCH = 1709251200000


def code(f):
    with pytest.raises(BarframeError) as e:
        f()
    return e.value.code


def bars(spark, start, n, step=M):
    return spark.createDataFrame([(start + k * step, 100 + k, 110 + k, 90 + k, 105 + k, 10) for k in range(n)], "ts long, open long, high long, low long, close long, volume long")


def scalars(spark, rows):
    return spark.createDataFrame(rows, "ts long, value long")


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/st")
    s.init()
    return s


def ts(df):
    return [r.ts for r in df.collect()]


def test_bars(spark, store):
    k = store.register_kline("BTC", "1m", M, 100, 100)
    assert store.register_kline("BTC", "1m", M, 100, 100) == k
    assert code(lambda: store.register_kline("BTC", "1m", M, 10, 100)) == "INVALID_INPUT"
    assert code(lambda: store.register_kline("X", "1m", 0, 10, 100)) == "INVALID_INPUT"
    assert code(lambda: store.put(keys.kline("NO", "1m"), bars(spark, T, 1))) == "NOT_FOUND"
    assert store.put(k, bars(spark, T, 5))["written"] == 5
    assert store.append(k, bars(spark, MARCH - 2 * M, 4))["parts"] == ["2024-02", "2024-03"]
    assert code(lambda: store.append(k, bars(spark, MARCH + M, 2))) == "INVALID_DATA"
    assert code(lambda: store.put(k, bars(spark, MARCH - M, 3))) == "INVALID_INPUT"
    assert code(lambda: store.append(k, bars(spark, T + 99 * M, 1).unionByName(bars(spark, T + 99 * M, 1)))) == "INVALID_DATA"
    states = {(r.part, r.generation): r.state for r in store.chunks().collect()}
    assert states == {("2024-02", 1): "sealed", ("2024-02", 2): "active", ("2024-03", 1): "sealed"}
    assert ts(store.between(k, T + 3 * M, MARCH)) == [T + 3 * M, T + 4 * M, MARCH - 2 * M, MARCH - M, MARCH]
    assert ts(store.latest(k, 3)) == [MARCH - M, MARCH, MARCH + M] and store.between(k, 5, 4).count() == 0
    assert store.at(k, T + M).first().open == 101 and store.at(k, T + 1).count() == 0
    assert ts(store.replay(k, T)) == [T + j * M for j in range(5)] + [MARCH, MARCH + M]
    assert store.merge(k, "2024-02") and not store.merge(k, "2024-02")
    assert {r.state for r in store.parts(k).collect() and store.chunks().where("part = '2024-02'").collect()} == {"active"}
    assert ts(store.between(k, T, MARCH)) == [*(T + j * M for j in range(5)), MARCH - 2 * M, MARCH - M, MARCH]
    assert ts(store.replay(k, T)) == [MARCH, MARCH + M]
    c = store.cursor(k, 0)
    assert len(c.next_batch(1)) == 1 and not c.is_exhausted() and len(c.next_batch(9)) == 1 and c.is_exhausted() and c.next_batch(1) == []
    assert code(lambda: c.next_batch(0)) == "INVALID_INPUT" and code(lambda: store.replay(k, 2, 1)) == "INVALID_INPUT"
    assert store.coverage(k) == {"start_ts": T, "end_ts": MARCH + M, "records": 9}
    assert store.flow(k, T, T).first().quote_volume is None
    assert admin.clean(admin.validate(store, deep=True)) and admin.health(store)["clean"]


def test_flow_rules(spark, store):
    k = store.register_kline("ETH", "1m", M, 100, 100, quote_scale=100)
    schema = store.family(k).schema
    row = lambda *f: spark.createDataFrame([(T, 1, 1, 1, 1, 10, *f)], schema)
    for bad in ((-1, None, None, None), (5, 1, 11, None), (5, 1, 1, 6), (None, 1, 1, 1)):
        assert code(lambda b=bad: store.put(k, row(*b))) == "INVALID_INPUT"
    store.put(k, row(None, 0, None, None))
    got = store.activity(k, T, T).first()
    assert (got.quote_volume, got.trade_count) == (None, 0)
    assert store.bars(k, T, T).columns == ["ts", "open", "high", "low", "close", "volume"]
    assert code(lambda: store.replay(k, T, family="kline")) == "INVALID_DATA"


def test_capabilities_are_what_is_stored(spark, store):
    """Scalars get a zone map and a value index with every write; a chunk without them is read raw."""
    k = store.register_scalar(keys.Key("BTC", "feature", "1m@@x"), M)
    none = {"raw": True, "zone_map": False, "value_index": False}
    assert code(lambda: store.capabilities(keys.Key("NO", "x", "y"))) == "NOT_FOUND"
    assert store.capabilities(k) == none and store.predicate_statistics(k, p.gt(1), T, MARCH).first().index_used is None
    store.append(k, scalars(spark, [(T + i * M, (i * 7) % 100) for i in range(600)] + [(MARCH + i * M, 1000 + i) for i in range(300)]))
    assert store.capabilities(k) == {"raw": True, "zone_map": True, "value_index": True} and not store.orphans()
    z = store.zones(k).orderBy("chunk", "start_row").collect()
    assert [(r.start_row, r.end_row) for r in z] == [(0, 255), (256, 511), (512, 599), (0, 255), (256, 299)] and z[0].min_value == 0 and z[-1].max_value == 1299
    used = lambda q: store.predicate_statistics(k, q, T, MARCH + 999 * M).first()
    want = lambda f: sorted([T + i * M for i in range(600) if f((i * 7) % 100)] + [MARCH + i * M for i in range(300) if f(1000 + i)])
    cases = [(p.eq(14), lambda v: v == 14, "ValueIndex"), (p.in_set(3, 1005), lambda v: v in (3, 1005), "ValueIndex"), (p.gt(1100), lambda v: v > 1100, "ZoneMap"), (p.between(90, 1010), lambda v: 90 <= v <= 1010, "ZoneMap"), (p.ne(14), lambda v: v != 14, "FullScan"), (p.not_in_set(1, 2), lambda v: v not in (1, 2), "FullScan")]
    for q, f, path in cases:
        got = store.predicate(k, q, T, MARCH + 999 * M)
        assert [r.ts for r in got.collect()] == want(f) and all(f(r.value) for r in got.collect())
        s = used(q)
        assert (s.index_used, s.rows_matched, s.fallback_scan, s.chunks_considered) == (path, len(want(f)), path == "FullScan", 2)
        files = "".join(got.inputFiles())
        assert (".vix" in files) == (path == "ValueIndex") and (path == "FullScan" or ("2024-03" in files) == bool([v for v in want(f) if v >= MARCH]))
    s = used(p.gt(1100))
    assert (s.chunks_pruned, s.chunks_scanned, s.blocks_considered, s.blocks_pruned, s.rows_checked) == (1, 1, 5, 3, 300)
    assert not any(admin.scrub(store).values())
    store.put(k, scalars(spark, [(T, 5)]))
    assert store.capabilities(k)["value_index"] and [r.ts for r in store.predicate(k, p.eq(5), T, T + M).collect()] == [T] and not store.orphans()
    chunk = Path(store.folder(k).removeprefix("file://")) / store.meta(k)["chunks"][0]["relative_path"]
    shutil.rmtree(f"{chunk}.vix")
    assert not admin.clean(admin.validate(store))


def test_statistics_count_chunks(spark, store):
    """Blocks begin anew in each chunk, also where a part has several."""
    k = store.register_kline("BTC", "1m", M, 1, 1)
    store.put(k, bars(spark, T, 5))
    store.put(k, bars(spark, T + 9 * M, 5))
    assert len(store.meta(k)["chunks"]) == 2
    named = store.frame(k).select("ts", F.col("close").alias("value"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("chunk"))
    s = predicates.statistics(named, p.gt(-1), T, MARCH, part="chunk", block=4, has_value_index=False).first()
    assert (s.chunks_considered, s.blocks_considered, s.rows_checked) == (2, 4, 10)


def test_writers_and_readers(spark, store, tmp_path):
    """One writer at a time; a writer that is gone doesn't hold the store; readers keep writers out while they are open."""
    k = store.register_kline("BTC", "1m", M, 1, 1)
    store.put(k, bars(spark, T, 3))
    root = tmp_path / "st"
    other = subprocess.Popen([sys.executable, "-c", "import time; time.sleep(600)"])
    held = json.dumps({"owner": "x", "host": socket.gethostname(), "pid": other.pid, "time": time.time()})
    (root / "lock").write_text(held)
    (root / "pending").write_text("x")
    (root / "staging").mkdir(exist_ok=True)
    (root / "staging" / "unfinished").write_text("x")
    assert code(lambda: Store(spark, store.root)) == "IO" and (root / "staging" / "unfinished").exists()
    assert code(lambda: store.put(k, bars(spark, T + 9 * M, 1))) == "IO" and code(lambda: admin.repair(store)) == "IO"
    other.kill()
    other.wait()
    second = Store(spark, store.root)
    assert not (root / "staging" / "unfinished").exists() and not second.pending()
    for left in (held, "pid=999999,ts_ms=0", "", json.dumps({"owner": "x", "host": "elsewhere", "pid": 1, "time": time.time() - 1000})):
        (root / "lock").write_text(left)
        store.put(k, bars(spark, store.coverage(k)["end_ts"] + M, 1))
        assert not (root / "lock").exists()
    (root / "lock").write_text(json.dumps({"owner": "x", "host": "elsewhere", "pid": 1, "time": time.time()}))
    assert code(lambda: store.put(k, bars(spark, T + 99 * M, 1))) == "IO"
    (root / "lock").unlink()
    # writers that take turns see each other's rows
    second.put(k, bars(spark, T + 100 * M, 1))
    store.put(k, bars(spark, T + 101 * M, 1))
    second.cache.clear()
    assert second.frame(k).count() == store.frame(k).count() == 9
    reader, again = Store(spark, store.root, read_only=True), Store(spark, store.root, read_only=True)
    assert code(lambda: store.put(k, bars(spark, T + 200 * M, 1))) == "IO" and not (root / "lock").exists()
    reader.close()
    again.close()
    store.put(k, bars(spark, T + 200 * M, 1))
    with Store(spark, store.root, read_only=True) as r:
        assert r.frame(k).count() == 10 and code(lambda: admin.repair(r)) == "INVALID_INPUT"


def test_ties_keep_their_order(spark, store):
    """Without a column ordinal, rows are in the order they come in; ticks out of order are refused."""
    k = store.register_ticks("trade", "BTC", "spot")
    rows = [(T + (i // 40) * M, T, 1000 - i, 5, 1, 1, 0) for i in range(200)]
    cols = "ts long, recv_ts long, trade_id long, price long, qty long, side int, flags int"
    store.put(k, spark.createDataFrame(rows, cols).repartitionByRange(5, F.desc("trade_id")))
    assert [r.trade_id for r in store.replay(k, T).collect()] == [1000 - i for i in range(200)]
    assert code(lambda: store.put(k, spark.createDataFrame([rows[0], rows[-1], rows[0]], cols))) == "INVALID_DATA"
    assert not store.pending() and not store.orphans()


def test_scalars(spark, store):
    base = store.register_kline("BTC", "1m", M, 1, 1)
    assert code(lambda: store.register_indicator("NO", "1m", "x")) == "NOT_FOUND"
    k = store.register_indicator("BTC", "1m", "x")
    assert store.meta(k)["timeframe_ms"] == store.meta(base)["timeframe_ms"] and store.indicators("BTC", "1m") == ["x"]
    store.put(k, scalars(spark, [(T, 10), (T + M, 15), (T + 2 * M, 20)]))
    store.put(k, scalars(spark, [(T, 1), (T + M, 2)]))
    assert [r.value for r in store.between(k, T, T + 9 * M).collect()] == [1, 2]
    store.append(k, scalars(spark, [(T + 5 * M, 7), (MARCH, 8)]))
    assert [r.value for r in store.between(k, T, MARCH).collect()] == [1, 2, 7, 8]
    assert {r.state for r in store.chunks().collect()} == {"sealed"}
    assert code(lambda: store.append(k, scalars(spark, [(T + 5 * M, 1)]))) == "INVALID_DATA"
    assert [r.value for r in store.predicate(k, p.gte(7), T, MARCH).collect()] == [7, 8]
    assert store.predicate(keys.Key("NO", "x", "y"), p.in_set(), 0, 1).count() == 0
    assert code(lambda: store.predicate(keys.Key("NO", "x", "y"), p.gt(1), 0, 1)) == "NOT_FOUND"
    s = store.predicate_statistics(k, p.gt(7), T, MARCH).first()
    assert (s.chunks_considered, s.chunks_pruned, s.rows_matched) == (2, 1, 1)
    session = store.session()
    session.attach(k)
    session.attach(k)
    session.prewarm(eager=True)
    assert ts(session.latest(k, 1)) == [MARCH] and session.inventory() == [k] and session.at(k, T).count() == 1
    assert session.between(k, T, T).count() == 1 and session.predicate(k, p.eq(2), 0, MARCH).count() == 1
    session.reset("full")
    assert session.inventory() == [] and session.at(k, T).count() == 1


def test_ticks(spark, store):
    k = store.register_ticks("trade", "BTC", "spot")
    assert code(lambda: store.register_ticks("trade", "BTC", "z", unit="rows")) == "INVALID_INPUT"
    rows = [(T, T, 1, 5, 1, 1, 0, 0), (T, T, 2, 5, 1, -1, 0, 1), (T + M, T, 4, 5, 1, 1, 255, 2), (T + H, T, 5, 5, 1, 1, 0, 3)]
    df = spark.createDataFrame(rows, "ts long, recv_ts long, trade_id long, price long, qty long, side int, flags int, ordinal long")
    assert store.put(k, df)["parts"] == ["2024-02-01T00", "2024-02-01T01"]
    assert [r.trade_id for r in store.between(k, T, T + H).collect()] == [1, 2, 4, 5]
    assert [r.trade_id for r in store.latest(k, 3).collect()] == [2, 4, 5]
    assert seq.gaps(store.scan(k, T, T + H), ["series"]).count() == 1
    assert [r.trade_id for r in store.replay(k, T, T).collect()] == [1, 2]
    assert code(lambda: store.put(k, df)) == "INVALID_DATA"
    b = store.register_ticks("bbo", "BTC", "spot")
    quotes = spark.createDataFrame([(T, T, 1, 1, 1, 1, 1, 0), (T, T, 1, 1, 1, 1, 2, 1)], [*store.family(b).columns, "ordinal"])
    assert code(lambda: store.put(b, quotes)) == "INVALID_DATA"
    assert store.stats()["scalar_series"] == 2 and [r.name for r in store.series("scalar").collect()] == ["spot", "spot"]


def test_recovery_repair_and_locks(spark, store, tmp_path):
    k = store.register_kline("BTC", "1m", M, 1, 1)
    store.put(k, bars(spark, T, 3))
    folder = Path(store.folder(k).removeprefix("file://"))
    bars(spark, MARCH, 2).withColumn("ordinal", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("long")).write.parquet(str(folder / "2024-03.g00000001"))
    bars(spark, T, 1).write.parquet(str(folder / "2024-02.g00000001x.g00000001"))
    assert len(store.orphans()) == 2 and not admin.health(store)["clean"]
    assert len(admin.repair(store, dry_run=True)) == 2 and len(store.orphans()) == 2
    assert sorted(x.split()[0] for x in admin.repair(store)) == ["adopt", "remove"]
    assert store.frame(k).count() == 5 and admin.clean(admin.validate(store, deep=True))
    assert admin.rebuild(store) == 2
    # an interrupted write
    (folder / "2024-04.g00000001").mkdir()
    (tmp_path / "st" / "pending").write_text("x")
    assert code(lambda: Store(spark, store.root, read_only=True)) == "INVALID_DATA"
    again = Store(spark, store.root)
    assert not again.pending() and not (folder / "2024-04.g00000001").exists()
    assert code(lambda: Store(spark, store.root, read_only=True).put(k, bars(spark, T + 9 * M, 1))) == "INVALID_INPUT"


def test_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "st"), policy=Policy(deltas=2, auto_merge=True))
    k = s.register_kline("BTC", "1m", M, 1, 1)
    for j in range(3):
        s.put(k, bars(spark, T + j * 10 * M, 2))
    assert s.chunks().count() == 1 and s.frame(k).count() == 6
    s.policy = Policy(deltas=1)
    s.put(k, bars(spark, T + 90 * M, 1))
    assert s.advice(k)[0]["reasons"] == ["deltas"]


def test_snapshot_and_registry(spark, store, tmp_path):
    assert code(lambda: admin.seal(store)) == "INVALID_DATA"
    k = store.register_kline("BTC", "1m", M, 1, 1)
    store.put(k, bars(spark, T, 3))
    store.put(k, bars(spark, T + 9 * M, 3))
    r = admin.Registry(spark, str(tmp_path / "registry.json"))
    assert code(lambda: r.latest("d")) == "NOT_FOUND"
    r.upsert_dataset("d", "1", store.root, 5)
    r.upsert_dataset("d", "2", store.root, 5)
    assert r.latest("d")["version"] == "2" and r.resolve("d@1") == store.root and code(lambda: r.resolve("d")) == "INVALID_INPUT"
    done = r.publish("d", "1")
    assert done["status"] == "sealed" and admin.seal(Store(spark, store.root))["digest"] == done["checksum"]
    assert r.upsert_dataset(**done) == done and code(lambda: r.upsert_dataset("d", "1", "elsewhere", 5)) == "INVALID_INPUT"
    r.upsert_feature("f2", "d", "1")
    r.upsert_feature("f1", "d", "2")
    r.upsert_factor("g", "d", "1", note="x")
    assert [x["feature_id"] for x in r.listed("features")] == ["f1", "f2"] and len(r.listed("factors", "d", "1")) == 1
    store.cache.clear()
    assert store.replay(k, T).count() == 6
    assert admin.verify(store, done["checksum"])["digest"] == done["checksum"]
    assert code(lambda: store.put(k, bars(spark, T + 99 * M, 1))) == "INVALID_INPUT"
    path = next(Path(store.folder(k).removeprefix("file://")).glob("*/part-*.parquet"))
    path.write_bytes(path.read_bytes() + b"x")
    assert code(lambda: admin.verify(store)) == "INVALID_DATA"


def test_bridge(spark, tmp_path):
    root = str(tmp_path / "st")
    do = lambda verb, **r: json.loads(json.dumps(call(spark, root, verb, r)))
    assert do("init") == {"initialized": True} and "version" in do("version")
    bar = lambda t, **more: {"ts": t, "open": 1, "high": 2, "low": 1, "close": 2, "volume": 3} | more
    b = {"symbol": "BTC", "timeframe": "1m"}
    scales = {"timeframe_ms": M, "price_scale": 1, "volume_scale": 1}
    assert do("write-kline-range", **b, **scales, records=[bar(T + M), bar(T)])["written"] == 2
    assert code(lambda: do("write-kline-range", **b, **scales, records=[bar(T + 5 * M), bar(T + 5 * M)])) == "INVALID_INPUT"
    assert code(lambda: do("write-kline-range", **b, records=[])) == "INVALID_INPUT"
    assert [x["ts"] for x in do("read-kline-latest", **b, limit=1)["records"]] == [T + M]
    assert len(do("read-kline-range", **b, start_ts=T, end_ts=T + M)["records"]) == 2
    assert do("read-kline-prices", **b, start_ts=T, end_ts=T)["records"] == [{"ts": T, "open": 1, "high": 2, "low": 1, "close": 2}]
    assert do("read-kline-flow-latest", **b, limit=1)["records"][0]["trade_count"] is None
    f = {"symbol": "ETH", "timeframe": "1m"}
    assert code(lambda: do("write-kline-flow-range", **f, **scales, quote_scale=1, records=[bar(T, quote_volume=-(1 << 63))])) == "INVALID_INPUT"
    do("write-kline-flow-range", **f, **scales, quote_scale=1, records=[bar(T, quote_volume=6)])
    assert do("read-kline-activity", **f, start_ts=T, end_ts=T)["records"][0]["quote_volume"] == 6
    assert do("read-indicator-range", **b, name="x", start_ts=0, end_ts=T) == {"exists": False, "records": []}
    assert code(lambda: do("read-kline-range", symbol="NO", timeframe="1m", start_ts=0, end_ts=1)) == "NOT_FOUND"
    do("write-indicator-range", **b, name="x", records=[{"ts": T, "value": 5}, {"ts": T + M, "value": 9}])
    got = do("query-scalar-predicate", **b, name="x", predicate="gt", values="5", start_ts=T, end_ts=T + M, stats=True)
    assert got["matches"] == [{"ts": T + M, "value": 9}] and got["stats"]["rows_matched"] == 1
    assert do("indicator-inventory", **b, name="x")["coverage"]["records"] == 2 and not do("kline-inventory", symbol="NO", timeframe="1m")["exists"]
    assert do("list-indicators", **b) == {"indicators": ["x"]} and len(do("list-series")["series"]) == 3
    assert do("stats")["records"] == 5 and do("health")["clean"] and not any(do("validate", deep=True).values())
    assert do("overlaps") == {"groups": []} and do("orphans") == {"orphans": []} and do("repair") == {"actions": []} and do("rebuild")["chunks"] == 3
    assert do("seal")["digest"] == do("verify")["digest"]
    assert code(lambda: do("nothing")) == "INVALID_INPUT" and len(VERBS) >= 20


def test_sessions_and_views(spark, store):
    from barframe.operators import backtest

    k = store.register_kline("A", "1h", H, 1, 1)
    other = store.register_kline("B", "1h", H, 1, 1)
    x = store.register_scalar(keys.Key("A", "feature", "1h@@x"), H)
    for key in (k, other):
        store.append(key, bars(spark, T, 80, H))
    store.put(x, scalars(spark, [(T + i * H, i) for i in range(80)]))
    s = store.session()
    s.attach(k, x)
    s.prewarm(eager=True)
    assert [r.value for r in s.predicate(x, p.gt(77), T, MARCH).collect()] == [78, 79] and s.predicate(x, p.gt(77), T, MARCH) is s.predicate(x, p.gt(77), T, MARCH)
    assert s.cached() == {"attached": 2, "cached": 2, "answers": 1} and s.health() == {k: True, x: True} and s.capabilities()[x]["zone_map"] and not s.capabilities()[k]["zone_map"]
    s.reset("query")
    assert s.cached() == {"attached": 2, "cached": 2, "answers": 0}
    s.reset("logical")
    assert s.cached() == {"attached": 2, "cached": 0, "answers": 0}
    s.reset("full")
    assert s.cached() == {"attached": 0, "cached": 0, "answers": 0} and code(lambda: s.reset("other")) == "INVALID_INPUT"
    view = store.backtest_view(x).attach_timeframe("1h", ["A", "B"])
    account = backtest.accounts(view.bars("1h", T, MARCH), "momentum", 100)
    assert account.count() == 160 and backtest.summary(account, "momentum").first().fills > 0
    assert set(view.snapshot()) == {"A:kline:1h", "B:kline:1h", "A:feature:1h@@x"} and view.snapshot()["A:kline:1h"] == [c["chunk_id"] for c in store.meta(k)["chunks"]]
    assert view.predicate(x, p.eq(5), T, MARCH).first().value == 5 and view.latest(k, 2).count() == 2 and view.between(other, T, T).count() == 1
    assert code(lambda: store.backtest_view().bars("1h", T, MARCH)) == "NOT_FOUND"
    s.attach(k)
    store.append(k, bars(spark, T + 100 * H, 1))
    store.merge(k, "2024-02")
    assert s.health() == {k: False}


def test_registry_formats(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text(json.dumps({"datasets": {"d@1": {"dataset_id": "d", "version": "1", "root": "r", "created_at": 1}}}))
    r = admin.Registry(spark, str(path))
    assert r.dataset("d", "1")["status"] == "open" and r.latest("d")["checksum"] is None
    r.upsert_feature("f", "d", "1", note="x")
    r.upsert_factor("g", "d", "1")
    assert r.feature("f")["note"] == "x" and r.factor("g")["version"] == "1" and code(lambda: r.factor("f")) == "NOT_FOUND"
    assert json.loads(path.read_text())["format"] == 2
    (tmp_path / ".registry.json.crc").unlink()
    path.write_text(json.dumps({"format": 3}))
    assert code(lambda: r.datasets()) == "INVALID_DATA"


def test_scalars_of_events_may_repeat_times(spark, store):
    """A series that is registered for it keeps all values of one time, in order, through appends and indexes; others refuse them."""
    k = store.register_scalar(keys.Key("BTC", "feature", "1m@@x"), M, equal_ts=True)
    assert store.register_scalar(k, M, equal_ts=True) == k and code(lambda: store.register_scalar(k, M)) == "INVALID_INPUT"
    rows = [(T + i // 3 * M, 900 - i) for i in range(900)]
    for batch in (rows[:600], rows[600:]):
        store.append(k, scalars(spark, batch))
    assert [tuple(r) for r in store.between(k, T, MARCH).collect()] == rows and [tuple(r) for r in store.latest(k, 4).collect()] == rows[-4:]
    z = [(r.start_row, r.end_row, r.min_value, r.max_value) for r in store.zones(k).orderBy("start_row").collect()]
    assert z == [(a, b, 900 - b, 900 - a) for a, b in ((0, 255), (256, 511), (512, 767), (768, 899))]
    assert sorted(tuple(r) for r in store.values(k).select("ts", "value").collect()) == sorted(rows)
    assert code(lambda: store.append(k, scalars(spark, [rows[-1]]))) == "INVALID_DATA"
    assert admin.clean(admin.validate(store, deep=True)) and not any(admin.scrub(store).values())
    other = store.register_scalar(keys.Key("BTC", "feature", "1m@@y"), M)
    assert code(lambda: store.put(other, scalars(spark, rows))) == "INVALID_DATA"


def test_quotes_of_events_may_repeat_times(spark, store):
    b = store.register_ticks("bbo", "BTC", "spot", equal_ts=True)
    rows = [(T + i // 3 * M, T, 1, 1, 1, 1, 900 - i, i) for i in range(90)]
    cols = [*store.family(b).columns, "ordinal"]
    store.put(b, spark.createDataFrame(rows, cols))
    assert [r.sequence for r in store.replay(b, T).collect()] == [900 - i for i in range(90)]
    assert code(lambda: store.put(b, spark.createDataFrame([(T + 99 * M + k * M, T, 1, 1, 1, 1, 1, 9 - k) for k in range(2)], cols))) == "INVALID_DATA"
