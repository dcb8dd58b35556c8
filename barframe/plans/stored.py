"""Queries that go through a store: written, merged, indexed, scanned and read back by the library.

The store is made once a session from the derived series of two symbols, in the folder
that all executors share.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import keys
from ..functions import derived
from ..functions import predicate as p
from ..keys import Key
from ..operators import sequences as seq
from ..schema import FLOW
from ..sources import views
from ..store import admin
from ..errors import BarframeError
from ..store.arrays import Reader, Writer, to_array
from ..store.bridge import call
from ..store.store import Policy, Store
from .queries import ALL, END, START, query

SYMBOLS = ONE, TWO = "click", "error"
HOUR_MS = 3_600_000
FIRST, LAST = ALL
_made: dict[tuple[str, str], Store] = {}
_IN = f"symbol IN ('{ONE}', '{TWO}')"
_FLOWS = ", ".join(FLOW)
_BARS = f"ts, open, high, low, close, volume, {_FLOWS}"
#: The series that the store holds, beside the views.
_TICKS = f""", bbo_view AS (SELECT symbol, ts, recv_ts, price AS bid_price, qty AS bid_qty, price + 1 AS ask_price, qty + 2 AS ask_qty, CAST(trade_id // 2 - CASE WHEN trade_id % 97 = 0 THEN 50 ELSE 0 END AS BIGINT) AS sequence, trade_id FROM trade_view WHERE {_IN}),
delta_view AS (SELECT symbol, ts - ts % {HOUR_MS // 60} AS ts, recv_ts, trade_id AS sequence, price, qty, side, CAST(trade_id % 3 AS TINYINT) AS action, CAST(trade_id % 10 AS SMALLINT) AS level, CAST(0 AS BIGINT) AS flags, ts AS seen FROM trade_view WHERE {_IN}),
day AS (SELECT symbol, 'trade' AS category, 'trade' AS family, ts, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS part FROM trade_view WHERE {_IN}
 UNION ALL SELECT symbol, 'bbo', 'bbo', ts, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') FROM bbo_view UNION ALL SELECT symbol, 'book_delta', 'book_delta', ts, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') FROM delta_view),
chunk AS (SELECT symbol, category, 'events' AS name, family, part, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS count, 'sealed' AS state, 1::BIGINT AS generation FROM day GROUP BY ALL
 UNION ALL SELECT symbol, 'feature', '1m@@value', 'scalar', '2024-01', min(ts), max(ts), count(*), 'sealed', 1 FROM scalar_view WHERE {_IN} GROUP BY symbol
 UNION ALL SELECT symbol, 'indicator', '1h@@body', 'scalar', '2024-01', min(ts), max(ts), count(*), 'sealed', 1 FROM bar_view WHERE symbol = '{ONE}' GROUP BY symbol
 UNION ALL SELECT symbol, 'kline', '1h', 'kline_flow', '2024-01', min(ts), max(ts), count(*), CASE WHEN ts < {END} THEN 'sealed' ELSE 'active' END AS state, CASE WHEN ts < {END} THEN 1 ELSE 2 END AS generation FROM bar_view WHERE symbol = '{ONE}' GROUP BY symbol, ts < {END}
 UNION ALL SELECT symbol, 'kline', '1h', 'kline_flow', '2024-01', min(ts), max(ts), count(*), 'active', 3 FROM bar_view WHERE symbol = '{TWO}' GROUP BY symbol)
"""


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="barframe-store-")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


def _tick_frames(spark: SparkSession, d: str, symbol: str) -> dict[str, DataFrame]:
    t = views.trades(spark, d).where(F.col("symbol") == symbol).orderBy("ts", "trade_id")
    c = F.col
    number = (F.floor(c("trade_id") / 2) - F.when(c("trade_id") % 97 == 0, 50).otherwise(0)).cast("long")
    return {
        "trade": t.drop("ordinal"),
        "bbo": t.select("ts", "recv_ts", c("price").alias("bid_price"), c("qty").alias("bid_qty"), (c("price") + 1).alias("ask_price"), (c("qty") + 2).alias("ask_qty"), number.alias("sequence")),
        "book_delta": t.select((c("ts") - c("ts") % (HOUR_MS // 60)).alias("ts"), "recv_ts", c("trade_id").alias("sequence"), "price", "qty", "side", (c("trade_id") % 3).cast("byte").alias("action"), (c("trade_id") % 10).cast("short").alias("level"), F.lit(0).cast("long").alias("flags")),
    }


def store(spark: SparkSession, d: str) -> Store:
    """Bars in two appends, merged for one symbol; scalars with indexes; ticks by day; a derived series."""
    name = (spark.sparkContext.applicationId, d)
    if name not in _made:
        s = Store(spark, _folder(spark))
        s.init()
        for symbol in SYMBOLS:
            bars = views.bars(spark, d).where(F.col("symbol") == symbol)
            k = s.register_kline(symbol, "1h", HOUR_MS, 100, 1, 100)
            s.append(k, bars.where(F.col("ts") < END))
            s.append(k, bars.where(F.col("ts") >= END))
            # of events, of which several may have one time
            scalars = s.register_scalar(Key(symbol, "feature", keys.scoped("1m", "value")), 60_000, equal_ts=True)
            s.append(scalars, views.scalars(spark, d).where(F.col("symbol") == symbol))
            for family, df in _tick_frames(spark, d, symbol).items():
                s.put(s.register_ticks(family, symbol, "events", unit="day", equal_ts=True), df)
        s.merge(keys.kline(TWO, "1h"), "2024-01")
        derived.materialize(s, derived.CloseMinusOpen(Key(ONE, "indicator", keys.scoped("1h", "body"))), keys.kline(ONE, "1h"), FIRST, LAST)
        _made[name] = s
    return _made[name]


def _each(spark, d, category: str, name: str, read) -> DataFrame:
    s = store(spark, d)
    one, two = (read(s, Key(x, category, name)).withColumn("symbol", F.lit(x)) for x in SYMBOLS)
    return one.unionByName(two)


def _rows(spark, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# ---- writes and reads -------------------------------------------------------------------------


@query("w07_append_bars", f"SELECT symbol, {_BARS} FROM bar_view WHERE {_IN}")
def w07_append_bars(spark, d):
    return _each(spark, d, "kline", "1h", lambda s, k: s.between(k, *ALL))


@query("w08_put_scalars", f"SELECT symbol, ts, value FROM scalar_view WHERE {_IN}")
def w08_put_scalars(spark, d):
    return _each(spark, d, "feature", "1m@@value", lambda s, k: s.between(k, *ALL))


@query("w14_merge", _TICKS + f"SELECT symbol, part, start_ts, end_ts, count, state, generation FROM chunk WHERE symbol = '{TWO}' AND category = 'kline'")
def w14_merge(spark, d):
    return store(spark, d).chunks().where(f"symbol = '{TWO}' AND category = 'kline'").select("symbol", "part", "start_ts", "end_ts", "count", "state", "generation")


@query("w15_advice", f"SELECT symbol, '2024-01' AS part, 1::BIGINT AS deltas, count(*) AS records FROM bar_view WHERE symbol = '{ONE}' GROUP BY symbol")
def w15_advice(spark, d):
    s = Store(spark, store(spark, d).root, policy=Policy(deltas=1, appends=99))
    k = keys.kline(ONE, "1h")
    parts = s.parts(k).select("part", "records")
    return _rows(spark, "symbol string, part string, deltas long", *((ONE, a["part"], a["deltas"]) for a in s.advice(k))).join(parts, "part").select("symbol", "part", "deltas", "records")


@query("u12_derived", f"SELECT ts, close - open AS value FROM bar_view WHERE symbol = '{ONE}'")
def u12_derived(spark, d):
    return store(spark, d).between(Key(ONE, "indicator", "1h@@body"), *ALL)


@query("r01_store_at", f"SELECT {_BARS} FROM bar_view WHERE symbol = '{ONE}' AND ts = 1704862800000")
def r01_store_at(spark, d):
    return store(spark, d).at(keys.kline(ONE, "1h"), 1704862800000)


@query("r03_store_latest", f"SELECT {_BARS} FROM bar_view WHERE symbol = '{ONE}' ORDER BY ts DESC LIMIT 50")
def r03_store_latest(spark, d):
    return store(spark, d).latest(keys.kline(ONE, "1h"), 50)


@query("r09_indicator_at", f"SELECT ts, close - open AS value FROM bar_view WHERE symbol = '{ONE}' AND ts = 1704862800000")
def r09_indicator_at(spark, d):
    return store(spark, d).at(Key(ONE, "indicator", "1h@@body"), 1704862800000)


@query("p01_store_prices", f"SELECT symbol, ts, open, high, low, close FROM bar_view WHERE {_IN} AND ts BETWEEN {START} AND {END}")
def p01_store_prices(spark, d):
    return _each(spark, d, "kline", "1h", lambda s, k: s.prices(k, START, END))


@query("p02_store_activity", f"SELECT symbol, ts, volume, {_FLOWS} FROM bar_view WHERE {_IN} AND ts BETWEEN {START} AND {END}")
def p02_store_activity(spark, d):
    return _each(spark, d, "kline", "1h", lambda s, k: s.activity(k, START, END))


_COLUMNS = {"trade": "ts, recv_ts, trade_id, price, qty, side, flags", "bbo": "ts, recv_ts, bid_price, bid_qty, ask_price, ask_qty, sequence", "book_delta": "ts, recv_ts, sequence, price, qty, side, action, level, flags"}
_VIEW = {"trade": f"(SELECT *, trade_id AS tie, ts AS seen FROM trade_view WHERE {_IN})", "bbo": "(SELECT *, trade_id AS tie, ts AS seen FROM bbo_view)", "book_delta": "(SELECT *, sequence AS tie FROM delta_view)"}


def _tick_queries(family: str) -> None:
    cols, view = _COLUMNS[family], _VIEW[family]
    field = "trade_id" if family == "trade" else "sequence"

    def numbered(df: DataFrame) -> DataFrame:
        # the order of rows as they come, made a column
        rows = df.coalesce(1).withColumn("_n", F.monotonically_increasing_id())
        return rows.withColumn("position", (F.row_number().over(Window.partitionBy("symbol").orderBy("_n")) - 1).cast("long")).drop("_n")

    @query(f"r10_{family}_range", _TICKS + f"SELECT symbol, {cols}, row_number() OVER (PARTITION BY symbol ORDER BY ts, seen, tie) - 1 AS position FROM {view} WHERE ts BETWEEN {START} AND {END}")
    def between(spark, d):
        return numbered(_each(spark, d, family, "events", lambda s, k: s.between(k, START, END)))

    @query(f"r11_{family}_latest", _TICKS + f"SELECT symbol, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seen DESC, tie DESC) AS r FROM {view}) WHERE r <= 30")
    def latest(spark, d):
        return _each(spark, d, family, "events", lambda s, k: s.latest(k, 30))

    @query(f"s01_{family}_replay", _TICKS + f"SELECT symbol, {cols}, row_number() OVER (PARTITION BY symbol ORDER BY ts, seen, tie) - 1 AS position FROM {view} WHERE ts >= {START}")
    def replay(spark, d):
        return numbered(_each(spark, d, family, "events", lambda s, k: s.replay(k, START, family=family)))

    @query(f"q01_{family}_scan", _TICKS + f"SELECT symbol, count(*) AS records, arg_min({field}, n) AS first_sequence, arg_max({field}, n) AS last_sequence, count(*) FILTER ({field} - prev > 1) AS gaps, count(*) FILTER ({field} = prev) AS duplicates, count(*) FILTER ({field} < prev) AS violations, count(*) FILTER ({field} - prev <> 1) = 0 AS is_clean FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seen, tie) AS n, lag({field}) OVER (PARTITION BY symbol ORDER BY ts, seen, tie) AS prev FROM {view}) GROUP BY symbol")
    def scan(spark, d):
        return _each(spark, d, family, "events", lambda s, k: seq.report(s.scan(k, *ALL), ["series"]).drop("series"))


for _family in _COLUMNS:
    _tick_queries(_family)


@query("s02_cursor", f"SELECT (n - 1) // 100 AS batch, count(*) AS rows, min(ts) AS start_ts, max(ts) AS end_ts FROM (SELECT ts, row_number() OVER (ORDER BY ts, trade_id) AS n FROM trade_view WHERE symbol = '{ONE}' AND ts BETWEEN {START} AND {START + 172_800_000}) GROUP BY ALL")
def s02_cursor(spark, d):
    c = store(spark, d).cursor(Key(ONE, "trade", "events"), START, START + 172_800_000)
    out = []
    while batch := c.next_batch(100):
        out.append((len(out), len(batch), batch[0].ts, batch[-1].ts))
    return _rows(spark, "batch long, rows long, start_ts long, end_ts long", *out)


# ---- indexes ------------------------------------------------------------------------------------

_ZONES = ", z AS (SELECT symbol, n // 256 AS block, min(n) AS start_row, max(n) AS end_row, min(ts) AS start_ts, max(ts) AS end_ts, min(value) AS min_value, max(value) AS max_value FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n FROM scalar_view) GROUP BY ALL)\n"


@query("w16_zone_map", _ZONES + f"SELECT * FROM z WHERE {_IN}")
def w16_zone_map(spark, d):
    return _each(spark, d, "feature", "1m@@value", lambda s, k: s.zones(k).drop("chunk"))


@query("i03_stored_index", f"SELECT symbol, value, ts FROM scalar_view WHERE {_IN}")
def i03_stored_index(spark, d):
    return _each(spark, d, "feature", "1m@@value", lambda s, k: s.values(k).drop("chunk"))


def _found(name: str, q: p.Predicate, sql: str, used: str) -> None:
    """The matches, and the counters with the index that gave them."""

    @query(f"{name}_store", f"SELECT symbol, ts, value FROM scalar_view WHERE {_IN} AND ts BETWEEN {START} AND {END} AND {sql}")
    def matches(spark, d):
        return _each(spark, d, "feature", "1m@@value", lambda s, k: s.predicate(k, q, START, END))

    kept = {"ZoneMap": f"z.max_value >= {q.values[0]} AND z.min_value <= {q.values[-1]}", "ValueIndex": "false", "FullScan": "false"}[used]
    checked = {"ZoneMap": "(SELECT sum(end_row - start_row + 1) FROM k WHERE k.symbol = s.symbol)", "ValueIndex": f"count(*) FILTER ({sql})", "FullScan": f"count(*) FILTER (ts BETWEEN {START} AND {END})"}[used]
    blocks = used == "ZoneMap"
    of = lambda what, table: f"(SELECT {what} FROM {table} AS t WHERE t.symbol = s.symbol)" if blocks else "0"
    pruned = {"ZoneMap": "(SELECT count(*) FROM k WHERE k.symbol = s.symbol) = 0", "ValueIndex": f"count(*) FILTER ({sql}) = 0", "FullScan": "false"}[used]
    counters = _ZONES + f""", b AS (SELECT * FROM z WHERE end_ts >= {START} AND start_ts <= {END}), k AS (SELECT * FROM b AS z WHERE {kept}),
r AS (SELECT symbol, sum(CASE WHEN block - 1 = before THEN 0 ELSE 1 END) AS runs FROM (SELECT *, lag(block) OVER (PARTITION BY symbol ORDER BY block) AS before FROM k) GROUP BY symbol)
SELECT symbol, 1::BIGINT AS chunks_considered, CASE WHEN {pruned} THEN 1 ELSE 0 END::BIGINT AS chunks_pruned, CASE WHEN {pruned} THEN 0 ELSE 1 END::BIGINT AS chunks_scanned, {of("count(*)", "b")}::BIGINT AS blocks_considered,
 ({of("count(*)", "b")} - {of("count(*)", "k")})::BIGINT AS blocks_pruned, coalesce({of("max(runs)", "r")}, 0)::BIGINT AS blocks_scanned, coalesce({checked}, 0)::BIGINT AS rows_checked, count(*) FILTER (ts BETWEEN {START} AND {END} AND {sql}) AS rows_matched, '{used}' AS index_used, {str(used == "FullScan").lower()} AS fallback_scan
FROM scalar_view AS s WHERE {_IN} GROUP BY symbol"""

    @query(f"i06_{name}_counters", counters)
    def statistics(spark, d):
        return _each(spark, d, "feature", "1m@@value", lambda s, k: s.predicate_statistics(k, q, START, END))


_found("p06_eq", p.eq(4793), "value = 4793", "ValueIndex")
_found("p11_in", p.in_set(4793, 5000, 9999), "value IN (4793, 5000, 9999)", "ValueIndex")
_found("p10_between", p.between(9990, 9999), "value BETWEEN 9990 AND 9999", "ZoneMap")
_found("p07_ne", p.ne(4793), "value <> 4793", "FullScan")


@query("i08_capabilities", f"SELECT * FROM (VALUES ('{ONE}', 'feature', true, true, true), ('{ONE}', 'indicator', true, true, true), ('{ONE}', 'kline', true, false, false), ('{ONE}', 'trade', true, false, false)) AS v(symbol, category, raw, zone_map, value_index)")
def i08_capabilities(spark, d):
    s = store(spark, d)
    rows = [(k.symbol, k.category, *s.capabilities(k).values()) for k in s.keys() if k.symbol == ONE and k.category in ("feature", "indicator", "kline", "trade")]
    return _rows(spark, "symbol string, category string, raw boolean, zone_map boolean, value_index boolean", *rows)


# ---- inventories and administration -----------------------------------------------------------------


@query("r13_metadata", _TICKS + "SELECT DISTINCT symbol, category, name, family, CASE family WHEN 'kline_flow' THEN 3600000 WHEN 'scalar' THEN CASE category WHEN 'feature' THEN 60000 ELSE 3600000 END ELSE 0 END::BIGINT AS timeframe_ms, CASE WHEN category IN ('trade', 'bbo', 'book_delta') THEN 'day' ELSE 'month' END AS unit FROM chunk")
def r13_metadata(spark, d):
    s = store(spark, d)
    return _rows(spark, "symbol string, category string, name string, family string, timeframe_ms long, unit string", *((*k, s.meta(k)["family"], s.meta(k)["timeframe_ms"], s.meta(k)["unit"]) for k in s.keys()))


@query("a01_store_series", _TICKS + "SELECT symbol, category, name, family, count(*) AS chunks, CAST(sum(count) AS BIGINT) AS records, count(*) FILTER (state = 'active') AS active FROM chunk GROUP BY ALL")
def a01_store_series(spark, d):
    return store(spark, d).series()


@query("a02_store_stats", _TICKS + "SELECT count(DISTINCT (symbol, category, name)) AS series, count(DISTINCT CASE WHEN category = 'kline' THEN symbol END) AS kline_series, count(DISTINCT CASE WHEN category <> 'kline' THEN (symbol, category, name) END) AS scalar_series, count(*) AS chunks, CAST(sum(count) AS BIGINT) AS records, count(*) FILTER (state = 'active') AS active_chunks FROM chunk")
def a02_store_stats(spark, d):
    found = store(spark, d).stats()
    return _rows(spark, ", ".join(f"{k} long" for k in found), tuple(found.values()))


@query("a03_store_parts", _TICKS + f"SELECT symbol, part, count(*) AS chunks, CAST(sum(count) AS BIGINT) AS records, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'sealed') AS sealed, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM chunk WHERE category = 'trade' GROUP BY ALL")
def a03_store_parts(spark, d):
    return _each(spark, d, "trade", "events", lambda s, k: s.parts(k))


@query("a04_store_chunks", _TICKS + "SELECT * FROM chunk")
def a04_store_chunks(spark, d):
    return store(spark, d).chunks().drop("chunk_id", "relative_path")


@query("a05_store_coverage", _TICKS + "SELECT symbol, category, name, min(start_ts) AS start_ts, max(end_ts) AS end_ts, CAST(sum(count) AS BIGINT) AS records FROM chunk GROUP BY ALL")
def a05_store_coverage(spark, d):
    s = store(spark, d)
    return _rows(spark, "symbol string, category string, name string, start_ts long, end_ts long, records long", *((*k, *s.coverage(k).values()) for k in s.keys()))


@query("a06_json_inventory", _TICKS + f"SELECT symbol, CAST(sum(count) AS BIGINT) AS records, true AS exists FROM chunk WHERE category = 'kline' AND symbol = '{ONE}' GROUP BY symbol UNION ALL SELECT 'none', NULL, false")
def a06_json_inventory(spark, d):
    root = store(spark, d).root
    found = {x: call(spark, root, "kline-inventory", {"symbol": x, "timeframe": "1h"}) for x in (ONE, "none")}
    return _rows(spark, "symbol string, records long, exists boolean", *((k, (v.get("coverage") or {}).get("records"), v["exists"]) for k, v in found.items()))


@query("a07_store_indicators", f"SELECT '{ONE}' AS symbol, '1h' AS timeframe, 'body' AS name")
def a07_store_indicators(spark, d):
    s = store(spark, d)
    return _rows(spark, "symbol string, timeframe string, name string", *((x, "1h", n) for x in SYMBOLS for n in s.indicators(x, "1h")))


@query("a08_health", "SELECT true AS clean, 0::BIGINT AS issues, 0::BIGINT AS orphans, 0::BIGINT AS overlap_groups, false AS recovery_pending")
def a08_health(spark, d):
    h = admin.health(store(spark, d))
    return _rows(spark, "clean boolean, issues long, orphans long, overlap_groups long, recovery_pending boolean", tuple(h.values()))


@query("m01_validate", "SELECT issue, 0::BIGINT AS found FROM (SELECT unnest(['missing', 'untracked', 'count_mismatch', 'range_mismatch', 'overlap', 'unordered_manifest', 'pending']) AS issue)")
def m01_validate(spark, d):
    return _rows(spark, "issue string, found long", *((k, len(v)) for k, v in admin.validate(store(spark, d), deep=True).items()))


def _small(spark, d) -> tuple[Store, Key]:
    """A store of one symbol's bars, to break or to seal."""
    s = Store(spark, _folder(spark))
    k = s.register_kline(ONE, "1h", HOUR_MS, 100, 1, 100)
    bars = views.bars(spark, d).where(F.col("symbol") == ONE)
    s.append(k, bars.where(F.col("ts") < END))
    s.append(k, bars.where(F.col("ts") >= END))
    return s, k


@query("m05_rebuild", f"SELECT state, CAST(generation AS BIGINT) AS generation, count(*) AS count, min(ts) AS start_ts, max(ts) AS end_ts FROM (SELECT ts, 'sealed' AS state, CASE WHEN ts < {END} THEN 1 ELSE 2 END AS generation FROM bar_view WHERE symbol = '{ONE}') GROUP BY ALL")
def m05_rebuild(spark, d):
    """The manifest forgets its chunks; they come back from the files."""
    s, k = _small(spark, d)
    with s._locked():
        s._publish(k, s.meta(k) | {"chunks": []})
    admin.rebuild(s)
    return s.chunks().select("state", "generation", "count", "start_ts", "end_ts")


@query("m04_repair", f"SELECT 'adopt' AS action, count(*) FILTER (ts >= {END}) AS orphan_rows, count(*) AS rows FROM bar_view WHERE symbol = '{ONE}'")
def m04_repair(spark, d):
    """The manifest forgets its last chunk; repair adopts it."""
    s, k = _small(spark, d)
    with s._locked():
        s._publish(k, s.meta(k) | {"chunks": s.meta(k)["chunks"][:1]})
    before = s.coverage(k)["records"]
    actions = admin.repair(s)
    return _rows(spark, "action string, orphan_rows long, rows long", *((a.split()[0], s.coverage(k)["records"] - before, s.coverage(k)["records"]) for a in actions))


@query("n01_seal", f"SELECT 'sealed' AS state, true AS verified, true AS again, count(*) AS rows, min(ts) AS start_ts, max(ts) AS end_ts FROM bar_view WHERE symbol = '{ONE}'")
def n01_seal(spark, d):
    s, k = _small(spark, d)
    sealed = admin.seal(s)
    verified, again = admin.verify(s, sealed["digest"]) == sealed, admin.seal(s) == sealed
    s.cache.clear()
    rows = s.replay(k, FIRST).agg(F.count("*").alias("rows"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    states = {c["state"] for c in s.meta(k)["chunks"]}
    return rows.select(F.lit(",".join(sorted(states))).alias("state"), F.lit(verified).alias("verified"), F.lit(again).alias("again"), "*")


@query("g01_registry", "SELECT * FROM (VALUES ('bars', '2', 'sealed', 'f1'), ('bars', '1', 'open', NULL)) AS v(dataset_id, version, status, feature_id)")
def g01_registry(spark, d):
    s, _ = _small(spark, d)
    r = admin.Registry(spark, f"{_folder(spark)}.json")
    r.upsert_dataset("bars", "1", "elsewhere", 1)
    r.upsert_dataset("bars", "2", s.root, 2)
    r.publish("bars", "2")
    r.upsert_feature("f1", "bars", r.latest("bars")["version"])
    named = {f["version"]: f["feature_id"] for f in r.listed("features", "bars")}
    return _rows(spark, "dataset_id string, version string, status string, feature_id string", *((x["dataset_id"], x["version"], x["status"], named.get(x["version"])) for x in r.datasets()))


@query("c01_session", f"SELECT symbol, ts, close FROM bar_view WHERE {_IN} AND ts BETWEEN {START} AND {END}")
def c01_session(spark, d):
    def read(s, k):
        session = s.session()
        session.attach(k)
        session.prewarm()
        return session.between(k, START, END).select("ts", "close")

    return _each(spark, d, "kline", "1h", read)


@query("r15_arrays", f"SELECT symbol, ts, open, high, low, close FROM bar_view WHERE {_IN} AND ts BETWEEN {START} AND {END}")
def r15_arrays(spark, d):
    root = store(spark, d).root
    with Reader(spark, root) as r:
        rows = [(x, *row.tolist()) for x in SYMBOLS for row in r.read_kline_prices(x, "1h", START, END)]
    return _rows(spark, "symbol string, ts long, open long, high long, low long, close long", *rows)


@query("r16_json", f"SELECT symbol, ts, volume, {_FLOWS} FROM bar_view WHERE {_IN} AND ts BETWEEN {START} AND {END}")
def r16_json(spark, d):
    root = store(spark, d).root
    found = [(x, r) for x in SYMBOLS for r in call(spark, root, "read-kline-activity", {"symbol": x, "timeframe": "1h", "start_ts": START, "end_ts": END})["records"]]
    return _rows(spark, "symbol string, " + ", ".join(f"{c} long" for c in ("ts", "volume", *FLOW)), *((x, *(r[c] for c in ("ts", "volume", *FLOW))) for x, r in found))


@query("c05_backtest_view", f"SELECT symbol, ts, open, close FROM bar_view WHERE {_IN} AND ts BETWEEN {START} AND {END}")
def c05_backtest_view(spark, d):
    return store(spark, d).backtest_view().attach_timeframe("1h", list(SYMBOLS)).bars("1h", START, END)


@query("m03_scrub", "SELECT 0::BIGINT AS unreadable, 0::BIGINT AS index_mismatch")
def m03_scrub(spark, d):
    s, _ = _small(spark, d)
    s.append(s.register_scalar(Key(ONE, "feature", "1m@@value"), 60_000, equal_ts=True), views.scalars(spark, d).where(F.col("symbol") == ONE))
    found = admin.scrub(s)
    return _rows(spark, "unreadable long, index_mismatch long", (len(found["unreadable"]), len(found["index_mismatch"])))


@query("w10_append_scalars", f"SELECT ts, value, CASE WHEN ts < {END} THEN 1 ELSE 2 END::BIGINT AS batch FROM scalar_view WHERE symbol = '{ONE}'")
def w10_append_scalars(spark, d):
    """A part is rewritten with what it holds and what comes."""
    s = Store(spark, _folder(spark))
    k = s.register_scalar(Key(ONE, "feature", "1m@@value"), 60_000, equal_ts=True)
    rows = views.scalars(spark, d).where(F.col("symbol") == ONE)
    for batch in (rows.where(F.col("ts") < END), rows.where(F.col("ts") >= END)):
        s.append(k, batch)
    return s.between(k, *ALL).withColumn("batch", F.when(F.col("ts") < END, 1).otherwise(2).cast("long"))


@query("w12_json_writes", f"SELECT ts, open, high, low, close, volume FROM bar_view WHERE symbol = '{ONE}' AND ts BETWEEN {START} AND {END}")
def w12_json_writes(spark, d):
    root = _folder(spark)
    bars = views.bars(spark, d).where((F.col("symbol") == ONE) & F.col("ts").between(START, END))
    names = ("ts", "open", "high", "low", "close", "volume")
    records = [{c: r[c] for c in names} for r in bars.collect()]
    call(spark, root, "write-kline-range", {"symbol": ONE, "timeframe": "1h", "timeframe_ms": HOUR_MS, "price_scale": 100, "volume_scale": 1, "records": records})
    return Store(spark, root).between(keys.kline(ONE, "1h"), *ALL)


@query("w13_array_writes", f"SELECT ts, value FROM scalar_view WHERE symbol = '{ONE}' AND ts BETWEEN {START} AND {END}")
def w13_array_writes(spark, d):
    root = _folder(spark)
    rows = to_array(store(spark, d).between(Key(ONE, "feature", "1m@@value"), START, END))
    Writer(spark, root).write_scalar_range(ONE, "1m", "feature", "value", rows, timeframe_ms=60_000, equal_ts=True)
    return Store(spark, root).between(Key(ONE, "feature", "1m@@value"), *ALL)


@query("r14_open_read_only", f"SELECT count(*) AS rows, 'INVALID_INPUT' AS write, 'IO' AS while_read, count(*) AS after FROM bar_view WHERE symbol = '{ONE}'")
def r14_open_read_only(spark, d):
    """A handle for reading refuses writes, and keeps writers out until it is closed."""
    s, k = _small(spark, d)

    def code(f) -> str:
        try:
            f()
        except BarframeError as e:
            return e.code
        return ""

    with Store(spark, s.root, read_only=True) as r:
        n = r.frame(k).count()
        codes = code(lambda: r.merge(k, "2024-01")), code(lambda: s.merge(k, "2024-01"))
    s.merge(k, "2024-01")
    return _rows(spark, "rows long, write string, while_read string, after long", (n, *codes, s.frame(k).count()))


@query("p19_find_raw", f"SELECT DISTINCT symbol, ts FROM bar_view WHERE {_IN} AND close > open AND ts BETWEEN {START} AND {END}")
def p19_find_raw(spark, d):
    from ..operators import predicates

    def read(s, k):
        body = s.frame(k).select("ts", (F.col("close") - F.col("open")).alias("value"))
        return predicates.find(body, p.gt(0), START, END)

    return _each(spark, d, "kline", "1h", read)
