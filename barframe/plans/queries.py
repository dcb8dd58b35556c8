"""A query for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions import predicate as p
from ..operators import backtest, index, overlaps, predicates, reads
from ..operators import sequences as seq
from ..schema import FLOW
from ..sources import views

#: A range in January 2024, a bar in it, and a series.
START, END, HOUR, SYMBOL = 1704412800000, 1705276800000, 1704862800000, "click"
POINT = 1704686264331
ALL = (0, 1 << 60)
DAY = 86_400_000

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None):
    def add(f):
        _found[name] = (f, sql and views.SQL.replace("WITH", "WITH RECURSIVE", 1) + sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items() if sql}


def _scalar(spark, d) -> DataFrame:
    return reads.series(views.scalars(spark, d), symbol=SYMBOL, category="feature", name="value")


def _bar(spark, d) -> DataFrame:
    return reads.series(views.bars(spark, d), symbol=SYMBOL)


def _trade(spark, d) -> DataFrame:
    return reads.series(views.trades(spark, d), symbol=SYMBOL)


S = f"scalar_view WHERE symbol = '{SYMBOL}'"
B = f"bar_view WHERE symbol = '{SYMBOL}'"
_O = "ts, open, high, low, close, volume"
_F = ", ".join(FLOW)
_N = ", ".join(f"CAST(NULL AS BIGINT) AS {c}" for c in FLOW)
_T = "ts, recv_ts, trade_id, price, qty, side, flags, ordinal"
IN = f"ts BETWEEN {START} AND {END}"

# ---- reads --------------------------------------------------------------------------------


@query("r01_point", f"SELECT {_O} FROM {B} AND ts = {HOUR}")
def r01_point(spark, d):
    return reads.ohlcv(reads.at(_bar(spark, d), HOUR))


@query("r01_point_miss", f"SELECT {_O} FROM {B} AND ts = {HOUR - 1}")
def r01_point_miss(spark, d):
    return reads.ohlcv(reads.at(_bar(spark, d), HOUR - 1))


@query("r02_range", f"SELECT {_O} FROM {B} AND {IN}")
def r02_range(spark, d):
    return reads.between(reads.ohlcv(_bar(spark, d)), START, END)


@query("r02_range_reversed", f"SELECT {_O} FROM {B} AND false")
def r02_range_reversed(spark, d):
    return reads.between(reads.ohlcv(_bar(spark, d)), END, START)


def _positions(df: DataFrame, *ties: str) -> DataFrame:
    return df.withColumn("position", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts", *ties)) - 1).cast("long"))


@query("r03_latest_n", f"SELECT *, row_number() OVER (ORDER BY ts) - 1 AS position FROM (SELECT {_O} FROM {B} ORDER BY ts DESC LIMIT 100)")
def r03_latest_n(spark, d):
    return _positions(reads.latest(reads.ohlcv(_bar(spark, d)), 100))


@query("r03_latest_gt_rows", f"SELECT {_O} FROM {B}")
def r03_latest_gt_rows(spark, d):
    return reads.latest(reads.ohlcv(_bar(spark, d)), 100_000)


@query("r03_latest_zero", f"SELECT {_O} FROM {B} AND false")
def r03_latest_zero(spark, d):
    return reads.latest(reads.ohlcv(_bar(spark, d)), 0)


@query("r04_flow_point", f"SELECT {_O}, {_F} FROM {B} AND ts = {HOUR}")
def r04_flow_point(spark, d):
    return reads.at(_bar(spark, d), HOUR).drop("symbol", "timeframe")


@query("r04_flow_of_ohlcv", f"SELECT {_O}, {_N} FROM {B} AND ts = {HOUR}")
def r04_flow_of_ohlcv(spark, d):
    return reads.widened(reads.at(reads.ohlcv(_bar(spark, d)), HOUR))


@query("r05_flow_range", f"SELECT {_O}, {_F} FROM {B} AND {IN}")
def r05_flow_range(spark, d):
    return reads.between(_bar(spark, d).drop("symbol", "timeframe"), START, END)


@query("r05_flow_range_widened", f"SELECT {_O}, {_N} FROM {B} AND {IN}")
def r05_flow_range_widened(spark, d):
    return reads.between(reads.widened(reads.ohlcv(_bar(spark, d))), START, END)


@query("r06_flow_latest", f"SELECT *, row_number() OVER (ORDER BY ts) - 1 AS position FROM (SELECT {_O}, {_F} FROM {B} ORDER BY ts DESC LIMIT 50)")
def r06_flow_latest(spark, d):
    return _positions(reads.latest(_bar(spark, d).drop("symbol", "timeframe"), 50))


@query("r07_scalar_at", f"SELECT ts, value FROM {S} AND ts = {POINT}")
def r07_scalar_at(spark, d):
    return reads.at(_scalar(spark, d), POINT).select("ts", "value")


@query("r08_scalar_range", f"SELECT ts, value FROM {S} AND {IN}")
def r08_scalar_range(spark, d):
    return reads.between(_scalar(spark, d).select("ts", "value"), START, END)


def _ma20(spark, d) -> DataFrame:
    return views.bars(spark, d).select("symbol", F.lit("indicator").alias("category"), F.lit("1h@@ma20").alias("name"), "ts", fx.rolling_mean("close", 20, ["symbol"]).alias("value"))


def _roll(column: str, n: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    s, c = f"sum({column}) OVER {w}", f"count({column}) OVER {w}"
    return f"CAST(({s} - (({s} % {c}) + {c}) % {c}) // {c} AS BIGINT)"


@query("r09_indicator_range", f"SELECT symbol, ts, value FROM (SELECT symbol, ts, {_roll('close', 20)} AS value FROM bar_view) WHERE symbol = '{SYMBOL}' AND {IN}")
def r09_indicator_range(spark, d):
    return reads.between(reads.series(_ma20(spark, d), symbol=SYMBOL, category="indicator", name="1h@@ma20").select("symbol", "ts", "value"), START, END)


@query("r10_trade_range", f"SELECT {_T} FROM trade_view WHERE symbol = '{SYMBOL}' AND {IN}")
def r10_trade_range(spark, d):
    return reads.between(_trade(spark, d).drop("symbol", "part"), START, END, "ordinal")


@query("r11_trade_latest", f"SELECT *, row_number() OVER (ORDER BY ts, ordinal) - 1 AS position FROM (SELECT {_T} FROM trade_view WHERE symbol = '{SYMBOL}' ORDER BY ts DESC, ordinal DESC LIMIT 128)")
def r11_trade_latest(spark, d):
    return _positions(reads.latest(_trade(spark, d).drop("symbol", "part"), 128, "ordinal"), "ordinal")


@query("r11_latest_each", "SELECT symbol, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM scalar_view) WHERE k <= 10")
def r11_latest_each(spark, d):
    return reads.latest_each(views.scalars(spark, d).select("symbol", "ts", "value"), 10, ["symbol"])


@query("r12_full_scan", "SELECT symbol, count(*) AS n, CAST(sum(close) AS BIGINT) AS closes, max(ts) AS last_ts FROM bar_view GROUP BY symbol")
def r12_full_scan(spark, d):
    return views.bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("close").alias("closes"), F.max("ts").alias("last_ts"))


# ---- projections and predicates --------------------------------------------------------------


@query("p01_prices", f"SELECT ts, open, high, low, close FROM {B} AND {IN}")
def p01_prices(spark, d):
    return reads.between(reads.prices(_bar(spark, d)), START, END)


@query("p02_activity", f"SELECT ts, volume, {_F} FROM {B} AND {IN}")
def p02_activity(spark, d):
    return reads.between(reads.activity(_bar(spark, d)), START, END)


@query("p02_activity_of_ohlcv", f"SELECT ts, volume, {_N} FROM {B} AND {IN}")
def p02_activity_of_ohlcv(spark, d):
    return reads.between(reads.activity(reads.ohlcv(_bar(spark, d))), START, END)


@query("p03_ohlcv_of_flow", f"SELECT symbol, {_O} FROM bar_view")
def p03_ohlcv_of_flow(spark, d):
    return reads.ohlcv(views.bars(spark, d), "symbol")


@query("p04_closes", f"SELECT ts, close FROM {B} AND {IN}")
def p04_closes(spark, d):
    return reads.between(reads.closes(_bar(spark, d)), START, END)


_SOME = (4793, 3547, 639, 1231, 174)
_PREDICATES = {
    "p06_eq": (p.eq(4793), "value = 4793"),
    "p07_ne": (p.ne(4793), "value <> 4793"),
    "p08_gt": (p.gt(10_000), "value > 10000"),
    "p08_gte": (p.gte(4793), "value >= 4793"),
    "p09_lt": (p.lt(639), "value < 639"),
    "p09_lte": (p.lte(639), "value <= 639"),
    "p10_between": (p.between(639, 4793), "value BETWEEN 639 AND 4793"),
    "p10_between_exclusive": (p.between(639, 4793, False), "value > 639 AND value < 4793"),
    "p11_in": (p.in_set(*_SOME), f"value IN {_SOME}"),
    "p11_in_empty": (p.in_set(), "false"),
    "p12_not_in": (p.not_in_set(*_SOME), f"value NOT IN {_SOME}"),
    "p12_not_in_empty": (p.not_in_set(), "true"),
    "p13_legacy_between_swapped": (p.legacy("between", 4793, 639), "value BETWEEN 639 AND 4793"),
    "p13_legacy_gt": (p.legacy("gt", 10_000), "value > 10000"),
    "p22_grammar": (p.parse("between-exclusive", "639,4793"), "value > 639 AND value < 4793"),
}


def _predicate_query(name: str, predicate: p.Predicate, sql: str) -> None:
    @query(name, f"SELECT ts, value FROM {S} AND {IN} AND {sql}")
    def run(spark, d):
        return predicates.matches(_scalar(spark, d), predicate, START, END)


for _name, (_p, _sql) in _PREDICATES.items():
    _predicate_query(_name, _p, _sql)


@query("p14_no_values", f"SELECT ts, CAST(NULL AS BIGINT) AS value FROM {S} AND {IN} AND value > 10000")
def p14_no_values(spark, d):
    return predicates.matches(_scalar(spark, d), p.gt(10_000), START, END, values=False)


@query("p15_timestamps", f"SELECT ts FROM {S} AND {IN} AND value IN {_SOME}")
def p15_timestamps(spark, d):
    return predicates.timestamps(_scalar(spark, d), p.in_set(*_SOME), START, END)


@query("p16_points", f"SELECT ts, value FROM {S} AND {IN} AND value <= 639")
def p16_points(spark, d):
    return predicates.points(_scalar(spark, d), p.lte(639), START, END)


@query("p17_find", f"SELECT DISTINCT ts FROM {S} AND {IN} AND value BETWEEN 639 AND 4793")
def p17_find(spark, d):
    return predicates.find(_scalar(spark, d), p.legacy("between", 4793, 639), START, END)


@query("p17_find_reversed", f"SELECT ts FROM {S} AND false")
def p17_find_reversed(spark, d):
    return predicates.find(_scalar(spark, d), p.gt(0), END, START)


@query("p18_find_by_value_index", f"SELECT ts, value FROM {S} AND {IN} AND value IN {_SOME}")
def p18_find_by_value_index(spark, d):
    return index.lookup(index.value_index(_scalar(spark, d), []), p.in_set(*_SOME), START, END)


@query("p20_indicator_find", f"SELECT DISTINCT ts FROM (SELECT symbol, ts, {_roll('close', 20)} AS value FROM bar_view) WHERE symbol = '{SYMBOL}' AND {IN} AND value > 7000")
def p20_indicator_find(spark, d):
    return predicates.find(reads.series(_ma20(spark, d), symbol=SYMBOL), p.gt(7000), START, END)


@query("p21_every_series", "SELECT symbol, count(*) AS matches FROM scalar_view WHERE value BETWEEN 639 AND 4793 GROUP BY symbol")
def p21_every_series(spark, d):
    return views.scalars(spark, d).where(p.between(639, 4793).column(F.col("value"))).groupBy("symbol").agg(F.count("*").alias("matches"))


# ---- indexes and statistics --------------------------------------------------------------------

_Z = "SELECT symbol, part, CAST(block AS BIGINT) AS block, min(r) AS start_row, max(r) AS end_row, min(ts) AS start_ts, max(ts) AS end_ts, min(value) AS min_value, max(value) AS max_value FROM (SELECT *, r // 16 AS block FROM (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY ts) - 1 AS r FROM scalar_view)) GROUP BY symbol, part, block"


@query("i01_zone_map", _Z)
def i01_zone_map(spark, d):
    return index.zone_map(views.scalars(spark, d), ["symbol", "part"], 16)


@query("i02_candidate_blocks", f"SELECT symbol, part, block, start_row, end_row FROM ({_Z}) WHERE end_ts >= {START} AND start_ts <= {END} AND max_value > 20000")
def i02_candidate_blocks(spark, d):
    z = index.zone_map(views.scalars(spark, d), ["symbol", "part"], 16)
    return index.candidates(z, p.gt(20_000), START, END).select("symbol", "part", "block", "start_row", "end_row")


_C = f"SELECT * FROM ({_Z}) WHERE end_ts >= {START} AND start_ts <= {END} AND max_value > 20000"


@query("i10_row_ranges", f"SELECT symbol, part, min(start_row) AS start_row, max(end_row) AS end_row FROM (SELECT *, block - row_number() OVER (PARTITION BY symbol, part ORDER BY block) AS g FROM ({_C})) GROUP BY symbol, part, g")
def i10_row_ranges(spark, d):
    z = index.zone_map(views.scalars(spark, d), ["symbol", "part"], 16)
    return index.row_ranges(index.candidates(z, p.gt(20_000), START, END), ["symbol", "part"]).drop("run")


@query("i03_value_index", "SELECT symbol, value, ts FROM scalar_view")
def i03_value_index(spark, d):
    return index.value_index(views.scalars(spark, d), ["symbol"])


_CH = f"SELECT part, min(ts) AS a, max(ts) AS b, sum(CASE WHEN {IN} THEN 1 ELSE 0 END) AS rows_in FROM {S} GROUP BY part HAVING max(ts) >= {START} AND min(ts) <= {END}"
_ZS = f"SELECT z.* FROM ({_Z}) z WHERE symbol = '{SYMBOL}' AND end_ts >= {START} AND start_ts <= {END}"
_RUNS = f"SELECT part, g, min(start_row) AS s, max(end_row) AS e FROM (SELECT *, block - row_number() OVER (PARTITION BY part ORDER BY block) AS g FROM ({_ZS}) WHERE max_value > 20000) GROUP BY part, g"


@query(
    "i06_stats_zone_map",
    f"SELECT (SELECT count(*) FROM ({_CH})) AS chunks_considered, (SELECT count(*) FROM ({_CH}) WHERE part NOT IN (SELECT part FROM ({_RUNS}))) AS chunks_pruned, (SELECT count(*) FROM ({_ZS})) AS blocks_considered, (SELECT count(*) FROM ({_ZS}) WHERE max_value <= 20000) AS blocks_pruned, (SELECT count(*) FROM ({_RUNS})) AS blocks_scanned, (SELECT CAST(coalesce(sum(e - s + 1), 0) AS BIGINT) FROM ({_RUNS})) AS rows_checked, (SELECT count(*) FROM {S} AND {IN} AND value > 20000) AS rows_matched, 'ZoneMap' AS index_used, false AS fallback_scan",
)
def i06_stats_zone_map(spark, d):
    return predicates.statistics(_scalar(spark, d), p.gt(20_000), START, END, block=16)


_IDX = f"SELECT part, sum(CASE WHEN value IN {_SOME} THEN 1 ELSE 0 END) AS n FROM {S} GROUP BY part HAVING max(ts) >= {START} AND min(ts) <= {END}"


@query(
    "i06_stats_value_index",
    f"SELECT (SELECT count(*) FROM ({_IDX})) AS chunks_considered, (SELECT count(*) FROM ({_IDX}) WHERE n = 0) AS chunks_pruned, 0::BIGINT AS blocks_considered, 0::BIGINT AS blocks_pruned, 0::BIGINT AS blocks_scanned, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM ({_IDX})) AS rows_checked, (SELECT count(*) FROM {S} AND {IN} AND value IN {_SOME}) AS rows_matched, 'ValueIndex' AS index_used, false AS fallback_scan",
)
def i06_stats_value_index(spark, d):
    return predicates.statistics(_scalar(spark, d), p.in_set(*_SOME), START, END)


@query(
    "i06_stats_full_scan",
    f"SELECT (SELECT count(*) FROM ({_CH})) AS chunks_considered, 0::BIGINT AS chunks_pruned, 0::BIGINT AS blocks_considered, 0::BIGINT AS blocks_pruned, 0::BIGINT AS blocks_scanned, (SELECT CAST(coalesce(sum(rows_in), 0) AS BIGINT) FROM ({_CH})) AS rows_checked, (SELECT count(*) FROM {S} AND {IN} AND value <> 4793) AS rows_matched, 'FullScan' AS index_used, true AS fallback_scan",
)
def i06_stats_full_scan(spark, d):
    return predicates.statistics(_scalar(spark, d), p.ne(4793), START, END)


# ---- inventory ------------------------------------------------------------------------------------


@query("a10_percentiles", "SELECT symbol, avg(value) AS mean, min(value) AS least, max(value) AS most, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM (SELECT symbol, CAST(value % 1024 AS DOUBLE) AS value FROM scalar_view) GROUP BY symbol")
def a10_percentiles(spark, d):
    v = views.scalars(spark, d).select("symbol", (F.col("value") % 1024).cast("double").alias("value"))
    return fx.percentiles(v, ["symbol"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("a11_checksum", f"SELECT count(*) AS loaded, CAST(sum(ma5 + ma20 + ma60 + volume20 + CASE WHEN close >= ma20 THEN close - open ELSE open - close END) AS VARCHAR) AS checksum FROM (SELECT *, {_roll('close', 5)} AS ma5, {_roll('close', 20)} AS ma20, {_roll('close', 60)} AS ma60, {_roll('volume', 20)} AS volume20 FROM bar_view)")
def a11_checksum(spark, d):
    return fx.checksum(views.bars(spark, d), ["symbol"]).withColumn("checksum", F.col("checksum").cast("string"))


@query("a12_row_hash", "SELECT symbol, count(*) AS n, CAST(sum(('0x' || substr(md5(ts || ',' || value), 1, 8))::BIGINT) AS BIGINT) AS digest FROM scalar_view GROUP BY symbol")
def a12_row_hash(spark, d):
    return fx.row_digest(views.scalars(spark, d), ["symbol"], "ts", "value")


# ---- sequences ------------------------------------------------------------------------------------------

_SEQ = ", o AS (SELECT symbol, ts, sequence, row_number() OVER w - 1 AS ordinal, lag(sequence) OVER w AS prev, lag(ts) OVER w AS prev_ts FROM seq_view WINDOW w AS (PARTITION BY symbol ORDER BY ts, ordinal))\n"


def _seen(spark, d) -> DataFrame:
    return seq.observed(views.sequences(spark, d), "sequence", *ALL, ["symbol"])


@query("q01_trade_ids", "SELECT symbol, count(*) AS records, arg_min(trade_id, ordinal) AS first_sequence, arg_max(trade_id, ordinal) AS last_sequence, count(*) FILTER (trade_id - prev > 1) AS gaps, count(*) FILTER (trade_id = prev) AS duplicates, count(*) FILTER (trade_id < prev) AS violations, count(*) FILTER (trade_id - prev <> 1) = 0 AS is_clean FROM (SELECT *, lag(trade_id) OVER (PARTITION BY symbol ORDER BY ts, ordinal) AS prev FROM trade_view) GROUP BY symbol")
def q01_trade_ids(spark, d):
    return seq.report(seq.observed(views.trades(spark, d), "trade_id", *ALL, ["symbol"]), ["symbol"])


@query("q05_report", _SEQ + "SELECT symbol, count(*) AS records, arg_min(sequence, ordinal) AS first_sequence, arg_max(sequence, ordinal) AS last_sequence, count(*) FILTER (sequence - prev > 1) AS gaps, count(*) FILTER (sequence = prev) AS duplicates, count(*) FILTER (sequence < prev) AS violations, count(*) FILTER (sequence - prev <> 1) = 0 AS is_clean FROM o GROUP BY symbol")
def q05_report(spark, d):
    return seq.report(_seen(spark, d), ["symbol"])


@query("q02_gaps", _SEQ + "SELECT symbol, prev AS previous_sequence, prev + 1 AS expected_sequence, sequence AS next_sequence, CAST(sequence - prev - 1 AS BIGINT) AS missing_count, prev_ts AS previous_ts, ts AS next_ts, ordinal - 1 AS previous_ordinal, ordinal FROM o WHERE sequence - prev > 1")
def q02_gaps(spark, d):
    return seq.gaps(_seen(spark, d), ["symbol"]).withColumn("missing_count", F.col("missing_count").cast("long"))


@query("q03_duplicates", _SEQ + "SELECT symbol, sequence, prev_ts AS first_ts, ts AS duplicate_ts, ordinal - 1 AS first_ordinal, ordinal AS duplicate_ordinal FROM o WHERE sequence = prev")
def q03_duplicates(spark, d):
    return seq.duplicates(_seen(spark, d), ["symbol"])


@query("q04_violations", _SEQ + "SELECT symbol, prev AS previous_sequence, sequence AS next_sequence, prev_ts AS previous_ts, ts AS next_ts, ordinal - 1 AS previous_ordinal, ordinal FROM o WHERE sequence < prev")
def q04_violations(spark, d):
    return seq.violations(_seen(spark, d), ["symbol"])


# ---- features -----------------------------------------------------------------------------------------------


def _rolling_query(name: str, column: str, n: int) -> None:
    @query(f"q06_{name}", f"SELECT symbol, ts, {_roll(column, n)} AS value FROM bar_view")
    def run(spark, d):
        return views.bars(spark, d).select("symbol", "ts", fx.rolling_mean(column, n, ["symbol"]).alias("value"))


for _name, (_column, _n) in fx.ROLLING.items():
    _rolling_query(_name, _column, _n)


@query("q07_sma_signal", "SELECT symbol, ts, row_number() OVER w >= 60 AND sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * 60 > sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * 20 AS desired FROM bar_view WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def q07_sma_signal(spark, d):
    return views.bars(spark, d).select("symbol", "ts", fx.sma_signal(["symbol"]).alias("desired"))


@query("q08_momentum_signal", "SELECT symbol, ts, coalesce(close > lag(close, 60) OVER (PARTITION BY symbol ORDER BY ts), false) AS desired FROM bar_view")
def q08_momentum_signal(spark, d):
    return views.bars(spark, d).select("symbol", "ts", fx.momentum_signal(["symbol"]).alias("desired"))


@query("q10_drawdown", "SELECT symbol, ts, round(1 - close / max(close) OVER (PARTITION BY symbol ORDER BY ts), 9) AS drawdown FROM bar_view")
def q10_drawdown(spark, d):
    return views.bars(spark, d).select("symbol", "ts", F.round(fx.drawdown("close", ["symbol"]), 9).alias("drawdown"))


@query("j01_alignment", f"SELECT b.symbol, b.ts, b.close, f.value FROM bar_view b JOIN (SELECT symbol, ts, {_roll('close', 20)} AS value FROM bar_view) f ON f.symbol = b.symbol AND f.ts = b.ts")
def j01_alignment(spark, d):
    return fx.aligned(views.bars(spark, d).select("symbol", "ts", "close"), _ma20(spark, d).select("symbol", "ts", "value"), ["symbol"])


@query("j02_misaligned", "SELECT ts, count(DISTINCT symbol) AS symbols FROM bar_view GROUP BY ts HAVING count(DISTINCT symbol) <> 5")
def j02_misaligned(spark, d):
    return fx.misaligned(views.bars(spark, d), 5)


_FLOWS = {
    "d_vwap": (fx.vwap, "CASE WHEN volume <> 0 THEN quote_volume / volume END"),
    "d_net_taker": (lambda: fx.net_taker().cast("double"), "CAST(2 * taker_buy_volume - volume AS DOUBLE)"),
    "d_cvd": (lambda: fx.cumulative_net_taker(["symbol"]).cast("double"), "CAST(sum(2 * taker_buy_volume - volume) OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE)"),
    "d_taker_buy_price": (fx.taker_buy_price, "CASE WHEN taker_buy_volume <> 0 THEN taker_buy_quote_volume / taker_buy_volume END"),
    "d_taker_sell_price": (fx.taker_sell_price, "CASE WHEN volume - taker_buy_volume <> 0 THEN (quote_volume - taker_buy_quote_volume) / (volume - taker_buy_volume) END"),
    "d_average_trade": (fx.average_trade, "CASE WHEN trade_count <> 0 THEN volume / trade_count END"),
}


def _flow_query(name: str, column, sql: str) -> None:
    @query(name, f"SELECT symbol, ts, {sql} AS value FROM bar_view")
    def run(spark, d):
        return views.bars(spark, d).select("symbol", "ts", column().alias("value"))


for _name, (_make, _sql) in _FLOWS.items():
    _flow_query(_name, _make, _sql)


# ---- overlaps ----------------------------------------------------------------------------------


def _spans(spark, d) -> DataFrame:
    """Chunks that overlap, made of the trades: each 8 rows a chunk, some stretched."""
    t = views.trades(spark, d).groupBy("symbol", (F.floor(F.col("trade_id") / 64)).alias("k")).agg(F.min("ts").alias("start_ts"), (F.max("ts") + F.when(F.min("trade_id") % 3 == 0, 20 * DAY // 24).otherwise(0)).alias("end_ts"), F.count("*").alias("count"))
    return t.select("symbol", "start_ts", "end_ts", "count", (F.col("k") % 5).alias("generation"), F.format_string("%08d", "k").alias("relative_path"))


_SP = f""", sp AS (SELECT symbol, min(ts) AS start_ts, max(ts) + CASE WHEN min(trade_id) % 3 = 0 THEN {20 * DAY // 24} ELSE 0 END AS end_ts, count(*) AS count, (trade_id // 64) % 5 AS generation, printf('%08d', trade_id // 64) AS relative_path FROM trade_view GROUP BY symbol, trade_id // 64),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY start_ts, end_ts, relative_path) AS overlap_group FROM (SELECT *, CASE WHEN start_ts > max(end_ts) OVER (PARTITION BY symbol ORDER BY start_ts, end_ts, relative_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY symbol ORDER BY start_ts, end_ts, relative_path) = 1 THEN 1 ELSE 0 END AS fresh FROM sp))
"""


@query("j03_overlap_groups", _SP + "SELECT symbol, relative_path, CAST(overlap_group AS BIGINT) AS overlap_group FROM g")
def j03_overlap_groups(spark, d):
    return overlaps.groups(_spans(spark, d), ["symbol"]).select("symbol", "relative_path", F.col("overlap_group").cast("long").alias("overlap_group"))


@query("t06_winner", _SP + "SELECT symbol, CAST(overlap_group AS BIGINT) AS overlap_group, participants, window_start, window_end, winner FROM (SELECT symbol, overlap_group, count(*) AS participants, min(start_ts) AS window_start, max(end_ts) AS window_end, arg_max(relative_path, (generation, end_ts - start_ts, count, relative_path)) FILTER (start_ts <= ws AND end_ts >= we) AS winner FROM (SELECT *, min(start_ts) OVER (PARTITION BY symbol, overlap_group) AS ws, max(end_ts) OVER (PARTITION BY symbol, overlap_group) AS we FROM g) GROUP BY symbol, overlap_group) WHERE participants > 1")
def t06_winner(spark, d):
    return overlaps.winners(_spans(spark, d), ["symbol"]).withColumn("overlap_group", F.col("overlap_group").cast("long"))


# ---- backtest ----------------------------------------------------------------------------------------------------

CAPITAL = 100_000.0


def _portfolio(spark, d) -> DataFrame:
    """The bars at times that all five symbols have."""
    b = views.bars(spark, d).select("symbol", "ts", "open", "close")
    return b.join(b.groupBy("ts").agg(F.count("*").alias("n")).where("n = 5").select("ts"), "ts")


def _backtest_sql(case: str) -> str:
    if case == "rsi":
        source = """d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS change FROM b),
a AS (SELECT symbol, 14::BIGINT AS n, sum(greatest(change, 0)) / 14.0::DOUBLE AS up, sum(greatest(-change, 0)) / 14.0::DOUBLE AS down FROM d WHERE n BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT d.symbol, d.n, (13 * a.up + greatest(d.change, 0)) / 14, (13 * a.down + greatest(-d.change, 0)) / 14 FROM a JOIN d ON d.symbol = a.symbol AND d.n = a.n + 1),
s AS (SELECT d.*, CASE WHEN up + down > 0 THEN 100 * up / (up + down) WHEN up IS NOT NULL THEN 50 END AS rsi FROM d LEFT JOIN a ON a.symbol = d.symbol AND a.n = d.n)"""
    else:
        source = "s AS (SELECT * FROM b)"
    desired = {
        "rsi": "coalesce(last_value(CASE WHEN rsi <= 30 THEN true WHEN rsi >= 70 THEN false END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), false)",
        "sma": "row_number() OVER (PARTITION BY symbol ORDER BY ts) >= 60 AND sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * 60 > sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * 20",
        "momentum": "coalesce(close > lag(close, 60) OVER (PARTITION BY symbol ORDER BY ts), false)",
    }[case]
    return f""", b AS (SELECT symbol, ts, open, close FROM bar_view WHERE ts IN (SELECT ts FROM bar_view GROUP BY ts HAVING count(*) = 5)),
{source},
w AS (SELECT symbol, ts, open, close, {desired} AS desired FROM s),
x AS (SELECT *, coalesce(lag(desired) OVER (PARTITION BY symbol ORDER BY ts), false) AS held FROM w),
y AS (SELECT *, held <> coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts), false) AS filled,
      CASE WHEN held THEN open / 100.0::DOUBLE * 1.0001::DOUBLE ELSE open / 100.0::DOUBLE * 0.9999::DOUBLE END AS price FROM x),
e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM y WHERE filled),
r AS (SELECT symbol, k, CASE WHEN held THEN 1 / (price * 1.001) ELSE price * 0.999 END AS factor FROM e),
m AS (SELECT symbol, k, exp(sum(ln(factor)) OVER (PARTITION BY symbol ORDER BY k)) * {CAPITAL / 5} AS worth FROM r),
q AS (SELECT y.symbol, y.ts, y.held, y.close, (SELECT max(e.k) FROM e WHERE e.symbol = y.symbol AND e.ts <= y.ts) AS k FROM y),
v AS (SELECT q.symbol, q.ts, CASE WHEN q.held THEN m.worth * q.close / 100.0 ELSE coalesce(m.worth, {CAPITAL / 5}) END AS equity FROM q LEFT JOIN m ON m.symbol = q.symbol AND m.k = q.k),
c AS (SELECT ts, sum(equity) AS equity FROM v GROUP BY ts),
z AS (SELECT ts, equity, max(equity) OVER (ORDER BY ts) AS peak FROM c)
SELECT '{case}' AS "case", (SELECT count(*) FROM b) AS rows, round(ln((SELECT arg_max(equity, ts) FROM z)), 6) AS log_equity, round((SELECT max(1 - equity / peak) FROM z), 6) AS max_drawdown,
 (SELECT count(*) FROM e) AS fills, (SELECT count(*) FROM e WHERE NOT held) AS completed_round_trips,
 (SELECT count(*) FROM (SELECT arg_max(held, ts) AS open FROM y GROUP BY symbol) WHERE open) AS open_positions, (SELECT count(*) FROM (SELECT arg_max(desired <> held, ts) AS waits FROM y GROUP BY symbol) WHERE waits) AS pending_targets
"""


def _backtest_query(case: str, sql: str | None) -> None:
    @query(f"b01_backtest_{case}", sql)
    def run(spark, d):
        a = backtest.accounts(_portfolio(spark, d), case, 100, CAPITAL)
        return backtest.summary(a, case, CAPITAL).select("case", "rows", F.round(F.log("final_equity"), 6).alias("log_equity"), F.round("max_drawdown", 6).alias("max_drawdown"), "fills", "completed_round_trips", "open_positions", "pending_targets")


for _case in backtest.CASES:
    _backtest_query(_case, _backtest_sql(_case))


@query("q09_rsi", _backtest_sql("rsi").split("w AS (")[0].rstrip().rstrip(",") + " SELECT symbol, ts, round(rsi, 6) AS rsi, coalesce(last_value(CASE WHEN rsi <= 30 THEN true WHEN rsi >= 70 THEN false END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), false) AS desired FROM s")
def q09_rsi(spark, d):
    rows = backtest.strength(_portfolio(spark, d))
    return rows.select("symbol", "ts", F.round("rsi", 6).alias("rsi"), backtest.rsi_signal("rsi").alias("desired"))
