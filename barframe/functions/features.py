"""Integer features of bars, flow metrics and the research checksum; all window or column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name -> (column, bars): the usual rolling means (fixed values).
ROLLING = {"ma5": ("close", 5), "ma20": ("close", 20), "ma60": ("close", 60), "volume20": ("volume", 20)}


def floor_div(total: Column, n: Column) -> Column:
    """Floor of a quotient of whole numbers, exact beyond 2**53."""
    return F.floor(total.cast("decimal(38,0)") / n.cast("decimal(20,0)")).cast("long")


def bars_of(by: list[str], n: int):
    return Window.partitionBy(*by).orderBy("ts").rowsBetween(1 - n, 0)


def rolling_mean(column: str, n: int, by: list[str]) -> Column:
    """Floor mean over the last n rows that exist."""
    w = bars_of(by, n)
    return floor_div(F.sum(column).over(w), F.count(column).over(w))


def with_sums(rows: DataFrame, by: list[str], sums: dict[str, tuple[str, int]]) -> DataFrame:
    """name -> (column, n): sums over the last n rows that exist, of columns without nulls, and `_seen`, the rows so far.

    A sum is the difference of two running sums, so its cost doesn't grow with n.
    """
    w = Window.partitionBy(*by).orderBy("ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    columns = list(dict.fromkeys(c for c, _ in sums.values()))
    run = rows.select("*", F.row_number().over(w).cast("long").alias("_seen"), *(F.sum(F.col(c).cast("decimal(38,0)")).over(so_far).alias(f"_run_{c}") for c in columns))
    last = [(F.col(f"_run_{c}") - F.coalesce(F.lag(f"_run_{c}", n).over(w), F.lit(0))).cast("long").alias(k) for k, (c, n) in sums.items()]
    return run.select(*rows.columns, "_seen", *last)


def _floored(total: Column, n: Column) -> Column:
    """Floor of a quotient of 64-bit integers, without leaving them."""
    return F.call_function("div", total - F.pmod(total, n), n)


def with_rolling(bars: DataFrame, by: list[str]) -> DataFrame:
    """All usual features; they share one shuffle and sort."""
    rows = with_sums(bars, by, {f"_sum_{k}": v for k, v in ROLLING.items()})
    return rows.select(*bars.columns, *(_floored(F.col(f"_sum_{k}"), F.least("_seen", F.lit(n).cast("long"))).alias(k) for k, (_, n) in ROLLING.items()))


def with_sma_signal(bars: DataFrame, by: list[str], name: str, fast: int = 20, slow: int = 60) -> DataFrame:
    """Bars with sma_signal() as a column, whatever the length of the means."""
    rows = with_sums(bars, by, {"_fast": ("close", fast), "_slow": ("close", slow)})
    up = F.col("_fast").cast("decimal(20,0)") * slow > F.col("_slow").cast("decimal(20,0)") * fast
    return rows.select(*bars.columns, ((F.col("_seen") >= slow) & up).alias(name))


def sma_signal(by: list[str], fast: int = 20, slow: int = 60) -> Column:
    """fast mean above slow mean, false before slow bars."""
    w = Window.partitionBy(*by).orderBy("ts")
    up = F.sum("close").over(bars_of(by, fast)) * slow > F.sum("close").over(bars_of(by, slow)) * fast
    return (F.row_number().over(w) >= slow) & up


def momentum_signal(by: list[str], lookback: int = 60) -> Column:
    before = F.lag("close", lookback).over(Window.partitionBy(*by).orderBy("ts"))
    return F.coalesce(F.col("close") > before, F.lit(False))


def drawdown(value: str, by: list[str]) -> Column:
    """1 - value / running peak."""
    peak = F.max(value).over(Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return 1 - F.col(value) / peak


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def vwap() -> Column:
    return _ratio(F.col("quote_volume"), F.col("volume"))


def net_taker() -> Column:
    return 2 * F.col("taker_buy_volume") - F.col("volume")


def cumulative_net_taker(by: list[str]) -> Column:
    return F.sum(net_taker()).over(Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))


def taker_buy_price() -> Column:
    return _ratio(F.col("taker_buy_quote_volume"), F.col("taker_buy_volume"))


def taker_sell_price() -> Column:
    return _ratio(F.col("quote_volume") - F.col("taker_buy_quote_volume"), F.col("volume") - F.col("taker_buy_volume"))


def average_trade() -> Column:
    return _ratio(F.col("volume"), F.col("trade_count"))


def aligned(bars: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    """Bars with their feature rows; equal timestamps only. Count both sides to prove alignment."""
    return bars.join(features, [*by, "ts"])


def misaligned(frames: DataFrame, symbols: int) -> DataFrame:
    """Timestamps that not all symbols have: a portfolio needs this to be empty."""
    return frames.groupBy("ts").agg(F.countDistinct("symbol").alias("symbols")).where(F.col("symbols") != symbols)


def checksum(bars: DataFrame, by: list[str]) -> DataFrame:
    """The exact sum of all four features and of close - open, signed by close against ma20."""
    wide = lambda c: c.cast("decimal(38,0)")
    signed = F.when(F.col("close") >= F.col("ma20"), wide(F.col("close")) - wide(F.col("open"))).otherwise(wide(F.col("open")) - wide(F.col("close")))
    total = signed
    for k in ROLLING:
        total = total + wide(F.col(k))
    return with_rolling(bars, by).agg(F.count("*").alias("loaded"), F.sum(total.cast("decimal(38,0)")).alias("checksum"))


def percentiles(rows: DataFrame, by: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Mean, least, most and interpolated percentiles of a value; exact, from counts of its distinct values."""
    q = F.percentile(value, F.array(*map(F.lit, ranks.values())))
    found = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), q.alias("_q"))
    return found.select(*by, "mean", "least", "most", *(F.get("_q", k).alias(n) for k, n in enumerate(ranks)))


def row_digest(rows: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Rows and the sum of a hash of each, whatever their order: 32 bits of the MD5 of the values with commas between."""
    mark = F.conv(F.substring(F.md5(F.concat_ws(",", *columns).cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(mark).alias("digest"))
