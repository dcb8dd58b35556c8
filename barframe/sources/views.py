"""Series derived from a table of events (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _ms():
    return F.unix_millis(F.col("ts").cast("timestamp"))


def _cents():
    return F.round(F.col("value") * 100).cast("long")


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(F.col("event_type").alias("symbol"), F.lit("feature").alias("category"), F.lit("1m").alias("timeframe"), F.lit("value").alias("name"), _ms().alias("ts"), _cents().alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("part"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    side = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).cast("byte")
    return e.select(F.col("event_type").alias("symbol"), _ms().alias("ts"), (_ms() + F.col("user_id") % 10).alias("recv_ts"), F.col("event_id").alias("trade_id"), _cents().alias("price"), F.col("user_id").alias("qty"), side.alias("side"), F.lit(0).cast("short").alias("flags"), F.col("event_id").alias("ordinal"), F.date_format("ts", "yyyy-MM-dd'T'HH").alias("part"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    number = F.floor(F.col("event_id") / 2) - F.when(F.col("event_id") % 97 == 0, 50).otherwise(0)
    return e.select(F.col("event_type").alias("symbol"), _ms().alias("ts"), F.col("event_id").alias("ordinal"), number.alias("sequence"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with flow fields, null for the symbol `error`."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("ts"), _cents().alias("v"), "user_id", "event_id")
    taken = F.col("event_id") % 2 == 0
    flow = lambda c, k: F.when(F.col("symbol") != "error", c).cast("long").alias(k)
    g = e.groupBy("symbol", "ts").agg(F.min_by("v", "event_id").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "event_id").alias("close"), F.sum("user_id").alias("volume"), F.sum(F.col("v") * F.col("user_id")).alias("q"), F.count("*").alias("n"), F.sum(F.when(taken, F.col("user_id")).otherwise(0)).alias("tv"), F.sum(F.when(taken, F.col("v") * F.col("user_id")).otherwise(0)).alias("tq"))
    return g.select("symbol", F.lit("1h").alias("timeframe"), "ts", "open", "high", "low", "close", "volume", flow(F.col("q"), "quote_volume"), flow(F.col("n"), "trade_count"), flow(F.col("tv"), "taker_buy_volume"), flow(F.col("tq"), "taker_buy_quote_volume"))


#: The same in SQL, as a WITH clause.
SQL = """WITH scalar_view AS (SELECT event_type AS symbol, 'feature' AS category, '1m' AS timeframe, 'value' AS name,
 epoch_us(ts)//1000 AS ts, CAST(round(value*100) AS BIGINT) AS value, strftime(ts,'%Y-%m-%d') AS part FROM events),
trade_view AS (SELECT event_type AS symbol, epoch_us(ts)//1000 AS ts, epoch_us(ts)//1000 + user_id%10 AS recv_ts, event_id AS trade_id,
 CAST(round(value*100) AS BIGINT) AS price, user_id AS qty, CAST(CASE WHEN event_id%2=0 THEN 1 ELSE -1 END AS TINYINT) AS side, 0::SMALLINT AS flags, event_id AS ordinal, strftime(ts,'%Y-%m-%dT%H') AS part FROM events),
seq_view AS (SELECT event_type AS symbol, epoch_us(ts)//1000 AS ts, event_id AS ordinal, event_id//2 - CASE WHEN event_id%97=0 THEN 50 ELSE 0 END AS sequence FROM events),
bar_view AS (SELECT symbol, '1h' AS timeframe, ts, arg_min(v,event_id) AS open, max(v) AS high, min(v) AS low,
 arg_max(v,event_id) AS close, CAST(sum(user_id) AS BIGINT) AS volume,
 CASE WHEN symbol='error' THEN NULL ELSE CAST(sum(v*user_id) AS BIGINT) END AS quote_volume,
 CASE WHEN symbol='error' THEN NULL ELSE count(*) END AS trade_count,
 CASE WHEN symbol='error' THEN NULL ELSE CAST(sum(CASE WHEN event_id%2=0 THEN user_id ELSE 0 END) AS BIGINT) END AS taker_buy_volume,
 CASE WHEN symbol='error' THEN NULL ELSE CAST(sum(CASE WHEN event_id%2=0 THEN v*user_id ELSE 0 END) AS BIGINT) END AS taker_buy_quote_volume
 FROM (SELECT event_type AS symbol, epoch_ms(date_trunc('hour',ts)) AS ts, CAST(round(value*100) AS BIGINT) AS v, user_id, event_id FROM events) x GROUP BY symbol, ts)
"""
