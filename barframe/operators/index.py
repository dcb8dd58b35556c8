"""Zone maps and value indexes as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicate import Predicate

BLOCK = 256


def zone_map(df: DataFrame, by: list[str], block: int = BLOCK, span: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """A row for each block of rows of a chunk; blocks restart in each chunk. by: what names a chunk; ties: what orders rows of one time.

    span: a number that grows with ts; rows are then numbered span by span, so that a large chunk is more than one task.
    """
    rows = df.withColumn("_span", F.lit(0) if span is None else span)
    w = Window.partitionBy(*by, "_span").orderBy("ts", *ties)
    rows = rows.withColumn("_row", F.row_number().over(w) - 1)
    if span is not None:
        sizes = rows.groupBy(*by, "_span").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.join(sizes.select(*by, "_span", before.alias("_before")), [*by, "_span"]).withColumn("_row", F.col("_row") + F.col("_before"))
    blocks = rows.groupBy(*by, F.floor(F.col("_row") / block).alias("block"))
    return blocks.agg(F.min("_row").cast("long").alias("start_row"), F.max("_row").cast("long").alias("end_row"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def candidates(zones: DataFrame, predicate: Predicate, start: int, end: int) -> DataFrame:
    """Blocks that meet the range and may match."""
    predicate.validated()
    return zones.where((F.col("end_ts") >= start) & (F.col("start_ts") <= end) & predicate.may_match(F.col("min_value"), F.col("max_value")))


def row_ranges(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring blocks joined to ranges of rows."""
    w = Window.partitionBy(*by).orderBy("start_row")
    fresh = (F.coalesce(F.lag("end_row").over(w), F.lit(-2)) + 1 != F.col("start_row")).cast("long")
    runs = blocks.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w))
    return runs.groupBy(*by, "run").agg(F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"))


def value_index(df: DataFrame, by: list[str]) -> DataFrame:
    """(value, ts) of every row; written sorted, its Parquet statistics serve exact lookups."""
    return df.select(*by, "value", "ts")


def write_value_index(df: DataFrame, by: list[str], path: str, n: int | None = None) -> None:
    """The index as a table, a folder for what by names, whose files hold ranges of values, so a lookup reads few row groups."""
    cols = [F.col(c) for c in (*by, "value", "ts")]
    index = value_index(df, by)
    (index.repartitionByRange(n, *cols) if n else index.repartitionByRange(*cols)).sortWithinPartitions(*cols).write.partitionBy(*by).parquet(path)


def lookup(index: DataFrame, predicate: Predicate, start: int, end: int) -> DataFrame:
    """Matches from the index alone."""
    predicate.validated()
    return index.where(predicate.column(F.col("value")) & F.col("ts").between(start, end)).select("ts", "value").orderBy("ts")
