"""Predicate queries on scalars, and what an index would have done for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import invalid_input
from ..functions.predicate import Predicate
from .index import zone_map

FULL_SCAN, ZONE_MAP, VALUE_INDEX = "FullScan", "ZoneMap", "ValueIndex"


def matches(df: DataFrame, predicate: Predicate, start: int, end: int, values: bool = True) -> DataFrame:
    """(ts, value) in order of time; value is null unless asked for. Reversed ranges are an error."""
    predicate.validated()
    if start > end:
        raise invalid_input(f"start {start} is after end {end}")
    if predicate.impossible:
        found = df.limit(0)
    else:
        found = df.where(F.col("ts").between(start, end) & predicate.column(F.col("value")))
    value = F.col("value") if values else F.lit(None).cast("long").alias("value")
    return found.select("ts", value).orderBy("ts")


def timestamps(df: DataFrame, predicate: Predicate, start: int, end: int) -> DataFrame:
    return matches(df, predicate, start, end, values=False).select("ts")


def points(df: DataFrame, predicate: Predicate, start: int, end: int) -> DataFrame:
    return matches(df, predicate, start, end)


def find(df: DataFrame, predicate: Predicate, start: int, end: int) -> DataFrame:
    """The older finders: distinct timestamps in order; a reversed range is empty. The index they name changes no result."""
    if start > end:
        return df.select("ts").limit(0)
    return df.where(F.col("ts").between(start, end) & predicate.column(F.col("value"))).select("ts").distinct().orderBy("ts")


def access_path(predicate: Predicate, has_zone_map: bool, has_value_index: bool) -> str:
    if predicate.discrete and has_value_index:
        return VALUE_INDEX
    if predicate.ranged and has_zone_map:
        return ZONE_MAP
    return FULL_SCAN


def statistics(df: DataFrame, predicate: Predicate, start: int, end: int, part: str = "part", block: int = 256, has_zone_map: bool = True, has_value_index: bool = True, zones: DataFrame | None = None) -> DataFrame:
    """One row of counters for one series whose chunks are its parts.

    A chunk that meets the range is considered. With a zone map, blocks that meet the
    range are considered, those that cannot match pruned, and runs of neighbours that
    remain are scanned; with a value index, the rows of its slices are checked. zones: a
    stored zone map; else one is made.
    """
    predicate.validated()
    if start > end:
        raise invalid_input(f"start {start} is after end {end}")
    path = access_path(predicate, has_zone_map, has_value_index)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    inside = F.col("ts").between(start, end)
    value = predicate.column(F.col("value"))
    chunks = df.groupBy(part).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.sum(inside.cast("long")).alias("rows_in"), F.sum((inside & value).cast("long")).alias("hits"), F.sum(value.cast("long")).alias("sliced")).where((F.col("b") >= start) & (F.col("a") <= end))
    if path == ZONE_MAP:
        z = (zone_map(df, [part], block) if zones is None else zones).where((F.col("end_ts") >= start) & (F.col("start_ts") <= end)).withColumn("may", predicate.may_match(F.col("min_value"), F.col("max_value")))
        before = F.lag("end_row").over(Window.partitionBy(part).orderBy("start_row"))
        runs = z.where("may").withColumn("fresh", (F.coalesce(before, F.lit(-2)) + 1 != F.col("start_row")).cast("long"))
        of = z.groupBy(part).agg(F.count("*").alias("blocks")).join(runs.groupBy(part).agg(F.count("*").alias("kept"), F.sum("fresh").alias("runs"), F.sum(F.col("end_row") - F.col("start_row") + 1).alias("checked")), part, "left")
        chunks = chunks.join(of, part, "left")
        cols = {"chunks_pruned": zero(F.sum(F.col("kept").isNull().cast("long"))), "blocks_considered": zero(F.sum("blocks")), "blocks_pruned": zero(F.sum(F.col("blocks") - F.coalesce("kept", F.lit(0)))), "blocks_scanned": zero(F.sum("runs")), "rows_checked": zero(F.sum("checked"))}
    elif path == VALUE_INDEX:
        cols = {"chunks_pruned": zero(F.sum((F.col("sliced") == 0).cast("long"))), "blocks_considered": F.lit(0).cast("long"), "blocks_pruned": F.lit(0).cast("long"), "blocks_scanned": F.lit(0).cast("long"), "rows_checked": zero(F.sum("sliced"))}
    else:
        cols = {"chunks_pruned": F.lit(0).cast("long"), "blocks_considered": F.lit(0).cast("long"), "blocks_pruned": F.lit(0).cast("long"), "blocks_scanned": F.lit(0).cast("long"), "rows_checked": zero(F.sum("rows_in"))}
    return chunks.agg(F.count("*").alias("chunks_considered"), *(v.alias(k) for k, v in cols.items()), zero(F.sum("hits")).alias("rows_matched")).select("*", F.lit(path).alias("index_used"), F.lit(path == FULL_SCAN).alias("fallback_scan"))


def merged_index(paths: list[str]) -> str:
    """Of the paths of several chunks: an index wins over a scan."""
    found = {p for p in paths if p != FULL_SCAN}
    return FULL_SCAN if not found else found.pop() if len(found) == 1 else "ZoneMapAndValueIndex"
