"""Overlapping chunks: groups by a running end, not by a join of all pairs, and their winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def groups(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunks with the number of their group; a chunk that starts after all ends before begins a group."""
    order = [F.col(c) for c in ("start_ts", "end_ts", "relative_path")]
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = chunks.withColumn("_fresh", F.coalesce((F.col("start_ts") > before).cast("long"), F.lit(1)))
    return marked.withColumn("overlap_group", F.sum("_fresh").over(w)).drop("_fresh")


def winners(chunks: DataFrame, by: list[str]) -> DataFrame:
    """A row for each group of two or more: the best of those that cover its whole window, null if none does.

    Best: generation, span, count, then path, the highest first.
    """
    own = [*by, "overlap_group"]
    w = Window.partitionBy(*own)
    g = groups(chunks, by).select("*", F.min("start_ts").over(w).alias("window_start"), F.max("end_ts").over(w).alias("window_end"))
    covers = (F.col("start_ts") <= F.col("window_start")) & (F.col("end_ts") >= F.col("window_end"))
    rank = F.struct("generation", (F.col("end_ts") - F.col("start_ts")).alias("span"), "count", "relative_path")
    out = g.groupBy(*own).agg(F.count("*").alias("participants"), F.min("start_ts").alias("window_start"), F.max("end_ts").alias("window_end"), F.max(F.when(covers, rank)).alias("best"))
    return out.where("participants > 1").select(*own, "participants", "window_start", "window_end", F.col("best.relative_path").alias("winner"))
