"""Adjacent-row scans of sequence numbers: gaps, duplicates and violations of every series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import invalid_input

MOST = (1 << 63) - 1


def observed(df: DataFrame, field: str, start: int, end: int, by: list[str], tie: str = "ordinal") -> DataFrame:
    """Rows in the range with the row before: one window, on which all reports build."""
    if start > end:
        raise invalid_input(f"start {start} is after end {end}")
    w = Window.partitionBy(*by).orderBy("ts", tie)
    rows = df.where(F.col("ts").between(start, end))
    return rows.select(*by, "ts", F.col(field).alias("sequence"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.lag(field).over(w).alias("previous"), F.lag("ts").over(w).alias("previous_ts"))


def _delta():
    return F.col("sequence").cast("decimal(38,0)") - F.col("previous").cast("decimal(38,0)")


def gaps(seen: DataFrame, by: list[str]) -> DataFrame:
    after = F.when(F.col("previous") == MOST, F.lit(MOST)).otherwise(F.col("previous") + 1)
    return seen.where(_delta() > 1).select(*by, F.col("previous").alias("previous_sequence"), after.alias("expected_sequence"), F.col("sequence").alias("next_sequence"), (_delta() - 1).cast("decimal(20,0)").alias("missing_count"), "previous_ts", F.col("ts").alias("next_ts"), (F.col("ordinal") - 1).alias("previous_ordinal"), "ordinal")


def duplicates(seen: DataFrame, by: list[str]) -> DataFrame:
    return seen.where(F.col("sequence") == F.col("previous")).select(*by, "sequence", F.col("previous_ts").alias("first_ts"), F.col("ts").alias("duplicate_ts"), (F.col("ordinal") - 1).alias("first_ordinal"), F.col("ordinal").alias("duplicate_ordinal"))


def violations(seen: DataFrame, by: list[str]) -> DataFrame:
    return seen.where(F.col("sequence") < F.col("previous")).select(*by, F.col("previous").alias("previous_sequence"), F.col("sequence").alias("next_sequence"), "previous_ts", F.col("ts").alias("next_ts"), (F.col("ordinal") - 1).alias("previous_ordinal"), "ordinal")


def report(seen: DataFrame, by: list[str]) -> DataFrame:
    """A row a series; first and last are those of the scan, not the least and most."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = seen.groupBy(*by).agg(F.count("*").alias("records"), F.min_by("sequence", "ordinal").alias("first_sequence"), F.max_by("sequence", "ordinal").alias("last_sequence"), n(_delta() > 1).alias("gaps"), n(_delta() == 0).alias("duplicates"), n(_delta() < 0).alias("violations"))
    return out.withColumn("is_clean", (F.col("gaps") == 0) & (F.col("duplicates") == 0) & (F.col("violations") == 0))
