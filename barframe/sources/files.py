"""Rows of the record families from files, with their schemas stated, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import invalid_input
from ..schema import FAMILIES, MISSING

FORMATS = ("parquet", "csv", "json", "orc")


def read(spark: SparkSession, family: str, path: str, form: str = "parquet", **options: str) -> DataFrame:
    """A family's columns from files; outside, absent flow values may be the least 64-bit integer: they become null."""
    if form not in FORMATS:
        raise invalid_input(f"unknown format {form}")
    f = FAMILIES[family]
    df = spark.read.format(form).options(**({"header": "true"} | options if form == "csv" else options)).schema(f.schema).load(path)
    return df.select(*(F.when(F.col(c.name) != F.lit(MISSING), F.col(c.name)).alias(c.name) if c.nullable else F.col(c.name) for c in f.schema))


def write(df: DataFrame, family: str, path: str, form: str = "parquet", sentinel: bool = False) -> None:
    """A family's columns to files, absent flow values as null or as the sentinel."""
    if form not in FORMATS:
        raise invalid_input(f"unknown format {form}")
    f = FAMILIES[family]
    cols = [F.coalesce(F.col(c.name), F.lit(MISSING)).alias(c.name) if sentinel and c.nullable else F.col(c.name) for c in f.schema]
    w = df.select(*cols).write.format(form)
    (w.option("header", "true") if form == "csv" else w).save(path)
