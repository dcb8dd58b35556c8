"""What the operators share: the shared folder, row packing and Python batches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and 0x09-0x0D, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
REPO = str(Path(__file__).resolve().parents[2])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), REPO) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without it; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="barframe-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.

    What dropped() doesn't delete before goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barframe-{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables from written() that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are out of use; it does so when the driver collects garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; one that is missing comes as a null string."""
    have = set(df.columns)
    return df.select(*(F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names))


def crc_of(col: str) -> Column:
    """crc32 of a key as text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def utf8(column: pa.Array) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """A string column of an Arrow batch, null as empty, ill-formed bytes replaced."""
    return [x.decode("utf-8", "replace") for x in utf8(column)]


#: Rows of a batch that Python gets at once, at most: texts may be long.
BATCH_ROWS = 1000


def arrow_map(df: DataFrame, work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches of at most BATCH_ROWS rows, a setting of the session."""
    reach(df.sparkSession)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(rows)) <= BATCH_ROWS:
        df.sparkSession.conf.set(rows, BATCH_ROWS)
    return df.mapInArrow(work, schema)
