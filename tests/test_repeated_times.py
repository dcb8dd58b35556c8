"""Queries through a store on events of which many have one time, held against their SQL."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from barframe.errors import BarframeError
from barframe.store.arrays import Writer
from barframe.store.bridge import call

COPIES = 3


@pytest.fixture(scope="module")
def repeated(spark, sf, tmp_path_factory):
    """The events of sf three times, with keys that go on."""
    d = str(tmp_path_factory.mktemp("repeated"))
    one = spark.read.parquet(f"{sf}/events.parquet")
    n = one.agg(F.max("event_id")).first()[0] + 1
    out = one
    for k in range(1, COPIES):
        out = out.unionByName(one.withColumn("event_id", F.col("event_id") + k * n))
    out.repartition(4, "event_id").write.parquet(f"{d}/events.parquet")
    return d


def rows(found, names):
    return Counter(tuple(r[n] for n in names) for r in found)


def check(spark, d, name):
    got = e.queries()[name](spark, d)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    want = con.execute(e.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.collect(), names) == rows((dict(zip(names, r, strict=True)) for r in want.fetchall()), names)


NAMES = [
    "m03_scrub",
    "a01_store_series",
    "w10_append_scalars",
    "w13_array_writes",
    "a02_store_stats",
    "a03_store_parts",
    "a04_store_chunks",
    "a05_store_coverage",
    "a07_store_indicators",
    "a06_json_inventory",
    "c05_backtest_view",
    "i03_stored_index",
    "c01_session",
    "i06_p06_eq_counters",
    "a08_health",
    "i06_p07_ne_counters",
    "i06_p10_between_counters",
    "i06_p11_in_counters",
    "m01_validate",
    "i08_capabilities",
    "p02_store_activity",
    "p01_store_prices",
    "p06_eq_store",
    "p10_between_store",
    "p07_ne_store",
    "p11_in_store",
]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, repeated, name):
    check(spark, repeated, name)


def test_rows_of_one_time_by_json_and_arrays(spark, tmp_path):
    """What such a series holds comes back whole and in order, by the JSON verbs and by arrays; others refuse it."""
    root, b = str(tmp_path / "st"), {"symbol": "BTC", "timeframe": "1m", "category": "feature", "name": "x"}
    rows = [{"ts": 60_000 * (i // 2), "value": 9 - i} for i in range(6)]
    with pytest.raises(BarframeError):
        call(spark, root, "write-scalar-range", b | {"timeframe_ms": 60_000, "records": rows})
    for part in (rows[:4], rows[4:]):
        call(spark, root, "write-scalar-range", b | {"name": "y", "timeframe_ms": 60_000, "equal_ts": True, "records": part})
    found = call(spark, root, "read-scalar-range", b | {"name": "y", "start_ts": 0, "end_ts": 1 << 60})["records"]
    assert found == rows
    array = np.array([(r["ts"], r["value"]) for r in rows], [("ts", np.int64), ("value", np.int64)])
    with pytest.raises(BarframeError):
        Writer(spark, root).write_scalar_range("BTC", "1m", "feature", "z", array, timeframe_ms=60_000)
    with pytest.raises(BarframeError):
        Writer(spark, root).write_scalar_range("BTC", "1m", "feature", "u", array[::-1], timeframe_ms=60_000, equal_ts=True)
    Writer(spark, root).write_scalar_range("BTC", "1m", "feature", "v", array, timeframe_ms=60_000, equal_ts=True)
    assert call(spark, root, "read-scalar-range", b | {"name": "v", "start_ts": 0, "end_ts": 1 << 60})["records"] == rows
