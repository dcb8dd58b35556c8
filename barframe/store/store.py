"""A store: series in folders of Parquet chunks, each with a manifest that says what counts.

A write is one Spark job for all parts of a request, into a staging folder; the staged
files are checked, then each part moves to its place and the manifest is published, so a
part is the unit of commit, and the source is read once. A chunk of scalars has a zone map
and an index of its values beside it, and its least and most value in the manifest.
Reads take the files that the manifest lists for the range: that prunes by time and
state before Spark plans the scan.

One writer holds the store at a time, by a lease in a file that it renews; the lease of a
process that is gone, or of one that hasn't renewed it, can be taken over. Handles for
reading leave leases too, and keep writers out while they are open.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import keys
from ..errors import BarframeError, invalid_data, invalid_input, not_found
from ..functions.predicate import Predicate
from ..keys import Key
from ..operators import index, predicates, reads, sequences
from ..schema import FAMILIES, KLINE, KLINE_FLOW, SCALAR, UNITS, Family, flow_faults, part_of
from .files import Files

ACTIVE, SEALED, MERGING, REPLACED = "active", "sealed", "merging", "replaced"
CHUNK = T.StructType([T.StructField(n, t) for n, t in (("symbol", T.StringType()), ("category", T.StringType()), ("name", T.StringType()), ("family", T.StringType()), ("chunk_id", T.StringType()), ("part", T.StringType()), ("start_ts", T.LongType()), ("end_ts", T.LongType()), ("count", T.LongType()), ("state", T.StringType()), ("generation", T.LongType()), ("relative_path", T.StringType()))])
MANIFEST, LOCK, READERS, PENDING, SNAPSHOT = "manifest.json", "lock", "readers", "pending", "snapshot.json"
ZONES, VALUES = "zmap", "vix"
#: Seconds after which a lease that isn't renewed has ended.
LEASE = 120.0
#: A part's rows are dealt to that many spans of time at most; small ones share a file.
SPANS = 32
SPAN_MS = {"month": 31 * 86_400_000 // SPANS, "day": 86_400_000 // SPANS, "hour": 3_600_000 // SPANS}


def _lease() -> str:
    return json.dumps({"owner": uuid.uuid4().hex, "host": socket.gethostname(), "pid": os.getpid(), "time": time.time()})


def _ended(text: str) -> bool:
    """Whether the holder of a lease is gone; a text that isn't a lease is left over."""
    try:
        held = json.loads(text)
        host, pid, at = held["host"], int(held["pid"]), float(held["time"])
    except (ValueError, TypeError, KeyError):
        return True
    if host == socket.gethostname():
        try:
            os.kill(pid, 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            pass
    return time.time() - at > LEASE


class Policy:
    """When to merge a part: that many deltas, bytes of deltas or appends."""

    def __init__(self, deltas: int = 4, delta_bytes: int = 4 << 20, appends: int = 4, auto_merge: bool = False):
        self.deltas, self.delta_bytes, self.appends, self.auto_merge = deltas, delta_bytes, appends, auto_merge


class Store:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, policy: Policy | None = None):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.files, self.policy = Files(spark), policy or Policy()
        self.cache: dict[Key, dict] = {}
        self.lease = ""
        if read_only and self.pending():
            raise invalid_data("recovery is pending; open the store for writing first")
        if read_only and self.files.exists(f"{self.root}/series") and not self.sealed():
            self.lease = f"{self.root}/{READERS}/{uuid.uuid4().hex}"
            self.files.create(self.lease, _lease())
        if not read_only and self.pending():
            with self._locked(recover=True):
                self.recover()

    def close(self) -> None:
        """Let writers in again, if this handle is for reading."""
        if self.lease:
            self.files.delete(self.lease)
            self.lease = ""

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def __del__(self):
        if getattr(self, "lease", "") and self.spark.sparkContext._jsc is not None:
            self.close()

    # ---- layout and manifests -----------------------------------------------------------

    def init(self) -> None:
        self.files.make(f"{self.root}/series")

    def folder(self, key: Key) -> str:
        return f"{self.root}/series/" + "/".join(quote(x, safe="@") for x in key)

    def keys(self) -> list[Key]:
        base, names = f"{self.root}/series", self.files.names
        found = [Key(unquote(s), unquote(c), unquote(n)) for s in names(base) for c in names(f"{base}/{s}") for n in names(f"{base}/{s}/{c}")]
        return sorted(k for k in found if self.files.has(f"{self.folder(k)}/{MANIFEST}"))

    def meta(self, key: Key) -> dict[str, Any]:
        if key not in self.cache:
            path = f"{self.folder(key)}/{MANIFEST}"
            if not self.files.has(path):
                raise not_found(f"no series {':'.join(key)}")
            self.cache[key] = self.files.load(path)
        return self.cache[key]

    def _publish(self, key: Key, meta: dict) -> None:
        meta["chunks"].sort(key=lambda c: (c["start_ts"], c["end_ts"], c["chunk_id"]))
        self.files.publish(f"{self.folder(key)}/{MANIFEST}", json.dumps(meta, indent=1))
        self.cache[key] = meta

    def family(self, key: Key) -> Family:
        return FAMILIES[self.meta(key)["family"]]

    # ---- locks and recovery -------------------------------------------------------------

    def pending(self) -> bool:
        return self.files.exists(f"{self.root}/{PENDING}")

    def sealed(self) -> bool:
        return self.files.exists(f"{self.root}/{SNAPSHOT}")

    def _take(self, path: str, lease: str) -> None:
        """Create the lock, or take over one whose holder is gone."""
        for _ in range(2):
            if self.files.create(path, lease):
                return
            held = self.files.read(path) if self.files.exists(path) else ""
            if held and not _ended(held):
                break
            aside = f"{path}.{uuid.uuid4().hex}"
            if self.files.renamed(path, aside):
                if self.files.read(aside) != held:
                    self.files.renamed(aside, path)  # another writer was quicker
                    break
                self.files.delete(aside)
        raise BarframeError("IO", "another writer holds the store")

    def _readers(self) -> bool:
        """Whether a handle for reading is open; leases that have ended go."""
        live = False
        for name in self.files.names(f"{self.root}/{READERS}"):
            path = f"{self.root}/{READERS}/{name}"
            if _ended(self.files.read(path)):
                self.files.delete(path)
            else:
                live = True
        return live

    def _locked(self, recover: bool = False):
        store = self
        path = f"{store.root}/{LOCK}"

        class Lock:
            def __enter__(self):
                if store.read_only:
                    raise invalid_input("the store is open for reading only")
                if store.sealed():
                    raise invalid_input("the store is sealed")
                store.files.make(store.root)
                lease = _lease()
                store._take(path, lease)
                if not recover and store._readers():
                    store.files.delete(path)
                    raise BarframeError("IO", "a reader holds the store")
                self.done = threading.Event()
                threading.Thread(target=self.renew, args=(lease,), daemon=True).start()
                store.cache.clear()

            def renew(self, lease: str):
                while not self.done.wait(LEASE / 4):
                    store.files.overwrite(path, json.dumps(json.loads(lease) | {"time": time.time()}))

            def __exit__(self, *_):
                self.done.set()
                store.files.delete(path)

        return Lock()

    def recover(self) -> list[str]:
        """Remove what an interrupted write left: staging folders, and chunks no manifest names."""
        if not self.pending():
            return []
        gone = [f"{self.root}/staging"] if self.files.exists(f"{self.root}/staging") else []
        gone += [f"{self.root}/series/{x}" for x in self.orphans()]
        for x in gone:
            self.files.delete(x)
        self.files.delete(f"{self.root}/{PENDING}")
        return gone

    # ---- registration -------------------------------------------------------------------

    def _register(self, key: Key, **meta: Any) -> dict:
        key.checked()
        meta = {"symbol": key.symbol, "category": key.category, "name": key.name, **meta}
        if meta["unit"] not in UNITS:
            raise invalid_input(f"parts by {meta['unit']} are not supported")
        path = f"{self.folder(key)}/{MANIFEST}"
        if self.files.has(path):
            old = self.files.load(path)
            if {k: v for k, v in old.items() if k != "chunks"} != meta:
                raise invalid_input(f"{':'.join(key)} is registered otherwise")
            return old
        meta["chunks"] = []
        self.files.make(self.folder(key))
        self._publish(key, meta)
        return meta

    def register_kline(self, symbol: str, timeframe: str, timeframe_ms: int, price_scale: int, volume_scale: int, quote_scale: int | None = None) -> Key:
        if min(timeframe_ms, price_scale, volume_scale, 1 if quote_scale is None else quote_scale) <= 0:
            raise invalid_input("timeframe and scales must be positive")
        key = keys.kline(symbol, timeframe)
        with self._locked():
            self._register(key, family=(KLINE if quote_scale is None else KLINE_FLOW).name, timeframe_ms=timeframe_ms, price_scale=price_scale, volume_scale=volume_scale, quote_scale=quote_scale, unit="month")
        return key

    def register_scalar(self, key: Key, timeframe_ms: int, equal_ts: bool = False) -> Key:
        """equal_ts: the values are of events, of which several may have one time; they keep their order."""
        if timeframe_ms <= 0:
            raise invalid_input("timeframe must be positive")
        with self._locked():
            self._register(key, family=SCALAR.name, timeframe_ms=timeframe_ms, price_scale=1, volume_scale=1, quote_scale=None, unit="month", **({"equal_ts": True} if equal_ts else {}))
        return key

    def register_indicator(self, symbol: str, timeframe: str, name: str) -> Key:
        """An indicator has the timeframe of its bars, which must exist."""
        base = self.meta(keys.kline(symbol, timeframe))
        return self.register_scalar(keys.derived("indicator", symbol, timeframe, name), base["timeframe_ms"])

    def register_ticks(self, family: str, symbol: str, name: str, timeframe_ms: int = 0, unit: str | None = None, equal_ts: bool = False) -> Key:
        """equal_ts: quotes may have one time too, as trades and deltas of the book always may."""
        f = FAMILIES[family]
        key = Key(symbol, family, name)
        with self._locked():
            self._register(key, family=family, timeframe_ms=timeframe_ms, price_scale=1, volume_scale=1, quote_scale=None, unit=unit or f.unit, **({"equal_ts": True} if equal_ts and not f.equal_ts else {}))
        return key

    # ---- writes -------------------------------------------------------------------------

    def _staged(self, df: DataFrame, meta: dict, stage: str) -> list:
        """Write the rows, dealt to parts, and check what was written: a summary a part. A broken rule rejects the request.

        Rows without a column `ordinal` are in the order they come in. Ticks must come in
        order of time; bars and scalars are sorted. Equal times keep their order where the
        family or the series allows them.
        """
        family, unit = FAMILIES[meta["family"]], meta["unit"]
        lack = [c for c in family.columns if c not in df.columns]
        if lack:
            raise invalid_input(f"missing columns {lack}")
        own = [F.col(f.name).cast(f.dataType).alias(f.name) for f in family.schema]
        order = F.col("ordinal").cast("long") if "ordinal" in df.columns else F.monotonically_increasing_id()
        rows = df.select(*own, order.alias("ordinal")).withColumn("part", F.coalesce(part_of(F.col("ts"), unit), F.lit("")))
        # within a part, by spans of time, so that a large part is more than one task and one file
        dealt = rows.repartition("part", F.floor(F.col("ts") / SPAN_MS[unit]))
        dealt.sortWithinPartitions("part", "ts", "ordinal").write.partitionBy("part").parquet(stage)
        schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in family.schema), T.StructField("ordinal", T.LongType()), T.StructField("part", T.StringType())])
        rows = self.spark.read.schema(schema).parquet(stage)
        # rows of one time lie in one span; between spans, the ordinals must go on
        span = F.floor(F.col("ts") / SPAN_MS[unit])
        rows = rows.withColumn("_span", span)
        w = Window.partitionBy("part", "_span").orderBy("ts", "ordinal")
        back = F.lit(False) if family.equal_ts or meta.get("equal_ts") else F.col("ts") == F.lag("ts").over(w)
        if family.sequence:
            back = back | (F.col("ordinal") < F.lag("ordinal").over(w))
        nulls = F.lit(False)
        for f in family.schema:
            if not f.nullable:
                nulls = nulls | F.col(f.name).isNull()
        faults = flow_faults() if family is KLINE_FLOW else F.lit(False)
        marked = rows.select("*", F.coalesce(back, F.lit(False)).alias("_back"), nulls.alias("_null"), F.coalesce(faults, F.lit(False)).alias("_fault"))
        worth = [F.min("value").alias("low"), F.max("value").alias("high")] if family is SCALAR else []
        spans = marked.groupBy("part", "_span").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), *(F.max(f"_{k}").alias(k) for k in ("back", "null", "fault")), F.min("ordinal").alias("_least"), F.max("ordinal").alias("_most"), *worth)
        if family.sequence:
            spans = spans.withColumn("back", F.col("back") | F.coalesce(F.lag("_most").over(Window.partitionBy("part").orderBy("_span")) > F.col("_least"), F.lit(False)))
        total = [F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), *(F.max(k).alias(k) for k in ("back", "null", "fault"))]
        parts = spans.groupBy("part").agg(*total, *([F.min("low").alias("low"), F.max("high").alias("high")] if worth else [])).orderBy("part").collect()
        if any(p.null for p in parts):
            raise invalid_input("a required value is null")
        if any(p.back for p in parts):
            raise invalid_data("timestamps are out of order or repeat")
        if any(p.fault for p in parts):
            raise invalid_input("flow values break a rule")
        return parts

    def _indexed(self, unit: str, stage: str) -> None:
        """Zone maps and value indexes of all staged parts."""
        rows = self.spark.read.schema("ts long, value long, ordinal long, part string").parquet(stage)
        index.zone_map(rows, ["part"], span=F.floor(F.col("ts") / SPAN_MS[unit]), ties=("ordinal",)).write.partitionBy("part").parquet(f"{stage}.{ZONES}")
        index.write_value_index(rows, ["part"], f"{stage}.{VALUES}")

    def _place(self, key: Key, stage: str, p, name: str, state: str, generation: int) -> dict:
        """Move a staged part to its place; its entry in the manifest."""
        chunk = {"chunk_id": uuid.uuid4().hex, "part": name, "start_ts": p.a, "end_ts": p.b, "count": p.n, "state": state, "generation": generation, "relative_path": f"{quote(name, safe='')}.g{generation:08d}"}
        sidecars = [x for x in (ZONES, VALUES) if self.files.exists(f"{stage}.{x}")]
        for x in sidecars:
            self.files.move(f"{stage}.{x}/part={_escaped(name)}", f"{self.folder(key)}/{chunk['relative_path']}.{x}")
        self.files.move(f"{stage}/part={_escaped(name)}", f"{self.folder(key)}/{chunk['relative_path']}")
        return chunk | {"sidecars": sidecars} | ({"min_value": p.low, "max_value": p.high} if sidecars else {})

    def _remove(self, key: Key, chunk: dict) -> None:
        for x in ("", *(f".{y}" for y in chunk.get("sidecars", []))):
            self.files.delete(f"{self.folder(key)}/{chunk['relative_path']}{x}")

    def _write(self, key: Key, stage: str, parts: list, replace: bool = False) -> list[str]:
        """Commit part by part; an error names the parts that are done."""
        meta = json.loads(json.dumps(self.meta(key)))
        if not replace:
            for p in parts:
                last = max((c["end_ts"] for c in meta["chunks"] if c["part"] == p.part), default=None)
                if last is not None and p.a <= last:
                    raise invalid_data(f"rows of {p.part} begin at {p.a}, not after {last}")
        done: list[str] = []
        try:
            if self.family(key) is SCALAR:
                self._indexed(meta["unit"], stage)
            for p in parts:
                old = [c for c in meta["chunks"] if c["part"] == p.part]
                generation = max((c["generation"] for c in old), default=0) + 1
                chunk = self._place(key, stage, p, p.part, ACTIVE if old and not replace else SEALED, generation)
                meta["chunks"] = [c for c in meta["chunks"] if not (replace and c["part"] == p.part)] + [chunk]
                self._publish(key, meta)
                for c in old if replace else []:
                    self._remove(key, c)
                done.append(p.part)
                if self.policy.auto_merge and any(a["part"] == p.part for a in self.advice(key)):
                    self._merge(key, p.part)
                    meta = json.loads(json.dumps(self.meta(key)))
        except BarframeError:
            raise
        except Exception as e:
            raise BarframeError("IO", f"write stopped after parts {done}: {e}", completed=done) from e
        return done

    def _staging(self, key: Key):
        """A folder for what a write stages; pending until its end."""
        store, stage = self, f"{self.root}/staging/{uuid.uuid4().hex}"

        class Stage:
            def __enter__(self) -> str:
                store.files.create(f"{store.root}/{PENDING}", ":".join(key))
                return stage

            def __exit__(self, *_) -> None:
                for x in ("", f".{ZONES}", f".{VALUES}"):
                    store.files.delete(f"{stage}{x}")
                store.files.delete(f"{store.root}/{PENDING}")

        return Stage()

    def put(self, key: Key, df: DataFrame) -> dict[str, Any]:
        """One batch: bars and scalars in one part; ticks are split. Bars append, scalars replace their part."""
        return self._store(key, df, one_part=self.family(key).name in (KLINE.name, KLINE_FLOW.name, SCALAR.name), replace=self.family(key) is SCALAR)

    def append(self, key: Key, df: DataFrame) -> dict[str, Any]:
        """A batch over any parts: checked whole, then committed part by part."""
        return self._store(key, df, merge=self.family(key) is SCALAR)

    def _store(self, key: Key, df: DataFrame, one_part: bool = False, replace: bool = False, merge: bool = False) -> dict[str, Any]:
        with self._locked(), self._staging(key) as stage:
            meta = self.meta(key)
            parts = self._staged(df, meta, stage)
            if one_part and len(parts) > 1:
                raise invalid_input("a batch must stay in one part; use append")
            if one_part and not parts:
                raise invalid_input("a batch must not be empty")
            n = sum(p.n for p in parts)
            held = [c for c in meta["chunks"] if c["part"] in {p.part for p in parts}]
            if merge and held:
                # scalars append by rewriting their part
                for p in parts:
                    last = max((c["end_ts"] for c in held if c["part"] == p.part), default=None)
                    if last is not None and p.a <= last:
                        raise invalid_data(f"rows of {p.part} begin at {p.a}, not after {last}")
                old = self._rows(key, held)
                fresh = self.spark.read.schema("ts long, value long, ordinal long, part string").parquet(stage).drop("part")
                with self._staging(key) as both:
                    parts = self._staged(old.unionByName(fresh), meta, both)
                    written = self._write(key, both, parts, replace=True)
            else:
                written = self._write(key, stage, parts, replace) if parts else []
            return {"registered": True, "written": n, "parts": written}

    def _merge(self, key: Key, part: str) -> bool:
        meta = json.loads(json.dumps(self.meta(key)))
        old = [c for c in meta["chunks"] if c["part"] == part]
        if len(old) < 2:
            return False
        generation = max(c["generation"] for c in old) + 1
        state = ACTIVE if any(c["state"] == ACTIVE for c in old) else SEALED
        with self._staging(key) as stage:
            parts = self._staged(self._rows(key, old), meta, stage)
            if self.family(key) is SCALAR:
                self._indexed(meta["unit"], stage)
            chunk = self._place(key, stage, parts[0], part, state, generation)
            meta["chunks"] = [c for c in meta["chunks"] if c["part"] != part] + [chunk]
            self._publish(key, meta)
            for c in old:
                self._remove(key, c)
        return True

    def merge(self, key: Key, part: str) -> bool:
        """The chunks of a part as one; it stays active if one of them was."""
        with self._locked():
            return self._merge(key, part)

    def advice(self, key: Key) -> list[dict[str, Any]]:
        """Parts worth merging, and why."""
        out = []
        chunks = self.meta(key)["chunks"]
        for part in sorted({c["part"] for c in chunks}):
            deltas = [c for c in chunks if c["part"] == part][1:]
            size = sum(self.files.size(f"{self.folder(key)}/{c['relative_path']}") for c in deltas)
            why = [k for k, on in (("deltas", len(deltas) >= self.policy.deltas), ("bytes", bool(deltas) and size >= self.policy.delta_bytes), ("appends", len(deltas) >= self.policy.appends)) if on]
            if why:
                out.append({"part": part, "deltas": len(deltas), "delta_bytes": size, "reasons": why})
        return out

    # ---- reads --------------------------------------------------------------------------

    def _rows(self, key: Key, chunks: list[dict]) -> DataFrame:
        schema = T.StructType([*self.family(key).schema.fields, T.StructField("ordinal", T.LongType())])
        if not chunks:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder(key)}/{c['relative_path']}" for c in chunks))

    def frame(self, key: Key, start: int | None = None, end: int | None = None) -> DataFrame:
        """All rows of a series whose chunks meet the range."""
        chunks = [c for c in self.meta(key)["chunks"] if (end is None or c["start_ts"] <= end) and (start is None or c["end_ts"] >= start)]
        return self._rows(key, chunks)

    def at(self, key: Key, ts: int) -> DataFrame:
        return reads.at(self.frame(key, ts, ts), ts).drop("ordinal")

    def between(self, key: Key, start: int, end: int) -> DataFrame:
        return reads.between(self.frame(key, start, end), start, end, "ordinal").drop("ordinal")

    def latest(self, key: Key, n: int) -> DataFrame:
        """From the newest chunks that hold n rows."""
        take, have = [], 0
        for c in sorted(self.meta(key)["chunks"], key=lambda c: -c["end_ts"]):
            if have >= n:
                break
            take.append(c)
            have += c["count"]
        return reads.latest(self._rows(key, take), n, "ordinal").drop("ordinal")

    def bars(self, key: Key, start: int, end: int) -> DataFrame:
        return reads.ohlcv(self.between(key, start, end))

    def flow(self, key: Key, start: int, end: int) -> DataFrame:
        return reads.widened(self.between(key, start, end))

    def prices(self, key: Key, start: int, end: int) -> DataFrame:
        return reads.prices(self.between(key, start, end))

    def activity(self, key: Key, start: int, end: int) -> DataFrame:
        return reads.activity(self.between(key, start, end))

    def _in_range(self, key: Key, start: int, end: int) -> list[dict]:
        return [c for c in self.meta(key)["chunks"] if c["start_ts"] <= end and c["end_ts"] >= start]

    def _sidecar(self, key: Key, chunks: list[dict], kind: str) -> DataFrame:
        """The zone maps or value indexes of chunks, with the chunk's path as `chunk`."""
        schema = "value long, ts long" if kind == VALUES else "block long, start_row long, end_row long, start_ts long, end_ts long, min_value long, max_value long"
        if not chunks:
            return self.spark.createDataFrame([], f"{schema}, chunk string")
        found = self.spark.read.schema(schema).parquet(*(f"{self.folder(key)}/{c['relative_path']}.{kind}" for c in chunks))
        return found.withColumn("chunk", F.regexp_replace(_folder_of(), f"[.]{kind}$", ""))

    def zones(self, key: Key, start: int | None = None, end: int | None = None) -> DataFrame:
        """The stored zone maps of the chunks that meet the range."""
        return self._sidecar(key, [c for c in self._in_range(key, -(1 << 63) if start is None else start, 1 << 62 if end is None else end) if ZONES in c.get("sidecars", [])], ZONES)

    def values(self, key: Key, start: int | None = None, end: int | None = None) -> DataFrame:
        """The stored value indexes of the chunks that meet the range."""
        return self._sidecar(key, [c for c in self._in_range(key, -(1 << 63) if start is None else start, 1 << 62 if end is None else end) if VALUES in c.get("sidecars", [])], VALUES)

    def access_path(self, key: Key, predicate: Predicate, start: int, end: int) -> str | None:
        """The index that answers a predicate in the range; None without a chunk there."""
        chunks = self._in_range(key, start, end)
        has = {x: all(x in c.get("sidecars", []) for c in chunks) for x in (ZONES, VALUES)}
        return predicates.access_path(predicate, has[ZONES], has[VALUES]) if chunks else None

    def predicate(self, key: Key, predicate: Predicate, start: int, end: int, values: bool = True) -> DataFrame:
        """Matches in order of time. Values that are listed come from the value indexes alone,
        ranges from the chunks whose least and most value meet them, all else from the rows."""
        predicate.validated()
        if start > end:
            raise invalid_input(f"start {start} is after end {end}")
        if predicate.impossible:
            return self.spark.createDataFrame([], "ts long, value long")
        path, chunks = self.access_path(key, predicate, start, end), self._in_range(key, start, end)
        if path == predicates.VALUE_INDEX:
            chunks = [c for c in chunks if predicate.may_hold(c["min_value"], c["max_value"])]
            return predicates.matches(self._sidecar(key, chunks, VALUES), predicate, start, end, values)
        if path == predicates.ZONE_MAP:
            chunks = [c for c in chunks if predicate.may_hold(c["min_value"], c["max_value"])]
        return predicates.matches(self._rows(key, chunks), predicate, start, end, values)

    def predicate_statistics(self, key: Key, predicate: Predicate, start: int, end: int) -> DataFrame:
        """One row of counters, chunk by chunk, from the stored indexes; no index without a chunk in the range."""
        path, chunks = self.access_path(key, predicate, start, end), self._in_range(key, start, end)
        rows = self._rows(key, chunks).withColumn("chunk", _folder_of() if chunks else F.lit(""))
        zones = self._sidecar(key, chunks, ZONES) if path == predicates.ZONE_MAP else None
        found = predicates.statistics(rows, predicate, start, end, part="chunk", has_zone_map=zones is not None, has_value_index=path == predicates.VALUE_INDEX, zones=zones)
        found = found.withColumn("chunks_scanned", F.col("chunks_considered") - F.col("chunks_pruned"))
        return found if path else found.withColumn("index_used", F.lit(None).cast("string")).withColumn("fallback_scan", F.lit(False))

    def scan(self, key: Key, start: int, end: int) -> DataFrame:
        """Adjacent rows of a tick series, for the reports of operators.sequences."""
        field = self.family(key).sequence
        if field is None:
            raise invalid_data(f"{':'.join(key)} has no sequence")
        return sequences.observed(self.frame(key, start, end).withColumn("series", F.lit(":".join(key))), field, start, end, ["series"])

    def replay(self, key: Key, start: int, end: int | None = None, family: str | None = None) -> DataFrame:
        """Sealed chunks only, in the order of chunks and rows; a wrong family is an error."""
        if end is not None and start > end:
            raise invalid_input(f"start {start} is after end {end}")
        if family is not None and family != self.meta(key)["family"]:
            raise invalid_data(f"the series holds {self.meta(key)['family']}, not {family}")
        chunks = [c for c in self.meta(key)["chunks"] if c["state"] == SEALED and c["end_ts"] >= start and (end is None or c["start_ts"] <= end)]
        rows = self._rows(key, chunks).where(F.col("ts") >= start)
        return (rows if end is None else rows.where(F.col("ts") <= end)).orderBy("ts", "ordinal").drop("ordinal")

    def cursor(self, key: Key, start: int, end: int | None = None) -> Cursor:
        return Cursor(self.replay(key, start, end))

    # ---- inventory ----------------------------------------------------------------------

    def chunks(self) -> DataFrame:
        """The manifests as a frame; all inventories are aggregates of it."""
        rows = [(*k, m["family"], c["chunk_id"], c["part"], c["start_ts"], c["end_ts"], c["count"], c["state"], c["generation"], c["relative_path"]) for k in self.keys() for m in [self.meta(k)] for c in m["chunks"]]
        return self.spark.createDataFrame(rows, CHUNK)

    def series(self, kind: str | None = None) -> DataFrame:
        """A row a series; kind `scalar` is all that isn't a bar, ticks included."""
        rows = [(*k, self.meta(k)["family"]) for k in self.keys()]
        all_ = self.spark.createDataFrame(rows, "symbol string, category string, name string, family string")
        if kind:
            all_ = all_.where((F.col("category") == keys.KLINE) == F.lit(kind == "kline"))
        found = self.chunks().groupBy("symbol", "category", "name").agg(F.count("*").alias("chunks"), F.sum("count").alias("records"), F.count_if(F.col("state") == ACTIVE).alias("active"))
        return all_.join(found, ["symbol", "category", "name"], "left").na.fill(0, ["chunks", "records", "active"]).orderBy("symbol", "category", "name")

    def parts(self, key: Key) -> DataFrame:
        self.meta(key)
        own = reads.series(self.chunks(), **key._asdict())
        return own.groupBy("part").agg(F.count("*").alias("chunks"), F.sum("count").alias("records"), *(F.count_if(F.col("state") == s).alias(s) for s in (ACTIVE, SEALED)), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")).orderBy("part")

    def stats(self) -> dict[str, int]:
        all_ = [self.meta(k) for k in self.keys()]
        chunks = [c for m in all_ for c in m["chunks"]]
        return {"series": len(all_), "kline_series": sum(m["category"] == keys.KLINE for m in all_), "scalar_series": sum(m["category"] != keys.KLINE for m in all_), "chunks": len(chunks), "records": sum(c["count"] for c in chunks), "active_chunks": sum(c["state"] == ACTIVE for c in chunks)}

    def coverage(self, key: Key) -> dict[str, int | None]:
        chunks = [c for c in self.meta(key)["chunks"] if c["state"] != REPLACED]
        return {"start_ts": min((c["start_ts"] for c in chunks), default=None), "end_ts": max((c["end_ts"] for c in chunks), default=None), "records": sum(c["count"] for c in chunks)}

    def indicators(self, symbol: str, timeframe: str) -> list[str]:
        scoped = [keys.unscoped(k.name) for k in self.keys() if k.symbol == symbol and k.category == "indicator"]
        return sorted({s[1] for s in scoped if s and s[0] == timeframe})

    def capabilities(self, key: Key) -> dict[str, bool]:
        """What is stored with every chunk of the series."""
        chunks = self.meta(key)["chunks"]
        has = lambda x: bool(chunks) and all(x in c.get("sidecars", []) for c in chunks)
        return {"raw": True, "zone_map": has(ZONES), "value_index": has(VALUES)}

    def orphans(self) -> list[str]:
        """Folders under a series that its manifest doesn't name."""
        out = []
        for k in self.keys():
            folder = self.folder(k)
            own = {c["relative_path"] + x for c in self.files.load(f"{folder}/{MANIFEST}")["chunks"] for x in ("", *(f".{y}" for y in c.get("sidecars", [])))}
            out += [f"{folder.removeprefix(f'{self.root}/series/')}/{n}" for n in self.files.names(folder) if ".g" in n and n not in own]
        return out

    def session(self) -> Session:
        return Session(self)

    def backtest_view(self, *plan: Key) -> BacktestView:
        return BacktestView(self).initialize(*plan)


def _folder_of():
    """The name of the folder that a row's file is in."""
    return F.element_at(F.split("_metadata.file_path", "/"), -2)


def _escaped(part: str) -> str:
    """As Spark names the folder of a partition value."""
    return part.replace(":", "%3A")


class Cursor:
    """Batches of a replay, pulled partition by partition."""

    def __init__(self, df: DataFrame):
        self.rows: Iterator = df.toLocalIterator()
        self.done = False

    def next_batch(self, n: int) -> list:
        if n <= 0:
            raise invalid_input("a batch needs a positive size")
        out: list = []
        while not self.done and len(out) < n:
            row = next(self.rows, None)
            if row is None:
                self.done = True
            else:
                out.append(row)
        return out

    def is_exhausted(self) -> bool:
        return self.done


class Session:
    """Attached series as cached frames, with the manifests as they were then; others are read through the store."""

    def __init__(self, store: Store):
        self.store, self.attached, self.metas, self.answers = store, {}, {}, {}

    def attach(self, *wanted: Key) -> None:
        for k in wanted:
            if k not in self.attached:
                self.attached[k] = self.store.frame(k)
                self.metas[k] = self.store.meta(k)

    def prewarm(self, eager: bool = False) -> None:
        for df in self.attached.values():
            df.cache()
            if eager:
                df.count()

    def between(self, key: Key, start: int, end: int) -> DataFrame:
        df = self.attached.get(key)
        return reads.between(df, start, end, "ordinal").drop("ordinal") if df is not None else self.store.between(key, start, end)

    def at(self, key: Key, ts: int) -> DataFrame:
        df = self.attached.get(key)
        return reads.at(df, ts).drop("ordinal") if df is not None else self.store.at(key, ts)

    def latest(self, key: Key, n: int) -> DataFrame:
        df = self.attached.get(key)
        return reads.latest(df, n, "ordinal").drop("ordinal") if df is not None else self.store.latest(key, n)

    def predicate(self, key: Key, predicate: Predicate, start: int, end: int) -> DataFrame:
        """Matches with their values; the frame of an answer is kept until a reset."""
        asked = (key, predicate, start, end)
        if asked not in self.answers:
            df = self.attached.get(key)
            self.answers[asked] = predicates.matches(df, predicate, start, end) if df is not None else self.store.predicate(key, predicate, start, end)
        return self.answers[asked]

    def inventory(self) -> list[Key]:
        return sorted(self.attached)

    def capabilities(self) -> dict[Key, dict[str, bool]]:
        return {k: self.store.capabilities(k) for k in self.inventory()}

    def health(self) -> dict[Key, bool]:
        """Whether the files of each attached series are still those that it was attached with."""
        there = {k: set(self.store.files.names(self.store.folder(k))) for k in self.inventory()}
        return {k: all(c["relative_path"] in there[k] for c in self.metas[k]["chunks"]) for k in there}

    def cached(self) -> dict[str, int]:
        return {"attached": len(self.attached), "cached": sum(df.storageLevel.useMemory for df in self.attached.values()), "answers": len(self.answers)}

    def reset(self, scope: str = "query") -> None:
        """query forgets answers, logical frees cached rows too, full also detaches."""
        if scope not in ("query", "logical", "full"):
            raise invalid_input(f"unknown scope {scope}")
        self.answers.clear()
        if scope == "query":
            return
        for df in self.attached.values():
            df.unpersist()
        if scope == "full":
            self.attached.clear()
            self.metas.clear()


class BacktestView:
    """A session for a plan of series, all attached at the start; a snapshot tells what a run has read."""

    def __init__(self, store: Store):
        self.session = store.session()

    def initialize(self, *plan: Key) -> BacktestView:
        self.session.reset("full")
        self.session.attach(*plan)
        return self

    def attach_timeframe(self, timeframe: str, symbols: list[str]) -> BacktestView:
        self.session.attach(*(keys.kline(s, timeframe) for s in symbols))
        return self

    def bars(self, timeframe: str, start: int, end: int) -> DataFrame:
        """(symbol, ts, open, close) of all attached series of bars, for operators.backtest."""
        own = [k for k in self.session.inventory() if k.category == keys.KLINE and k.name == timeframe]
        if not own:
            raise not_found(f"no bars of {timeframe} are attached")
        out = None
        for k in own:
            one = self.session.between(k, start, end).select(F.lit(k.symbol).alias("symbol"), "ts", "open", "close")
            out = one if out is None else out.unionByName(one)
        return out

    def between(self, key: Key, start: int, end: int) -> DataFrame:
        return self.session.between(key, start, end)

    def latest(self, key: Key, n: int) -> DataFrame:
        return self.session.latest(key, n)

    def predicate(self, key: Key, predicate: Predicate, start: int, end: int) -> DataFrame:
        return self.session.predicate(key, predicate, start, end)

    def snapshot(self) -> dict[str, list[str]]:
        """The chunks that each attached series is read from."""
        return {":".join(k): [c["chunk_id"] for c in self.session.metas[k]["chunks"]] for k in self.session.inventory()}
