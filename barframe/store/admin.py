"""Validation, repair, snapshots and the registry of datasets."""

from __future__ import annotations

import hashlib
import json
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import invalid_data, invalid_input, not_found
from ..keys import Key
from ..operators import overlaps
from .files import Files
from .store import ACTIVE, MANIFEST, SEALED, SNAPSHOT, VALUES, ZONES, Store

ISSUES = ("missing", "untracked", "count_mismatch", "range_mismatch", "overlap", "unordered_manifest", "pending")


#: Of the registry's file; 1 had no status and checksum of datasets.
FORMAT = 2


def measured(store: Store, key: Key, names: list[str]) -> dict[str, Any]:
    """Rows, least and most time of each of these folders of a series, whatever manifests say: one scan, grouped by folder."""
    if not names:
        return {}
    rows = store._rows(key, [{"relative_path": n} for n in names])
    found = rows.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("name")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return {unquote(r.name): r for r in found.collect()}


def validate(store: Store, deep: bool = False) -> dict[str, list]:
    """What manifests and files disagree about; deep also reads the rows, one aggregate a series."""
    found: dict[str, list] = {k: [] for k in ISSUES}
    for key in store.keys():
        meta, folder, name = store.meta(key), store.folder(key), ":".join(key)
        there = set(store.files.names(folder))
        for c in meta["chunks"]:
            for x in ("", *(f".{y}" for y in c.get("sidecars", []))):
                if c["relative_path"] + x not in there:
                    found["missing"].append(f"{name}/{c['relative_path']}{x}")
        here = [c for c in meta["chunks"] if c["relative_path"] in there]
        if deep:
            rows = measured(store, key, [c["relative_path"] for c in here])
            for c in here:
                r = rows.get(unquote(c["relative_path"]))
                if (r.n if r else 0) != c["count"]:
                    found["count_mismatch"].append(f"{name}/{c['relative_path']}")
                elif (r.a, r.b) != (c["start_ts"], c["end_ts"]):
                    found["range_mismatch"].append(f"{name}/{c['relative_path']}")
        starts = [c["start_ts"] for c in meta["chunks"]]
        if starts != sorted(starts):
            found["unordered_manifest"].append(name)
    found["untracked"] = store.orphans()
    found["overlap"] = [f"{r.symbol}:{r.category}:{r['name']}#{r.overlap_group}" for r in explain_overlaps(store).collect()]
    if store.pending():
        found["pending"] = ["an interrupted write"]
    return found


def scrub(store: Store) -> dict[str, list]:
    """Read every row of every chunk and sidecar: what can't be read, and where an index and its rows disagree."""
    found: dict[str, list] = {"unreadable": [], "index_mismatch": []}
    both = F.sum(F.xxhash64("ts", "value").cast("decimal(38,0)"))
    for key in store.keys():
        for c in store.meta(key)["chunks"]:
            name = f"{':'.join(key)}/{c['relative_path']}"
            try:
                rows = store._rows(key, [c])
                if VALUES in c.get("sidecars", []):
                    one, two = (x.agg(F.count("*").alias("n"), both.alias("mark")).first() for x in (rows, store._sidecar(key, [c], VALUES)))
                    if one != two:
                        found["index_mismatch"].append(name)
                else:
                    rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
            except Exception:
                found["unreadable"].append(name)
    return found


def clean(report: dict[str, list]) -> bool:
    return not any(report.values())


def explain_overlaps(store: Store) -> DataFrame:
    return overlaps.winners(store.chunks(), ["symbol", "category", "name"])


def health(store: Store) -> dict[str, Any]:
    v = validate(store)
    return {"clean": clean(v), "issues": sum(map(len, v.values())), "orphans": len(v["untracked"]), "overlap_groups": len(v["overlap"]), "recovery_pending": store.pending()}


def _untracked(store: Store, key: Key, meta: dict) -> list[str]:
    own = {c["relative_path"] + x for c in meta["chunks"] for x in ("", *(f".{y}" for y in c.get("sidecars", [])))}
    return [n for n in store.files.names(store.folder(key)) if ".g" in n and n not in own]


def _is_sidecar(name: str) -> bool:
    return name.endswith((f".{ZONES}", f".{VALUES}"))


def repair(store: Store, dry_run: bool = False) -> list[str]:
    """Adopt chunks that no manifest names if they overlap nothing, newer than what is committed; remove the rest.

    Under the lock, so not on a sealed store or one open for reading; a dry run only says what it would do.
    """
    if dry_run:
        return _repaired(store, True)
    with store._locked():
        return _repaired(store, False)


def _repaired(store: Store, dry_run: bool) -> list[str]:
    plan = []
    for key in store.keys():
        meta = json.loads(json.dumps(store.meta(key)))
        names = _untracked(store, key, meta)
        rows = measured(store, key, [n for n in names if not _is_sidecar(n)])
        adopted = False
        for name in names:
            part, _, generation = name.rpartition(".g")
            r = rows.get(unquote(name))
            if r is None or not generation.isdigit() or any(c["start_ts"] <= r.b and c["end_ts"] >= r.a or c["part"] == unquote(part) and c["generation"] >= int(generation) for c in meta["chunks"]):
                plan.append(f"remove {':'.join(key)}/{name}")
                if not dry_run:
                    store.files.delete(f"{store.folder(key)}/{name}")
            else:
                plan.append(f"adopt {':'.join(key)}/{name}")
                adopted = True
                meta["chunks"].append({"chunk_id": name, "part": unquote(part), "start_ts": r.a, "end_ts": r.b, "count": r.n, "state": ACTIVE if any(c["part"] == unquote(part) for c in meta["chunks"]) else SEALED, "generation": int(generation), "relative_path": name})
        if adopted and not dry_run:
            store._publish(key, meta)
    return plan


def rebuild(store: Store) -> int:
    """Chunk lists anew from the files; an overlap without a clear winner is an error."""
    n = 0
    with store._locked():
        for key in store.keys():
            meta = json.loads(json.dumps(store.meta(key)))
            known = {c["relative_path"]: c for c in meta["chunks"]}
            there = store.files.names(store.folder(key))
            names = [x for x in there if ".g" in x and not _is_sidecar(x)]
            rows = measured(store, key, names)
            chunks = []
            for name in names:
                part, _, generation = name.rpartition(".g")
                r, old = rows.get(unquote(name)), known.get(name, {})
                if r is None:
                    continue
                kept = {k: old[k] for k in ("sidecars", "min_value", "max_value") if k in old and all(f"{name}.{x}" in there for x in old.get("sidecars", []))}
                chunks.append({"chunk_id": name, "part": unquote(part), "start_ts": r.a, "end_ts": r.b, "count": r.n, "state": old.get("state", SEALED), "generation": int(generation), "relative_path": name} | kept)
            chunks.sort(key=lambda c: c["start_ts"])
            if any(a["end_ts"] >= b["start_ts"] for a, b in zip(chunks, chunks[1:], strict=False)):
                raise invalid_data(f"chunks of {':'.join(key)} overlap")
            store._publish(key, meta | {"chunks": chunks})
            n += len(chunks)
    return n


def _hashes(store: Store) -> list[dict[str, Any]]:
    """SHA-256 of every data file, computed where the files are read."""
    base = f"{store.root}/series"
    files = store.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(base)
    rows = files.select("path", "length", F.sha2("content", 256).alias("sha256")).collect()
    out = [{"path": r.path.split("/series/", 1)[1], "bytes": r.length, "sha256": r.sha256} for r in rows]
    for k in store.keys():
        text = store.files.read(f"{store.folder(k)}/{MANIFEST}")
        out.append({"path": f"{store.folder(k).removeprefix(base + '/')}/{MANIFEST}", "bytes": len(text), "sha256": hashlib.sha256(text.encode()).hexdigest()})
    return sorted(out, key=lambda x: x["path"])


def _digest(files: list[dict[str, Any]]) -> str:
    return hashlib.sha256(json.dumps(files, sort_keys=True).encode()).hexdigest()


def seal(store: Store) -> dict[str, Any]:
    """Freeze a clean store: all chunks sealed, every file hashed; sealing again returns the same."""
    path = f"{store.root}/{SNAPSHOT}"
    if store.sealed():
        return store.files.load(path)
    if not store.keys() or not any(store.meta(k)["chunks"] for k in store.keys()):
        raise invalid_data("the store is empty")
    if not clean(validate(store)):
        raise invalid_data("the store isn't clean")
    with store._locked():
        for k in store.keys():
            meta = json.loads(json.dumps(store.meta(k)))
            for c in meta["chunks"]:
                c["state"] = SEALED
            store._publish(k, meta)
    files = _hashes(store)
    snapshot = {"format": 1, "digest": _digest(files), "files": files}
    store.files.publish(path, json.dumps(snapshot, indent=1))
    return snapshot


def verify(store: Store, digest: str | None = None) -> dict[str, Any]:
    path = f"{store.root}/{SNAPSHOT}"
    if not store.files.has(path):
        raise not_found("the store isn't sealed")
    snapshot = store.files.load(path)
    try:
        files = _hashes(store)
    except Exception as e:
        # a file system with checksums of its own refuses changed files
        raise invalid_data(f"files can't be read: {str(e)[:200]}") from e
    if files != snapshot["files"] or _digest(files) != snapshot["digest"] or digest not in (None, snapshot["digest"]):
        raise invalid_data("files differ from the snapshot")
    return snapshot


class Registry:
    """Datasets, features and factors in one published file; a published dataset never changes."""

    def __init__(self, spark, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)

    def _all(self) -> dict[str, dict]:
        """The rows as of now: those of older formats get what has been added since."""
        found = self.files.load(self.path) if self.files.has(self.path) else {}
        if found.get("format", 1) > FORMAT:
            raise invalid_data(f"the registry has format {found['format']}, newer than {FORMAT}")
        rows = {"datasets": {}, "features": {}, "factors": {}} | {k: v for k, v in found.items() if k != "format"}
        rows["datasets"] = {k: {"status": "open", "checksum": None} | v for k, v in rows["datasets"].items()}
        return rows

    def _put(self, kind: str, key: str, row: dict) -> dict:
        everything = self._all()
        old = everything[kind].get(key)
        if kind == "datasets" and old and old.get("status") == "sealed" and old != row:
            raise invalid_input(f"{key} is published and can't change")
        everything[kind][key] = row
        self.files.publish(self.path, json.dumps(everything | {"format": FORMAT}, indent=1, sort_keys=True))
        return row

    def upsert_dataset(self, dataset_id: str, version: str, root: str, created_at: int, **more: Any) -> dict:
        if not dataset_id or not version:
            raise invalid_input("dataset_id and version must not be empty")
        return self._put("datasets", f"{dataset_id}@{version}", {"dataset_id": dataset_id, "version": version, "root": root, "created_at": created_at, "status": "open", "checksum": None} | more)

    def dataset(self, dataset_id: str, version: str) -> dict:
        row = self._all()["datasets"].get(f"{dataset_id}@{version}")
        if row is None:
            raise not_found(f"no dataset {dataset_id}@{version}")
        return row

    def latest(self, dataset_id: str) -> dict:
        rows = [r for r in self._all()["datasets"].values() if r["dataset_id"] == dataset_id]
        if not rows:
            raise not_found(f"no dataset {dataset_id}")
        return max(rows, key=lambda r: (r["created_at"], r["version"]))

    def datasets(self) -> list[dict]:
        return sorted(self._all()["datasets"].values(), key=lambda r: (r["dataset_id"], r["version"]))

    def resolve(self, ref: str) -> str:
        """The root of `id@version`."""
        dataset_id, mark, version = ref.partition("@")
        if not mark:
            raise invalid_input("a reference needs a version")
        return self.dataset(dataset_id, version)["root"]

    def publish(self, dataset_id: str, version: str) -> dict:
        row = self.dataset(dataset_id, version)
        digest = seal(Store(self.spark, row["root"]))["digest"]
        return self._put("datasets", f"{dataset_id}@{version}", row | {"status": "sealed", "checksum": digest})

    def upsert_feature(self, feature_id: str, dataset_id: str, version: str, **more: Any) -> dict:
        return self._put("features", feature_id, {"feature_id": feature_id, "dataset_id": dataset_id, "version": version} | more)

    def upsert_factor(self, factor_id: str, dataset_id: str, version: str, **more: Any) -> dict:
        return self._put("factors", factor_id, {"factor_id": factor_id, "dataset_id": dataset_id, "version": version} | more)

    def feature(self, feature_id: str) -> dict:
        return self._one("features", feature_id)

    def factor(self, factor_id: str) -> dict:
        return self._one("factors", factor_id)

    def _one(self, kind: str, name: str) -> dict:
        row = self._all()[kind].get(name)
        if row is None:
            raise not_found(f"no {kind[:-1]} {name}")
        return row

    def listed(self, kind: str, dataset_id: str | None = None, version: str | None = None) -> list[dict]:
        rows = [r for r in self._all()[kind].values() if dataset_id in (None, r["dataset_id"]) and version in (None, r["version"])]
        return sorted(rows, key=lambda r: r[f"{kind[:-1]}_id"])
