"""JSON verbs over a store: one request, one response. Rows that arrive are sorted; repeated times are refused, but in series that are registered for them."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from .. import __version__, keys
from ..errors import BarframeError, invalid_input
from ..functions import predicate as p
from ..keys import Key
from ..operators import reads
from ..schema import FLOW, KLINE, KLINE_FLOW, MISSING, SCALAR
from . import admin
from .store import Store


def _rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _sorted(records: list[dict], columns: list[str], optional: tuple[str, ...] = (), equal_ts: bool = False) -> list[tuple]:
    for r in records:
        for c in columns:
            v = r.get(c)
            if v is None and c not in optional or v is not None and (isinstance(v, bool) or not isinstance(v, int)):
                raise invalid_input(f"{c} must be a whole number")
            if v == MISSING and c in optional:
                raise invalid_input(f"{c} holds the mark of a missing value; send null")
    out = sorted((tuple(r.get(c) for c in columns) for r in records), key=lambda r: r[0])
    if not equal_ts and any(a[0] == b[0] for a, b in zip(out, out[1:], strict=False)):
        raise invalid_input("timestamps repeat")
    return out


class Bridge:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.opened: list[Store] = []

    def store(self, read_only: bool = True) -> Store:
        self.opened.append(Store(self.spark, self.root, read_only))
        return self.opened[-1]

    def close(self) -> None:
        for s in self.opened:
            s.close()

    def _scalar_key(self, r: dict) -> Key:
        return Key(r["symbol"], r.get("category", "indicator"), keys.scoped(r["timeframe"], r["name"]))

    # ---- bars

    def _bars(self, r: dict, kind: str) -> dict:
        key, s = keys.kline(r["symbol"], r["timeframe"]), self.store()
        if "limit" in r:
            df = s.latest(key, r["limit"])
            df = df.select("ts", "open", "high", "low", "close", "volume") if kind == "bars" else reads.widened(df)
        else:
            df = getattr(s, kind)(key, r["start_ts"], r["end_ts"])
        return {"symbol": r["symbol"], "timeframe": r["timeframe"], "records": _rows(df)}

    def read_kline_latest(self, r):
        return self._bars(r, "bars")

    def read_kline_flow_latest(self, r):
        return self._bars(r, "flow")

    def read_kline_range(self, r):
        return self._bars(r, "bars")

    def read_kline_flow_range(self, r):
        return self._bars(r, "flow")

    def read_kline_prices(self, r):
        return self._bars(r, "prices")

    def read_kline_activity(self, r):
        return self._bars(r, "activity")

    def _write_bars(self, r: dict, family) -> dict:
        s = self.store(False)
        key = s.register_kline(r["symbol"], r["timeframe"], r["timeframe_ms"], r["price_scale"], r["volume_scale"], r.get("quote_scale") if family is KLINE_FLOW else None)
        rows = _sorted(r["records"], family.columns, FLOW if family is KLINE_FLOW else ())
        return s.append(key, self.spark.createDataFrame(rows, family.schema)) | {"requested": len(rows)}

    def write_kline_range(self, r):
        return self._write_bars(r, KLINE)

    def write_kline_flow_range(self, r):
        return self._write_bars(r, KLINE_FLOW)

    # ---- scalars

    def read_scalar_range(self, r):
        try:
            records = _rows(self.store().between(self._scalar_key(r), r["start_ts"], r["end_ts"]))
        except BarframeError as e:
            if e.code != "NOT_FOUND":
                raise
            return {"exists": False, "records": []}
        return {"exists": True, "records": records}

    def read_indicator_range(self, r):
        return self.read_scalar_range(r | {"category": "indicator"})

    def write_scalar_range(self, r):
        s, key = self.store(False), self._scalar_key(r)
        equal_ts = r.get("equal_ts", False)
        try:
            timeframe_ms, equal_ts = s.meta(key)["timeframe_ms"], s.meta(key).get("equal_ts", False)
        except BarframeError:
            timeframe_ms = r.get("timeframe_ms") or s.meta(keys.kline(r["symbol"], r["timeframe"]))["timeframe_ms"]
        s.register_scalar(key, timeframe_ms, equal_ts)
        rows = _sorted(r["records"], SCALAR.columns, equal_ts=equal_ts)
        return s.append(key, self.spark.createDataFrame(rows, SCALAR.schema)) | {"requested": len(rows)}

    def write_indicator_range(self, r):
        return self.write_scalar_range(r | {"category": "indicator"})

    def query_scalar_predicate(self, r):
        s, key = self.store(), self._scalar_key(r)
        found = s.predicate(key, p.parse(r["predicate"], str(r.get("values", ""))), r["start_ts"], r["end_ts"], r.get("return_values", True))
        stats = s.predicate_statistics(key, p.parse(r["predicate"], str(r.get("values", ""))), r["start_ts"], r["end_ts"]).first().asDict() if r.get("stats") else None
        return {"matches": _rows(found), "stats": stats}

    # ---- inventories and administration

    def _inventory(self, key: Key) -> dict:
        s = self.store()
        try:
            s.meta(key)
        except BarframeError as e:
            if e.code != "NOT_FOUND":
                raise
            return {"exists": False, "parts": [], "coverage": None}
        return {"exists": True, "parts": _rows(s.parts(key)), "coverage": s.coverage(key), "capabilities": s.capabilities(key)}

    def kline_inventory(self, r):
        return self._inventory(keys.kline(r["symbol"], r["timeframe"]))

    def scalar_inventory(self, r):
        return self._inventory(self._scalar_key(r))

    def indicator_inventory(self, r):
        return self._inventory(self._scalar_key(r | {"category": "indicator"}))

    def list_series(self, r):
        return {"series": _rows(self.store().series(r.get("kind")))}

    def list_indicators(self, r):
        return {"indicators": self.store().indicators(r["symbol"], r["timeframe"])}

    def version(self, r):
        return {"version": __version__}

    def init(self, r):
        self.store(False).init()
        return {"initialized": True}

    def stats(self, r):
        return self.store().stats()

    def health(self, r):
        return admin.health(self.store())

    def validate(self, r):
        return admin.validate(self.store(), r.get("deep", False))

    def orphans(self, r):
        return {"orphans": self.store().orphans()}

    def overlaps(self, r):
        return {"groups": _rows(admin.explain_overlaps(self.store()))}

    def repair(self, r):
        return {"actions": admin.repair(self.store(False), r.get("dry_run", False))}

    def rebuild(self, r):
        return {"chunks": admin.rebuild(self.store(False))}

    def seal(self, r):
        return {"digest": admin.seal(self.store(False))["digest"]}

    def scrub(self, r):
        return admin.scrub(self.store())

    def capabilities(self, r):
        return self.store().capabilities(self._scalar_key(r) if r.get("name") else keys.kline(r["symbol"], r["timeframe"]))

    def verify(self, r):
        return {"digest": admin.verify(self.store(), r.get("digest"))["digest"]}


VERBS = sorted(v for v in vars(Bridge) if not v.startswith("_") and v not in ("store", "close"))


def call(spark: SparkSession, root: str, verb: str, request: dict[str, Any]) -> dict[str, Any]:
    name = verb.replace("-", "_")
    if name not in VERBS:
        raise invalid_input(f"unknown verb {verb}")
    bridge = Bridge(spark, root)
    try:
        return getattr(bridge, name)(request)
    except KeyError as e:
        raise invalid_input(f"the request lacks {e}") from None
    finally:
        bridge.close()


def main(args: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="python -m barframe.store.bridge", description=__doc__)
    a.add_argument("root")
    a.add_argument("verb", choices=[v.replace("_", "-") for v in VERBS])
    a.add_argument("request", nargs="?", default="{}", help="a JSON object; - reads it from standard input")
    o = a.parse_args(args)
    try:
        request = json.loads(sys.stdin.read() if o.request == "-" else o.request)
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
        out = call(spark, o.root, o.verb, request)
    except json.JSONDecodeError as e:
        print(json.dumps({"code": "JSON", "message": str(e)}), file=sys.stderr)
        return 1
    except BarframeError as e:
        print(json.dumps({"code": e.code, "message": e.message}), file=sys.stderr)
        return 1
    print(json.dumps(out))
    return int(o.verb == "validate" and not admin.clean(out))


if __name__ == "__main__":
    sys.exit(main())
