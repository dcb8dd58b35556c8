import numpy as np
import pytest

from barframe import keys
from barframe.errors import BarframeError
from barframe.functions.derived import CloseMinusOpen, materialize
from barframe.schema import MISSING
from barframe.sources import files
from barframe.store.arrays import Reader, Writer

T, M = 1706745600000, 60000


def test_arrays(spark, tmp_path):
    root = str(tmp_path / "st")
    w = Writer(spark, root)
    bars = np.zeros(4, [(c, np.int64) for c in ("ts", "open", "high", "low", "close", "volume")])
    bars["ts"], bars["close"] = T + M * np.arange(4), np.arange(4)
    assert w.write_kline_range("A", "1m", bars, timeframe_ms=M, price_scale=1, volume_scale=1)["written"] == 4
    with pytest.raises(BarframeError):
        w.write_kline_range("A", "1m", bars[::-1], timeframe_ms=M, price_scale=1, volume_scale=1)
    flow = np.zeros(1, [*bars.dtype.descr, *((c, np.int64) for c in ("quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume"))])
    flow["ts"], flow["quote_volume"], flow["taker_buy_quote_volume"] = T, MISSING, MISSING
    w.write_kline_flow_range("B", "1m", flow, timeframe_ms=M, price_scale=1, volume_scale=1, quote_scale=1)
    points = np.array([(T, 5), (T + M, 7)], [("ts", np.int64), ("value", np.int64)])
    w.write_scalar_range("A", "1m", "feature", "f", points, timeframe_ms=M)
    key = keys.derived("indicator", "A", "1m", "gain")
    assert materialize(w.store, CloseMinusOpen(key), keys.kline("A", "1m"), T + M, T + 2 * M)["written"] == 2
    with Reader(spark, root) as r:
        assert (r.read_kline_range("A", "1m", T, T + 9 * M) == bars).all() and len(r.read_kline_latest("A", "1m", 2)) == 2
        assert r.read_kline_flow_range("B", "1m", T, T)["quote_volume"][0] == MISSING
        assert r.read_kline_prices("A", "1m", T, T).dtype.names == ("ts", "open", "high", "low", "close")
        assert r.read_kline_activity("B", "1m", T, T)["trade_count"][0] == 0
        assert (r.read_scalar_range("A", "1m", "feature", "f", T, T + M) == points).all()
        q = lambda **k: r.query_scalar_predicate("A", "1m", "feature", "f", T, T + M, **k)["value"].tolist()
        assert q(predicate="gt", value=5) == [7] and q(predicate="in", values=[]) == [] and q(predicate="between", min=5, max=7, inclusive=False) == [] and q(predicate="not-in", values=[7]) == [5]
        assert r.read_scalar_range("A", "1m", "indicator", "gain", T, T + 9 * M)["value"].tolist() == [1, 2]
        assert r.kline_info("A", "1m")["family"] == "kline" and r.scalar_info("A", "1m", "feature", "f")["timeframe_ms"] == M


@pytest.mark.parametrize("form", files.FORMATS)
def test_files(spark, tmp_path, form):
    from barframe.schema import KLINE_FLOW

    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6, None, 0, 1, None)], KLINE_FLOW.schema)
    files.write(df, "kline_flow", str(tmp_path / "x"), form, sentinel=True)
    assert files.read(spark, "kline_flow", str(tmp_path / "x"), form).collect() == df.collect()
    with pytest.raises(BarframeError):
        files.read(spark, "kline", "x", "xlsx")
