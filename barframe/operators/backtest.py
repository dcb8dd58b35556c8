"""A long/flat backtest with fills at the next open, in window functions only.

Wilder's averages are an exponential filter of the rises and falls. A filter over a run of
BLOCK bars is a sum with growing weights, scaled back; what came before a run fades by
FADE ** BLOCK for each run further back, so RUNS runs hold all that a double can. Runs of
one symbol are worked on in parallel. A target changes where strength reaches a bound and
holds in between. An account changes only where it fills: a purchase divides what it is
worth by the price, a sale multiplies, so it is the product of its fills.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import invalid_data, invalid_input
from ..functions.features import momentum_signal, with_sma_signal

CASES = ("rsi", "sma", "momentum")
PERIOD, BUY, SELL = 14, 30, 70
BLOCK, RUNS, FADE = 256, 3, 1 - 1 / PERIOD
#: Time of a bucket of the equity curve, whose peaks are found apart: 30 days of milliseconds.
BUCKET = 30 * 86_400_000


def strength(bars: DataFrame) -> DataFrame:
    """bars (symbol, ts, close, ...) with rsi: null before PERIOD changes, 50 while nothing has moved."""
    by_time = Window.partitionBy("symbol").orderBy("ts")
    change = F.col("close") - F.lag("close").over(by_time)
    rows = bars.withColumn("_n", F.row_number().over(by_time) - 1).withColumn("_change", F.coalesce(change, F.lit(0)).cast("double"))
    rows = rows.withColumn("_run", F.floor(F.col("_n") / BLOCK)).withColumn("_place", F.col("_n") % BLOCK)
    seed = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - PERIOD, 0)
    so_far = Window.partitionBy("symbol", "_run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    scale = F.pow(F.lit(FADE), F.col("_place"))
    sides = {"_up": F.greatest("_change", F.lit(0.0)), "_down": F.greatest(-F.col("_change"), F.lit(0.0))}
    for k, moved in sides.items():
        # the first average is a plain mean; from then on each bar adds its share
        rows = rows.withColumn(k, moved)
        rows = rows.withColumn(f"{k}_in", F.when(F.col("_n") > PERIOD, F.col(k) / PERIOD).when(F.col("_n") == PERIOD, F.sum(k).over(seed) / PERIOD).otherwise(0.0))
    for k in sides:
        rows = rows.withColumn(k, scale * F.sum(F.col(f"{k}_in") / scale).over(so_far))
    ends = rows.groupBy("symbol", "_run").agg(*(F.max_by(k, "_n").alias(f"{k}_end") for k in sides))
    runs = Window.partitionBy("symbol").orderBy("_run")
    before = lambda k: sum(F.coalesce(F.lag(f"{k}_end", j).over(runs), F.lit(0.0)) * FADE ** (BLOCK * (j - 1)) for j in range(1, RUNS + 1))
    carried = ends.select("symbol", "_run", *(before(k).alias(f"{k}_before") for k in sides))
    rows = rows.join(carried, ["symbol", "_run"])
    up, down = (F.col(k) + scale * FADE * F.col(f"{k}_before") for k in sides)
    # where all has faded, nothing has moved for long, and the strength is as it was
    moving = F.when((F.col("_n") >= PERIOD) & (up + down > 0), 100 * up / (up + down))
    held = F.last(moving, ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*bars.columns, F.when(F.col("_n") >= PERIOD, F.coalesce(held, F.lit(50.0))).alias("rsi"))


def rsi_signal(rsi: Column | str) -> Column:
    """On from BUY or less until SELL or more."""
    rsi = F.col(rsi) if isinstance(rsi, str) else rsi
    turn = F.when(rsi <= BUY, True).when(rsi >= SELL, False)
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(False))


def _desired(bars: DataFrame, case: str) -> DataFrame:
    if case == "rsi":
        return strength(bars).withColumn("desired", rsi_signal("rsi")).drop("rsi")
    if case == "sma":
        return with_sma_signal(bars, ["symbol"], "desired")
    return bars.withColumn("desired", momentum_signal(["symbol"]))


def checked(bars: DataFrame) -> int:
    """The number of symbols; bars that differ in their times or have no price are an error. One aggregate without a sort."""
    found = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.bit_xor(F.xxhash64("ts")).alias("mark"), F.min(F.least("open", "close")).alias("low"))
    total = found.agg(F.count("*").alias("symbols"), F.count_distinct("n", "first", "last", "mark").alias("kinds"), F.min("low").alias("low")).first()
    if not total.symbols:
        raise invalid_input("a backtest needs bars")
    if total.kinds > 1:
        raise invalid_data("the symbols' bars must have the same times; none are filled in")
    if total.low <= 0:
        raise invalid_data("a price is zero or less")
    return total.symbols


def accounts(bars: DataFrame, case: str, scale: int, capital: float = 100_000.0, fee_bps: float = 10.0, slippage_bps: float = 1.0) -> DataFrame:
    """A row a bar: equity, the fill at its open if any, the account after it, and the target for the next open.

    bars: (symbol, ts, open, close). Symbols share the capital and have accounts of their own.
    Two bars of a symbol at one time stop the query when it runs.
    """
    if case not in CASES:
        raise invalid_input(f"no such case: {case}")
    if min(scale, capital) <= 0 or fee_bps < 0 or not 0 <= slippage_bps < 10_000:
        raise invalid_input("scale and capital must be positive, costs not negative, slippage below the price")
    bars = bars.select("symbol", "ts", "open", "close")
    share, fee, slip = capital / checked(bars), fee_bps / 10_000, slippage_bps / 10_000
    w = Window.partitionBy("symbol").orderBy("ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    twice = F.when(F.lag("ts").over(w) == F.col("ts"), F.raise_error(F.lit("INVALID_DATA: a symbol has two bars of one time")).cast("boolean")).otherwise(F.col("desired"))
    rows = _desired(bars, case).withColumn("desired", twice).withColumn("held", F.coalesce(F.lag("desired").over(w), F.lit(False)))
    rows = rows.withColumn("filled", F.col("held") != F.coalesce(F.lag("held").over(w), F.lit(False)))
    price = F.col("open") / scale * F.when(F.col("held"), 1 + slip).otherwise(1 - slip)
    # the logarithm of what a fill makes of an account: money to units, or units to money
    factor = F.when(~F.col("filled"), 0.0).when(F.col("held"), -F.log(price) - log(1 + fee)).otherwise(F.log(price) + (log(1 - fee) if fee < 1 else float("-inf")))
    rows = rows.withColumn("price", F.when(F.col("filled"), price)).withColumn("_factor", factor).withColumn("_sum", F.sum("_factor").over(so_far))
    worth, before = F.lit(share) * F.exp("_sum"), F.lit(share) * F.exp(F.col("_sum") - F.col("_factor"))
    units = F.when(F.col("filled"), F.when(F.col("held"), worth).otherwise(before))
    return rows.select(
        "symbol", "ts", F.when(F.col("held"), worth * (F.col("close") / scale)).otherwise(worth).alias("equity"),
        F.when(F.col("filled"), F.when(F.col("held"), "buy").otherwise("sell")).alias("side"), "price", units.alias("quantity"), (units * F.col("price") * fee).alias("fee"),
        F.when(F.col("held"), 0.0).otherwise(worth).alias("cash_after"), F.when(F.col("held"), worth).otherwise(0.0).alias("units_after"), F.col("desired").alias("pending"),
    )


def curve(account: DataFrame, *more: Column) -> DataFrame:
    """(ts, equity, peak, drawdown) of the portfolio, and more sums of each time: peaks of buckets of time first, then within each."""
    total = account.groupBy("ts").agg(F.sum("equity").alias("equity"), *more).withColumn("_bucket", F.floor(F.col("ts") / BUCKET))
    tops = total.groupBy("_bucket").agg(F.max("equity").alias("_top"))
    # a row for 30 days: the one window without a partition
    tops = tops.select("_bucket", F.max("_top").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    within = F.max("equity").over(Window.partitionBy("_bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    rows = total.withColumn("_within", within).join(tops, "_bucket")
    peak = F.greatest("_within", "_before")
    return rows.withColumn("peak", peak).withColumn("drawdown", 1 - F.col("equity") / F.col("peak")).drop("_bucket", "_within", "_before")


def summary(account: DataFrame, case: str, capital: float = 100_000.0) -> DataFrame:
    """One row: what became of the capital, fills, positions open at the end and targets that wait for a next open.

    All comes from one row for each time, so the accounts are made once.
    """
    is_open = F.col("units_after") > 0
    times = account.groupBy("ts").agg(F.sum("equity").alias("equity"), F.count("*").alias("rows"), F.count("side").alias("fills"), F.count_if(F.col("side") == "sell").alias("sales"), F.sum("fee").alias("fees"), F.count_if(is_open).alias("open"), F.count_if(F.col("pending") != is_open).alias("waits"))
    w = Window.partitionBy("_bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    # within a bucket: the worst against the bucket's own peaks, and against any peak before it, the least equity
    each = times.withColumn("_bucket", F.floor(F.col("ts") / BUCKET)).withColumn("_peak", F.max("equity").over(w))
    last = lambda c: F.max_by(c, "ts").alias(c)
    sums = lambda *cs: [F.sum(c).alias(c) for c in cs]
    kept = ("rows", "fills", "sales", "fees")
    # an account can fade to nothing after many fills; then its own bucket has no peak to fall from
    each = each.withColumn("_own", 1 - F.try_divide("equity", "_peak"))
    buckets = each.groupBy("_bucket").agg(F.max("ts").alias("ts"), *(last(c) for c in ("equity", "open", "waits")), *sums(*kept), F.max("_own").alias("own"), F.min("equity").alias("low"), F.max("equity").alias("top"))
    before = F.max("top").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    worst = F.greatest("own", 1 - F.col("low") / F.col("_before"), F.lit(0.0))
    total = buckets.withColumn("_before", before).agg(*(last(c) for c in ("equity", "open", "waits")), *sums(*kept), F.max(worst).alias("max_drawdown"))
    return total.select(F.lit(case).alias("case"), "rows", F.col("equity").alias("final_equity"), (F.col("equity") / capital - 1).alias("return_fraction"), "max_drawdown", "fills", F.col("sales").alias("completed_round_trips"), F.coalesce("fees", F.lit(0.0)).alias("fees"), F.col("open").alias("open_positions"), F.col("waits").alias("pending_targets"))


def digest(account: DataFrame) -> DataFrame:
    """(fills, curve): sums of hashes of the fills, and of the equity of each time, to 6 digits; equal runs have equal digests."""
    six = lambda c: F.format_string("%.6f", F.col(c))
    mark = lambda *c: F.concat_ws(":", F.count("*"), *(F.sum(F.xxhash64(F.concat_ws(",", F.lit(k), *c)).cast("decimal(38,0)")) for k in (1, 2)))
    fills = account.where("side IS NOT NULL").agg(mark("symbol", "ts", "side", six("price"), six("quantity"), six("fee")).alias("fills"))
    equity = account.groupBy("ts").agg(F.sum("equity").alias("equity")).agg(mark("ts", six("equity")).alias("curve"))
    one = F.lit(1).alias("one")
    return fills.select(one, "*").join(equity.select(one, "*"), "one").drop("one")
