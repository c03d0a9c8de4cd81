"""Row-count windows per key, with gates on the number of non-null observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import EPS, divide, floor_at
from tidemark.sources.tables import with_defaults


def _order(key: str, date: str):
    return Window.partitionBy(key).orderBy(date)


def gated(value: Column, counted: Column, window, least: int) -> Column:
    """value over the window where at least so many counted values are not null, else null."""
    return F.when(F.count(counted).over(window) >= least, value.over(window))


def simple_return(close: Column, order) -> Column:
    """Change to the row before; nulls are not filled."""
    return divide(close, F.lag(close).over(order)) - 1


def benchmark_returns(benchmark: DataFrame, date: str = "date", close: str = "close") -> DataFrame:
    """date and market_return_1d of a series with a row per date (of several, the least close).

    The order is global, over one row per calendar day.
    """
    series = benchmark.groupBy(date).agg(F.min(close).alias("_c"))
    return series.select(F.col(date).alias("date"), simple_return(F.col("_c"), Window.orderBy(date)).alias("market_return_1d"))


def daily_features(daily: DataFrame, benchmark: DataFrame | None = None, key: str = "ticker", date: str = "date") -> DataFrame:
    """All daily features of one pass over (key, date) order: one exchange and one sort serve every frame.

    Without a benchmark the market's return is the mean return of the date.
    """
    daily = with_defaults(daily, {"high": F.col("close"), "low": F.col("close"), "volume": None, "shares_outstanding": None})
    order = _order(key, date)
    df = daily.withColumn("return_1d", simple_return(F.col("close"), order))
    if benchmark is not None:
        close = "market_close" if "market_close" in benchmark.columns else "close"
        df = df.join(benchmark_returns(benchmark, date, close), date, "left")
    elif "market_return_1d" not in df.columns:
        # a mean by date and a join, not a window: it combines before the exchange
        df = df.join(df.groupBy(date).agg(F.avg("return_1d").alias("market_return_1d")), date, "left")
    rows = lambda k: order.rowsBetween(1 - k, 0)
    ret, market, value = F.col("return_1d"), F.col("market_return_1d"), F.col("value")
    loss = F.when(ret < 0, ret)
    illiquid = F.abs(ret) / (F.abs(value) + EPS)
    down = F.when(F.count(loss).over(rows(60)) <= 1, F.lit(0.0)).otherwise(F.stddev_samp(loss).over(rows(60)))
    both = F.when(ret.isNotNull() & market.isNotNull(), 1)
    beta = F.covar_samp(ret, market).over(rows(60)) / (F.var_samp(market).over(rows(60)) + EPS)
    cap = F.col("close") * F.col("shares_outstanding")
    return df.withColumns(
        {
            "rolling_vol_20d": gated(F.stddev_samp(ret), ret, rows(20), 10),
            "downside_vol_60d": F.when(F.count(ret).over(rows(60)) >= 20, down),
            "momentum_6m": divide(F.col("close"), F.lag("close", 126).over(order)) - 1,
            "avg_daily_traded_value_20d": gated(F.avg(value), value, rows(20), 5),
            "amihud_20d": gated(F.avg(illiquid), illiquid, rows(20), 5),
            "spread_proxy": floor_at(F.abs(F.col("high") - F.col("low")) / (F.abs("close") + EPS), 0),
            "turnover_ratio": F.col("volume") / (F.col("shares_outstanding") + EPS),
            "beta_60d": F.when((F.count(both).over(rows(60)) >= 20) & (F.count(market).over(rows(60)) >= 20), beta),
            "market_cap": cap,
            "log_market_cap": F.log1p(floor_at(cap, 0)),
        }
    )


def realised_volatility(benchmark: DataFrame, date: str = "date", close: str = "close", rows: int = 20, least: int = 10) -> DataFrame:
    """date and market_vol of a benchmark: the deviation of its last returns."""
    returns = benchmark_returns(benchmark, date, close)
    window = Window.orderBy("date").rowsBetween(1 - rows, 0)
    ret = F.col("market_return_1d")
    return returns.select("date", gated(F.stddev_samp(ret), ret, window, least).alias("market_vol_20d"))


def last_close(daily: DataFrame, key: str = "ticker", date: str = "date", close: str = "close") -> DataFrame:
    """The long form of the date x key matrix: the last close of each pair."""
    return daily.groupBy(date, key).agg(F.max_by(close, close).alias("close"))


def market_correlation(daily: DataFrame, window: int = 60, least: int = 20, key: str = "ticker", date: str = "date", tile: int = 128, block: int = 21) -> DataFrame:
    """For each date: the mean Pearson correlation over pairs of keys in the last rows of the market's calendar.

    Returns need a close on the previous calendar row.  A pair counts with ``least`` common observations.  Keys are dealt
    into tiles and the calendar into blocks: one task call has the returns of two tiles over a block and the window
    before it, keeps the pairs' sums as matrices, and slides them by adding a date and taking one away.  What is
    exchanged are a key's returns of a block, once per tile it meets, and a sum per date and pair of tiles; no row is
    one pair's.
    """
    calendar = daily.select(date).distinct().withColumn("_di", F.row_number().over(Window.orderBy(date)))
    closes = last_close(daily, key, date).join(calendar, date)
    before = Window.partitionBy(key).orderBy("_di")
    returns = closes.withColumn("_gap", F.col("_di") - F.lag("_di").over(before)).withColumn("r", simple_return(F.col("close"), before)).filter("_gap = 1 and r is not null").select(F.col(key).alias("k"), "_di", "r")
    tiles = -(-max(1, daily.select(key).distinct().count()) // tile)
    own = F.pmod(F.xxhash64("k"), F.lit(tiles)).cast("int")
    # a block takes the returns of its dates and of the window before
    blocks = F.explode(F.sequence(F.floor(F.col("_di") / block), F.floor((F.col("_di") + window - 1) / block)))
    packed = returns.withColumn("block", blocks).groupBy("block", "k").agg(F.collect_list("_di").alias("di"), F.collect_list("r").alias("r")).withColumn("tile", own)
    meets = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    pairs = packed.select("block", "di", "r", "tile", meets).select("block", "di", "r", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") > F.col("other")).alias("second"))

    def slide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        number, a, b = key
        first = number * block - window + 1
        span = block + window - 1

        def matrix(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            x, there = np.zeros((span, len(side))), np.zeros((span, len(side)))
            for j, (di, r) in enumerate(zip(side["di"], side["r"])):
                at = np.asarray(di) - first
                x[at, j], there[at, j] = r, 1.0
            return x, there

        x, mx = matrix(rows[~rows["second"]])
        y, my = (x, mx) if a == b else matrix(rows[rows["second"]])
        pick = np.triu(np.ones((x.shape[1], y.shape[1]), bool), 1) if a == b else np.ones((x.shape[1], y.shape[1]), bool)
        products = ((mx, my), (x, my), (mx, y), (x * x, my), (mx, y * y), (x, y))
        # the window before the block's first date, then a date in and a date out
        sums = [p[: window - 1].T @ q[: window - 1] for p, q in products]
        found = []
        for t in range(window - 1, span):
            for s, (p, q) in zip(sums, products):
                s += np.outer(p[t], q[t])
                if t >= window:
                    s -= np.outer(p[t - window], q[t - window])
            n, sx, sy, xx, yy, xy = sums
            vx, vy = n * xx - sx * sx, n * yy - sy * sy
            # what rounding leaves of a constant's variance is none
            good = pick & (n > least - 0.5) & (vx > 1e-12 * n * xx) & (vy > 1e-12 * n * yy)
            c = (n[good] * xy[good] - sx[good] * sy[good]) / np.sqrt(vx[good] * vy[good])
            found.append((first + t, float(c.sum()), int(good.sum())))
        return pd.DataFrame(found, columns=["_di", "s", "n"])

    sums = pairs.groupBy("block", "a", "b").applyInPandas(slide, "_di long, s double, n long").filter("n > 0")
    means = sums.groupBy("_di").agg((F.sum("s") / F.sum("n")).alias("market_corr_60d"))
    return calendar.join(means, "_di", "left").select(date, "market_corr_60d")


def monthly_snapshot(daily: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """The last row of each key and calendar month; its date becomes decision_date."""
    last = Window.partitionBy(key, F.trunc(date, "month")).orderBy(F.desc(date))
    return daily.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n").withColumnRenamed(date, "decision_date")


def month_ends(dates: DataFrame, date: str = "date") -> DataFrame:
    return dates.groupBy(F.trunc(date, "month").alias("month")).agg(F.max(date).alias("month_end"))


def fill_series(series: DataFrame, columns: list[str], date: str = "date", backward: bool = False) -> DataFrame:
    """Nulls take the last value before; with backward, leading ones the first after (which looks ahead).

    The order is global, over one row per calendar day.
    """
    past = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    fill = lambda c: F.last(c, ignorenulls=True).over(past)
    return series.withColumns({c: F.coalesce(fill(c), F.first(c, ignorenulls=True).over(later)) if backward else fill(c) for c in columns})
