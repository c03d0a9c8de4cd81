"""Forward windows: what the next rows of a key hold after a decision date, and the risk measures over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import EPS
from tidemark.operators.asof import asof_join
from tidemark.operators.rolling import simple_return

COMPONENTS = ("future_max_drawdown", "future_downside_volatility", "future_cvar_95", "future_illiquidity")


def forward_rows(panel: DataFrame, daily: DataFrame, horizon: int = 126, key: str = "ticker", date: str = "date") -> DataFrame:
    """(key, decision_date, n, close, return_1d, value) of the next rows strictly after each decision.

    Positions make it an equi-join: a decision opens horizon consecutive row numbers of its key.
    """
    order = Window.partitionBy(key).orderBy(date)
    numbered = daily.select(key, date, "close", "value", F.row_number().over(order).alias("n"), simple_return(F.col("close"), order).alias("return_1d"))
    keys = panel.select(key, "decision_date").distinct()
    placed = asof_join(keys, numbered.select(key, date, "n"), key, "decision_date", date, {"n": "pos"})
    wanted = placed.select(key, "decision_date", F.explode(F.sequence(F.coalesce("pos", F.lit(0)) + 1, F.coalesce("pos", F.lit(0)) + horizon)).alias("n"))
    return wanted.join(numbered.drop(date), [key, "n"])


def target_components(panel: DataFrame, daily: DataFrame, horizon: int = 126, key: str = "ticker", date: str = "date") -> DataFrame:
    """panel with the four components; null where fewer than max(20, horizon // 3) rows follow.

    A group has at most horizon rows, so it is one sorted array, and all measures are expressions on it.
    """
    rows = forward_rows(panel, daily, horizon, key, date)
    gathered = rows.groupBy(key, "decision_date").agg(F.array_sort(F.collect_list(F.struct("n", "close", "return_1d", "value"))).alias("w")).filter(F.size("w") >= max(20, horizon // 3))
    closes = F.expr("filter(transform(w, x -> x.close), c -> c is not null and not isnan(c))")
    returns = F.expr("array_sort(filter(transform(w, x -> x.return_1d), r -> r is not null and not isnan(r)))")
    df = gathered.withColumns({"c": closes, "r": returns})
    drawdown = F.expr(f"aggregate(c, named_struct('top', -1e308D, 'low', 0D), (m, x) -> named_struct('top', greatest(m.top, x), 'low', least(m.low, x / (greatest(m.top, x) + {EPS}D) - 1)), m -> abs(m.low))")
    losses = F.expr("filter(r, x -> x < 0)")
    df = df.withColumn("l", losses).withColumn("m", F.expr("aggregate(l, 0D, (s, x) -> s + x) / greatest(size(l), 1)"))
    deviation = F.expr("sqrt(aggregate(l, 0D, (s, x) -> s + (x - m) * (x - m)) / greatest(size(l) - 1, 1))")
    place = "0.05D * (size(r) - 1)"
    cut = F.expr(f"get(r, int(floor({place}))) + (get(r, int(ceil({place}))) - get(r, int(floor({place})))) * ({place} - floor({place}))")
    df = df.withColumn("q", cut).withColumn("t", F.expr("filter(r, x -> x <= q)"))
    ill = F.expr(f"filter(transform(w, x -> abs(x.return_1d) / (abs(x.value) + {EPS}D)), x -> x is not null and not isnan(x))")
    df = df.withColumn("i", ill)
    mean = lambda a: F.when(F.size(a) > 0, F.expr(f"aggregate({a}, 0D, (s, x) -> s + x) / greatest(size({a}), 1)"))
    out = df.select(
        key, "decision_date",
        F.when(F.size("c") >= 2, drawdown).alias("future_max_drawdown"),
        F.when(F.size("l") <= 1, F.lit(0.0)).otherwise(deviation).alias("future_downside_volatility"),
        F.abs(mean("t")).alias("future_cvar_95"),
        mean("i").alias("future_illiquidity"),
    )
    return panel.join(out, [key, "decision_date"], "left")
