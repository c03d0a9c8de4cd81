"""Statistics fitted on one part of the data and applied anywhere; parameters are small tables or rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import divide
from tidemark.functions.longform import ROW, to_lines, to_rows
from tidemark.operators.selection import FoldStatistics, Selection

# The weight of each component in the risk score.
WEIGHTS = {"future_max_drawdown": 0.35, "future_downside_volatility": 0.30, "future_cvar_95": 0.20, "future_illiquidity": 0.15}
CLASSES = ("low", "medium", "high")
MISSING = "__MISSING__"


def ecdf_rank(df: DataFrame, train: DataFrame, columns: list[str], suffix: str = "_rank") -> DataFrame:
    """Adds the share of train values <= x for each column; null stays null, all is null without train values.

    The distinct values of df are looked up in the train steps of all columns at once, then joined by equal
    value.  Both inputs are read several times, so callers should persist what is costly to make.
    """
    long = lambda x: x.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "_c", "_v").filter("_v is not null")
    counts = long(train).groupBy("_c", "_v").agg(F.count("*").alias("n"))
    asked = long(df).select("_c", "_v").distinct()
    parts = 64
    bounds = counts.groupBy("_c").agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 10_000).alias("b"))
    both = asked.withColumn("n", F.lit(0).cast("long")).unionByName(counts).groupBy("_c", "_v").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 0).alias("asked"))
    # one row of bounds per column; a value's part is the number of bounds below it
    dealt = both.join(F.broadcast(bounds), "_c").withColumn("part", F.expr("size(filter(b, x -> x < _v))")).drop("b")
    sums = dealt.groupBy("_c", "part").agg(F.sum("n").alias("s"))
    by = Window.partitionBy("_c")
    before = sums.select("_c", "part", F.coalesce(F.sum("s").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(by).alias("total"))
    running = F.sum("n").over(Window.partitionBy("_c", "part").orderBy("_v"))
    found = dealt.withColumn("r", running).filter("asked > 0").join(F.broadcast(before), ["_c", "part"]).select("_c", "_v", ((F.col("r") + F.col("before")) / F.col("total")).alias("share"))
    # all columns' values meet their shares in one join; lines of rows have keys of their own
    lines = to_lines(df, {c: F.col(c) for c in columns}).withColumn("_v", F.when(F.col("_name") == ROW, F.col("_id").cast("double")).otherwise(F.col("_x")))
    lines = lines.join(found.withColumnRenamed("_c", "_name"), ["_name", "_v"], "left")
    return to_rows(lines, df.columns, {f"{c}{suffix}": (c, "share") for c in columns})


def risk_score(df: DataFrame, suffix: str = "_rank") -> DataFrame:
    """The weighted sum of ranks; null if one is null."""
    total = None
    for c, w in WEIGHTS.items():
        part = F.lit(w) * F.col(f"{c}{suffix}")
        total = part if total is None else total + part
    return df.withColumn("risk_score", total)


def terciles(train: DataFrame, score: str = "risk_score") -> tuple[float | None, float | None]:
    """The thirds of the train scores, interpolated; exact, by range counts."""
    t = Selection(train, [score]).quantiles([1 / 3, 2 / 3])[score]
    return (t[0], t[1]) if t else (None, None)


def label(score: Column, low: float | None, high: float | None) -> Column:
    return F.when(score <= F.lit(low), "low").when(score <= F.lit(high), "medium").when(score.isNotNull(), "high")


def prepare_targets(panel: DataFrame, is_train: Column) -> DataFrame:
    """Ranks, score and risk_class by train statistics; rows without a class go."""
    panel = panel.persist()
    scored = risk_score(ecdf_rank(panel, panel.filter(is_train), list(WEIGHTS))).persist()
    low, high = terciles(scored.filter(is_train))
    return scored.withColumn("risk_class", label(F.col("risk_score"), low, high)).na.drop(subset=["risk_class"])


def class_distribution(df: DataFrame, label_col: str = "risk_class", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Rows per class in the fixed order, absent ones 0."""
    return df.agg(*(F.count_if(F.col(label_col) == c).alias(c) for c in classes)).unpivot([], list(classes), "risk_class", "n")


class Preprocessor:
    """Median imputation, winsor bounds, signed log, standardisation and one-hot coding, fitted by aggregations.

    All numbers come from one exact selection by range counts, whatever the number of features.
    """

    def __init__(self, numeric: list[str], categorical: list[str] = (), lower: float = 0.01, upper: float = 0.99):
        self.numeric, self.categorical, self.lower, self.upper = list(numeric), list(categorical), lower, upper

    def fit(self, train: DataFrame) -> Preprocessor:
        found = FoldStatistics(train, self.numeric, F.lit(1), 1, self.lower, self.upper)
        at = lambda values, default: {c: values.get((c, 1), default) for c in self.numeric}
        self.medians, self.bounds, self.means = at(found.medians, 0.0), at(found.bounds, (0.0, 0.0)), at(found.means, 0.0)
        self.scales = {c: v or 1.0 for c, v in at(found.scales, 1.0).items()}
        self.values = {}
        for c in self.categorical:
            got = [r[0] for r in train.select(F.coalesce(F.col(c).cast("string"), F.lit(MISSING))).distinct().limit(10_001).collect()]
            if len(got) > 10_000:
                raise ValueError(f"{c} has too many categories to code one by one")
            self.values[c] = sorted(got)
        return self

    def state(self) -> dict:
        """All fitted values, for a package."""
        return {k: getattr(self, k) for k in ("numeric", "categorical", "lower", "upper", "medians", "bounds", "means", "scales", "values")}

    @staticmethod
    def from_state(state: dict) -> Preprocessor:
        out = Preprocessor(state["numeric"], state["categorical"], state["lower"], state["upper"])
        out.medians, out.means, out.scales, out.values = (state[k] for k in ("medians", "means", "scales", "values"))
        out.bounds = {c: tuple(v) for c, v in state["bounds"].items()}
        return out

    def _imputed(self, c: str) -> Column:
        x = F.col(c).cast("double")
        return F.coalesce(F.when(~F.isnan(x), x), F.lit(float(self.medians[c])))

    def _logged(self, c: str) -> Column:
        lo, hi = self.bounds[c]
        x = F.least(F.greatest(self._imputed(c), F.lit(float(lo))), F.lit(float(hi)))
        return F.signum(x) * F.log1p(F.abs(x))

    def outputs(self) -> dict[str, Column]:
        out = {f"{c}_std": (self._logged(c) - self.means[c]) / self.scales[c] for c in self.numeric}
        for c in self.categorical:
            out |= {f"{c}={v}": F.when(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == v, 1.0).otherwise(0.0) for v in self.values[c]}
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.outputs())

    def parameters(self, spark) -> DataFrame:
        """One row per numeric feature."""
        rows = [(c, float(self.medians[c]), float(self.bounds[c][0]), float(self.bounds[c][1]), float(self.means[c]), float(self.scales[c])) for c in self.numeric]
        return spark.createDataFrame(rows, "feature string, median double, lower double, upper double, mean double, scale double")


def population_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column (0 or null deviation: 1)."""
    row = train.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def drift_report(df: DataFrame, features: list[str], split: str = "split", train: str = "train", bins: int = 10, warn: float = 0.20) -> DataFrame:
    """Population stability of each feature between the train rows and every other split.

    Edges are the distinct train quantiles; with two or fewer, equal steps over both ranges.  Bins are closed
    on the right and open to both ends.  A share counts 1e-6 at least.  Fewer than two values: null; a
    constant: 0.
    """
    long = df.filter(F.col(split).isNotNull()).select(split, *(F.col(c).cast("double").alias(c) for c in features)).unpivot([split], features, "feature", "x")
    long = long.withColumn("x", F.when(~(F.isnan("x") | (F.abs("x") == float("inf"))), F.col("x")))
    stats = long.groupBy("feature", split).agg(F.count("*").alias("rows"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    quantiles = Selection(df.filter(F.col(split) == train), features).quantiles([i / bins for i in range(bins + 1)])
    edges = df.sparkSession.createDataFrame([(f, sorted(set(e)) if e else None) for f, e in quantiles.items()], "feature string, edges array<double>")
    base = stats.filter(F.col(split) == train).select("feature", F.col("rows").alias("t_rows"), F.col("n").alias("t_n"), F.col("mean").alias("t_mean"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    other = stats.filter(F.col(split) != train)
    per = other.join(base, "feature").join(edges, "feature")
    low, high = F.least("lo", "t_lo"), F.greatest("hi", "t_hi")
    steps = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: low + (high - low) * i / bins)
    per = per.withColumn("edges", F.when(F.size("edges") <= 2, F.when(low < high, steps)).otherwise(F.col("edges"))).withColumnRenamed(split, "period")
    # inner edges below x give the bin, for the rows of the period and for those of train
    keyed = per.select("feature", "period", "edges").filter("edges is not null")
    binned = keyed.join(long, "feature").filter((F.col(split) == F.col("period")) | (F.col(split) == train)).filter("x is not null")
    inner = F.expr("size(filter(slice(edges, 2, size(edges) - 2), e -> e < x))")
    counts = binned.groupBy("feature", "period", inner.alias("bin")).agg(F.count_if(F.col(split) == train).alias("e"), F.count_if(F.col(split) != train).alias("a"))
    all_bins = keyed.select("feature", "period", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    full = all_bins.join(counts, ["feature", "period", "bin"], "left").na.fill(0, ["e", "a"]).join(per.select("feature", "period", "n", "t_n"), ["feature", "period"])
    e, a = F.greatest(F.col("e") / F.greatest("t_n", F.lit(1)), F.lit(1e-6)), F.greatest(F.col("a") / F.greatest("n", F.lit(1)), F.lit(1e-6))
    index = full.groupBy("feature", "period").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))
    out = per.join(index, ["feature", "period"], "left")
    psi = F.when((F.col("n") >= 2) & (F.col("t_n") >= 2), F.coalesce("psi", F.lit(0.0)))
    return out.select("feature", "period", (1 - divide(F.col("t_n"), F.col("t_rows"))).alias("train_missing_rate"), (1 - divide(F.col("n"), F.col("rows"))).alias("period_missing_rate"), F.col("t_mean").alias("train_mean"), F.col("mean").alias("period_mean"), psi.alias("psi"), F.coalesce(psi >= warn, F.lit(False)).alias("drift_warning"))
