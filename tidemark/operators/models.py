"""Model work as Spark jobs: Spark ML estimators, and searches over grids that reduce to confusion counts.

Random-cut trees and boosting of three classes at once are ``trees``' own; Spark's perceptron has no class weights,
so it learns from rows drawn in proportion to them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import divide
from tidemark.operators import trees as grown
from tidemark.operators.evaluate import _counts, confusion, high_recall, macro_f1
from tidemark.operators.fit import CLASSES
from tidemark.operators.selection import FoldStatistics
from tidemark.sources.shared import staged

PROBABILITIES = tuple(f"p_{c}" for c in CLASSES)
# Search grids.
GAMMAS = (0.65, 0.80, 1.00, 1.25, 1.50, 1.80)
THRESHOLDS = tuple(round(0.25 + 0.025 * i, 3) for i in range(21))


def _filled(columns: Sequence[str], stats: Mapping[str, tuple[float, float]], medians: Mapping[str, float]) -> list[Column]:
    return [((F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) - stats[c][0]) / stats[c][1]).alias(f"_z{i}") for i, c in enumerate(columns)]


class _Scaled:
    """Median-filled columns at mean 0 and population deviation 1, as a vector column."""

    def __init__(self, columns: Sequence[str], medians: Mapping[str, float], stats: Mapping[str, tuple[float, float]]):
        self.columns, self.medians, self.stats = list(columns), dict(medians), {c: tuple(v) for c, v in stats.items()}

    @staticmethod
    def fit(train: DataFrame, columns: Sequence[str]) -> _Scaled:
        found = FoldStatistics(train, columns, F.lit(1), 1)
        return _Scaled(columns, {c: found.medians.get((c, 1), 0.0) for c in columns}, {c: found.filled_moments(c, 1) for c in columns})

    def state(self) -> dict:
        return {"columns": self.columns, "medians": self.medians, "stats": {c: list(v) for c, v in self.stats.items()}}

    def __call__(self, df: DataFrame) -> DataFrame:
        z = _filled(self.columns, self.stats, self.medians)
        wide = df.select("*", *z)
        return VectorAssembler(inputCols=[f"_z{i}" for i in range(len(z))], outputCol="_scaled").transform(wide).drop(*(f"_z{i}" for i in range(len(z))))


class Regimes:
    """k-means over scaled columns, the cheapest of several seeds; clusters are named in the order of their centres."""

    def __init__(self, columns: Sequence[str], k: int = 2, seeds: Sequence[int] = tuple(range(1, 17)), iterations: int = 120):
        self.columns, self.k, self.seeds, self.iterations = list(columns), k, seeds, iterations

    def fit(self, train: DataFrame) -> Regimes:
        self.scaled = _Scaled.fit(train, self.columns)
        data = self.scaled(train).select("_scaled").persist()
        start = lambda s: KMeans(k=self.k, maxIter=self.iterations, seed=s, initMode="random", featuresCol="_scaled", predictionCol="_cluster").fit(data)
        with ThreadPool(min(8, len(self.seeds))) as pool:  # independent small jobs
            found = pool.map(inheritable_thread_target(train.sparkSession)(start), self.seeds)
        self.model = min(found, key=lambda m: m.summary.trainingCost)
        order = sorted(range(len(self.model.clusterCenters())), key=lambda i: tuple(self.model.clusterCenters()[i]))
        self.names = {c: n for n, c in enumerate(order)}
        data.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.scaled(df)).drop("_scaled")
        name = F.lit(None).cast("string")
        for c, n in self.names.items():
            name = F.when(F.col("_cluster") == c, F.lit(f"regime_{n}")).otherwise(name)
        return out.withColumn("regime", name).drop("_cluster")

    def state(self) -> dict:
        return {"scaled": self.scaled.state(), "k": self.k, "names": list(self.names.items())}

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(state: dict, path: str) -> Regimes:
        out = Regimes(state["scaled"]["columns"], state["k"])
        out.scaled, out.model, out.names = _Scaled(**state["scaled"]), KMeansModel.load(path), dict(map(tuple, state["names"]))
        return out


class LatentFactors:
    """Principal components of scaled columns; the largest loading of each is positive."""

    def __init__(self, columns: Sequence[str], k: int = 3):
        self.columns, self.k = list(columns), k

    def fit(self, train: DataFrame) -> LatentFactors:
        self.scaled = _Scaled.fit(train, self.columns)
        self.model = PCA(k=self.k, inputCol="_scaled", outputCol="_pc").fit(self.scaled(train).select("_scaled"))
        load = self.model.pc.toArray()
        self.signs = [1.0 if load[abs(load[:, j]).argmax(), j] >= 0 else -1.0 for j in range(self.k)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.scaled(df)).withColumn("_pc", vector_to_array("_pc"))
        return out.withColumns({f"latent_{j}": F.col("_pc")[j] * self.signs[j] for j in range(self.k)}).drop("_pc", "_scaled")

    def state(self) -> dict:
        return {"scaled": self.scaled.state(), "k": self.k, "signs": self.signs}

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(state: dict, path: str) -> LatentFactors:
        out = LatentFactors(state["scaled"]["columns"], state["k"])
        out.scaled, out.model, out.signs = _Scaled(**state["scaled"]), PCAModel.load(path), state["signs"]
        return out

    def reconstruction_error(self, df: DataFrame) -> DataFrame:
        """Mean squared error of the scaled columns rebuilt from the factors (what the factors' norm leaves)."""
        out = self.model.transform(self.scaled(df)).select(vector_to_array("_scaled").alias("x"), vector_to_array("_pc").alias("z"))
        square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
        return out.agg(F.avg((square("x") - square("z")) / len(self.columns)).alias("reconstruction_mse"))


def class_weights(train: DataFrame, label: str = "y") -> DataFrame:
    """rows / (classes * rows of the class) for each class that occurs."""
    counts = train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("rows") / (F.col("k") * F.col("n"))).alias("weight"))


def weighted(train: DataFrame, label: str = "y") -> DataFrame:
    return train.join(F.broadcast(class_weights(train, label)), label)


def aligned(probability: Column, labels: Sequence[str]) -> dict[str, Column]:
    """Class columns from an array in the order of labels; absent classes 0, normalised, a zero row uniform."""
    raw = [probability[list(labels).index(c)] if c in labels else F.lit(0.0) for c in CLASSES]
    total = raw[0] + raw[1] + raw[2]
    return {p: F.when(total > 0, r / total).otherwise(1 / 3) for p, r in zip(PROBABILITIES, raw)}


def argmax(low: Column, medium: Column, high: Column) -> Column:
    """The class of the largest probability; of equals the lower one."""
    return F.when((low >= medium) & (low >= high), "low").when(medium >= high, "medium").otherwise("high")


def systematic_sample(df: DataFrame, weight: str = "weight", by: str = "y", seed: int = 7) -> DataFrame:
    """Rows repeated by systematic resampling: as often as a unit grid with a random start falls into the row's stretch of
    the running weight sum of its class.

    A row of weight w comes floor(w) or ceil(w) times, w times on average; a class's rows are within one of its weights'
    sum, whatever the fractions.  The same stored rows and seed give the same copies.  Null and negative weights count
    as 0.  Running sums are made per stored partition, from the sums of earlier partitions, in decimals, so no rounding
    adds up.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0)).cast("decimal(20,9)")
    rows = staged(df.withColumns({"_w": w, "_row": F.monotonically_increasing_id()}), "weights").withColumn("_part", F.shiftright("_row", 33))
    parts = rows.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.sum("_w").alias("_sum"))
    earlier = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_by", "_of", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("decimal(30,9)").alias("_before"))
    own = Window.partitionBy(by, "_part").orderBy("_row")
    found = rows.withColumn("_to", F.sum("_w").over(own).cast("decimal(30,9)")).join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    start = (F.pmod(F.xxhash64(F.col(by).cast("string"), F.lit(seed)), F.lit(1_000_000_000)) / 1_000_000_000).cast("decimal(10,9)")
    ends = F.col("_before") + F.col("_to") + start
    times = (F.floor(ends) - F.floor(ends - F.col("_w"))).cast("int")
    return found.withColumn("_times", times).filter("_times > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*df.columns)


class Network:
    """A perceptron on rows drawn by weight, trained in stretches until a held-out part stops gaining."""

    def __init__(self, hidden: Sequence[int] = (96, 48), iterations: int = 60, stretch: int = 15, patience: int = 2, share: float = 0.1, seed: int = 7):
        self.hidden, self.iterations, self.stretch, self.patience, self.share, self.seed = tuple(hidden), iterations, stretch, patience, share, seed

    def fit(self, data: DataFrame) -> MultilayerPerceptronClassificationModel:
        """data: features, _label, weight.  The last stretch's model is kept only if no earlier one was better."""
        out = F.pmod(F.xxhash64("features", "_label", F.lit(self.seed)), F.lit(1000)) < int(1000 * self.share)
        marked = staged(data.select("features", "_label", "weight", out.alias("_out")), "network")
        learn = systematic_sample(marked.filter("not _out"), "weight", "_label", self.seed).select("features", "_label").persist()
        held = marked.filter("_out").persist()
        size, best, worse, weights = len(marked.select("features").first()[0]), None, 0, None
        self.losses: list[float] = []
        try:
            for _ in range(-(-self.iterations // self.stretch)):
                step = MultilayerPerceptronClassifier(layers=[size, *self.hidden, 3], maxIter=self.stretch, labelCol="_label", featuresCol="features", seed=self.seed)
                model = (step if weights is None else step.setInitialWeights(weights)).fit(learn)
                weights = model.weights
                true = F.element_at(vector_to_array("probability"), F.col("_label").cast("int") + 1)
                loss = model.transform(held).agg(F.sum(-F.ln(F.greatest(true, F.lit(1e-12))) * F.col("weight")) / F.sum("weight")).first()[0]
                if loss is None:  # nothing held out
                    best = model
                    continue
                if not self.losses or loss < min(self.losses):
                    best, worse = model, 0
                else:
                    worse += 1
                self.losses.append(loss)
                if worse >= self.patience:
                    break
        finally:
            learn.unpersist()
            held.unpersist()
        return best


class Candidate:
    """One classifier over a vector column ``features``."""

    def __init__(self, kind: str, trees: int = 60, seed: int = 7):
        self.kind, self.trees, self.seed = kind, trees, seed

    def fit(self, train: DataFrame, label: str = "y") -> Candidate:
        """train: features, the label, weight."""
        index = F.when(F.col(label) == "low", 0.0).when(F.col(label) == "medium", 1.0).otherwise(2.0)
        data = train.withColumn("_label", index)
        if self.kind == "forest":
            self.model = RandomForestClassifier(numTrees=self.trees, minInstancesPerNode=4, weightCol="weight", maxDepth=8, labelCol="_label", featuresCol="features", seed=self.seed).fit(data)
        elif self.kind == "extra":
            self.model = grown.ExtraTrees(self.trees, seed=self.seed).fit(grown.training_rows(data, F.col("_label")))
        elif self.kind == "boosting":
            self.model = grown.Boosting(max(50, min(self.trees, 180)), seed=self.seed).fit(grown.training_rows(data, F.col("_label")))
        else:
            self.model = Network(iterations=max(60, min(260, self.trees // 2)), seed=self.seed).fit(data)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with p_low, p_medium, p_high."""
        if self.kind in ("extra", "boosting"):
            return grown.predicted(df, self.model, "_p").withColumns(aligned(F.col("_p"), CLASSES)).drop("_p")
        out = self.model.transform(df)
        known = list(CLASSES)[: self.model.numClasses]
        return out.withColumns(aligned(vector_to_array("probability"), known)).drop("rawPrediction", "probability", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        if self.kind in ("extra", "boosting"):
            self.model.save(spark, path)
        else:
            self.model.write().overwrite().save(path)

    def load(self, spark: SparkSession, path: str) -> Candidate:
        """The fitted model of a candidate of this kind."""
        own = {"boosting": grown.Boosting, "extra": grown.ExtraTrees}.get(self.kind)
        kind = MultilayerPerceptronClassificationModel if self.kind == "network" else RandomForestClassificationModel
        self.model = own.load(spark, path) if own else kind.load(path)
        return self

    def importances(self, names: Sequence[str]) -> list[tuple[str, float]]:
        if self.kind == "network":
            return [(n, 0.0) for n in names]
        found = self.model.featureImportances if self.kind == "forest" else self.model.importances()
        return [(n, float(found[i])) for i, n in enumerate(names)]


def grid_search(df: DataFrame, grid: DataFrame, pred: Column, bonus: float = 0.0, y: str = "y", weight: str | None = None) -> DataFrame:
    """The scores of every grid row: macro F1, high recall and their objective, best first.

    grid has a column grid_id and is bounded by its parameters, so it is broadcast; rows are combined into
    nine counts per grid row before the exchange.  A row counts as often as its weight says.
    """
    times = F.col(weight) if weight else F.lit(1)
    both = df.crossJoin(F.broadcast(grid)).select("grid_id", F.col(y).alias("y"), pred.alias("pred"), times.alias("times"))
    scored = confusion(both, by=["grid_id"], weight="times" if weight else None).select("grid_id", macro_f1().alias("macro_f1"), high_recall().alias("high_recall"))
    scored = scored.withColumn("objective", F.col("macro_f1") + bonus * F.col("high_recall"))
    return scored.join(F.broadcast(grid), "grid_id").orderBy(F.desc(F.round("objective", 12)), "grid_id")


def weight_grid(n: int, step: float = 0.10) -> list[tuple[float, ...]]:
    """All weights on the step grid that sum to 1, then the unit vectors."""
    if n == 1:
        return [(1.0,)]
    values = [round(i * step, 10) for i in range(int(1 / step + 0.5) + 1)]
    found = [w for w in product(values, repeat=n) if abs(sum(w) - 1) < 1e-8]
    return found + [tuple(1.0 if i == j else 0.0 for j in range(n)) for i in range(n)]


def ensemble_search(df: DataFrame, names: Sequence[str], step: float = 0.10, bonus: float = 0.0, y: str = "y") -> DataFrame:
    """Soft-vote weights for the probabilities <name>_p_<class>; the first best comes first."""
    rows = [(i, *map(float, w)) for i, w in enumerate(weight_grid(len(names), step))]
    grid = df.sparkSession.createDataFrame(rows, "grid_id int, " + ", ".join(f"w_{n} double" for n in names))
    return grid_search(df, grid, argmax(*soft_vote(names)), bonus, y)


def soft_vote(names: Sequence[str], weights: Mapping[str, float] | None = None) -> list[Column]:
    """Weighted sums per class; without weights, by the columns w_<name>."""
    w = {n: F.lit(float(weights[n])) if weights else F.col(f"w_{n}") for n in names}
    return [sum((w[n] * F.col(f"{n}_{p}") for n in names[1:]), w[names[0]] * F.col(f"{names[0]}_{p}")) for p in PROBABILITIES]


def soft_vote_apply(df: DataFrame, names: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Normalised weighted vote."""
    parts = soft_vote(names, weights)
    total = parts[0] + parts[1] + parts[2]
    return df.withColumns({p: F.when(total > 0, x / total).otherwise(1 / 3) for p, x in zip(PROBABILITIES, parts)})


def _powered(gamma: Column) -> list[Column]:
    powers = [F.pow(F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1.0)), gamma) for p in PROBABILITIES]
    total = powers[0] + powers[1] + powers[2]
    return [p / total for p in powers]


def calibration_search(df: DataFrame, gammas: Sequence[float] = GAMMAS, y: str = "y") -> DataFrame:
    """Log-loss of every power, best first."""
    grid = df.sparkSession.createDataFrame([(i, float(g)) for i, g in enumerate(gammas)], "grid_id int, gamma double")
    low, medium, high = _powered(F.col("gamma"))
    true = F.when(F.col(y) == "low", low).when(F.col(y) == "medium", medium).when(F.col(y) == "high", high)
    loss = df.crossJoin(F.broadcast(grid)).groupBy("grid_id", "gamma").agg(F.avg(-F.ln(F.greatest(true, F.lit(1e-12)))).alias("log_loss"))
    return loss.orderBy(F.round("log_loss", 12), "grid_id")


def calibrate(df: DataFrame, gamma: float) -> DataFrame:
    return df.withColumns(dict(zip(PROBABILITIES, _powered(F.lit(float(gamma))))))


def policy(low_cut: Column, high_cut: Column, base: Column | None = None) -> Column:
    """The largest probability (base), unless p_high reaches its cut (high), or else p_low its own (low)."""
    base = argmax(*(F.col(p) for p in PROBABILITIES)) if base is None else base
    return F.when(F.col("p_high") >= high_cut, "high").when((F.col("p_low") >= low_cut) & (base != "high"), "low").otherwise(base)


def policy_search(df: DataFrame, cuts: Sequence[float] = THRESHOLDS, bonus: float = 0.02, y: str = "y") -> DataFrame:
    """Every pair of cuts, best first.

    Which cuts a row reaches follows from the largest of them that its probability reaches.  Rows are counted by these,
    the class of the largest probability and y first, so that the pairs meet a few thousand counts, not the rows.
    """
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(product(cuts, cuts))]
    grid = df.sparkSession.createDataFrame(rows, "grid_id int, low_cut double, high_cut double")
    reached = lambda p: F.greatest(*(F.when(F.col(p) >= float(c), F.lit(float(c))) for c in cuts), F.lit(None).cast("double"))
    counts = df.groupBy(F.col(y).alias("y"), reached("p_low").alias("p_low"), reached("p_high").alias("p_high"), argmax(*(F.col(p) for p in PROBABILITIES)).alias("base")).agg(F.count("*").alias("n"))
    return grid_search(counts, grid, policy(F.col("low_cut"), F.col("high_cut"), F.col("base")), bonus, weight="n")


def apply_policy(df: DataFrame, low_cut: float, high_cut: float) -> DataFrame:
    return df.withColumn("pred", policy(F.lit(float(low_cut)), F.lit(float(high_cut))))


def threshold_table(df: DataFrame, cuts: Sequence[float] = (0.45, 0.40, 0.35, 0.30, 0.25, 0.20), y: str = "y") -> DataFrame:
    """Recall, precision, F1 and missed rows of the class high at several cuts of p_high."""
    grid = df.sparkSession.createDataFrame([(float(c),) for c in cuts], "cut double")
    called, true = F.col("p_high") >= F.col("cut"), F.col(y) == "high"
    n = df.crossJoin(F.broadcast(grid)).groupBy("cut").agg(F.count_if(called & true).alias("hit"), F.count_if(called).alias("called"), F.count_if(true).alias("true"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return n.select("cut", zero(divide(1.0 * F.col("hit"), F.col("true"))).alias("recall"), zero(divide(1.0 * F.col("hit"), F.col("called"))).alias("precision"), zero(divide(2.0 * F.col("hit"), F.col("true") + F.col("called"))).alias("f1"), (F.col("true") - F.col("hit")).alias("missed"))


def sector_overlay(df: DataFrame, min_rows: int = 18, min_gain: float = 0.10, y: str = "y") -> DataFrame:
    """Per sector: macro F1 of the global and of the expert prediction, and whether the expert earned the sector."""
    one = confusion(df, y, "global_pred", ["sector"]).select("sector", macro_f1().alias("global_macro_f1"))
    two = df.groupBy("sector").agg(*_counts(y, "expert_pred"), F.count("*").alias("n")).select(F.col("sector").alias("_s"), "n", macro_f1().alias("expert_macro_f1"))
    both = one.join(two, F.col("sector").eqNullSafe(F.col("_s"))).drop("_s")
    gain = F.col("expert_macro_f1") - F.col("global_macro_f1")
    return both.select("sector", "n", "global_macro_f1", "expert_macro_f1", gain.alias("gain"), ((F.col("n") >= min_rows) & (F.round(gain, 12) >= min_gain)).alias("selected"))


def apply_overlay(df: DataFrame, report: DataFrame) -> DataFrame:
    """The expert's prediction in selected sectors, else the global one."""
    chosen = report.filter("selected").select("sector", F.lit(True).alias("used_sector_expert"))
    out = df.join(chosen, "sector", "left").withColumn("used_sector_expert", F.coalesce("used_sector_expert", F.lit(False)))
    return out.withColumn("pred", F.when(F.col("used_sector_expert"), F.col("expert_pred")).otherwise(F.col("global_pred")))
