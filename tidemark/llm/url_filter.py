"""Operator 13: URL filters, by rules and by gradient-boosted trees on lexical features.

Rules (verdict, host, path) come first; a url that none fits is judged by trees that were boosted on labelled urls.  The
trees see the url's text only: lengths, depth, digit ratio, entropy, counts of parameters, labels and hyphens, and
statistics of its host's suffixes (share and smoothed block rate of the last label and of the last two among the
labelled urls).  Features, rules and scores are column expressions of one scan; fitting and scoring are Spark ML's.

The trees learn from all labelled urls, copies of one url once, and the suffix statistics count all of them; Spark
chooses how to join these by their size.  ``max_per_class`` can bound both to the urls of least hash of each class.  All
urls are judged.  Spark ML places the candidate thresholds of the features by a sample of its own (10,000 rows); what a
threshold parts is counted over all rows.

A null url and one without ``://`` have empty host and path, no rule, and are judged by the trees as empty texts.
Repeated rows and null ids are judged one by one.  Urls are read whole, however long.  Equal lengths of two fitting
rules go to the one with the longer host, then to the first.  Without labelled urls of both classes nothing is learned
and a url without rule has the verdict of the one class there is, or ``allow``.  An empty table gives an empty one.
Further columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint_dir, staged


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules every filtering starts with.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: Words that, alone between dots and hyphens of a host, label a url as blocked: the seed of labelled urls where none are given.
SEED_TERMS = ("ads", "adult", "bets", "casino", "pills", "spam")

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOW)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null: rules are a short list, a condition each."""
    text = verdict = F.lit(None).cast("string")
    # the last condition set is asked first
    for r in sorted(reversed(rules), key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def seed_labels(urls: DataFrame, url_col: str = "url", terms: Sequence[str] = SEED_TERMS) -> DataFrame:
    """(url, blocked): whether one of the terms stands alone between dots and hyphens of the host; urls without host have no label."""
    named = host(F.col(f"`{url_col}`"))
    labelled = urls.select(F.col(f"`{url_col}`").alias("url"), named.alias("_host")).filter("_host != ''")
    return labelled.select("url", F.arrays_overlap(F.split("_host", "[.-]"), F.array(*map(F.lit, terms))).cast("int").alias("blocked"))


def _entropy(text: Column) -> Column:
    """Bits per character: characters sorted, equal ones matched as one stretch."""
    letters = F.array_join(F.array_sort(F.split(text, "")), "")
    counts = F.transform(F.regexp_extract_all(letters, F.lit(r"(?s)(.)\1*"), 0), lambda x: F.length(x).cast("double"))
    n = F.length(text).cast("double")
    return F.when(n > 0, F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * F.log2(x)) / n).otherwise(0.0)


def _share(text: Column, pattern: str) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, pattern, "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def lexical(url: Column) -> dict[str, Column]:
    """What is told from the url's text alone."""
    url = F.coalesce(url, F.lit(""))
    h, p = host(url), path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.split(h, r"\.")
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    return {
        "length": F.length(url).cast("double"), "host_length": F.length(h).cast("double"), "path_length": F.length(p).cast("double"), "query_length": F.length(query).cast("double"),
        "depth": F.size(F.filter(F.split(p, "/"), lambda x: x != "")).cast("double"), "labels": F.size(labels).cast("double"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
        "hyphens": count(h, "-"), "host_digits": _share(h, "[^0-9]"), "path_digits": _share(p, "[^0-9]"), "digits": _share(url, "[^0-9]"),
        "vowels": _share(h, "[^aeiouy]"), "host_entropy": _entropy(h), "path_entropy": _entropy(p),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "fragment": F.when(url.contains("#"), 1.0).otherwise(0.0),
        "secure": F.when(F.lower(url).startswith("https:"), 1.0).otherwise(0.0), "escapes": count(url, "%"), "consonants": F.array_max(F.transform(F.split(h, "[aeiouy.-]"), lambda x: F.length(x))).cast("double"),
    }


#: Suffix statistics: how many labels, and the rows by which a rate is drawn to that of all labelled urls.
LEVELS, PRIOR = (1, 2), 20.0


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(level, suffix, share, rate) of the hosts of labelled urls."""
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), _suffix(host(F.col("url")), k).alias("suffix")) for k in LEVELS)))
    whole = labelled.agg(F.count("*").alias("_n"), F.avg("blocked").alias("_rate"))
    found = labelled.select("blocked", levels.alias("x")).groupBy("x.level", "x.suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    found = found.crossJoin(F.broadcast(whole))  # one row
    return found.select("level", "suffix", (F.col("n") / F.col("_n")).alias("share"), ((F.col("b") + PRIOR * F.col("_rate")) / (F.col("n") + PRIOR)).alias("rate"), F.col("_rate").alias("prior"))


def described(urls: DataFrame, statistics: DataFrame) -> tuple[DataFrame, list[str]]:
    """urls (column ``url``) with the features as columns, and their names."""
    features = lexical(F.col("url"))
    found = urls.withColumns(features).withColumn("_host", host(F.col("url")))
    names = list(features)
    prior = statistics.agg(F.max("prior").alias("_prior"))
    for k in LEVELS:
        one = statistics.filter(F.col("level") == k).select(F.col("suffix").alias("_suffix"), F.col("share").alias(f"share_{k}"), F.col("rate").alias(f"rate_{k}"))
        found = found.join(one, _suffix(F.col("_host"), k) == F.col("_suffix"), "left").drop("_suffix")
        names += [f"share_{k}", f"rate_{k}"]
    found = found.crossJoin(F.broadcast(prior))  # one row
    rates = {f"share_{k}": F.coalesce(f"share_{k}", F.lit(0.0)) for k in LEVELS} | {f"rate_{k}": F.coalesce(f"rate_{k}", "_prior", F.lit(0.0)) for k in LEVELS}
    return found.withColumns(rates).fillna(0.0, names), names


def distinct_labels(labelled: DataFrame) -> DataFrame:
    """(url, blocked): copies of one url count once.  A url with both labels is blocked."""
    return labelled.filter(F.col("url").isNotNull() & F.col("blocked").isin(0, 1)).groupBy("url").agg(F.max("blocked").cast("int").alias("blocked"))


def sampled(labelled: DataFrame, max_per_class: int) -> DataFrame:
    """Of each class the distinct labelled urls of least hash."""
    known = distinct_labels(labelled)
    least = lambda y: known.filter(F.col("blocked") == y).orderBy(F.xxhash64("url", F.lit(13)), "url").limit(max_per_class)
    return least(0).unionAll(least(1))


class UrlModel(NamedTuple):
    """Trees and suffix statistics; trees None: everything has the verdict of ``only``."""

    trees: GBTClassificationModel | None
    statistics: DataFrame | None
    only: float


def fit_urls(labelled: DataFrame, max_per_class: int | None = None, rounds: int = 30, depth: int = 4, seed: int = 13) -> UrlModel:
    """Boosts trees on all labelled urls (url, blocked 0/1), or max_per_class a class, with both classes of equal weight."""
    checkpoint_dir(labelled.sparkSession)  # long boosting cuts its lineage there
    known = staged(distinct_labels(labelled) if max_per_class is None else sampled(labelled, max_per_class), "url-labels")
    sizes = {r["blocked"]: r["n"] for r in known.groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return UrlModel(None, None, float(next(iter(sizes), 0)))
    statistics = staged(suffix_statistics(known), "url-suffixes")
    rows, names = described(known, statistics)
    weight = F.lit(sum(sizes.values())) / F.when(F.col("blocked") == 1, 2 * sizes[1]).otherwise(2 * sizes[0])
    rows = VectorAssembler(inputCols=names, outputCol="_features").transform(rows).select("_features", F.col("blocked").cast("double").alias("_label"), weight.alias("_weight"))
    boosting = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64, seed=seed)
    return UrlModel(boosting.fit(rows), statistics, 0.0)


def filter_urls(pages: DataFrame, model: UrlModel, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule (null if none fits), verdict, score (the trees' probability of block) of every row."""
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("url"))
    if model.trees is None:
        rows = rows.withColumn("score", F.lit(model.only))
    else:
        rows, names = described(rows, model.statistics)
        rows = model.trees.transform(VectorAssembler(inputCols=names, outputCol="_features").transform(rows.select("_id", "url", *names)))
        rows = rows.select("_id", "url", F.element_at(vector_to_array("probability"), 2).alias("score"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")
