"""The logical inputs as Spark tables and as SQL, and the registry of queries.

The test tables have no price table, so they stand for one: a ticker is a brand, its daily prices come from
the lineitems of that day, the macro series from the orders, fundamentals from the quarter's lineitems, and
reports from the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import fit, splits
from tidemark.operators.asof import asof_join, asof_series
from tidemark.operators.forward import COMPONENTS, target_components
from tidemark.operators.rolling import daily_features, monthly_snapshot
from tidemark.plans.panel import attach_sector
from tidemark.sources.shared import shared_folder
from tidemark.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The splits of the test data's years.
RANGES = {"train": ("1996-01-01", "1999-06-30"), "validation": ("1999-07-01", "2000-03-31"), "test": ("2000-04-01", "2000-12-31")}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(x: Column | str, n: int = 4) -> Column:
    """Rounded for comparison.

    Prices are quotients of cents and whole numbers, so many lie exactly between two roundings, where the last
    bit of a sum decides; a fixed offset of a hundredth of a step moves these ties.  Adding 0 takes the sign
    off a zero.
    """
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(0.0137 * 10**-n), n) + F.lit(0.0)


def rounded(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    return df.withColumns({c: r(c, n) for c, n in columns.items()})


def q(x: str, n: int = 4) -> str:
    return f"round({x} + {0.0137 * 10**-n!r}::DOUBLE, {n}) + 0.0"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def priced(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").filter("l_quantity > 0")
    return line.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker")), "l_partkey").withColumn("date", F.col("l_shipdate").cast("date"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    days = priced(spark, sf).groupBy("ticker", "date").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("volume"))
    shares = table(spark, sf, "part").groupBy(F.col("p_brand").alias("ticker")).agg((F.sum("p_size") * 1000.0).alias("shares_outstanding"))
    return days.join(shares, "ticker")


def members(spark: SparkSession, sf: str) -> DataFrame:
    number = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return brands.select("ticker", F.lit("issuer").alias("company_name"), F.concat(F.lit("S"), (number % 5).cast("string")).alias("sector"), F.when(F.col("ticker") != "Brand#25", 1).otherwise(0).alias("include_flag"))


def market(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_quantity > 0").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("market_close"))


def macro(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda c, v: F.avg(F.when(F.col(c) == v, F.col("o_totalprice")))
    return table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        (mean("o_orderpriority", "1-URGENT") / 20000).alias("key_rate"),
        (mean("o_orderpriority", "2-HIGH") / 2000).alias("fx_rate"),
        ((mean("o_orderstatus", "O") - mean("o_orderstatus", "F")) / 20000).alias("curve_slope"),
        (F.avg("o_totalprice") / 1e7).alias("market_vol_20d"),
        (mean("o_orderpriority", "3-MEDIUM") / 1e6).alias("market_corr_60d"),
    )


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    x, tax, cut = F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")
    kept = F.sum(F.when(F.col("l_returnflag") == "N", x))
    rows = priced(spark, sf).groupBy("ticker", F.trunc("date", "quarter").alias("q")).agg(
        F.sum(x).alias("revenue"), (F.sum(x * (1 - cut)) - 0.8 * F.sum(x)).alias("ebitda"), (3 * F.sum(x * tax) - F.sum(x * cut)).alias("net_debt"),
        (-0.1 * F.sum(x * tax)).alias("interest_expense"), (0.4 * F.sum(x)).alias("book_equity"), (kept - 0.3 * F.sum(x)).alias("operating_cash_flow"), (kept - 0.4 * F.sum(x)).alias("free_cash_flow"),
    )
    end = F.date_sub(F.add_months("q", 3), 1)
    return rows.withColumn("report_date", end).withColumn("publish_date", F.date_add(end, F.when(F.quarter("q") == 4, 100).otherwise(45))).drop("q")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    published = F.date_add(F.lit("1995-03-01").cast("date"), ((i * 37) % 2300).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("Brand#"), (i % 20 + 1).cast("string")).alias("ticker"), published.alias("publish_date"), F.date_sub(published, 45).alias("report_period_end"),
        (F.col("n_chars") * 1000.0).alias("report_revenue"), F.when(i % 5 != 0, (i % 100) * 10.0).alias("report_total_debt"), ((i % 7) / 100.0).alias("report_text_risk_density"),
        (i % 9 - 2.0).alias("report_net_debt_to_ebitda"), (i % 11 / 2.0).alias("report_interest_coverage"), ((i % 13 - 6) / 10.0).alias("report_free_cf_margin"), ((i % 10) / 10.0).alias("report_financial_pressure"), ((i % 4) / 4.0).alias("report_extraction_quality"), F.lit(1.0).alias("report_document_available"),
    )


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_snapshot(daily_features(daily(spark, sf)))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Keys, features, macro series and sector, without what comes later in a plan."""
    return attach_sector(asof_series(snapshot(spark, sf), macro(spark, sf)), members(spark, sf))


def keys(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker, decision_date): the last trading day of each month."""
    return monthly_snapshot(daily(spark, sf).select("ticker", "date"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    """Means over equal rows in another order may differ in the last bit, which would part their ranks: hence the rounding."""
    return target_components(keys(spark, sf), daily(spark, sf)).withColumn("future_cvar_95", F.round("future_cvar_95", 12))


def is_train() -> Column:
    return F.col("decision_date").between(*(F.lit(d).cast("date") for d in RANGES["train"]))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return fit.prepare_targets(components(spark, sf), is_train())


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Truth, probabilities and sector per row, from the events: a stand-in for scored rows."""
    a, b = F.col("value"), F.col("event_id") % 17 + 1
    c = F.col("user_id") % 7 + 1
    total = a + b + c
    y = F.when(F.col("event_type").isin("view", "click"), "low").when(F.col("event_type") == "purchase", "medium").otherwise("high")
    return table(spark, sf, "events").filter("value >= 0").select("event_id", y.alias("y"), (a / total).alias("p_low"), (b / total).alias("p_medium"), (c / total).alias("p_high"), F.concat(F.lit("S"), F.col("user_id") % 5).alias("sector"))


# --- the same in SQL ---------------------------------------------------------------------------------
_R = RANGES
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "priced": ((), "SELECT l.*, p.p_brand AS ticker, CAST(l.l_shipdate AS DATE) AS date FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_quantity > 0"),
    "days": (("priced",), "SELECT ticker, date, sum(l_extendedprice) / sum(l_quantity) AS close, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) AS value, sum(l_quantity) AS volume FROM priced GROUP BY 1, 2"),
    "shares": ((), "SELECT p_brand AS ticker, sum(p_size) * 1000.0 AS shares_outstanding FROM part GROUP BY 1"),
    "daily": (("days", "shares"), "SELECT d.*, s.shares_outstanding::DOUBLE AS shares_outstanding FROM days d JOIN shares s ON d.ticker = s.ticker"),
    "members": ((), "SELECT DISTINCT p_brand AS ticker, 'issuer' AS company_name, 'S' || (CAST(substr(p_brand, 7) AS INT) % 5) AS sector, CASE WHEN p_brand <> 'Brand#25' THEN 1 ELSE 0 END AS include_flag FROM part"),
    "market": ((), "SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS market_close FROM lineitem WHERE l_quantity > 0 GROUP BY 1"),
    "macro": ((), "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') / 20000 AS key_rate, avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') / 2000 AS fx_rate, (avg(o_totalprice) FILTER (o_orderstatus = 'O') - avg(o_totalprice) FILTER (o_orderstatus = 'F')) / 20000 AS curve_slope, avg(o_totalprice) / 1e7 AS market_vol_20d, avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') / 1e6 AS market_corr_60d FROM orders GROUP BY 1"),
    "fund0": (("priced",), "SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) AS q, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) - 0.8 * sum(l_extendedprice) AS ebitda, 3 * sum(l_extendedprice * l_tax) - sum(l_extendedprice * l_discount) AS net_debt, -0.1 * sum(l_extendedprice * l_tax) AS interest_expense, 0.4 * sum(l_extendedprice) AS book_equity, sum(l_extendedprice) FILTER (l_returnflag = 'N') - 0.3 * sum(l_extendedprice) AS operating_cash_flow, sum(l_extendedprice) FILTER (l_returnflag = 'N') - 0.4 * sum(l_extendedprice) AS free_cash_flow FROM priced GROUP BY 1, 2"),
    "fund": (("fund0",), "SELECT *, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + CASE WHEN month(q) = 10 THEN 100 ELSE 45 END AS publish_date FROM fund0"),
    "reports": ((), "SELECT doc_id, 'Brand#' || (doc_id % 20 + 1) AS ticker, DATE '1995-03-01' + CAST((doc_id * 37) % 2300 AS INT) AS publish_date, DATE '1995-03-01' + CAST((doc_id * 37) % 2300 - 45 AS INT) AS report_period_end, n_chars * 1000.0::DOUBLE AS report_revenue, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 100) * 10.0::DOUBLE END AS report_total_debt, (doc_id % 7) / 100.0::DOUBLE AS report_text_risk_density, doc_id % 9 - 2.0::DOUBLE AS report_net_debt_to_ebitda, doc_id % 11 / 2.0::DOUBLE AS report_interest_coverage, (doc_id % 13 - 6) / 10.0::DOUBLE AS report_free_cf_margin, (doc_id % 10) / 10.0::DOUBLE AS report_financial_pressure, (doc_id % 4) / 4.0::DOUBLE AS report_extraction_quality FROM documents"),
    "ret": (("daily",), "SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS return_1d FROM daily"),
    "mret": (("ret",), "SELECT *, avg(return_1d) OVER (PARTITION BY date) AS market_return_1d FROM ret"),
    "feat": (("mret",), "SELECT *, CASE WHEN count(return_1d) OVER w20 >= 10 THEN stddev_samp(return_1d) OVER w20 END AS rolling_vol_20d, CASE WHEN count(return_1d) OVER w60 >= 20 THEN CASE WHEN count(CASE WHEN return_1d < 0 THEN 1 END) OVER w60 <= 1 THEN 0.0 ELSE stddev_samp(CASE WHEN return_1d < 0 THEN return_1d END) OVER w60 END END AS downside_vol_60d, close / nullif(lag(close, 126) OVER w, 0) - 1 AS momentum_6m, CASE WHEN count(value) OVER w20 >= 5 THEN avg(value) OVER w20 END AS avg_daily_traded_value_20d, CASE WHEN count(return_1d) OVER w20 >= 5 THEN avg(abs(return_1d) / (abs(value) + 1e-12)) OVER w20 END AS amihud_20d, greatest(abs(high - low) / (abs(close) + 1e-12), 0) AS spread_proxy, volume / (shares_outstanding + 1e-12) AS turnover_ratio, CASE WHEN count(CASE WHEN return_1d IS NOT NULL AND market_return_1d IS NOT NULL THEN 1 END) OVER w60 >= 20 AND count(market_return_1d) OVER w60 >= 20 THEN covar_samp(return_1d, market_return_1d) OVER w60 / (var_samp(market_return_1d) OVER w60 + 1e-12) END AS beta_60d, close * shares_outstanding AS market_cap, ln(1 + greatest(close * shares_outstanding, 0)) AS log_market_cap FROM mret WINDOW w AS (PARTITION BY ticker ORDER BY date), w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"),
    "snap": (("feat",), "SELECT * EXCLUDE (date), date AS decision_date FROM feat QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY date DESC) = 1"),
    "panel": (("snap", "macro", "members"), "SELECT s.*, m.* EXCLUDE (date), coalesce(u.sector, 'unknown') AS sector FROM snap s ASOF LEFT JOIN macro m ON s.decision_date >= m.date LEFT JOIN members u ON s.ticker = u.ticker"),
    "keys": (("days",), "SELECT ticker, max(date) AS decision_date FROM days GROUP BY ticker, date_trunc('month', date)"),
    "numbered": (("daily",), "SELECT ticker, date, close, value, row_number() OVER w AS n, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY date)"),
    "ahead": (("numbered", "keys"), "SELECT k.ticker, k.decision_date, f.n, f.close, f.ret, f.value FROM keys k JOIN numbered p ON p.ticker = k.ticker AND p.date = k.decision_date JOIN numbered f ON f.ticker = k.ticker AND f.n > p.n AND f.n <= p.n + 126"),
    "cut": (("ahead",), "SELECT ticker, decision_date, quantile_cont(ret, 0.05) AS c, count(*) AS rows_ FROM ahead GROUP BY 1, 2"),
    "tops": (("ahead",), "SELECT *, max(close) OVER (PARTITION BY ticker, decision_date ORDER BY n) AS top FROM ahead"),
    "comp": (("tops", "cut", "keys"), "SELECT k.ticker, k.decision_date, x.dd AS future_max_drawdown, x.dv AS future_downside_volatility, x.cv AS future_cvar_95, x.il AS future_illiquidity FROM keys k LEFT JOIN (SELECT t.ticker, t.decision_date, abs(least(min(close / (top + 1e-12) - 1), 0)) AS dd, CASE WHEN count(*) FILTER (ret < 0) <= 1 THEN 0.0 ELSE stddev_samp(ret) FILTER (ret < 0) END AS dv, round(abs(avg(ret) FILTER (ret <= c)), 12) AS cv, avg(abs(ret) / (abs(value) + 1e-12)) AS il FROM tops t JOIN cut ON cut.ticker = t.ticker AND cut.decision_date = t.decision_date WHERE rows_ >= 42 GROUP BY 1, 2) x ON x.ticker = k.ticker AND x.decision_date = k.decision_date"),
    "train": (("comp",), f"SELECT * FROM comp WHERE decision_date BETWEEN DATE '{_R['train'][0]}' AND DATE '{_R['train'][1]}'"),
    "ranked": (("comp", "train"), "SELECT c.*, " + ", ".join(f"CASE WHEN {x} IS NOT NULL THEN (SELECT count(*) FROM train t WHERE t.{x} <= c.{x}) / (SELECT count({x}) FROM train)::DOUBLE END AS {x}_rank" for x in COMPONENTS) + " FROM comp c"),
    "score": (("ranked",), "SELECT *, 0.35 * future_max_drawdown_rank + 0.30 * future_downside_volatility_rank + 0.20 * future_cvar_95_rank + 0.15 * future_illiquidity_rank AS risk_score FROM ranked"),
    "thirds": (("score",), f"SELECT quantile_cont(risk_score, [1/3.0, 2/3.0]) AS t FROM score WHERE decision_date BETWEEN DATE '{_R['train'][0]}' AND DATE '{_R['train'][1]}'"),
    "labelled": (("score", "thirds"), "SELECT s.*, CASE WHEN risk_score <= t[1] THEN 'low' WHEN risk_score <= t[2] THEN 'medium' ELSE 'high' END AS risk_class FROM score s, thirds WHERE risk_score IS NOT NULL"),
    "stressed": (("comp", "reports"), "SELECT k.*, " + ", ".join(f"CASE WHEN k.decision_date - x.publish_date <= 550 THEN {e} END AS {n}" for e, n in (("x.report_financial_pressure", "p"), ("(x.doc_id % 6 = 0)::DOUBLE", "a"), ("(x.doc_id % 4 = 0)::DOUBLE", "b"), ("(x.doc_id % 3 = 0)::DOUBLE", "c"))) + " FROM comp k ASOF LEFT JOIN (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY ticker, publish_date ORDER BY doc_id DESC) = 1) x ON k.ticker = x.ticker AND k.decision_date >= x.publish_date"),
    "pred0": ((), "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'low' WHEN event_type = 'purchase' THEN 'medium' ELSE 'high' END AS y, value AS a, event_id % 17 + 1 AS b, user_id % 7 + 1 AS c, 'S' || (user_id % 5) AS sector FROM events WHERE value >= 0"),
    "pred": (("pred0",), "SELECT event_id, y, a / (a + b + c) AS p_low, b / (a + b + c) AS p_medium, c / (a + b + c) AS p_high, sector FROM pred0"),
    "called": (("pred",), "SELECT *, CASE WHEN p_low >= p_medium AND p_low >= p_high THEN 'low' WHEN p_medium >= p_high THEN 'medium' ELSE 'high' END AS pred FROM pred"),
}


def sql(body: str, *names: str) -> str:
    """body with the common tables that it names, and those that they need."""
    order: list[str] = []

    def need(n: str) -> None:
        for d in CTES[n][0]:
            need(d)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    return ("WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + " " if order else "") + body


__all__ = ["COMPONENTS", "QUERIES", "RANGES", "SQL", "Column", "DataFrame", "F", "SparkSession", "Window", "asof_join", "asof_series", "components", "daily", "daily_features", "fit", "fundamentals", "is_train", "keys", "labelled", "macro", "market", "members", "monthly_snapshot", "panel", "predictions", "priced", "q", "query", "r", "reports", "rounded", "shared_folder", "snapshot", "splits", "sql", "table"]
