"""Queries of sources, predicates, rolling windows and point-in-time joins."""

from __future__ import annotations

from tidemark.operators import forward, rolling
from tidemark.operators.asof import align_series, asof_reports
from tidemark.plans.panel import attach_sector, build_panel, in_universe
from tidemark.queries.base import (  # noqa: F401
    COMPONENTS, DataFrame, F, SparkSession, Window, asof_join, asof_series, components, daily, daily_features, fundamentals, keys, macro, market, members, panel, priced, q, query, r, reports, rounded, shared_folder, snapshot, sql, table,
)
from tidemark.sources import tables

# --- sources and sinks -------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders")
def a1_table_reader(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_table(spark, f"{sf}/orders.parquet").withColumnRenamed("o_orderdate", "date").withColumn("date", F.col("date").cast("date")).select("o_orderkey", "date", "o_totalprice")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def a2_table_writer(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    tables.write_table(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "csv")
    return tables.read_table(spark, path, "c_custkey long, c_name string, c_mktsegment string")


@query(sql("SELECT ticker, date, close, close AS high, close AS low, CAST(NULL AS DOUBLE) AS volume, 'unknown' AS sector FROM (SELECT ticker, date, "+q("close")+" AS close FROM daily)", "daily"))
def a4_optional_columns(spark: SparkSession, sf: str) -> DataFrame:
    prices = daily(spark, sf).select("ticker", "date", r("close").alias("close"))
    return tables.with_defaults(prices, {"high": F.col("close"), "low": F.col("close"), "volume": None, "sector": "unknown", "close": 0.0})


@query("SELECT upper(trim('  src' || (doc_id % 20) || ' ')) AS ticker, DATE '2001-01-31' + CAST(doc_id % 300 AS INT) AS report_period_end, CASE WHEN doc_id % 3 < 2 THEN DATE '2001-03-01' + CAST(doc_id % 300 AS INT) END AS publish_date, 'd' || doc_id AS source_url, CAST(NULL AS VARCHAR) AS report_type FROM documents")
def a5_report_registry(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    day = lambda base: F.date_add(F.lit(base).cast("date"), (i % 300).cast("int"))
    shown = F.when(i % 3 == 0, F.date_format(day("2001-03-01"), "yyyy-MM-dd")).when(i % 3 == 1, F.date_format(day("2001-03-01"), "dd.MM.yyyy")).otherwise("soon")
    raw = table(spark, sf, "documents").select(F.concat(F.lit("  src"), i % 20, F.lit(" ")).alias("secid"), F.date_format(day("2001-01-31"), "dd.MM.yyyy").alias("period_end"), shown.alias("published_at"), F.concat(F.lit("d"), i).alias("url"))
    return tables.report_registry(raw).select("ticker", "report_period_end", "publish_date", "source_url", "report_type")


@query("SELECT DISTINCT upper(p_brand) AS ticker, CAST(NULL AS VARCHAR) AS e_disclosure_id, CAST(NULL AS VARCHAR) AS issuer_url FROM part")
def a6_report_sources(spark: SparkSession, sf: str) -> DataFrame:
    return tables.report_sources(table(spark, sf, "part").select(F.concat(F.lit(" "), F.lower("p_brand")).alias("ticker"))).distinct()


@query("SELECT p_brand AS ticker, min(p_type) AS company_name, (min(struct_pack(a := p_type, b := p_name))).b AS sector, 1 AS include_flag FROM part GROUP BY 1")
def a7_universe(spark: SparkSession, sf: str) -> DataFrame:
    return tables.universe(table(spark, sf, "part"), "p_brand", "p_type", "p_name")


@query("SELECT o_orderkey AS boardid, o_orderstatus AS secid, o_totalprice AS issuesize, CAST(NULL AS VARCHAR) AS lotsize FROM orders")
def a8_columnar_json(spark: SparkSession, sf: str) -> DataFrame:
    block = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 500).alias("page")).agg(F.collect_list(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("string"), F.lit("x"))).alias("data"))
    payload = F.to_json(F.struct(F.struct(F.array(*map(F.lit, ("BOARDID", "SECID", "ISSUESIZE", "OTHER"))).alias("columns"), "data").alias("securities")))
    return tables.columnar_json(block.select(payload.alias("p")), "p", "securities", {"boardid": "bigint", "secid": "string", "issuesize": "double", "lotsize": "string"})


@query("SELECT CAST(l_shipdate AS DATE) AS date, 'T' || l_suppkey AS ticker, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS close, l_quantity AS volume FROM lineitem")
def a9_trade_history(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("TRADEDATE"), F.concat(F.lit("T"), "l_suppkey").alias("SECID"), F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("CLOSE"), F.col("l_quantity").cast("string").alias("VOLUME"))
    return tables.trade_history(raw).select("date", "ticker", "close", "volume")


@query("SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, round(sum(round(o_totalprice) / 10) + 0.000137::DOUBLE, 2) + 0.0 AS rate FROM orders GROUP BY 1")
def a10_fx_records(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "xml")
    value = F.concat(F.round("o_totalprice").cast("long"), F.lit(",0"))
    raw = table(spark, sf, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("_Date"), F.lit("10").alias("Nominal"), value.alias("Value"))
    raw.write.format("xml").option("rowTag", "Record").option("rootTag", "ValCurs").save(path)
    return tables.fx_rates(spark, path).groupBy("date").agg(F.count("*").alias("n"), r(F.sum("rate"), 2).alias("rate"))


@query("SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM documents")
def a11_text_decoding(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "documents").select("doc_id", F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF"))).alias("content"))
    return raw.select("doc_id", tables.decode(F.col("content")).alias("text")).select("doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.html' WHEN 3 THEN CASE WHEN page_id % 2 = 0 THEN '.zip' ELSE '.pdf' END ELSE CASE WHEN regexp_matches(url, '(?i)^[a-z]+://[^/?#]+/[^?#]*[^/.]\\.html$') OR regexp_matches(url, '(?i)^[a-z]+://[^/?#]+/[^?#]*[^/.]\\.html[?#]') THEN '.html' ELSE '.bin' END END AS extension FROM pages")
def a12_file_type(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id") % 5
    content = F.when(i == 3, F.when(F.col("page_id") % 2 == 0, F.unhex(F.lit("504B03041400"))).otherwise(F.unhex(F.lit("255044462D31")))).otherwise(F.unhex(F.lit("00")))
    kind = tables.file_type(F.col("url"), F.when(i == 1, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet; x=1").when(i == 2, "TEXT/HTML; charset=utf-8"), F.when(i == 0, "attachment; filename*=UTF-8''an%20nual.PDF"), content)
    return table(spark, sf, "pages").select("page_id", kind.alias("extension"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def a13_checksum_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return tables.first_by_digest(table(spark, sf, "documents").withColumn("content", F.col("text").cast("binary")), "content", "doc_id")


_PREFIXED = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("l_orderkey", "l_linenumber", "l_returnflag"))
_HALF = "CAST(sum(CAST('0x' || substr(s, {at}, 16) AS UBIGINT)::HUGEINT) % 18446744073709551616::HUGEINT AS VARCHAR)"


@query(f"SELECT count(*) AS row_count, {_HALF.format(at=1)} AS hash_a, {_HALF.format(at=17)} AS hash_b FROM (SELECT sha256({_PREFIXED}) AS s FROM lineitem)")
def a14_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return tables.fingerprint(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


# --- predicates --------------------------------------------------------------------------------------


@query(sql("SELECT d.ticker, count(*) AS n FROM daily d JOIN members m ON d.ticker = m.ticker WHERE include_flag = 1 GROUP BY 1", "daily", "members"))
def p1_universe_filter(spark: SparkSession, sf: str) -> DataFrame:
    return in_universe(daily(spark, sf), members(spark, sf)).groupBy("ticker").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def p2_date_range(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").filter((d >= F.lit("1996-01-01").cast("timestamp")) & (d < F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey")


@query(sql("SELECT date, round(key_rate + 1.37e-06::DOUBLE, 4) + 0.0 AS key_rate FROM macro WHERE key_rate IS NOT NULL AND fx_rate IS NOT NULL", "macro"))
def p3_drop_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return macro(spark, sf).na.drop(subset=["key_rate", "fx_rate"]).select("date", r("key_rate").alias("key_rate"))


@query("WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN DATE '1999-01-01' + CAST(doc_id % 900 AS INT) END AS d FROM documents) SELECT doc_id, d AS publish_date FROM x WHERE d IS NULL OR d BETWEEN DATE '1999-06-01' AND DATE '2000-06-01'")
def p5_publish_window(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.links import in_publish_window

    i = F.col("doc_id")
    found = table(spark, sf, "documents").select("doc_id", F.when(i % 4 != 0, F.date_add(F.lit("1999-01-01").cast("date"), (i % 900).cast("int"))).alias("publish_date"))
    return found.filter(in_publish_window(F.col("publish_date"), "1999-06-01", "2000-06-01"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN NULL ELSE value END AS value FROM events")
def p7_numeric_coercion(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions import finite

    i = F.col("event_id") % 5
    raw = F.when(i == 0, "Infinity").when(i == 1, "n/a").when(i == 2, "NaN").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", finite(raw).alias("value"))


# --- rolling features --------------------------------------------------------------------------------
_FEATURES = {"return_1d": 6, "market_return_1d": 6, "rolling_vol_20d": 6, "downside_vol_60d": 6, "momentum_6m": 6, "avg_daily_traded_value_20d": 2, "spread_proxy": 6, "turnover_ratio": 6, "beta_60d": 5, "market_cap": 0, "log_market_cap": 6}
_FEATURE_SQL = ", ".join(f"{q(c, n)} AS {c}" for c, n in _FEATURES.items()) + f", {q('amihud_20d * 1e6', 6)} AS amihud_20d"


@query(sql(f"SELECT ticker, date, {_FEATURE_SQL} FROM feat", "feat"))
def b_daily_features(spark: SparkSession, sf: str) -> DataFrame:
    """B1, B3 to B12 in one pass."""
    df = daily_features(daily(spark, sf)).withColumn("amihud_20d", F.col("amihud_20d") * 1e6)
    return rounded(df, _FEATURES | {"amihud_20d": 6}).select("ticker", "date", *_FEATURES, "amihud_20d")


@query(sql("SELECT d.ticker, d.date, round(m.r + 1.37e-08::DOUBLE, 6) + 0.0 AS market_return_1d FROM daily d LEFT JOIN (SELECT date, market_close / nullif(lag(market_close) OVER (ORDER BY date), 0) - 1 AS r FROM market) m ON m.date = d.date", "daily", "market"))
def b2_benchmark_return(spark: SparkSession, sf: str) -> DataFrame:
    found = rolling.benchmark_returns(market(spark, sf), close="market_close")
    return daily(spark, sf).select("ticker", "date").join(found, "date", "left").select("ticker", "date", r("market_return_1d", 6).alias("market_return_1d"))


@query(sql("SELECT date, round(CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w END + 1.37e-08::DOUBLE, 6) + 0.0 AS market_vol_20d FROM (SELECT date, market_close / nullif(lag(market_close) OVER (ORDER BY date), 0) - 1 AS r FROM market) WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "market"))
def b13_realised_volatility(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rolling.realised_volatility(market(spark, sf), close="market_close"), {"market_vol_20d": 6})


@query(sql("SELECT date, ticker, round(close + 1.37e-06::DOUBLE, 4) + 0.0 AS close FROM daily", "daily"))
def b14_last_close(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rolling.last_close(daily(spark, sf)), {"close": 4})


@query(sql("SELECT c.date, round(x.m + 1.37e-06::DOUBLE, 4) + 0.0 AS market_corr_60d FROM cal c LEFT JOIN (SELECT di, avg(c) AS m FROM (SELECT g.di, a.ticker AS ta, b.ticker AS tb, (count(*) * sum(a.r * b.r) - sum(a.r) * sum(b.r)) / nullif(sqrt((count(*) * sum(a.r * a.r) - sum(a.r) * sum(a.r)) * (count(*) * sum(b.r * b.r) - sum(b.r) * sum(b.r))), 0) AS c FROM rr a JOIN rr b ON a.di = b.di AND a.ticker < b.ticker JOIN cal g ON g.di BETWEEN a.di AND a.di + 59 GROUP BY 1, 2, 3 HAVING count(*) >= 20) GROUP BY 1) x ON x.di = c.di", "daily").replace("SELECT c.date", ", cal AS (SELECT date, row_number() OVER (ORDER BY date) AS di FROM (SELECT DISTINCT date FROM daily)), rr AS (SELECT ticker, di, r FROM (SELECT d.ticker, c.di, d.close / nullif(lag(d.close) OVER w, 0) - 1 AS r, c.di - lag(c.di) OVER w AS gap FROM daily d JOIN cal c ON c.date = d.date WINDOW w AS (PARTITION BY d.ticker ORDER BY c.di)) WHERE gap = 1 AND r IS NOT NULL) SELECT c.date", 1).replace(") , cal", "), cal"))
def b15_market_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rolling.market_correlation(daily(spark, sf)), {"market_corr_60d": 4})


@query(sql(f"SELECT ticker, decision_date, {q('close')} AS close, {q('rolling_vol_20d', 6)} AS rolling_vol_20d FROM snap", "snap"))
def b16_monthly_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(snapshot(spark, sf), {"close": 4, "rolling_vol_20d": 6}).select("ticker", "decision_date", "close", "rolling_vol_20d")


@query(sql("SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS month_end FROM daily GROUP BY 1", "daily"))
def b17_month_ends(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.month_ends(daily(spark, sf))


@query(sql("SELECT date, round(coalesce(last_value(key_rate IGNORE NULLS) OVER p, first_value(key_rate IGNORE NULLS) OVER f) + 1.37e-06::DOUBLE, 4) + 0.0 AS key_rate, round(coalesce(last_value(curve_slope IGNORE NULLS) OVER p, first_value(curve_slope IGNORE NULLS) OVER f) + 1.37e-06::DOUBLE, 4) + 0.0 AS curve_slope FROM macro WINDOW p AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "macro"))
def b18_fill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rolling.fill_series(macro(spark, sf).select("date", "key_rate", "curve_slope"), ["key_rate", "curve_slope"], backward=True), {"key_rate": 4, "curve_slope": 4})


# --- point-in-time joins -----------------------------------------------------------------------------
_MACRO = ("key_rate", "fx_rate", "curve_slope", "market_vol_20d", "market_corr_60d")


@query(sql("SELECT k.ticker, k.decision_date, " + ", ".join(f"{q('m.' + c)} AS {c}" for c in _MACRO) + " FROM keys k ASOF LEFT JOIN macro m ON k.decision_date >= m.date", "keys", "macro"))
def j1_macro_asof(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(asof_series(keys(spark, sf), macro(spark, sf)), {c: 4 for c in _MACRO}).select("ticker", "decision_date", *_MACRO)


@query("WITH v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def j2_keyed_asof(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'view'").select("user_id", "ts", "event_id")
    return asof_join(left, right, "user_id", "ts", "ts", {"event_id": "view_id"}, tie="event_id", split=F.to_date("t")).drop("ts")


_FUND = ("revenue", "ebitda", "net_debt", "free_cash_flow")


@query(sql("SELECT k.ticker, k.decision_date, f.report_date AS fund_report_date, " + ", ".join(f"{q('f.' + c, 2)} AS fund_{c}" for c in _FUND) + " FROM keys k ASOF LEFT JOIN fund f ON k.ticker = f.ticker AND k.decision_date >= f.publish_date", "keys", "fund"))
def j2_fundamentals_asof(spark: SparkSession, sf: str) -> DataFrame:
    df = asof_join(keys(spark, sf), fundamentals(spark, sf), "ticker", "decision_date", "publish_date", {c: f"fund_{c}" for c in ("report_date", *_FUND)}, tie="report_date")
    return rounded(df, {f"fund_{c}": 2 for c in _FUND}).select("ticker", "decision_date", "fund_report_date", *(f"fund_{c}" for c in _FUND))


_REPORTS = sql("SELECT k.ticker, k.decision_date, x.publish_date AS report_publish_date, CAST(k.decision_date - x.publish_date AS INT) AS report_lag_days, CASE WHEN k.decision_date - x.publish_date <= 60 THEN 1.0::DOUBLE ELSE 0.0 END AS report_available, CASE WHEN k.decision_date - x.publish_date <= 60 THEN 0.0::DOUBLE ELSE 1.0 END AS report_stale_flag, CASE WHEN k.decision_date - x.publish_date <= 60 THEN x.report_revenue END AS report_revenue, CASE WHEN k.decision_date - x.publish_date <= 60 THEN x.report_total_debt END AS report_total_debt FROM keys k ASOF LEFT JOIN one x ON k.ticker = x.ticker AND k.decision_date >= x.publish_date", "keys", "reports").replace(" SELECT k.ticker", ", one AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY ticker, publish_date ORDER BY doc_id DESC) = 1) SELECT k.ticker", 1)


@query(_REPORTS)
def j3_reports_asof(spark: SparkSession, sf: str) -> DataFrame:
    one = reports(spark, sf)
    latest = one.groupBy("ticker", "publish_date").agg(F.max_by(F.struct("report_period_end", "report_revenue", "report_total_debt", "report_document_available"), "doc_id").alias("x")).select("ticker", "publish_date", "x.*")
    return asof_reports(keys(spark, sf), latest, ["report_revenue", "report_total_debt"], max_lag_days=60).drop("report_document_available")


@query(sql("SELECT m.date, round(last_value(k.key_rate IGNORE NULLS) OVER w + 1.37e-06::DOUBLE, 4) + 0.0 AS key_rate, round(last_value(k.fx_rate IGNORE NULLS) OVER w + 1.37e-06::DOUBLE, 4) + 0.0 AS fx_rate, k.key_rate IS NULL AS was_null FROM market m LEFT JOIN macro k ON k.date = m.date WINDOW w AS (ORDER BY m.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "market", "macro").replace(", k.key_rate IS NULL AS was_null FROM market m LEFT JOIN macro k ON k.date = m.date", " FROM alls m LEFT JOIN macro k ON k.date = m.date").replace("SELECT m.date, round(last", ", alls AS (SELECT date FROM market UNION SELECT date FROM macro) SELECT * FROM (SELECT m.date, round(last", 1) + ") WHERE date IN (SELECT date FROM market)")
def j4_multi_series(spark: SparkSession, sf: str) -> DataFrame:
    series = macro(spark, sf)
    out = align_series(market(spark, sf).select("date"), {c: series.select("date", F.col(c).alias("value")) for c in ("key_rate", "fx_rate")})
    return rounded(out, {"key_rate": 4, "fx_rate": 4}).select("date", "key_rate", "fx_rate")


@query(sql("SELECT k.ticker, k.decision_date, CASE WHEN k.decision_date - m.date <= 7 THEN round(m.curve_slope + 1.37e-06::DOUBLE, 4) + 0.0 END AS curve_slope FROM keys k ASOF LEFT JOIN macro m ON k.decision_date >= m.date", "keys", "macro"))
def j5_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    curve = macro(spark, sf).select("date", "curve_slope")
    return rounded(asof_series(keys(spark, sf), curve, tolerance_days=7), {"curve_slope": 4}).select("ticker", "decision_date", "curve_slope")


@query(sql("SELECT k.ticker, k.decision_date, m.sector FROM keys k JOIN members m ON m.ticker = k.ticker", "keys", "members"))
def j6_sector(spark: SparkSession, sf: str) -> DataFrame:
    return attach_sector(keys(spark, sf), members(spark, sf)).select("ticker", "decision_date", "sector")


@query(sql("SELECT d.ticker, d.date, s.shares_outstanding::DOUBLE AS shares_outstanding FROM days d LEFT JOIN shares s ON s.ticker = d.ticker", "days", "shares"))
def j7_share_count(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf).select("ticker", "date", "shares_outstanding")


@query(sql("SELECT ticker, decision_date, count(*) AS n_rows, round(sum(close) + 0.000137::DOUBLE, 2) + 0.0 AS closes FROM ahead GROUP BY 1, 2", "ahead"))
def j8_forward_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = forward.forward_rows(keys(spark, sf), daily(spark, sf))
    return rows.groupBy("ticker", "decision_date").agg(F.count("*").alias("n_rows"), r(F.sum("close"), 2).alias("closes"))


@query("WITH a AS (SELECT o_orderpriority AS feature, count(*)::DOUBLE AS importance FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY 1), b AS (SELECT o_orderpriority AS feature, count(*)::DOUBLE AS importance FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1) SELECT coalesce(a.feature, b.feature) AS feature, 0.25 * coalesce(a.importance, 0) + 0.75 * coalesce(b.importance, 0) AS importance FROM a FULL JOIN b ON a.feature = b.feature")
def j9_importance_merge(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.evaluate import importance_merge

    part = lambda s, no: table(spark, sf, "orders").filter((F.col("o_orderstatus") == s) & (F.col("o_orderpriority") != no)).groupBy(F.col("o_orderpriority").alias("feature")).agg(F.count("*").cast("double").alias("importance"))
    return importance_merge(part("O", "5-LOW"), part("F", "1-URGENT"), 0.25, 0.75)


@query(sql(f"SELECT k.ticker, k.decision_date, {q('c.future_cvar_95', 6)} AS future_cvar_95 FROM keys k LEFT JOIN comp c ON c.ticker = k.ticker AND c.decision_date = k.decision_date", "keys", "comp"))
def j10_join_components(spark: SparkSession, sf: str) -> DataFrame:
    found = components(spark, sf).select("ticker", "decision_date", r("future_cvar_95", 6).alias("future_cvar_95"))
    return keys(spark, sf).join(found, ["ticker", "decision_date"], "left").select("ticker", "decision_date", "future_cvar_95")


@query("SELECT l.l_orderkey, l.l_linenumber, round((l_extendedprice - m) / s + 1.37e-06::DOUBLE, 4) + 0.0 AS z FROM lineitem l, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')")
def j11_parameter_apply(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    one = line.filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")).agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("s"))
    return line.crossJoin(F.broadcast(one)).select("l_orderkey", "l_linenumber", r((F.col("l_extendedprice") - F.col("m")) / F.col("s")).alias("z"))


@query(sql("SELECT ticker, decision_date, " + ", ".join(f"{q(c + (' * 1e6' if c.endswith('ity') and 'ill' in c else ''), 6)} AS {c}" for c in COMPONENTS) + " FROM comp", "comp"))
def t_target_components(spark: SparkSession, sf: str) -> DataFrame:
    """T1 to T5."""
    df = components(spark, sf).withColumn("future_illiquidity", F.col("future_illiquidity") * 1e6)
    return rounded(df, {c: 6 for c in COMPONENTS}).select("ticker", "decision_date", *COMPONENTS)


_PANEL_DIGITS = {
    "close": 4, "return_1d": 6, "market_return_1d": 6, "rolling_vol_20d": 6, "downside_vol_60d": 6, "momentum_6m": 6, "avg_daily_traded_value_20d": 2, "spread_proxy": 6, "turnover_ratio": 6, "beta_60d": 5, "log_market_cap": 6, "key_rate": 5, "fx_rate": 5, "curve_slope": 5,
    "net_debt_to_ebitda": 5, "interest_coverage": 5, "ebitda_margin": 5, "free_cash_flow": 2, "operating_cash_flow": 2, "report_revenue": 2, "report_text_risk_density": 5, **dict.fromkeys(COMPONENTS, 5),
}
_PANEL_SQL = sql(
    "SELECT p.ticker, p.decision_date, p.sector, CAST(p.decision_date - x.publish_date AS INT) AS report_lag_days, f.publish_date AS fund_publish_date, "
    + ", ".join(f"{q(c, n)} AS {c}" for c, n in _PANEL_DIGITS.items())
    + " FROM panel p ASOF LEFT JOIN ff f ON p.ticker = f.ticker AND p.decision_date >= f.publish_date ASOF LEFT JOIN one x ON p.ticker = x.ticker AND p.decision_date >= x.publish_date LEFT JOIN comp c ON c.ticker = p.ticker AND c.decision_date = p.decision_date",
    "members", "panel", "fund", "reports", "comp",
).replace("FROM days d JOIN shares s ON d.ticker = s.ticker", "FROM days d JOIN shares s ON d.ticker = s.ticker WHERE d.ticker IN (SELECT ticker FROM members WHERE include_flag = 1)").replace(
    " SELECT p.ticker, p.decision_date, p.sector",
    ", ff AS (SELECT ticker, publish_date, net_debt / nullif(ebitda, 0) AS net_debt_to_ebitda, ebitda / nullif(abs(interest_expense), 0) AS interest_coverage, ebitda / nullif(revenue, 0) AS ebitda_margin, free_cash_flow, operating_cash_flow FROM fund), one AS (SELECT ticker, publish_date, report_revenue, report_text_risk_density FROM reports QUALIFY row_number() OVER (PARTITION BY ticker, publish_date ORDER BY doc_id DESC) = 1) SELECT p.ticker, p.decision_date, p.sector",
    1,
)
for _c in ("report_revenue", "report_text_risk_density"):
    _PANEL_SQL = _PANEL_SQL.replace(q(_c, _PANEL_DIGITS[_c]), q(f"CASE WHEN p.decision_date - x.publish_date <= 550 THEN x.{_c} END", _PANEL_DIGITS[_c]))


@query(_PANEL_SQL)
def m26_build_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The whole panel in one plan."""
    one = reports(spark, sf).groupBy("ticker", "publish_date").agg(F.max_by(F.struct("report_period_end", "report_revenue", "report_text_risk_density", "report_document_available"), "doc_id").alias("x")).select("ticker", "publish_date", "x.*")
    out = build_panel(daily(spark, sf), members(spark, sf), None, macro(spark, sf), fundamentals(spark, sf), one, ["report_revenue", "report_text_risk_density"])
    return rounded(out, _PANEL_DIGITS).select("ticker", "decision_date", "sector", "report_lag_days", "fund_publish_date", *_PANEL_DIGITS)
