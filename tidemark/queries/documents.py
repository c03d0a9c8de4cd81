"""Queries of report documents and links."""

from __future__ import annotations

from tidemark.functions import first_date
from tidemark.operators import documents as doc
from tidemark.operators import links
from tidemark.operators.asof import asof_reports
from tidemark.queries.base import DataFrame, F, SparkSession, keys, q, query, reports, rounded, sql, table
from tidemark.sources.tables import report_registry


@query(r"SELECT doc_id, md5(regexp_replace(translate(text || chr(9) || ' x' || chr(160) || chr(160) || 'y', chr(160) || chr(9), '  '), ' +', ' ', 'g')) AS digest FROM documents")
def g1_normalise(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit("\t x  y"))
    return table(spark, sf, "documents").select("doc_id", F.md5(doc.normalise(text).cast("binary")).alias("digest"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN p * 1e6 WHEN 1 THEN -p WHEN 2 THEN floor(p) * 1000 + 0.5 WHEN 3 THEN floor(p) * 1e9 ELSE NULL END AS value FROM (SELECT o_orderkey, round(o_totalprice, 2) AS p FROM orders)")
def g2_parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    p = F.round("o_totalprice", 2)
    whole = F.format_number(F.floor("o_totalprice"), 0)
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.replace(F.replace(F.format_number(p, 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))).when(k == 1, F.concat(F.lit("("), F.format_number(p, 2), F.lit(")"))).when(k == 2, F.concat(F.replace(whole, F.lit(","), F.lit(".")), F.lit(".000,5"))).when(k == 3, F.replace(whole, F.lit(","), F.lit("'"))).otherwise("-")
    scale = F.when(k == 0, "млн").when(k == 3, "billion")
    return table(spark, sf, "orders").select("o_orderkey", doc.parse_number(text, scale).alias("value"))


def _amounts(spark: SparkSession, sf: str) -> DataFrame:
    """A report's sentences with amounts that follow from the row."""
    i, n = F.col("doc_id"), F.col("n_chars")
    amount = lambda x: x.cast("string")
    text = F.concat(
        F.lit("Выручка составила "), amount(n + 3000), F.lit(" млн руб. EBITDA "), amount(i + 3000), F.lit(" million.\nTotal debt: ("), amount(i % 50 + 3000), F.lit(",5) thousand; cash and cash equivalents "),
        amount(i % 30 + 3000), F.lit(" тыс. Interest expense 0.0 and then 77 bn. Net profit in 2023 was "), amount(i % 90 + 5000), F.lit("."),
        F.when(i % 3 == 0, " Санкции and sanctions; covenant breach, ковенанты.").otherwise(" Nothing else."),
    )
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Brand#"), i % 20 + 1).alias("ticker"), F.date_add(F.lit("1995-03-01").cast("date"), ((i * 37) % 2300).cast("int")).alias("publish_date"), F.date_add(F.lit("1995-01-15").cast("date"), ((i * 37) % 2300).cast("int")).alias("report_period_end"), F.when(i % 10 == 7, None).when(i % 10 == 8, " ").otherwise(text).alias("report_text"))


_A = "SELECT doc_id, 'Brand#' || (doc_id % 20 + 1) AS ticker, doc_id % 10 NOT IN (7, 8) AS has, (n_chars + 3000) * 1e6::DOUBLE AS revenue, (doc_id + 3000) * 1e6::DOUBLE AS ebitda, -(doc_id % 50 + 3000.5::DOUBLE) * 1e3 AS debt, (doc_id % 30 + 3000) * 1e3::DOUBLE AS cash, 77e9::DOUBLE AS interest, (doc_id % 90 + 5000)::DOUBLE AS profit FROM documents"


@query(f"SELECT doc_id, CASE WHEN has THEN revenue END AS report_revenue, CASE WHEN has THEN ebitda END AS report_ebitda, CASE WHEN has THEN debt END AS report_total_debt, CASE WHEN has THEN cash END AS report_cash_and_equivalents, CASE WHEN has THEN interest END AS report_interest_expense FROM ({_A})")
def g6_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """G3 to G6: amounts after and before keywords in two languages."""
    found = doc.extract_metrics(_amounts(spark, sf), "report_text", keep=["doc_id"])
    return found.select("doc_id", "report_revenue", "report_ebitda", "report_total_debt", "report_cash_and_equivalents", "report_interest_expense")


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '(?:licens|license)')) AS DOUBLE) AS report_license_count, CAST(len(regexp_extract_all(lower(text), 'the\\s+th')) + len(regexp_extract_all(lower(text), 'auf\\s+der')) AS DOUBLE) AS report_the_count, CAST(length(lower(regexp_replace(translate(text, chr(160) || chr(9), '  '), ' +', ' ', 'g'))) AS DOUBLE) AS report_text_length FROM documents")
def g7_signals(spark: SparkSession, sf: str) -> DataFrame:
    """G7 and G8 with a dictionary of the test texts' own terms."""
    out = doc.signal_counts(F.col("text"), {"license": ["(?:licens|license)"], "the": [r"the\s+th", r"auf\s+der"]})
    return table(spark, sf, "documents").select("doc_id", *(out[c].alias(c) for c in ("report_license_count", "report_the_count", "report_text_length")))


@query(f"SELECT doc_id, CASE WHEN has THEN {q('(debt - cash) / ebitda', 6)} END AS report_net_debt_to_ebitda, CASE WHEN has THEN {q('ebitda / interest', 5)} END AS report_interest_coverage, CASE WHEN has THEN {q('ebitda / revenue', 5)} END AS report_ebitda_margin, CASE WHEN has THEN {q('profit / revenue * 1000', 5)} END AS report_net_margin, CASE WHEN has THEN 'parsed_embedded_text' WHEN doc_id % 10 = 8 THEN 'empty_text' ELSE 'missing_document' END AS parse_status, CASE WHEN has THEN 1.0 ELSE 0.0 END::DOUBLE AS report_document_available, CASE WHEN has THEN CAST(doc_id % 3 = 0 AS DOUBLE) END AS report_covenant_flag, CASE WHEN has THEN 1.0::DOUBLE END AS report_capex_missing FROM ({_A})".replace("profit / revenue * 1000", "profit / revenue * 1000"))
def g13_report_features(spark: SparkSession, sf: str) -> DataFrame:
    """G9 to G13."""
    df = doc.report_features(_amounts(spark, sf)).withColumn("report_net_margin", F.col("report_net_margin") * 1000)
    df = df.withColumn("report_net_margin", F.when(F.col("report_net_profit").isNotNull(), F.col("report_net_margin")))
    return rounded(df, {"report_net_debt_to_ebitda": 6, "report_interest_coverage": 5, "report_ebitda_margin": 5, "report_net_margin": 5}).select("doc_id", "report_net_debt_to_ebitda", "report_interest_coverage", "report_ebitda_margin", "report_net_margin", "parse_status", "report_document_available", "report_covenant_flag", "report_capex_missing")


_PREV = "lag({0}) OVER (PARTITION BY ticker ORDER BY report_period_end NULLS LAST, publish_date NULLS LAST)"


@query(sql("SELECT doc_id, " + ", ".join(f"{q(f'({c} - {_PREV.format(c)}) / nullif(abs({_PREV.format(c)}), 0)', 5)} AS {c}_yoy_change" for c in ("report_revenue", "report_total_debt")) + " FROM one", "reports").replace(" SELECT doc_id, round", ", one AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY ticker, publish_date ORDER BY doc_id DESC) = 1) SELECT doc_id, round", 1))
def g14_previous_change(spark: SparkSession, sf: str) -> DataFrame:
    one = reports(spark, sf).groupBy("ticker", "publish_date").agg(F.max_by(F.struct("doc_id", "report_period_end", "report_revenue", "report_total_debt"), "doc_id").alias("x")).select("ticker", "publish_date", "x.*")
    out = doc.previous_change(one, ["report_revenue", "report_total_debt"])
    return rounded(out, {"report_revenue_yoy_change": 5, "report_total_debt_yoy_change": 5}).select("doc_id", "report_revenue_yoy_change", "report_total_debt_yoy_change")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
def g15_dates(spark: SparkSession, sf: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(d, "dd.MM.yyyy")).when(k == 2, F.date_format(d, "d/M/yyyy")).otherwise("unknown")
    return table(spark, sf, "orders").select("o_orderkey", first_date(text).alias("date"))


_TITLE = "CASE doc_id % 6 WHEN 0 THEN 'IFRS Q1 ' WHEN 1 THEN 'Half-year results ' WHEN 2 THEN 'МСФО 9 месяцев ' WHEN 3 THEN 'Annual report ' WHEN 4 THEN 'Consolidated statement ' ELSE 'Note ' END || (2015 + doc_id % 9)"


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ifrs_q' WHEN 1 THEN 'ifrs_h1' WHEN 2 THEN 'ifrs_9m' WHEN 3 THEN 'annual_report' WHEN 4 THEN 'ifrs' ELSE 'report' END AS report_type, make_date(CAST(2015 + doc_id % 9 AS INT), CASE doc_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 9 ELSE 12 END, CASE doc_id % 6 WHEN 0 THEN 31 WHEN 1 THEN 30 WHEN 2 THEN 30 ELSE 31 END) AS period_end FROM documents")
def g16_titles(spark: SparkSession, sf: str) -> DataFrame:
    """G16 and G17."""
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_TITLE).alias("title"))
    return docs.select("doc_id", doc.report_type(F.col("title")).alias("report_type"), doc.period_end(F.col("title")).alias("period_end"))


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' THEN CAST(o_orderdate AS DATE) END AS publish_date FROM orders")
def g18_last_modified(spark: SparkSession, sf: str) -> DataFrame:
    header = F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return table(spark, sf, "orders").select("o_orderkey", doc.last_modified_date(header, "1997-01-01", "1999-12-31").alias("publish_date"))


@query("SELECT page_id, 'https://files.example.com/portal/FileLoad.ashx?Fileid=' || page_id AS source_url, DATE '2020-01-01' + CAST(page_id % 1000 AS INT) AS publish_date, make_date(CAST(2015 + page_id % 5 AS INT), 6, 30) AS report_period_end FROM pages")
def g19_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 1000).cast("int")), "dd.MM.yyyy")
    row = F.concat(F.lit("<table><tr class=a><td>6 месяцев "), F.col("page_id") % 5 + 2015, F.lit("</td><td>01.02.2003</td><td>"), day, F.lit("</td><td><a href='FileLoad.ashx?Fileid="), "page_id", F.lit("'>x</a></td></tr><tr><td>none</td></tr></table>"))
    pages = table(spark, sf, "pages").select("page_id", F.lit("https://files.example.com/portal/list.aspx?id=1").alias("url"), F.concat(row, "html").alias("html"))
    return links.table_rows(pages, keep=("page_id",)).select("page_id", "source_url", "publish_date", "report_period_end")


@query("SELECT 'T' || (doc_id % 50) AS ticker, 'u' || (doc_id % 70) AS source_url, 'annual' AS report_type, min(CASE WHEN doc_id % 3 = 0 THEN 'a_ok' WHEN doc_id % 3 = 1 THEN 'b_failed' ELSE 'c_manual_fallback' END) AS status FROM documents GROUP BY 1, 2")
def g20_registry_union(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("T"), F.col("doc_id") % 50).alias("ticker"), F.concat(F.lit("u"), F.col("doc_id") % 70).alias("source_url"), F.lit("annual").alias("report_type"))
    part = lambda i, s: base.filter(F.col("doc_id") % 3 == i).drop("doc_id").withColumn("status", F.lit(s))
    return links.registry_union([part(0, "a_ok"), part(1, "b_failed"), part(2, "c_manual_fallback")]).select("ticker", "source_url", "report_type", "status")


@query()
def g21_links(spark: SparkSession, sf: str) -> DataFrame:
    return links.extract_links(table(spark, sf, "pages"), keep=("page_id",))


_LINK = "CASE page_id % 4 WHEN 0 THEN 'https://www.corp.example.com/ifrs/report' || page_id || '.pdf?download=1' WHEN 1 THEN 'https://corp.example.com/esg/2023/x.html' WHEN 2 THEN 'https://ir.corp.example.com/presentation.pdf#p2' ELSE 'https://other.example.org/a?dl=1' END"
_TEXT = "CASE page_id % 3 WHEN 0 THEN 'Annual Report 2024' WHEN 1 THEN 'Financial statement' ELSE 'contacts' END"
_SUM = lambda words, each: " + ".join(f"CASE WHEN contains(blob, '{w}') THEN {each} ELSE 0 END" for w in words)
_YEAR = " OR ".join(f"contains(blob, '{y}')" for y in links.YEARS)


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.expr(_LINK).alias("link"), F.expr(_TEXT).alias("text"))


@query(f"SELECT page_id, CASE WHEN page_id % 4 IN (0, 2) THEN 5 ELSE 0 END + CASE WHEN {_YEAR} THEN 4 ELSE 0 END + {_SUM(links.LINK_WORDS, 2)} - CASE WHEN contains(blob, 'esg') THEN 6 ELSE 0 END - CASE WHEN contains(blob, 'presentation') THEN 2 ELSE 0 END AS score, {_SUM(links.PAGE_WORDS, 1)} + CASE WHEN {_YEAR} THEN 2 ELSE 0 END AS page_score FROM (SELECT page_id, lower({_LINK} || ' ' || {_TEXT}) AS blob FROM pages)")
def g22_scores(spark: SparkSession, sf: str) -> DataFrame:
    """G22 and G23."""
    return _links(spark, sf).select("page_id", links.link_score(F.col("link"), F.col("text")).alias("score"), links.page_score(F.col("link"), F.col("text")).alias("page_score"))


@query(f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.corp.example.com/ifrs/report' || page_id || '.pdf' WHEN 3 THEN 'https://other.example.org/a' ELSE {_LINK} END AS canonical, page_id % 4 <> 3 AS same_site, CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' WHEN 2 THEN '.pdf' ELSE '' END AS extension FROM pages")
def g24_canonical(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.sources.tables import url_extension

    return _links(spark, sf).select("page_id", links.canonical(F.col("link")).alias("canonical"), links.same_site(F.col("link"), F.lit("https://www.corp.example.com/")).alias("same_site"), url_extension(F.col("link")).alias("extension"))


@query("SELECT 'T' || (event_id % 40) AS ticker, 'https://x.example.com/' || (user_id % 30) AS canonical_url, max(CAST(floor(value) AS INT)) AS score, arg_max(event_id, struct_pack(a := CAST(floor(value) AS INT), b := -event_id)) AS position FROM events GROUP BY 1, 2")
def g25_best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return links.best_per_address(_candidates(spark, sf)).select("ticker", "canonical_url", "score", "position")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.concat(F.lit("T"), F.col("event_id") % 40).alias("ticker"), F.concat(F.lit("https://x.example.com/"), F.col("user_id") % 30, F.when(F.col("event_id") % 2 == 0, "?dl=1").otherwise("")).alias("link"), F.floor("value").cast("int").alias("score"), F.col("event_id").alias("position"))


@query("WITH b AS (SELECT 'T' || (event_id % 40) AS ticker, 'https://x.example.com/' || (user_id % 30) AS canonical_url, max(CAST(floor(value) AS INT)) AS score FROM events GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY score DESC, canonical_url) AS INT) AS place FROM b QUALIFY place <= 18")
def g26_top_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return links.top_candidates(links.best_per_address(_candidates(spark, sf))).select("ticker", "canonical_url", "score", "place")


@query("SELECT 'src' || (doc_id % 20) AS ticker, lang AS status, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1, 2")
def g27_status_audit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.concat(F.lit("src"), F.col("doc_id") % 20).alias("ticker"), F.col("lang").alias("status")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


_COVERED = sql("SELECT 1", "keys", "reports").removesuffix(" SELECT 1") + ", one AS (SELECT DISTINCT ticker, publish_date FROM reports), cov AS (SELECT k.ticker, k.decision_date, CAST(k.decision_date - x.publish_date AS INT) AS lag, k.decision_date - x.publish_date <= 40 AS ok FROM keys k ASOF LEFT JOIN one x ON k.ticker = x.ticker AND k.decision_date >= x.publish_date) "


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    one = reports(spark, sf).select("ticker", "publish_date").distinct()
    return asof_reports(keys(spark, sf), one, [], max_lag_days=40)


@query(_COVERED + f"SELECT ticker, count(*) AS panel_rows, count(*) FILTER (ok) AS covered_rows, {q('count(*) FILTER (ok) / count(*)::DOUBLE', 6)} AS coverage_rate, min(CASE WHEN ok THEN decision_date END) AS first_covered, max(CASE WHEN ok THEN decision_date END) AS last_covered, median(CASE WHEN ok THEN lag END)::DOUBLE AS median_lag FROM cov GROUP BY 1")
def g28_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(doc.coverage(_covered(spark, sf)), {"coverage_rate": 6})


@query(_COVERED + "SELECT count(*) AS panel_rows, count(DISTINCT CASE WHEN ok THEN ticker END) AS issuers, count(*) FILTER (ok) AS covered_rows FROM cov")
def g29_layer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return doc.layer_summary(_covered(spark, sf))


@query(sql("SELECT count(*) AS panel_rows, count(DISTINCT ticker) AS tickers, count(DISTINCT sector) AS sectors, min(decision_date) AS first_date, max(decision_date) AS last_date FROM panel", "panel"))
def g30_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.queries.base import panel

    return doc.dataset_summary(panel(spark, sf))


@query("SELECT DISTINCT CASE page_id % 4 WHEN 1 THEN 'https://corp.example.com/esg/2023/x.html' WHEN 2 THEN 'https://ir.corp.example.com/presentation.pdf' ELSE 'https://www.corp.example.com/ifrs/report' || page_id || '.pdf?download=1' END AS link, 1 AS depth FROM pages WHERE page_id % 4 <> 3 AND NOT (page_id % 4 = 0 AND page_id % 8 = 0) AND NOT (page_id % 4 = 2 AND page_id % 3 = 2)")
def j12_frontier(spark: SparkSession, sf: str) -> DataFrame:
    found = _links(spark, sf).withColumns({"depth": F.lit(0), "root_url": F.lit("https://corp.example.com/")})
    visited = found.filter("page_id % 8 = 0").select(F.col("link").alias("url"))
    return links.frontier(found, visited)


@query()
def a5_registry_features(spark: SparkSession, sf: str) -> DataFrame:
    """Registry to feature rows over the documents' own texts."""
    registry = report_registry(table(spark, sf, "documents").select("doc_id", F.col("source").alias("secid"), F.col("text").alias("report_text"), F.date_add(F.lit("2001-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")).alias("published_at")))
    return doc.report_features(registry).drop("report_text")


