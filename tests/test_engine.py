"""The engine against hand values, invariants, and DuckDB for every query that SQL can express."""

import io
import math
import os
import zipfile
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import features
from tidemark.operators import documents, evaluate, fit, forward, links, models, quality, splits
from tidemark.operators.asof import asof_join, asof_reports, asof_series
from tidemark.operators.rolling import daily_features, monthly_snapshot
from tidemark.queries import QUERIES, SQL
from tidemark.sources import tables

D = date.fromisoformat


def days(n, start="2024-01-01"):
    return [D(start) + timedelta(days=i) for i in range(n)]


def test_drawdown_and_losses(spark):
    closes = [100.0, 120.0, 90.0, 95.0, 80.0, 130.0] + [131.0] * 40
    daily = spark.createDataFrame([("A", d, 1.0, 1.0) for d in days(1)] + [("A", d, c, 10.0) for d, c in zip(days(46, "2024-01-02"), closes)], "ticker string, date date, close double, value double")
    panel = spark.createDataFrame([("A", D("2024-01-01")), ("B", D("2024-01-01"))], "ticker string, decision_date date")
    got = {r.ticker: r for r in forward.target_components(panel, daily).collect()}
    assert round(got["A"].future_max_drawdown, 4) == 0.3333
    assert got["A"].future_downside_volatility > 0 and got["A"].future_cvar_95 > 0 and got["A"].future_illiquidity > 0
    assert got["B"].future_max_drawdown is None


def test_short_forward_window_is_null(spark):
    daily = spark.createDataFrame([("A", d, 5.0, 1.0) for d in days(42)], "ticker string, date date, close double, value double")
    panel = spark.createDataFrame([("A", D("2024-01-01"))], "ticker string, decision_date date")
    assert forward.target_components(panel, daily).first().future_max_drawdown is None


def test_labels_cover_three_classes(spark):
    rows = [(f"t{i}", D("2024-01-31"), *[float(i + 1)] * 4) for i in range(6)]
    panel = spark.createDataFrame(rows, "ticker string, decision_date date, " + ", ".join(f"{c} double" for c in forward.COMPONENTS))
    got = fit.prepare_targets(panel, F.lit(True)).collect()
    assert {r.risk_class for r in got} == {"low", "medium", "high"}


def test_train_statistics_ignore_later_rows(spark):
    rows = [(i, float(i)) for i in range(50)]
    one = spark.createDataFrame(rows, "i int, x double")
    two = spark.createDataFrame([(i, x * (1 if i < 25 else 1000)) for i, x in rows], "i int, x double")
    pick = lambda df: [r.x_rank for r in fit.ecdf_rank(df, df.filter("i < 25"), ["x"]).filter("i < 25").orderBy("i").collect()]
    assert pick(one) == pick(two) == [(i + 1) / 25 for i in range(25)]


def test_snapshot_keeps_rolling_columns(spark):
    rows = [(d, t, 100.0 + i, 1e6) for t in "AB" for i, d in enumerate(days(40))]
    daily = spark.createDataFrame(rows, "date date, ticker string, close double, value double")
    got = monthly_snapshot(daily_features(daily)).collect()
    assert len(got) == 4 and all(r.rolling_vol_20d is not None for r in got)


def test_cross_sectional_rank(spark):
    rows = [(D("2024-01-31"), "A", "S", 1.0), (D("2024-01-31"), "B", "S", 2.0), (D("2024-02-29"), "A", "S", None)]
    df = spark.createDataFrame(rows, "decision_date date, ticker string, sector string, rolling_vol_20d double")
    out, added = features.augment(df)
    got = {(r.ticker, r.decision_date.month): r for r in out.collect()}
    assert got["B", 1].rolling_vol_20d_cs_rank == 1.0 and got["A", 1].rolling_vol_20d_cs_rank == 0.5
    assert got["A", 2].rolling_vol_20d_cs_rank is None and got["A", 2].rolling_vol_20d_sector_z == 0.0
    assert not any(c.startswith("future_") for c in added)


def test_policy_search_counts_rows(spark):
    """Counts by reached cuts give what the rows themselves give, on the cuts, beside them, and for nulls."""
    rows = [(y, low, round(1 - low - high, 3), high) for y in ("low", "medium", "high") for low in (0.1, 0.25, 0.3, 0.49) for high in (0.0, 0.249, 0.25, 0.4, 0.5)]
    df = spark.createDataFrame([*rows, ("high", None, 0.5, 0.5), ("low", 0.6, 0.4, None)], "y string, p_low double, p_medium double, p_high double")
    cuts = (0.25, 0.3, 0.5)
    grid = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in cuts for b in cuts)], "grid_id int, low_cut double, high_cut double")
    plain = models.grid_search(df, grid, models.policy(F.col("low_cut"), F.col("high_cut")), 0.02)
    assert models.policy_search(df, cuts).collect() == plain.collect()


def test_workbook_in_a_zip(spark):
    def packed(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, "x" * 300)
        return bytearray(out.getvalue())

    rows = [(0, packed("[Content_Types].xml", "_rels/.rels", "xl/workbook.xml")), (1, packed("[Content_Types].xml", "word/document.xml")), (2, packed("a/xl/b.txt", "x[Content_Types].xml")), (3, bytearray(b"PK\x03\x04")), (4, None)]
    none = F.lit(None).cast("string")
    df = spark.createDataFrame(rows, "id int, content binary").select("id", tables.file_type(F.lit("https://x.example.com/get"), none, none, F.col("content")).alias("kind"))
    assert [r.kind for r in df.orderBy("id").collect()] == [".xlsx", ".zip", ".zip", ".zip", ".bin"]


def test_splits(spark):
    months = [D(f"2024-{m:02d}-28") for m in range(1, 13)]
    df = spark.createDataFrame([(d, 1) for d in months], "decision_date date, x int")
    got = splits.temporal_split(df, {"train": ("2024-01-01", "2024-06-30"), "validation": ("2024-07-01", "2024-09-30"), "test": ("2024-10-01", "2024-12-31")}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 6, "validation": 3, "test": 3}
    eighteen = spark.createDataFrame([(D(f"{2023 + m // 12}-{m % 12 + 1:02d}-15"),) for m in range(18)], "decision_date date")
    # starts 12 and 15: with 18 months, initial 12 and test 3
    assert splits.walk_forward(eighteen).select("fold").distinct().count() == 2
    assert splits.walk_forward(eighteen, initial=6).select("fold").distinct().count() == 4


@pytest.mark.parametrize(("raw", "scale", "value"), [("1 234,5", "млн", 1234500000.0), ("(2.5)", "billion", -2.5e9), ("3,250.75", None, 3250.75), ("1.234.567", None, 1234567.0), ("−7", "тыс", -7000.0), ("1'000", None, 1000.0), ("-", None, None), ("12,345", None, 12345.0)])
def test_numbers(spark, raw, scale, value):
    df = spark.createDataFrame([(raw, scale)], "r string, s string")
    assert df.select(documents.parse_number(F.col("r"), F.col("s")).alias("v")).first().v == value


TEXT = "Выручка составила 8 600 млн руб. EBITDA 2 100 млн. Чистая прибыль 900 млн. Общий долг 6 000 млн. Денежные средства и их эквиваленты 500 млн. Процентные расходы 400 млн. Санкции и нарушение ковенант."


def test_report_text(spark):
    registry = spark.createDataFrame([("A", D("2023-12-31"), D("2024-03-01"), TEXT), ("B", None, None, None), ("C", None, None, "  ")], "ticker string, report_period_end date, publish_date date, report_text string")
    got = {r.ticker: r for r in documents.report_features(registry).collect()}
    a = got["A"]
    assert a.report_revenue == 8.6e9 and a.report_ebitda == 2.1e9 and a.report_net_debt_to_ebitda > 2
    assert a.report_sanctions_flag == 1 and a.report_covenant_flag == 1 and a.report_financial_pressure > 0
    assert a.report_revenue_evidence.startswith("Выручка")
    assert got["B"].parse_status == "missing_document" and got["C"].parse_status == "empty_text" and got["B"].report_revenue is None


def test_years_are_not_amounts(spark):
    df = spark.createDataFrame([("revenue for 2023 was 12 million, in the past 2020",)], "text string")
    assert documents.extract_metrics(df).first().report_revenue == 12e6


def test_no_report_leaks_from_the_future(spark):
    reports = spark.createDataFrame([("A", D("2024-03-01"), 1e9, 0.0, 1.0), ("A", D("2025-03-01"), 2e9, 1.0, 1.0)], "ticker string, publish_date date, report_revenue double, report_sanctions_flag double, report_document_available double")
    panel = spark.createDataFrame([(D(d), "A", "S") for d in ("2024-02-29", "2024-03-31", "2025-02-28", "2025-03-31")], "decision_date date, ticker string, sector string")
    got = asof_reports(panel, reports, ["report_revenue", "report_sanctions_flag"]).orderBy("decision_date").collect()
    assert [r.report_available for r in got] == [0.0, 1.0, 1.0, 1.0]
    assert [r.report_revenue for r in got] == [None, 1e9, 1e9, 2e9] and got[3].report_sanctions_flag == 1
    changed = reports.withColumn("report_revenue", F.when(F.col("publish_date") > "2025-01-01", 99.0).otherwise(F.col("report_revenue")))
    again = asof_reports(panel, changed, ["report_revenue", "report_sanctions_flag"]).orderBy("decision_date").collect()
    assert got[:3] == again[:3]


def test_asof_split_gives_the_same(spark):
    left = spark.createDataFrame([(i % 3, i * 7 % 100, i) for i in range(60)], "k int, t int, id int")
    right = spark.createDataFrame([(i % 3, i * 11 % 100, i if i % 4 else None) for i in range(40)], "k int, t int, v int")
    plain = asof_join(left, right, "k", "t", "t", {"v": "v"}, tie="v")
    dealt = asof_join(left, right, "k", "t", "t", {"v": "v"}, tie="v", split=F.floor(F.col("t") / 10))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, dealt.collect()), key=str)


def test_series_asof_carries_nulls(spark):
    left = spark.createDataFrame([(D("2024-01-05"),), (D("2024-01-01"),)], "decision_date date")
    series = spark.createDataFrame([(D("2024-01-02"), 1.0), (D("2024-01-04"), None)], "date date, x double")
    assert [r.x for r in asof_series(left, series).collect()] == [None, None]


def test_drift_and_quality(spark):
    rows = [("train", float(i)) for i in range(100)] + [("test", float(i)) for i in range(100, 200)]
    got = fit.drift_report(spark.createDataFrame(rows, "split string, x double"), ["x"], bins=5).first()
    assert got.psi > 0.5 and got.drift_warning
    keyed = spark.createDataFrame([("2024-01-31", "A", 1.0, 1.0, 1.0, 1.0)] * 2, "decision_date string, ticker string, " + ", ".join(f"{c} double" for c in forward.COMPONENTS))
    checks = {r.check: r.passed for r in quality.quality_report(keyed).collect()}
    assert checks["duplicate_keys"] is False and checks["dates"] is True
    assert {r.check: r.passed for r in quality.quality_report(keyed.drop("ticker")).collect()}["columns"] is False


def test_policy_and_vote(spark):
    rows = [(0.60, 0.30, 0.10), (0.20, 0.35, 0.45), (0.30, 0.40, 0.30)]
    df = spark.createDataFrame(rows, "p_low double, p_medium double, p_high double")
    assert [r.pred for r in models.apply_policy(df, 0.55, 0.40).collect()] == ["low", "high", "medium"]
    both = spark.createDataFrame([("low", 0.8, 0.1, 0.1, 0.4, 0.3, 0.3), ("high", 0.1, 0.1, 0.8, 0.3, 0.3, 0.4)], "y string, good_p_low double, good_p_medium double, good_p_high double, flat_p_low double, flat_p_medium double, flat_p_high double")
    best = models.ensemble_search(both, ["good", "flat"], 0.5).first()
    assert math.isclose(best.w_good + best.w_flat, 1.0)


def test_scores_of_nothing(spark):
    empty = spark.createDataFrame([], "y string, pred string")
    assert evaluate.confusion_matrix(empty).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Привет".encode() + b"\xff")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    assert [r.text for r in tables.text_documents(spark, str(tmp_path)).collect()] == ["Привет"]
    (tmp_path / "rates.xml").write_text('<ValCurs><Record Date="02.01.2024"><Nominal>10</Nominal><Value>905,5</Value></Record></ValCurs>')
    row = tables.fx_rates(spark, str(tmp_path / "rates.xml")).first()
    assert row.date == D("2024-01-02") and math.isclose(row.rate, 90.55)
    kind = spark.range(1).select(tables.file_type(F.lit("https://x.example.com/get?id=1"), F.lit("application/octet-stream"), F.lit(None).cast("string"), F.unhex(F.lit("255044462D31")))).first()[0]
    assert kind == ".pdf"
    with pytest.raises(tables.ContractError, match="close, value"):
        tables.require(spark.createDataFrame([], "date date, ticker string"), "daily_prices")


def test_links(spark):
    page = spark.createDataFrame([("https://x.example.com/a/b.html", '<A class="k" href="../ifrs%202024.pdf?x=1&amp;y=2" title="Annual"><b>Report</b></a> <a href=/p>p</a> "https:\\/\\/cdn.example.com\\/f.xlsx"')], "url string, html string")
    got = {(r.link, r.text) for r in links.extract_links(page).collect()}
    assert ("https://x.example.com/ifrs%202024.pdf?x=1&y=2", "Annual Report") in got and ("https://x.example.com/p", "p") in got
    assert any(x[0] == "https://cdn.example.com/f.xlsx" for x in got)


def test_no_python_in_plans(spark, sf_tiny):
    for name in ("b_daily_features", "t_target_components", "g13_report_features", "j2_keyed_asof", "s10_drift"):
        plan = QUERIES[name](spark, sf_tiny)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


QUICK = ["a8_columnar_json", "b_daily_features", "j1_macro_asof", "j2_keyed_asof", "j3_reports_asof", "t_target_components", "t10_labels", "e_derived_features", "e18_cross_sectional", "s2_walk_forward", "s10_drift", "q1_preprocess", "v2_scores", "m10_ensemble_search", "m13_policy_search", "g13_report_features", "g26_top_candidates"]


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("ALL_QUERIES") else QUICK)
def test_against_sql(spark, sf_tiny, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_tiny)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_tiny}/{f}'")
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if hasattr(x, "as_tuple") or isinstance(x, float) else x
    want = sorted((tuple(plain(x) for x in row) for row in found.fetchall()), key=repr)
    df = QUERIES[name](spark, sf_tiny)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want
