"""Plans and costs that must not grow with features, pairs or hits; and what they compute, by hand."""

import math
import random
import time
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import features
from tidemark.operators import documents, fit, rolling, stress
from tidemark.queries import scoring
from tidemark.sources import tables

D = date.fromisoformat


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def wide(spark, n):
    r = random.Random(n)
    rows = [(D("2024-01-31") if i % 7 else None, r.choice(["A", "B", None]), i % 5, *(r.choice([None, float("nan"), 1.0, r.random()]) for _ in range(n))) for i in range(120)]
    return rows, spark.createDataFrame(rows * 2, "decision_date date, sector string, tag int, " + ", ".join(f"f{i} double" for i in range(n))).repartition(3)


def test_ranks_of_many_features_take_two_exchanges(spark):
    counts = []
    for n in (2, 9):
        _, df = wide(spark, n)
        counts.append(exchanges(features.cross_sectional(df.cache(), [f"f{i}" for i in range(n)])))
    assert counts[0] == counts[1] <= 2


def test_ranks_by_hand(spark):
    rows, df = wide(spark, 2)
    got = features.cross_sectional(df, ["f0", "f1", "absent"]).collect()
    assert len(got) == len(rows) * 2 and "absent_cs_rank" not in got[0]
    plain = lambda v: None if v is None or math.isnan(v) else v
    for g in got:
        for j, c in enumerate(("f0", "f1")):
            x, all_ = plain(g[c]), [plain(row[3 + j]) for row in rows * 2 if row[0] is not None]
            all_ = [v for v in all_ if v is not None]
            if x is None or g.decision_date is None:
                assert g[f"{c}_cs_rank"] is None
            else:
                assert math.isclose(g[f"{c}_cs_rank"], (sum(v < x for v in all_) + (all_.count(x) + 1) / 2) / len(all_))
            own = [plain(row[3 + j]) for row in rows * 2 if row[0] is not None and row[1] == g.sector]
            own = [v for v in own if v is not None]
            want = (x - np.mean(own)) / np.std(own, ddof=1) if x is not None and g.decision_date is not None else 0.0
            assert math.isclose(g[f"{c}_sector_z"], want, abs_tol=1e-9)
    assert sorted(map(str, df.collect())) == sorted(str(r) for r in features.cross_sectional(df, ["f0"]).select(*df.columns).collect())


def test_shares_of_many_components_take_two_exchanges_more(spark):
    rows = [(i, *(random.Random(i * 9 + j).choice([None, 1.0, float(i)]) for j in range(6))) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{j} double" for j in range(6))).repartition(3).cache()
    one, six = (exchanges(fit.ecdf_rank(df, df.filter("i < 100"), [f"c{j}" for j in range(n)])) for n in (1, 6))
    assert one == six
    for r in fit.ecdf_rank(df, df.filter("i < 100"), [f"c{j}" for j in range(6)]).collect():
        for j in range(6):
            train = [row[1 + j] for row in rows[:100] if row[1 + j] is not None]
            assert r[f"c{j}_rank"] == (None if r[f"c{j}"] is None else sum(v <= r[f"c{j}"] for v in train) / len(train))


@pytest.mark.parametrize("tile,block", [(128, 21), (3, 4), (1, 1)])
def test_mean_correlation_of_pairs(spark, tile, block):
    r = random.Random(1)
    days = [D("2024-01-01") + timedelta(days=i) for i in range(45)]
    rows = [(t, d, 5.0 if t == "flat" else 50 + 40 * r.random()) for t in ("a", "b", "c", "d", "e", "flat") for d in days if r.random() < 0.93]
    daily = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = {x.date: x.market_corr_60d for x in rolling.market_correlation(daily, window=12, least=6, tile=tile, block=block).collect()}
    close = {(t, d): c for t, d, c in rows}
    ret = {(t, i): close[t, days[i]] / close[t, days[i - 1]] - 1 for t in "abcde" for i in range(1, 45) if (t, days[i]) in close and (t, days[i - 1]) in close}
    for i, d in enumerate(days):
        found = []
        for n, a in enumerate("abcde"):
            for b in "abcde"[n + 1 :]:
                common = [j for j in range(i - 11, i + 1) if (a, j) in ret and (b, j) in ret]
                if len(common) >= 6:
                    found.append(np.corrcoef([ret[a, j] for j in common], [ret[b, j] for j in common])[0, 1])
        assert (got[d] is None) == (not found) and (not found or math.isclose(got[d], np.mean(found), abs_tol=1e-9))


def test_no_row_of_a_pair_is_exchanged(spark):
    r = random.Random(2)
    rows = [(f"t{t}", D("2024-01-01") + timedelta(days=i), 50 + r.random()) for t in range(40) for i in range(50)]
    df = rolling.market_correlation(spark.createDataFrame(rows, "ticker string, date date, close double"), window=10, least=5, tile=16)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "_di#" in plan
    assert df.filter("market_corr_60d is not null").count() == 45


def test_fingerprints_tell_rows_apart(spark):
    mark = lambda *rows: tuple(tables.fingerprint(spark.createDataFrame(list(rows), "a string, b string"), ["a", "b"]).first())
    assert mark(("a|b", "c")) != mark(("a", "b|c")) and mark((None, "x")) != mark(("~", "x")) and mark((None, "x")) != mark(("-", "x"))
    assert mark(("1:a", None)) != mark(("", "1:a-")) and mark(("", None)) != mark((None, ""))
    assert mark(("x", "y"), ("z", None)) == mark(("z", None), ("x", "y"))
    assert mark(("x", "y"), ("x", "y")) != mark() and mark(("x", "y"), ("x", "y"))[1] != "0"
    assert len({x for m in (mark(("x", "y")), mark(("y", "x"))) for x in m[1:]}) == 4


def test_windows_are_found_in_long_texts_as_in_short_ones(spark):
    r = random.Random(3)
    filler = lambda n: "".join(r.choice("абв xyz\n😀") for _ in range(n))
    texts = []
    for _ in range(25):
        parts = [filler(r.randint(0, 900)) + r.choice(["EBITDA 12", "ebitda: (3,5) million", "EBITDA", "7 EBITDA 2020 bn", " 1 234 "]) for _ in range(r.randint(0, 9))]
        texts.append(filler(r.randint(0, 2100)) + "".join(parts))
    texts += ["", "EBITDA", "a" * 2047 + "EBITDA 5 million", "a" * 2048 + "EBITDA 5", "1 EBITDA" + "b" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", documents.keyword_hits(F.col("t"), "EBITDA").alias("hits"), documents.candidates_after(F.col("t"), "EBITDA").alias("after"), documents.candidates_before(F.col("t"), "EBITDA").alias("before")).collect()
    import re

    for x in got:
        t = texts[x.i]
        places = [(m.start(), m.end()) for m in re.finditer("ebitda", t, re.I)]
        assert [(h.start, h.start + h.size) for h in x.hits] == places
        evidence = [t[max(0, a - 80) : a + 260].strip(" ") for a, _ in places]
        assert {c.evidence for c in x.after} <= set(evidence)
        assert all(re.search(r"\d", t[b : b + 260]) for a, b in places if t[max(0, a - 80) : a + 260].strip(" ") in {c.evidence for c in x.after})
        assert {c.evidence for c in x.before} <= {t[max(0, a - 180) : b + 80].strip(" ") for a, b in places}


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        sizes = [random.Random(n).randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(sizes,)], "a array<int>").select(documents.running_sums(F.col("a"))).first()[0]
        assert got == [sum(sizes[:i]) for i in range(n)]


def test_twenty_thousand_hits_in_one_text(spark):
    def seconds(n):
        df = spark.createDataFrame([("EBITDA 5 million and more words. " * n,)], "text string").cache()
        df.count()
        start = time.time()
        row = documents.extract_metrics(df, metrics={"report_ebitda": ["EBITDA"]}).first()
        assert row.report_ebitda == 5e6
        return time.time() - start

    seconds(10)
    few, many = seconds(2500), seconds(20_000)
    assert many < 24 * max(few, 0.5)


def test_stress_panel(spark):
    rows = [("A", D("2024-01-31"), 0.5, 1.0, 2.0), ("B", D("2024-01-31"), None, None, 2.0), ("C", D("2024-01-05"), float("nan"), 0.0, None), ("D", D("2024-02-29"), 0.1, 0.0, 2.0), ("E", None, 9.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "ticker string, decision_date date, report_financial_pressure double, report_sanctions_flag double, future_cvar_95 double")
    got = {r.ticker: r for r in stress.stress_adjusted(df).collect()}
    assert {k: r.stress_rank for k, r in got.items()} == {"A": 1.0, "B": 0.5, "C": 0.5, "D": 1.0, "E": 0.0}
    assert math.isclose(got["A"].future_cvar_95, 2 * 1.22) and math.isclose(got["B"].future_cvar_95, 2 * 1.11) and got["C"].future_cvar_95 is None and got["E"].future_cvar_95 == 2.0


def test_stress_takes_the_last_of_a_days_reports(spark, tmp_path, monkeypatch):
    """Ids 2,300 apart are published on one day by one ticker; the greatest wins, however the rows are stored (as in the SQL)."""
    panel = spark.createDataFrame([("Brand#2", D("1995-05-31"))], "ticker string, decision_date date")
    monkeypatch.setattr(scoring, "components", lambda spark, sf: panel)
    ids = (1, 4601, 9201)
    for turn in range(len(ids)):
        docs = spark.createDataFrame([(i, 10) for i in ids[turn:] + ids[:turn]], "doc_id long, n_chars long").coalesce(1)
        docs.write.parquet(f"{tmp_path}/{turn}/documents.parquet")
        row = scoring._stressed(spark, f"{tmp_path}/{turn}").first()
        assert row.report_covenant_flag == 1.0


def test_report_text_is_prepared_once(spark):
    """Below a condition Spark shares no expressions: each count once lower-cased the text anew."""
    df = spark.createDataFrame([("A", None, None, "revenue 5 million")], "ticker string, report_period_end date, publish_date date, report_text string")
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = documents.report_features(df)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count("lower(") <= 2


def test_patterns_are_looked_for_where_their_literals_are(spark):
    """Letters of other case, also such whose lower case is another letter, are found as by the patterns alone."""
    assert documents.literal(r"long[-\s]?term\s+debt") == "long" and documents.literal(r"finance\s+costs?") == "finance" and documents.literal(r"чист\w+\s+прибыл\w+") == "прибыл"
    assert documents.literal(r"a+b?cd*e{2}") == documents.literal("ab|cd") == documents.literal(r"\x41bc") == "" and documents.literal("xa+bc?d") == "xa"
    texts = ["SANCTIONS and ſanction, sanctıon, SANCTİON", "СанКциᲀ ᲃанкции САНКЦИИ", "IMPAIRMENT  of a LİTİGATION, Going\t  Concern", "risK: MARKET ACCESS, lower  demand", "none", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_replace(F.translate("text", " \t", "  "), " +", " ")
    for name, patterns in documents.SIGNALS.items():
        want = sum((F.regexp_count(F.lower(plain), F.lit("(?iuU)" + p)) for p in patterns), F.lit(0)).cast("double")
        rows = df.select(want.alias("want"), documents.signal_counts(F.col("text"))[f"report_{name}_count"].alias("got"), documents.normalise(F.col("text")).alias("a"), plain.alias("b")).collect()
        assert all(r.want == r.got and r.a == r.b for r in rows), name
    amounts = spark.createDataFrame([("DİVİDENDS 5 million",), ("dıvıdendſ 5 million",), ("ДИᲀИДЕНДЫ 5 млн",), ("profits 5 million",)], "text string")
    assert [r.report_dividends for r in documents.extract_metrics(amounts).collect()] == [5e6, 5e6, 5e6, None]
