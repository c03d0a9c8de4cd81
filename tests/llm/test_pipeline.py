"""The corpus pipeline, stage by stage, against brute force on a small table."""

import random

import corpus_pipeline
from tests.llm.test_near_dedup import brute as classes
from tests.llm.test_scans import brute_hits
from tests.llm.test_suffix_dedup import brute as repeats


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioutnrs") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, leak = text(30), text(12)
    rows = [(i, text(r.randint(5, 120)), "en", "s", 1) for i in range(40)]
    rows += [(40, rows[3][1], "en", "s", 1), (41, rows[3][1] + " more", "en", "s", 1), (42, text(20) + " " + shared, "en", "s", 1), (43, shared + " " + text(20), "en", "s", 1)]
    rows += [(44, text(10) + " " + leak, "en", "s", 1), (45, None, "en", "s", 1), (46, "12 !!", None, "s", 1), (47, "", "en", "s", 1), (48, text(9), None, "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = []
    for name in ("language_id", "near_duplicates", "suffix_dedup", "decontamination"):
        docs = stages[name](spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({x.doc_id: x.text for x in docs.collect()})
    assert set(kept[0]) == set(range(49)) - {45, 46, 47}
    same = classes([(i, t) for i, t in kept[0].items()])
    assert set(kept[1]) == {i for i in kept[0] if same[i] == i}
    pairs = sorted(kept[1].items())
    for (i, t), (n, gone, _, _) in zip(pairs, repeats(pairs, 50)):
        assert len(kept[2][i].encode()) == n - gone if i in kept[2] else gone
    assert set(kept[3]) == {i for i, t in kept[2].items() if not brute_hits(t, [(1, leak)])[4]}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(kept[3])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_nulls_ties_and_long_texts(spark, tmp_path):
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("aeioutnrs") for _ in range(r.randint(2, 8))) for _ in range(n))
    long = text(200_000)
    extra = ["score", "Contaminated", "n_removed", "kept_text", "lang_pred", "input_score", "spans", "piece", "row", "node", "item_ids", "_y"]
    rows = [(i, text(60), "en", "s", 1) for i in range(20)]
    rows += [(None, rows[0][1] + " more", "en", "s", 1), (None, text(50), None, "s", 1), (20, long, "en", "s", 1), (21, long + " end", "en", None, 1), (22, rows[1][1], "en", "s", 1), (1, rows[1][1], "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(*x, *(f"{c}{x[0]}" for c in extra)) for x in rows], schema)
    spark.createDataFrame([(1, rows[2][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.schema.simpleString() == docs.schema.simpleString()
        docs = now
    got = docs.collect()
    assert sorted(x.doc_id if x.doc_id is not None else -1 for x in got) == [-1, *(i for i in range(21) if i != 2)]
    assert all(x[c] == f"{c}{x.doc_id}" for x in got for c in extra)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {x.doc_id for x in packed.collect()} == {x.doc_id for x in got}
