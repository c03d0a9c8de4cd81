"""Operator 5 against a full scan."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import topk


def brute(rows, k, every):
    bits = None
    good = []
    for i, v in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        bits = bits or len(v)
        if len(v) == bits:
            good.append((i, tuple(x is not None and x > 0 for x in v)))
    good = sorted(set(good))
    out = []
    for i in sorted({i for i, _ in good if i % every == 0}):
        best = {}
        for c in (c for j, c in good if j == i):
            for j, d in good:
                if j != i:
                    n = sum(x != y for x, y in zip(c, d))
                    best[j] = min(best.get(j, n), n)
        out += [(i, n + 1, j, d) for n, (d, j) in enumerate(sorted((d, j) for j, d in best.items())[:k])]
    return sorted(out)


def check(spark, rows, k=10, every=10):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = topk.nearest(df, F.col("vec_id") % every == 0, k)
    assert sorted((r.query_id, r["rank"], r.neighbor_id, r.distance) for r in got.collect()) == brute(rows, k, every)


def test_random_and_clustered(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + r.normal(size=64) * (0.3 if i % 2 else 1.5)).astype(float).tolist()) for i in range(600)]
    check(spark, rows)


def test_hot_vector_ties_nulls_lengths(spark):
    r = np.random.default_rng(2)
    hot = r.normal(size=16).tolist()
    rows = [(i, hot if i % 3 == 0 else r.normal(size=16).tolist()) for i in range(120)]
    rows += [(500, None), (None, hot), (501, []), (510, [1.0, 2.0]), (30, hot), (520, [float("nan")] * 16), (530, [None] * 16)]
    check(spark, rows, k=5)


def test_wide_codes_and_few_rows(spark):
    r = np.random.default_rng(3)
    check(spark, [(i, r.normal(size=150).tolist()) for i in range(40)], k=60)
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.nearest(df, F.col("vec_id") % 10 == 0).count() == 0


def test_index_gives_every_pair_once():
    r = np.random.default_rng(4)
    codes, queries = r.integers(0, 1 << 20, (300, 1)), r.integers(0, 1 << 20, (9, 1))
    index = topk.MultiIndex(codes, 20)
    query = [topk._values(queries, lo, hi) for lo, hi in index.cuts]
    seen = {}
    for radius in range(21):
        for segment, (lo, hi) in enumerate(index.cuts):
            for q, c, d in index.found(query, segment, radius) if radius <= hi - lo else ():
                for pair, n in zip(zip(q.tolist(), c.tolist()), d.tolist()):
                    assert pair not in seen and n == (int(queries[pair[0], 0]) ^ int(codes[pair[1], 0])).bit_count()
                    seen[pair] = n
            # what is covered has been found
            reach = len(index.cuts) * radius + segment
            near = np.bitwise_count(queries ^ codes[:, 0]) <= reach
            assert all((q, c) in seen for q, c in np.argwhere(near).tolist())
    assert len(seen) == 9 * 300


def test_near_codes_end_a_search_early():
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 60, 200)
    codes = np.unique(np.concatenate([centres ^ (1 << r.integers(0, 60, 200)) for _ in range(20)]))[:, None]
    index = topk.MultiIndex(codes, 60)
    ids, bounds = np.arange(len(codes)), np.arange(len(codes) + 1)
    q, d, i = index.nearest(centres[:, None], ids, bounds, 5)
    assert len(q) == 1000 and (d <= 2).all() and index.verified < len(codes) * 200 / 20


def test_id_with_several_codes(spark):
    rows = [(i, [float((i * 7 + j * j) % 5 - 2) for j in range(8)]) for i in range(40)] + [(i, [float((i + j) % 3 - 1) for j in range(8)]) for i in range(0, 40, 2)]
    check(spark, rows, k=6)
