"""Operator 2 against all pairs, and its parts."""

import itertools
import random
import re

import numpy as np

from tidemark.llm import near_dedup
from tidemark.llm.common import WORD_PATTERN
from tidemark.llm.graph import connected_components


def shingles(text):
    w = re.findall(WORD_PATTERN, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) >= threshold * len(a | b):
            parent[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return {k: min(x for x in g if x is not None) for g in groups.values() for k in g}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 150))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append((", " if r.random() < 0.2 else " ").join(copy))
        shared = base[: len(base) // 2] + [r.choice(vocabulary) for _ in range(len(base) // 2)]
        texts.append(" ".join(shared))
    texts += ["", None, "!!", "!!", "??", "one two", "One, two", "one three"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def test_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, class_id int, node string")
        got = near_dedup.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.class_id for x in got} == {0} and {x.class_size for x in got} == {400}


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None), (4, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or -1, x.class_id) for x in got) == [(-1, 3), (-1, 7), (3, 3), (4, 3), (7, 7), (7, 7)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probability_jaccard():
    r = np.random.default_rng(2)
    n = 400
    w = r.uniform(1, 4, (2, n))
    w[0, :100] = 0
    w[1, 300:] = 0
    row, at = np.nonzero(w)
    element = near_dedup.mix64(np.arange(n, dtype=np.uint64))[at]
    marks = near_dedup.prob_min_hash(row, element, w[row, at], 2, 4096)
    both = (w[0] > 0) & (w[1] > 0)
    want = sum(1 / np.maximum(w[0] / w[0, i], w[1] / w[1, i]).sum() for i in np.flatnonzero(both))
    assert abs((marks[0] == marks[1]).mean() - want) < 0.03


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, 1001 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}


def test_repetition_does_not_part_equal_sets(spark):
    r = random.Random(8)
    rows = []
    for i in range(60):
        u, v = ([f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(2))
        rows += [(2 * i, " ".join(u + v)), (2 * i + 1, " ".join(u + v * 20))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=6).collect()
    assert {x.doc_id: x.class_id for x in got} == {i: i - i % 2 for i in range(120)}


def test_pairs_inside_a_large_bucket(spark):
    # 150 pairs edited from one base; pairs are near copies, others are not; one register makes the buckets large
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(150):
        text = list(base)
        for j in r.sample(range(200), 8):
            text[j] = f"x{i}-{j}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:-1] + [f"y{i}"]))]
    assert not any(len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) for (_, a), (_, b) in itertools.combinations(rows[::2], 2))
    row, h, _, _, _ = near_dedup.shingle_sets(*near_dedup.utf8(near_dedup.pa.array([t for _, t in rows])), 5)
    mark = near_dedup.prob_min_hash(row, h, np.ones(len(h)), len(rows), 1)[:, 0]
    assert np.bincount(np.unique(mark, return_inverse=True)[1]).max() > near_dedup.SMALL_LATER
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=1).collect()}
    assert got == {i: i - i % 2 if mark[i] == mark[i - i % 2] else i for i in range(300)}


def test_links_in_crowded_buckets(spark):
    # pages of one template: each is 0.76 to the others, but two by two they are 0.82
    r = random.Random(10)
    base = [f"w{r.randrange(10**6)}" for _ in range(260)]
    rows = []
    for i in range(300):
        own = [f"p{i}x{j}" for j in range(12)]
        for half in range(2):
            rows.append((2 * i + half, " ".join([*base, *own, *(f"q{i}x{half}x{j}" for j in range(26))])))
    a, b, c = (shingles(t) for _, t in rows[:3])
    assert len(a & b) >= 0.8 * len(a | b) and len(a & c) < 0.8 * len(a | c)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=128).collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_spanning_links_are_those_of_all_pairs():
    r = np.random.default_rng(11)
    base = r.integers(0, 2**32, 60).astype(np.uint32)
    prints = [np.unique(np.concatenate([base[r.random(60) < 0.9], r.integers(0, 2**32, 4).astype(np.uint32)])) for _ in range(40)]
    node, component = np.arange(40) + 100, np.where(np.arange(40) < 10, 100, np.arange(40) + 100)
    for side in (np.zeros(40, np.int64), np.arange(40) % 2):
        def classes(links):
            name = {int(n): int(c) for n, c in zip(node, component)}
            for x, y in links:
                low, high = sorted((name[x], name[y]))
                name = {n: low if c == high else c for n, c in name.items()}
            return name
        alike = [(i, j) for i, j in itertools.combinations(range(40), 2) if len(set(side)) == 1 or side[i] != side[j]]
        alike = [(100 + i, 100 + j) for i, j in alike if len(np.intersect1d(prints[i], prints[j])) >= 0.8 * len(np.union1d(prints[i], prints[j]))]
        got = near_dedup.spanning_links(node, component, prints, side, 0.8)
        assert len(got) < 40 and classes(got) == classes(alike)


def test_near_copies_with_null_or_equal_ids(spark):
    r = random.Random(12)
    text = [f"w{r.randrange(10**6)}" for _ in range(100)]
    other = [f"w{r.randrange(10**6)}" for _ in range(100)]
    rows = [(None, " ".join(text)), (None, " ".join(text + ["x"])), (4, " ".join(other)), (4, " ".join(other + ["x"])), (5, "z" * 10)]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, row int, node string")
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((x.doc_id or 0, x.class_id or 0, x.class_size) for x in got) == [(0, 0, 2), (0, 0, 2), (4, 4, 2), (4, 4, 2), (5, 5, 1)]
    kept = near_dedup.one_of_each_class(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 4, 5]


def test_long_text(spark):
    r = random.Random(13)
    text = [f"w{r.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(text)), (2, " ".join(text[:-100])), (3, "short")]
    assert {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 3}


def test_colliding_names_lose_no_row(spark):
    """Names of one byte: hundreds of texts share each."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(30)) for _ in range(400)] + ["", "!", "?"]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.class_id, x.class_size) for x in near_dedup.near_duplicates(df, node_bytes=1).collect()}
    assert got == {i: (i % len(texts), 2) for i in range(len(rows))}
    kept = near_dedup.one_of_each_class(df, node_bytes=1).collect()
    assert sorted(x.doc_id for x in kept) == list(range(len(texts)))


def test_rows_with_maps_are_known_by_them(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, {"a": 1}), (1, text, {"a": 2}), (2, "other words " * 9, {"a": 1}), (2, "other words " * 9, {"a": 1})]
    kept = near_dedup.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")).collect()
    assert sorted(x.doc_id for x in kept) == [1, 2]
