"""Operator 12 against a plain Merkle tree."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest int, block int, place int"


def encode(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def reduce(nodes, fan_out):
    """All levels of the tree over nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([manifest.sha("".join(levels[-1][i : i + fan_out])) for i in range(0, len(levels[-1]), fan_out)])
    return levels


def siblings(levels, i, fan_out):
    found = []
    for nodes in levels[:-1]:
        a = i - i % fan_out
        found.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + fan_out])))
        i //= fan_out
    return found


def brute(rows, fan_out, later):
    """Sorted result rows for (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, manifest.sha(encode(r)), manifest.sha(encode((*r[:4], later(r))))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: reduce([x[2] for x in sorted(groups[g])], fan_out) for g in names}
    top = reduce([trees[g][-1][0] for g in names], fan_out)
    out = []
    for k, g in enumerate(names):
        for i, (has, doc_id, leaf, changed) in enumerate(sorted(groups[g])):
            way = siblings(trees[g], i, fan_out) + siblings(top, k, fan_out)
            folded = changed
            for a, b in way:
                folded = manifest.sha(a + folded + b)
            out.append((doc_id if has else None, leaf, trees[g][-1][0], top[-1][0], manifest.sha("".join(a + b for a, b in way)), folded, folded == top[-1][0], way))
    return sorted(out, key=repr)


def table(seed, n):
    r = random.Random(seed)
    texts = [None, "", "Plain", "low", "ÄÖÜ Z", "a|b", "1:a-", "X" * 70_000]
    rows = [(i * 3 + 2**60, r.choice(["src0", "src0", None, "", "ä", "b"]), r.choice([None, "en"]), r.choice([None, 5]), r.choice(texts)) for i in range(n)]
    rows += [(None, "src0", None, None, "Same")] * 40 + [(7, "lone", "en", 1, "One")] + [(8, f"s{i}", None, 3, "T") for i in range(30)] + rows[:5]
    return rows


@pytest.mark.parametrize("fan_out,levels", [(16, 3), (2, 1), (3, 2)])
def test_leaves_proofs_and_folds(spark, fan_out, levels):
    rows = table(fan_out, 150)
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    later = lambda r: r[4].translate({c: c + 32 for c in range(65, 91)}) if r[4] is not None and r[0] and r[0] % 2 == 0 else r[4]
    lower = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = manifest.merkle_manifest(docs, changed={"text": lower}, fan_out=fan_out, levels=levels, proofs=True).collect()
    want = brute(rows, fan_out, later)
    assert sorted([(*r[:7], [tuple(x) for x in r.proof]) for r in got], key=repr) == want
    assert {x[6] for x in want} == {True, False}


def test_unchanged_rows_verify_and_any_changed_field_does_not(spark):
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in table(5, 60)], SCHEMA)
    same = manifest.merkle_manifest(docs)
    assert same.filter("verified").count() == docs.count() and same.select("root").distinct().count() == 1
    assert not manifest.merkle_manifest(docs, changed={"lang": F.lit("xx")}).filter("verified").count()
    moved = manifest.merkle_manifest(docs.withColumn("n_chars", F.coalesce("n_chars", F.lit(0)) + 1))
    assert moved.first().root != same.first().root


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "a", None, None, None, "x", 1, 2, 3)], SCHEMA)
    assert manifest.merkle_manifest(docs.limit(0)).collect() == []
    one = manifest.merkle_manifest(docs).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == manifest.sha("1:11:a---") and one.proof_sha256 == manifest.sha("")


def test_fields_have_one_encoding():
    assert encode(["a", "-"]) != encode(["a-", None]) and encode([None, "-"]) != encode(["-", None])
    assert manifest.unpack(manifest.pack([("ab" * 32, ""), ("", "cd" * 64), ("", "")])) == [("ab" * 32, ""), ("", "cd" * 64), ("", "")]
