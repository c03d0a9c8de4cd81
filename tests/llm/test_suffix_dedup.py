"""Operator 8 against brute force over all byte strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import remove_repeats, suffix_order


def brute(rows, window):
    least = {}
    raw = [((i if i is not None else 2**63 - 1), (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if least[b[p : p + window]] < i:
                gone[p : p + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["the", "of", "tion", "éà", "ing", "er", "an", "b", "ñ", "ou"]
    passage = [" ".join(r.choice(words) for _ in range(30)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 4))]
        if r.random() < 0.6:
            parts.insert(r.randint(0, len(parts)), r.choice(passage)[r.randint(0, 20) :])
        rows.append((i, "".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 300), (n + 3, "xx" + "a" * 200 + "yy"), (n + 4, rows[3][1]), (n + 5, rows[3][1]), (5, rows[5][1]), (None, rows[4][1] + "tail"), (n + 6, "ab" * 120), (n + 7, "ba" * 90)]
    r.shuffle(rows)
    return rows


def check(spark, rows, window=50, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_bytes string, _group int")
    got = remove_repeats(docs, window=window, **options).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got)
    want = sorted((i is None, i or 0, x) for (i, _), x in zip(rows, brute(rows, window)))
    assert got == want


def test_brute_force(spark):
    for seed in (1, 2):
        check(spark, texts(seed), bucket_bytes=1 << 12, group_bytes=1 << 12)


def test_other_window(spark):
    check(spark, texts(3), window=37)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_ids_with_other_texts(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    check(spark, [(1, passage), (2, "a" + passage), (2, passage + "b"), (2, "c" * 80)])


def test_kept_text(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, passage), (2, "before " + passage + " after")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in remove_repeats(docs, kept_text=True).collect()} == {1: passage, 2: "before after".replace(" a", "  a")[:7] + " after"}


def test_suffix_order():
    r = np.random.default_rng(1)
    for _ in range(20):
        text = r.integers(97, 99, 400).astype(np.uint8)
        text[100:200] = text[200:300]
        at = np.sort(r.choice(350, 300, replace=False))
        order = suffix_order(text, at, 50)
        heads = [bytes(text[p : p + 50]) for p in at[order]]
        assert heads == sorted(heads)


def test_suffix_order_keeps_every_place_of_repeats_longer_than_the_window():
    r = np.random.default_rng(5)
    for _ in range(60):
        text = r.integers(97, 123, 1500).astype(np.uint8)
        for size, a, b in zip(r.integers(50, 120, 20), r.integers(0, 1380, 20), r.integers(0, 1380, 20)):
            text[a : a + size] = text[b : b + size].copy()
        at = np.arange(1450)
        order = suffix_order(text, at, 50)
        assert sorted(order.tolist()) == at.tolist()
        suffixes = [bytes(text[p:]) for p in order]
        assert suffixes == sorted(suffixes)


def pieces(seed, alphabet, n=120):
    """Texts of overlapping pieces of one text, longer than the window, with some letters in between."""
    r = random.Random(seed)
    base, rows = "".join(r.choice(alphabet) for _ in range(3000)), []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 12)):
            a = r.randrange(len(base))
            parts += [base[a : a + r.randint(20, 160)], "".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) if r.random() < 0.4 else ""]
        rows.append((i, "".join(parts)))
    return rows


def test_brute_force_on_overlapping_pieces(spark):
    check(spark, pieces(2, "abcdefghij klmnop"))
    check(spark, pieces(3, "aé\0z"), bucket_bytes=1 << 13, group_bytes=1 << 13)


def test_cover_is_complete():
    assert (suffix_dedup._OFFSET < suffix_dedup.PERIOD).all()


def decisions(texts, buckets, groups):
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    found = pa.Table.from_batches(list(suffix_dedup._emit(50, buckets, groups)(iter([batch.slice(0, len(texts) // 2), batch.slice(len(texts) // 2)]))))
    return pa.concat_tables([suffix_dedup._resolve(buckets, groups)(found.filter(pc.equal(found.column("key"), k))) for k in sorted(set(found.column("key").to_pylist()))])


def test_short_common_strings_do_not_make_runs_mixed():
    """All texts share 24 bytes, so their runs share buckets; none can share a window, and no bytes need be sorted."""
    r = random.Random(7)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [letters(60) + " terms and conditions of " + letters(60) for _ in range(200)]
    assert not any(decisions(texts, 2, 4).column("mixed").to_pylist())
    window = "one two three four five six seven eight nine ten 1"
    assert len(window) == 50 and any(decisions([t[:40] + window + t[-40:] for t in texts[:2]], 2, 4).column("mixed").to_pylist())


def test_small_blocks_cost_little():
    """Blocks number buckets times groups: with a group for each text they hold one entry or two."""
    r = random.Random(8)
    passage = " ".join(str(r.random()) for _ in range(20))
    out = decisions([f"{i} {passage[i % 50 :]}" for i in range(400)], 3, 400)
    assert out.num_rows > 300 and out.nbytes < 400 * out.num_rows


def test_brute_force_on_strings_that_occur_twice_in_a_window(spark):
    """The string that names a bucket may then be meant in two places of a window."""
    r = random.Random(9)
    parts = []
    for _ in range(40):
        motif = "".join(r.choice("abcdefgh") for _ in range(r.randint(16, 30)))
        parts.append(motif + "".join(r.choice("xy") for _ in range(r.randint(0, 3))) + motif[: r.randint(14, 30)])
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.9 else r.choice("pqrs") * r.randint(1, 60) for _ in range(r.randint(1, 8)))) for i in range(150)]
    check(spark, rows)
    check(spark, rows, window=24, bucket_bytes=1 << 12, group_bytes=1 << 12)
