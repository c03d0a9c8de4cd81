"""Operator 11 against brute force over all periods."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import queries, runs

SCHEMA = "doc_id long, text string, runs string, n_words int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(text, min_length=6, min_exponent=4):
    """Runs (start, length, period) and the collapsed text, by comparing all words at all distances."""
    w, found = words_of(text), {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    listed = sorted((a, b - a, q) for (a, b), q in found.items())
    dropped = {i for a, n, q in listed for i in range(a + q, a + n)}
    return sorted(listed, key=lambda x: (x[0], x[2])), " ".join(x for i, x in enumerate(w) if i not in dropped)


def texts(seed):
    r = random.Random(seed)
    out = [None, "", " \t\n", "one", "a " * 400, "a b " * 300, "\x0ba\x0cb\x1cc", "ä ö " * 9 + "x", "a a a a a", "a a a a a a", "a b c " * 200 + "a b x " + "a b c " * 50]
    for _ in range(150):
        alphabet = [r.choice("abé日") * r.randint(1, 4) for _ in range(r.randint(1, 4))]
        parts = []
        for _ in range(r.randint(1, 5)):
            unit = [r.choice(alphabet) for _ in range(r.randint(1, 40))]
            parts += (unit * r.randint(1, 9))[: r.randint(1, 300)]
        out.append("".join(w + r.choice([" ", "\n", " \t"]) for w in parts))
    return out


@pytest.mark.parametrize("min_length,min_exponent", [(6, 4), (1, 2), (9, 3)])
def test_runs_and_collapsed_texts(spark, min_length, min_exponent):
    rows = [(i if i % 17 else None, t, "x", i) for i, t in enumerate(texts(1))] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = runs.periodic_runs(df, keep=("n_words", "runs"), min_length=min_length, min_exponent=min_exponent).collect()
    assert len(got) == len(rows)
    for r in got:
        doc_id, text, _, n = rows[r.input_n_words]
        assert r.doc_id == doc_id and r.n_words == len(words_of(text)) and r.input_runs == "x"
        assert ([tuple(x) for x in r.runs], r.collapsed) == brute(text, min_length, min_exponent), text
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_words_appended_one_by_one_give_the_same_runs(monkeypatch):
    blob = [t.encode() if t else b"" for t in texts(2)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])])
    data = np.frombuffer(b"".join(blob), np.uint8)
    whole = runs.text_runs(data, offsets)[3]
    monkeypatch.setattr(runs, "STRETCH", 7)
    assert runs.text_runs(data, offsets)[3] == whole
    monkeypatch.setattr(runs, "STRETCH", 1)
    short = np.flatnonzero(np.diff(offsets) < 400)[:12]
    some = [blob[i] for i in short]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in some])])
    data = np.frombuffer(b"".join(some), np.uint8)
    one = runs.text_runs(data, offsets)[3]
    monkeypatch.setattr(runs, "STRETCH", 1 << 17)
    assert one == runs.text_runs(data, offsets)[3] and one


def test_equal_hashes_of_different_words_are_told_by_their_bytes(monkeypatch):
    monkeypatch.setattr(runs, "span_hashes", lambda blob, s, e: np.zeros(len(s), np.uint64))
    for text in ("ab cd " * 30 + "x ab", "a b c d e f g h", "aa bb cc " * 20 + "zz " * 7):
        data = text.encode()
        got = runs.text_runs(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[3]
        want = brute(text)[0]
        assert [x for x in got if x[1:] == want[-1][1:]] if want else not got


def test_very_long_text_of_few_words():
    data = ("x " * 300_000 + "a b c " * 100_000 + "q").encode()
    got = runs.text_runs(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[3]
    assert got == [(0, 300_000, 1), (300_000, 300_000, 3)]


def test_query_on_null_ids_and_texts(spark, tmp_path):
    rows = [(None, "a b " * 5, "x", 1), (1, None, "x", 1), (1, "a " * 7, "x", 1)] + [(i, "w%d x y z " % i * 6, "x", 1) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and [r.n_runs for r in got if r.doc_id is None] == [1]
    assert all(r.runs_sha256 and r.collapsed_sha256 and (r.n_runs > 0) == (r.start is not None) for r in got)
