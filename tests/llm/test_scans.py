"""Operators 1, 3, 4, 6, 7 and 9 against brute force, the libraries, and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import decontaminate, language, licenses, packing, quality, queries, tokens
from tidemark.llm.common import WORD_PATTERN

ODD = [None, "", " ", "!!", "ÄÖÜ", "a" * 3000, "tab\there", "İstanbul ǅ", "\x00nul", "ﬁ ½ ² é", "<|endoftext|> x <s>", "日本語 テキスト"]


def split(text):
    return re.findall(WORD_PATTERN, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def frame(spark, texts, more="lang string, n_words int"):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], f"doc_id long, text string, {more}")


def test_licenses(spark):
    texts = [*ODD, "Released under the MIT License.", "licensed under the terms of the GNU General Public License, version 3", "Licensed under CC BY-NC 4.0.", "Copyright (c) 2020 Some Body. All rights reserved", "all rights are reserved", "general public license general public license cc by", "released below the mit license", "cc\nby"]
    got = scanned = {r.doc_id - len(ODD): r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert [got[i].labels for i in range(8)] == ["mit", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0", "proprietary,reserved", "", "cc-by,gpl", "", "cc-by"]
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].score) == (3, 0, 6, 0.5) and got[4].first_word is None
    assert all(r.n_words == len(split(texts[i + len(ODD)])) for i, r in scanned.items())


def plain(parts, optional):
    """A wording that a template accepts, with or without its optional regions."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif p[0] == "opt":
            out += plain(p[1], optional) if optional else []
        else:
            out += {"number": lambda: ["2020"], "any": lambda: ["zz"] * p[1], "alt": lambda: p[1][0]}[p[0]]()
    return out


def test_every_license_wording_is_accepted_and_no_part_of_it(spark):
    # a label of its own for each template
    markups = {f"{k}-{i}": [m] for k, ms in licenses.templates().items() for i, m in enumerate(ms)}
    wordings = [(k, licenses.parse(m)) for k, (m,) in markups.items()]
    texts = [" ".join(plain(parts, o)) for _, parts in wordings for o in (False, True)]
    last = lambda parts: max(j for j, p in enumerate(parts) if isinstance(p, str))
    broken = [(k, [*parts[: last(parts)], *parts[last(parts) + 1 :]]) for k, parts in wordings if len(parts) > 60]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, [*texts, *(" ".join(plain(p, False)) for _, p in broken)]), markups=markups).collect()}
    assert len(wordings) >= 40 and len(broken) > 15
    assert all(k in got[2 * i + o].labels.split(",") and got[2 * i + o].score == 1 for i, (k, _) in enumerate(wordings) for o in (0, 1))
    assert not [k for i, (k, _) in enumerate(broken) if k in got[len(texts) + i].labels.split(",")]


def test_automata_agree_with_regular_expressions():
    r = random.Random(1)
    for label, markups in licenses.templates().items():
        for markup in markups:
            one, pattern = licenses.Automaton(label, markup), re.compile(licenses.as_regex(licenses.parse(markup)) + " ")
            pool = re.findall(r" ([^ ()?|{}\[\]:]+)", licenses.as_regex(licenses.parse(markup))) + ["zz", "2020"]
            for _ in range(60):
                text = [r.choice(pool) for _ in range(3)] + [w for w in pool[:-2] if r.random() < 0.97] + ["zz"]
                found = any(one.match(text, i) > 0 for i in range(len(text)))
                assert found == bool(pattern.search(" " + " ".join(text) + " "))


def brute_hits(text, items, window=10):
    w, hit, names = split(text), set(), set()
    for key, t in items:
        x = split(t)
        m = min(len(x), window)
        have = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else set()
        for i in range(len(w) - m + 1) if have and key is not None else ():
            if tuple(w[i : i + m]) in have:
                hit.update(range(i, i + m))
                names.add(str(key))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(12)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(0, 25))) for i in range(20)] + [(20, "alone"), (None, "v1 v2"), (21, None), (22, text(3)), (100, text(12))]
    texts = [*ODD, "", "ALONE, here"] + [text(r.randint(0, 900)) for _ in range(40)] + [text(5) + " " + items[3][1] + "; " + text(4)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.decontaminate(frame(spark, texts), benchmark, block_bytes=block_bytes).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == brute_hits(t, items), t
    assert decontaminate.decontaminate(frame(spark, texts), benchmark.limit(0)).filter("contaminated").count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    r = random.Random(3)
    texts = [*ODD, "it's  The\tDog's 12² don't_"] + [" ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 400))) for _ in range(120)]
    # runs the memo must not mistake: quotes, dashes, combining marks, added strings in either case, odd white space
    pool = ["“Hi”", "it’s", "—", "…", "e\u0301", "\u0301a", "ΟΔΟΣ", "Σς", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "a\x1cb", "\x85", "\u2003", "\x01", "don't", "WE'LL", "12²", "ﬁ", "word", "Word,"]
    texts += [r.choice(["", " "]).join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(400)]
    df = frame(spark, texts, "piece string, _group int")
    got = packing.pack_documents(df, path, capacity=100, group_rows=40).collect()
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    seen = {i: [] for i in ids}
    rooms = {}
    for x in got:
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == x.ids_crc32 and x.start == x.piece * 100
        seen[x.doc_id] += [x.length]
        rooms.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert {i: sum(n) for i, n in seen.items()} == {i: len(x) for i, x in ids.items()}
    for room in rooms.values():
        at = 0
        for offset, n in sorted(room):
            assert offset == at
            at += n
        assert at <= 100
    bound = -(-sum(map(len, ids.values())) // 100)
    assert len(rooms) <= bound * 1.05 + 2
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(4)
    for _ in range(30):
        n = r.integers(1, 60)
        lengths = r.integers(1, 100, n)
        where, _, bins = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= bins and np.bincount(where, weights=lengths).max() <= 100
    assert packing.lower_bound(np.array([60] * 5), 100) == 5 and packing.lower_bound(np.array([34] * 6), 100) == 3


def test_language(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = queries.op6_language(spark, sf_small).join(docs, "doc_id").filter("held_out")
    right, total = got.filter("lang_pred = lang").count(), got.count()
    assert total > 150 and right / total > 0.97
    odd = language.identify_languages(frame(spark, ODD), language.F.lit(True), label_col="lang").collect()
    assert [r.doc_id for r in odd if r.lang_pred == "und"] == [0, 1, 2, 3]
    assert {r.lang_pred for r in language.identify_languages(frame(spark, ODD), language.F.lit(False)).collect()} == {"und"}


def test_token_counts(spark, sf_tiny):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    alphabet = list(" ▁\n\tabcdeé中😀\x00") + ["the", "in", "<s>", "<unk>", "<0x0A>", "  "]
    texts = [*ODD, "a" * 5000, " " * 700] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    got = {x.doc_id: x for x in tokens.token_counts(frame(spark, texts), path, limit=50).collect()}
    for i, n in enumerate(lib.encode([t or "" for t in texts])):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(n), len((texts[i] or "").encode()), len(n) > 50)
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()
    counts = {x.doc_id: x.n_tokens for x in queries.op7_token_counts(spark, sf_tiny).collect()}
    assert counts == {d.doc_id: len(lib.encode(d.text)) for d in docs}


def test_quality(spark, sf_small):
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    got = queries.op9_quality(spark, sf_small).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 80 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    odd = quality.score_quality(frame(spark, ODD), quality.Attention()).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality.classify_quality(frame(spark, ODD), labels.limit(0), quality.F.lit(True)).collect()} == {0.5}


def test_attention_gradient():
    r = np.random.default_rng(6)
    count = np.array([2, 1, 4])
    x, y = r.normal(size=(7, quality.N_FEATURES)).astype(np.float32), np.array([1, 0, 1], np.float32)
    model = quality.Attention(width=5, gate=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    loss = lambda: float(-np.mean(y * np.log(model.forward(x, count)[0]) + (1 - y) * np.log(1 - model.forward(x, count)[0])))
    out, kept = model.forward(x, count)
    for name, g in model.gradient(y, np.ones(3), out, kept, count).items():
        w, g = model.p[name].ravel(), np.ravel(g)
        i = int(np.abs(g).argmax())
        w[i] += 1e-5
        up = loss()
        w[i] -= 2e-5
        down = loss()
        w[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[i]) < 1e-4
