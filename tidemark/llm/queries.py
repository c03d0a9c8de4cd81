"""The queries opN_<name>: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, licenses, manifest, near_dedup, packing, passages, quality, runs, suffix_dedup, tokens, topk, url_filter
from tidemark.llm.common import WORD_PATTERN, held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("item_ids")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_languages(_table(spark, sf_dir, "documents"), ~held_out("doc_id", 4, 2))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_classes(_table(spark, sf_dir, "documents"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """The contract's repeats: in a tenth of the documents, told by crc32 of the id, each word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def again(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (place(i) + 1).cast("int"))), " "))

    # a lambda over one array, so that the words are split once
    planted = F.element_at(F.transform(F.array(words), again), 1)
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_with_repeats(_table(spark, sf_dir, "documents")))
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(a.isNull() | (r.length * a.period > a.length * r.period), r).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.merkle_manifest(_table(spark, sf_dir, "documents"), changed={"text": F.when(tampered, lower).otherwise(F.col("text"))})


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.fit_urls(url_filter.seed_labels(pages)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_near_duplicates, op3_decontaminate, op4_pack, op5_nearest, op6_language, op7_token_counts, op8_suffix_dedup, op9_quality, op10_passages, op11_periodic_runs, op12_merkle_manifest, op13_url_filter)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '{WORD_PATTERN}')"


def _op1_sql() -> str:
    places = {k: f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f'w[i + {j + 1}] = {x!r}' for j, x in enumerate(v.split()))})" for k, v in licenses.BASE.items()}
    full = {k: " OR ".join(f"regexp_matches(t, '{licenses.as_regex(licenses.parse(m))} ')" for m in v) for k, v in licenses.templates().items()}
    named = lambda x: f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda v: v IS NOT NULL))), ',')"
    base = ", ".join(f"CASE WHEN len({c}) > 0 THEN '{k}' END" for k, c in zip(places, ("a", "b", "c")))
    more = ", ".join(f"CASE WHEN {e} THEN '{k}' END" for k, e in full.items())
    return (
        f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), "
        f"p AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS t, {', '.join(f'{e} AS {c}' for e, c in zip(places.values(), ('a', 'b', 'c')))} FROM d) "
        f"SELECT doc_id, n_words, len(a) + len(b) + len(c) AS n_base, list_min(a || b || c) AS first_word, list_max(a || b || c) AS last_word, {named(base)} AS base_labels, {named(base + ', ' + more)} AS labels, "
        f"CASE WHEN {' OR '.join(full.values())} THEN 1.0 WHEN len(a || b || c) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM p"
    )


_OP3_SQL = (
    f"WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL), "
    "x AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS s FROM i)), "
    f"d AS (SELECT doc_id, {_WORDS} AS w FROM documents), sizes AS (SELECT DISTINCT m FROM x), "
    "y AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m)), "
    "h AS (SELECT y.doc_id, y.s, y.m, x.item_id FROM y JOIN x ON x.m = y.m AND x.k = y.k), "
    "n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM h) GROUP BY 1), "
    "t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM h GROUP BY 1) "
    "SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"
)
_OP5_SQL = (
    "WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1.0::FLOAT ELSE -1.0::FLOAT END) AS b FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0), "
    "d AS (SELECT q.vec_id AS query_id, o.vec_id AS neighbor_id, CAST((len(q.b) - list_dot_product(q.b, o.b)) / 2 AS INT) AS distance FROM c q JOIN c o ON o.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) "
    "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INT) AS rank, neighbor_id, distance FROM d QUALIFY rank <= 10"
)


#: crc32 of the id as decimal text, bit by bit (a 256 stands for a shift).
_CRC = (
    "xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))), "
    "lambda c, x: CASE WHEN x = 256 THEN xor(c >> 1, 3988292384::UBIGINT * (c & 1)) ELSE xor(c, x) END), 4294967295::UBIGINT)::BIGINT"
)
_OP11_SQL = (
    f"WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC} AS h FROM documents), "
    "d AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM t), "
    "e AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM d), "
    "x AS (SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS v FROM (SELECT *, unnest(range(n)) AS i FROM e)), "
    "m AS (SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS g FROM x JOIN x AS y ON y.doc_id = x.doc_id AND y.v = x.v AND y.i > x.i AND 4 * (y.i - x.i) <= x.n), "
    "s AS (SELECT doc_id, q, min(i) AS a, max(i) + 1 + q AS b FROM m GROUP BY doc_id, q, g HAVING count(*) >= greatest(3 * q, 6 - q)), "
    "r AS (SELECT doc_id, a AS s, b - a AS l, min(q) AS q FROM s GROUP BY 1, 2, 3), "
    "b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1), "
    "k AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM r GROUP BY 1), "
    "c AS (SELECT x.doc_id, string_agg(v, ' ' ORDER BY i) AS t FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.s + r.q AND x.i < r.s + r.l) GROUP BY 1) "
    "SELECT e.doc_id, coalesce(k.n, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli, sha256(coalesce(k.t, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256 "
    "FROM e LEFT JOIN k USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"
)


def _op12_sql(levels: int = 7) -> str:
    enc = lambda t: " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", t))
    grow = lambda n, first: ", ".join(
        [f"{n}0 AS ({first})"]
        + [f"{n}{k + 1} AS (SELECT tree, {k + 1} AS lvl, i // 16 AS i, (max(n) + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {n}{k} WHERE n > 1 GROUP BY tree, i // 16)" for k in range(levels)]
        + [f"{n} AS (" + " UNION ALL ".join(f"SELECT tree, lvl, i, n, h FROM {n}{k}" for k in range(levels + 1)) + ")"]
    )
    lower = _LOWER.replace("coalesce(text, '')", "text")
    run = "OVER (PARTITION BY tree, lvl, i // 16 ORDER BY i ROWS BETWEEN"
    return (
        f"WITH RECURSIVE d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256({enc('text')}) AS h, CASE WHEN {_CRC} % 5 = 0 THEN sha256({enc(lower)}) END AS later FROM documents), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, later) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d), "
        + grow("a", "SELECT tree, 0 AS lvl, i, n, h FROM o")
        + ", s AS (SELECT tree, h FROM a WHERE n = 1), "
        + grow("b", "SELECT -1 AS tree, 0 AS lvl, tree AS i, count(*) OVER () AS n, h FROM s")
        + f", nodes AS (SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM (FROM a UNION ALL FROM b)), "
        "f AS (SELECT tree AS t0, i AS i0, tree, 0 AS lvl, i, coalesce(later, h) AS h, '' AS proof FROM o UNION ALL "
        "SELECT t0, i0, CASE WHEN x.n > 1 THEN x.tree ELSE -1 END, CASE WHEN x.n > 1 THEN x.lvl + 1 ELSE 0 END, CASE WHEN x.n > 1 THEN x.i // 16 ELSE x.tree END, CASE WHEN x.n > 1 THEN sha256(x.pre || f.h || x.post) ELSE f.h END, CASE WHEN x.n > 1 THEN proof || x.pre || x.post ELSE proof END "
        "FROM f JOIN nodes AS x ON x.tree = f.tree AND x.lvl = f.lvl AND x.i = f.i WHERE x.n > 1 OR x.tree >= 0), "
        "r AS (SELECT h AS root, lvl FROM b WHERE n = 1) "
        "SELECT o.doc_id, o.h AS leaf, s.h AS subroot, r.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified "
        "FROM o JOIN s USING (tree) CROSS JOIN r JOIN f ON f.t0 = o.tree AND f.i0 = o.i AND f.tree = -1 AND f.lvl = r.lvl"
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op3_decontaminate": _OP3_SQL, "op5_nearest": _OP5_SQL, "op11_periodic_runs": _OP11_SQL, "op12_merkle_manifest": _op12_sql()}
