"""Links of landed web pages: extraction, scores, canonical forms and choice of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import first_date
from tidemark.operators.documents import keyword_hits, once, period_end, stretches, window
from tidemark.sources.tables import url_extension

# Words and years that mark report links and pages, and document extensions.
YEARS = ("2021", "2022", "2023", "2024", "2025")
DOCUMENTS = (".pdf", ".xlsx", ".xlsm", ".zip", ".xls", ".doc", ".docx")
LINK_WORDS = ("ifrs", "msfo", "мсфо", "financial", "финансов", "statement", "отчет", "отчёт", "annual", "годов", "interim", "quarter", "results", "результат", "consolidated", "консолид")
PAGE_WORDS = ("report", "reports", "financial", "results", "annual", "statement", "investor", "investors", "disclosure", "отчет", "отчеты", "отчёты", "финансов", "результат", "инвест", "раскрыт")
# A document's address in raw markup, and the characters before and after it that describe it.
RAW_ADDRESS = r"https?://[^\s\"'<>]+?\.(?:pdf|xlsx|xlsm|zip|xls|docx?)(?:\?[^\s\"'<>]*)?"
RAW_BEFORE, RAW_AFTER = 900, 300
_ADDRESS = r"^([a-zA-Z][\w+.-]*://)([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _ADDRESS, n)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")


def same_site(url: Column, root: Column) -> Column:
    """The same host or a subdomain of it."""
    return (host(url) == host(root)) | F.endswith(host(url), F.concat(F.lit("."), host(root)))


def canonical(url: Column) -> Column:
    """Without a bare download mark in the query."""
    return F.regexp_replace(url, r"\?(?:dl|download)=1(?=#|$)", "")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def resolve(base: Column, href: Column) -> Column:
    """href as an absolute address on the page base (dot segments of relative paths are folded)."""
    root = F.concat(_part(base, 1), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), href)
    plain = F.regexp_replace(joined, r"/(?:\./)+", "/")
    for _ in range(4):
        plain = F.regexp_replace(plain, r"/[^/?#]+/\.\./", "/")
    query_free = F.concat(root, _part(base, 3))
    return (
        F.when(F.regexp_like(href, F.lit(r"^[a-zA-Z][\w+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(query_free, href))
        .when((href == "") | F.startswith(href, F.lit("#")), F.concat(query_free, _part(base, 4), href))
        .otherwise(F.concat(root, F.regexp_replace(plain, r"^/(?:\.\./)+", "/")))
    )


def _unescape(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _plain(markup: Column) -> Column:
    return F.trim(F.regexp_replace(_unescape(F.regexp_replace(markup, "<[^>]+>", " ")), r"(?U)\s+", " "))


def extract_links(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """link and text of every anchor (absolute; title, label and inner text) and of every document address in the raw page.

    A raw address comes with its surroundings, 900 characters before and 300 after, without tags.
    """
    page = pages.select(*keep, F.col(url).alias("page_url"), F.replace(F.coalesce(F.col(html), F.lit("")), F.lit("\\/"), F.lit("/")).alias("_h"))
    anchor = F.lit(r"(?is)<a\s([^>]*\bhref\s*=[^>]*)>(.*?)(?=</a\s*>|<a\s|$)")
    zipped = F.arrays_zip(F.regexp_extract_all("_h", anchor, F.lit(1)).alias("tag"), F.regexp_extract_all("_h", anchor, F.lit(2)).alias("inner"))
    value = lambda name: F.regexp_replace(F.regexp_extract(F.col("x.tag"), rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1), "^[\"']|[\"']$", "")
    anchors = page.select(*keep, "page_url", F.explode(zipped).alias("x")).select(*keep, "page_url", resolve(F.col("page_url"), _unescape(F.trim(value("href")))).alias("link"), F.trim(F.regexp_replace(F.concat_ws(" ", _unescape(value("title")), _unescape(value("aria-label")), _plain(F.col("x.inner"))), r"(?U)\s+", " ")).alias("text"))
    # a page's hits take their links and surroundings along, not the page
    around = lambda parts, h: F.struct(window(parts, h["start"], h["start"] + h["size"]).alias("link"), window(parts, h["start"] - RAW_BEFORE, h["start"] + h["size"] + RAW_AFTER).alias("around"))
    hits = once(stretches(F.col("_h")), lambda parts: F.transform(keyword_hits(F.col("_h"), RAW_ADDRESS), lambda h: around(parts, h)))
    found = page.filter(F.regexp_like("_h", F.lit("(?i)" + RAW_ADDRESS))).select(*keep, "page_url", F.explode(hits).alias("x"))
    bare = found.select(*keep, "page_url", "x.link", _plain(F.col("x.around")).alias("text"))
    return anchors.unionByName(bare)


def _score(blob: Column, words: tuple[str, ...], each: int) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.when(blob.contains(w), each).otherwise(0)
    return total


def _any(blob: Column, words: tuple[str, ...]) -> Column:
    hit = blob.contains(words[0])
    for w in words[1:]:
        hit = hit | blob.contains(w)
    return hit


def _blob(url: Column, text: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(text, F.lit(""))))


def link_score(url: Column, text: Column, words: tuple[str, ...] = LINK_WORDS, years: tuple[str, ...] = YEARS) -> Column:
    """5 for a document, 4 for a year, 2 for each word; 6 off for sustainability, 2 off for presentations."""
    blob = _blob(url, text)
    score = F.when(url_extension(url).isin(*DOCUMENTS), 5).otherwise(0) + F.when(_any(blob, years), 4).otherwise(0) + _score(blob, words, 2)
    return score - F.when(_any(blob, ("sustainability", "esg", "устойчив")), 6).otherwise(0) - F.when(_any(blob, ("presentation", "презентац")), 2).otherwise(0)


def page_score(url: Column, text: Column, words: tuple[str, ...] = PAGE_WORDS, years: tuple[str, ...] = YEARS) -> Column:
    blob = _blob(url, text)
    return _score(blob, words, 1) + F.when(_any(blob, years), 2).otherwise(0)


def best_per_address(candidates: DataFrame, key: str = "ticker", order: str = "position") -> DataFrame:
    """The candidate of highest score for each key and canonical address; the first of equals."""
    row = F.struct(*[c for c in candidates.columns if c != key])
    best = candidates.groupBy(key, canonical(F.col("link")).alias("canonical_url")).agg(F.max_by(row, F.struct(F.col("score"), -F.col(order))).alias("_b"))
    return best.select(key, "canonical_url", "_b.*")


def top_candidates(candidates: DataFrame, n: int = 18, key: str = "ticker", order: str = "canonical_url") -> DataFrame:
    """The n best of each key."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), order))).filter(F.col("place") <= n)


def frontier(links: DataFrame, visited: DataFrame, max_depth: int = 2, least: int = 1, root: str = "root_url") -> DataFrame:
    """Pages to read next: not visited, of the same site, not too deep, promising enough."""
    seen = visited.select(without_fragment(F.col("url")).alias("_u")).distinct()
    asked = links.withColumn("_u", without_fragment(F.col("link"))).filter((F.col("depth") < max_depth) & same_site(F.col("link"), F.col(root)) & (page_score(F.col("link"), F.col("text")) >= least))
    return asked.join(seen, "_u", "left_anti").groupBy("_u").agg(F.min("depth").alias("depth")).select(F.col("_u").alias("link"), (F.col("depth") + 1).alias("depth"))


def table_rows(pages: DataFrame, url: str = "url", html: str = "html", mark: str = "fileload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents of table rows with a file link: href, last date as publish date, period end and the row's text."""
    rows = pages.select(*keep, F.col(url).alias("page_url"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("_r")).filter(F.lower("_r").contains(mark))
    text = F.trim(F.regexp_replace(F.regexp_replace("_r", "<[^>]+>", " "), r"(?U)\s+", " "))
    rows = rows.withColumn("raw_text", text)
    href = F.regexp_extract("_r", rf"(?i)href=[\"']([^\"']*{mark}[^\"']*)[\"']", 1)
    dates = F.regexp_extract_all("raw_text", F.lit(r"(\d{2}\.\d{2}\.\d{4})"), F.lit(1))
    year = F.regexp_extract("raw_text", r"\b(20\d{2})\b", 1).try_cast("int")
    return rows.select(*keep, "page_url", F.when(href != "", resolve(F.col("page_url"), F.replace(href, F.lit("&amp;"), F.lit("&")))).alias("source_url"), first_date(F.get(dates, F.size(dates) - 1)).alias("publish_date"), period_end(F.col("raw_text"), year).alias("report_period_end"), "raw_text")


def registry_union(parts: list[DataFrame], keys: tuple[str, ...] = ("ticker", "source_url", "report_type")) -> DataFrame:
    """All rows found, failed and by hand; the first of equal keys stays (earlier parts first, then by status)."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    others = [c for c in out.columns if c not in keys]
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in others if c != "_part"]), F.struct("_part", *[c for c in ("status",) if c in others])).alias("_b"))
    return best.select(*keys, "_b.*")


def in_publish_window(date: Column, start: str | None, end: str | None) -> Column:
    """Known dates must lie in the window; unknown ones pass."""
    ok = F.lit(True)
    if start:
        ok = ok & (date.isNull() | (date >= F.lit(start).cast("date")))
    if end:
        ok = ok & (date.isNull() | (date <= F.lit(end).cast("date")))
    return ok
