"""Table sources and sinks, contracts, and normalisers of landed files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import first_date

DATE_COLUMNS = ("date", "decision_date", "publish_date", "report_date")
# Required columns of each contract, aliases of registry columns, and exchange field names.
CONTRACTS = {
    "daily_prices": ("date", "ticker", "close", "value"),
    "monthly_model": ("decision_date", "ticker", "sector", "risk_class"),
    "macro": ("date", "key_rate", "fx_rate", "curve_slope", "market_vol_20d", "market_corr_60d"),
    "fundamentals": ("ticker", "report_date", "publish_date"),
}
REGISTRY_ALIASES = {"secid": "ticker", "security": "ticker", "issuer": "company_name", "period_end": "report_period_end", "date": "report_period_end", "published_at": "publish_date", "publication_date": "publish_date", "url": "source_url", "path": "local_path"}
REGISTRY_TEXT = ("company_name", "report_type", "accounting_standard", "language", "source_url", "local_path", "source_name")
TRADE_FIELDS = {"TRADEDATE": "date", "SECID": "ticker", "OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close", "VOLUME": "volume", "VALUE": "value", "WAPRICE": "wap", "NUMTRADES": "num_trades"}
TRADE_NUMBERS = ("open", "high", "low", "close", "volume", "value", "wap", "num_trades")


class ContractError(ValueError):
    """A table lacks required columns."""


def require(df: DataFrame, contract: str | Iterable[str], name: str = "table") -> DataFrame:
    """df, or an error that lists the missing columns in order."""
    wanted = CONTRACTS[contract] if isinstance(contract, str) else tuple(contract)
    if missing := sorted(set(wanted) - set(df.columns)):
        raise ContractError(f"{contract if isinstance(contract, str) else name} lacks {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is the sources' null; Spark orders and sums it otherwise."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def read_table(spark: SparkSession, path: str, schema: str | None = None, date_columns: Iterable[str] = DATE_COLUMNS) -> DataFrame:
    """A parquet file, else CSV with a header; the date columns that are there become dates, NaN becomes null."""
    if path.lower().endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    kinds = dict(df.dtypes)
    return nan_to_null(df.withColumns({c: first_date(F.col(c)) if kinds[c] == "string" else F.col(c).cast("date") for c in date_columns if c in kinds}))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, CSV with a header, or JSON lines; replaces what is there."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Adds absent columns: a Column as it is, any other value as a literal (None: a null double)."""
    have = set(df.columns)
    return df.withColumns({c: v if isinstance(v, Column) else F.lit(v) if v is not None else F.lit(None).cast("double") for c, v in defaults.items() if c not in have})


def report_registry(df: DataFrame) -> DataFrame:
    """Canonical registry columns: aliases renamed, tickers trimmed and upper case, dates parsed, absent columns null."""
    have = set(df.columns)
    renames: dict[str, str] = {}
    for old, new in REGISTRY_ALIASES.items():
        if old in have and new not in have and new not in renames.values():
            renames[old] = new
    df = df.withColumnsRenamed(renames)
    if "ticker" not in df.columns:
        raise ContractError("a registry needs a ticker column")
    df = with_defaults(df, {c: F.lit(None).cast("string") for c in (*REGISTRY_TEXT, "report_period_end", "publish_date")})
    dates = [c for c in ("report_period_end", "publish_date", "downloaded_at") if c in df.columns]
    kinds = dict(df.dtypes)
    return df.withColumns({"ticker": F.upper(F.trim("ticker"))} | {c: F.col(c).cast("date") if kinds[c] in ("date", "timestamp") else first_date(F.col(c)) for c in dates})


def report_sources(df: DataFrame) -> DataFrame:
    """Issuers to look for: ticker is required, disclosure id and address may be absent."""
    require(df, ("ticker",), "report sources")
    return with_defaults(df.withColumn("ticker", F.upper(F.trim("ticker"))), {c: F.lit(None).cast("string") for c in ("e_disclosure_id", "issuer_url")})


def universe(df: DataFrame, ticker: str = "ticker", name: str = "company_name", sector: str = "sector") -> DataFrame:
    """One included row per ticker (of several, the least name and sector)."""
    return df.groupBy(F.col(ticker).alias("ticker")).agg(F.min(F.struct(F.col(name).alias("company_name"), F.col(sector).alias("sector"))).alias("x")).select("ticker", "x.company_name", "x.sector", F.lit(1).alias("include_flag"))


def columnar_json(df: DataFrame, payload: str, table: str, columns: Mapping[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """Rows of ``{table: {columns: [..], data: [[..], ..]}}``; names match in lower case, absent ones are null.

    columns: lower-case name -> type.
    """
    inner = F.from_json(payload, f"`{table}` struct<columns: array<string>, data: array<array<string>>>")[table]
    rows = df.select(*keep, F.transform(inner["columns"], F.lower).alias("_names"), F.explode(inner["data"]).alias("_row"))
    return rows.select(*keep, *(F.expr(f"try_cast(get(_row, int(nullif(array_position(_names, '{c}'), 0)) - 1) as {kind})").alias(c) for c, kind in columns.items()))


def trade_history(df: DataFrame) -> DataFrame:
    """Exchange fields renamed, the date parsed, numbers coerced (bad: null)."""
    df = df.withColumnsRenamed({k: v for k, v in TRADE_FIELDS.items() if k in df.columns})
    return df.withColumns({"date": first_date(F.col("date"))} | {c: F.col(c).try_cast("double") for c in TRADE_NUMBERS if c in df.columns})


def fx_rates(spark: SparkSession, path: str) -> DataFrame:
    """date and rate (value / nominal, decimal comma) of XML files of ``<Record Date="..">`` elements."""
    rows = spark.read.format("xml").option("rowTag", "Record").schema("_Date string, Nominal string, Value string").load(path)
    number = lambda c: F.regexp_replace(c, ",", ".").try_cast("double")
    return rows.select(first_date(F.col("_Date")).alias("date"), F.try_divide(number("Value"), number("Nominal")).alias("rate"))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of txt, md, csv and html files, read as UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,csv,html}").option("recursiveFileLookup", True).load(path)
    return files.select("path", decode(F.col("content")).alias("text"))


def decode(content: Column) -> Column:
    """Bytes as UTF-8 text; broken sequences are left out."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def first_by_digest(df: DataFrame, content: str, order: str) -> DataFrame:
    """One row per content: the digest, the row that is first in the order, and the number of rows."""
    return df.groupBy(digest(F.col(content)).alias("sha256")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def fingerprint(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Row count and two order-free sums over all rows, modulo 2^64, of independent halves of each row's digest.

    A row is the text of its values, each with its length in bytes before it and nulls told apart, so that different
    rows have different texts.  Sums make copies count, which an exclusive or would cancel.
    """
    values = [F.col(c).cast("string") for c in columns]
    text = F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values))
    sha = F.sha2(text.cast("binary"), 256)
    half = lambda at: F.conv(F.substring(sha, at, 16), 16, 10).cast("decimal(20,0)")
    total = lambda at: F.pmod(F.coalesce(F.sum(half(at)), F.lit(0)), F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string")
    return df.agg(F.count("*").alias("row_count"), total(1).alias("hash_a"), total(17).alias("hash_b"))


# Extensions that are read, by content type and by name.
CONTENT_TYPES = {
    "application/pdf": ".pdf",
    "application/zip": ".zip",
    "application/x-zip-compressed": ".zip",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "text/plain": ".txt",
    "text/csv": ".csv",
    "text/html": ".html",
    "application/xhtml+xml": ".html",
}
EXTENSIONS = (".pdf", ".xlsx", ".xlsm", ".zip", ".txt", ".md", ".csv", ".html", ".htm")


def url_extension(url: Column) -> Column:
    """The suffix of an address's path, in lower case ('' if none)."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.regexp_extract(F.try_url_decode(path), r"[^/.](\.[^./]*)$", 1))


def file_type(url: Column, content_type: Column, disposition: Column, content: Column, fallback: str = ".bin") -> Column:
    """By the name in the disposition, the content type, the first bytes, the address; else the fallback."""
    known = lambda e: F.when(F.lower(F.trim(e)).isin(*EXTENSIONS), F.lower(F.trim(e)))
    star = F.regexp_extract(disposition, r"(?i)filename\*=(?:UTF-8'')?([^;]+)", 1)
    plain = F.regexp_extract(disposition, r'(?i)filename=("[^"]+"|[^;]+)', 1)
    name = F.try_url_decode(F.regexp_replace(F.trim(F.when(star != "", star).otherwise(plain)), '^"|"$', ""))
    media = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    types = F.lit(None).cast("string")
    for k, v in CONTENT_TYPES.items():
        types = F.when(media == k, F.lit(v)).otherwise(types)
    head = F.hex(F.substring(content, 1, 8))
    start = F.lower(F.ltrim(F.decode(F.substring(content, 1, 64), "ISO-8859-1")))
    # a workbook is a zip whose directory has the content types and something below xl/
    raw = F.decode(content, "ISO-8859-1")
    entry = lambda size, name: F.regexp_like(raw, F.lit(rf"PK\x01\x02[\s\S]{{24}}{size}[\s\S]{{16}}{name}"))
    workbook = entry(r"\x13\x00", r"\[Content_Types\]\.xml") & entry(r"[\s\S]{2}", "xl/")
    magic = F.when(head.startswith("25504446"), F.lit(".pdf")).when(head.startswith("504B0304"), F.when(workbook, ".xlsx").otherwise(".zip")).when(start.startswith("<!doctype") | start.startswith("<html"), F.lit(".html"))
    return F.coalesce(known(F.regexp_extract(name, r"(\.[^./]+)$", 1)), types, magic, known(url_extension(url)), F.lit(fallback))
