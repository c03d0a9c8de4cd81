"""Report documents as column expressions: numbers near keywords, risk terms, ratios and scores.  No Python UDFs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clip, floor_at

# Keyword patterns of each metric, in order of preference.
METRICS = {
    "report_revenue": [r"выручк[аи]", r"revenue", r"sales", r"net\s+sales", r"net\s+interest\s+income", r"чистые\s+процентные\s+доходы"],
    "report_ebitda": [r"ebitda", r"oibda", r"операционн\w+\s+прибыл\w+\s+до\s+амортизац"],
    "report_net_profit": [r"чист\w+\s+прибыл\w+", r"net\s+profit", r"profit\s+for\s+the\s+period", r"net\s+income"],
    "report_operating_cash_flow": [r"операционн\w+\s+денежн\w+\s+поток", r"денежн\w+\s+поток\w+\s+от\s+операционн\w+\s+деятельност", r"cash\s+flows?\s+from\s+operating\s+activities", r"operating\s+cash\s+flow"],
    "report_free_cash_flow": [r"свободн\w+\s+денежн\w+\s+поток", r"free\s+cash\s+flow", r"fcf"],
    "report_capex": [r"капитальн\w+\s+затрат", r"капитальн\w+\s+вложен", r"capital\s+expenditure", r"capex", r"additions\s+to\s+property"],
    "report_total_debt": [r"общ\w+\s+долг", r"совокупн\w+\s+долг", r"заемн\w+\s+средств", r"total\s+debt", r"borrowings", r"loans\s+and\s+borrowings"],
    "report_short_term_debt": [r"краткосрочн\w+\s+долг", r"short[-\s]?term\s+debt", r"current\s+borrowings"],
    "report_long_term_debt": [r"долгосрочн\w+\s+долг", r"long[-\s]?term\s+debt", r"non[-\s]?current\s+borrowings"],
    "report_cash_and_equivalents": [r"денежн\w+\s+средств\w+\s+и\s+их\s+эквивалент", r"cash\s+and\s+cash\s+equivalents", r"cash\s+and\s+equivalents"],
    "report_interest_expense": [r"процентн\w+\s+расход", r"interest\s+expense", r"finance\s+costs?", r"финансов\w+\s+расход"],
    "report_total_assets": [r"активы\s+итого", r"итого\s+актив", r"total\s+assets"],
    "report_total_equity": [r"капитал\s+итого", r"итого\s+капитал", r"total\s+equity", r"shareholders[’']?\s+equity"],
    "report_dividends": [r"дивиденд", r"dividends"],
    "report_provisions": [r"резерв\w+", r"provisions?"],
    "report_cet1_ratio": [r"норматив\s+достаточности\s+базового\s+капитала", r"cet1", r"tier\s+1\s+capital\s+ratio"],
}
# Patterns of each group of risk terms.
SIGNALS = {
    "sanctions": [r"санкци", r"sanction", r"restricted\s+market", r"market\s+access"],
    "currency_fx": [r"валютн\w+\s+риск", r"курсов\w+\s+разниц", r"foreign\s+exchange", r"currency\s+risk", r"fx\s+risk"],
    "liquidity_refinancing": [r"ликвидност\w+\s+риск", r"рефинансирован", r"refinancing", r"liquidity\s+risk", r"maturity\s+profile"],
    "covenant": [r"ковенант", r"covenant"],
    "impairment": [r"обесценен", r"impairment"],
    "litigation": [r"судебн\w+\s+разбирательств", r"litigation", r"legal\s+claim"],
    "going_concern": [r"непрерывност\w+\s+деятельност", r"going\s+concern"],
    "dividend_pressure": [r"дивиденд\w+\s+не\s+выпла", r"приостанов\w+\s+дивиденд", r"dividend\s+suspend", r"no\s+dividend"],
    "tax_pressure": [r"налогов\w+\s+нагруз", r"tax\s+burden", r"income\s+tax\s+rate"],
    "capex_pressure": [r"рост\w+\s+капитальн\w+\s+затрат", r"capex\s+increase", r"investment\s+program"],
    "demand_pressure": [r"снижени\w+\s+спрос", r"demand\s+slowdown", r"lower\s+demand"],
    "auditor_emphasis": [r"модифицированн\w+\s+мнени", r"emphasis\s+of\s+matter", r"qualified\s+opinion"],
    "related_party": [r"связанн\w+\s+сторон", r"related\s+part"],
}
# Number and scale words as written in reports, and what a scale multiplies by.
NUMBER = r"\(?[-+−]?\d[\d\s .,']*\)?"
SCALE = r"трлн|триллион\w*|trillion|trn|млрд|миллиард\w*|billion|bn|млн|миллион\w*|million|mn|тыс|тысяч\w*|thousand|k"
SCALES = {1e12: r"трлн|триллион|trillion|trn", 1e9: r"млрд|миллиард|billion|bn", 1e6: r"млн|миллион|million|mn", 1e3: r"тыс|тысяч|thousand|\bk\b"}
YOY = ("report_revenue", "report_ebitda", "report_net_profit", "report_operating_cash_flow", "report_free_cash_flow", "report_total_debt", "report_net_debt", "report_cash_and_equivalents")
AFTER, BEFORE, EVIDENCE = 260, 180, 700
#: Characters of a stretch of text, and elements of a run of sums.
STRETCH, RUN = 2048, 128
TINY = 1e-12
#: Letters that match another one without regard to case, though it is not their lower case, and the dot that lower case leaves of one.
ODD = "[ſıİ\u0307\u1C80-\u1C88]"


def normalise(text: Column) -> Column:
    """No-break spaces and tabs become spaces, runs of spaces one; line ends stay."""
    plain = F.replace(F.replace(text, F.lit("\u00A0"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    return F.when(plain.contains("  "), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)


def literal(pattern: str) -> str:
    """The longest string that the lower case of every match of pattern holds (matches with ODD letters apart); '' if unsure."""
    if re.search(r"[|(){}.^$]|\\[^wWsSdDbB]", pattern):
        return ""
    bare = re.sub(r"\[[^\]]*\]|\\.|[a-zа-я0-9][?*]", "\0", pattern.lower())
    return max(re.findall("[a-zа-я0-9]+", re.sub(r"\+", "\0", bare)), key=len, default="")


def parse_number(raw: Column, scale: Column | None = None) -> Column:
    """The value of a number as written: thousands and decimal marks, brackets and unicode minus, scale word."""
    return _numbers(raw, F.coalesce(scale if scale is not None else F.lit(""), F.lit("")))


def _numbers(raw: Column, scale: Column) -> Column:
    t = F.replace(F.replace(F.trim(raw), F.lit(" "), F.lit(" ")), F.lit("−"), F.lit("-"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[()]+|[()]+$", ""), r"[^0-9,.'\-\s]", ""), "[' ]", "")
    tail = lambda m: F.length(F.substring_index(bare, m, -1))
    without = lambda x, m: F.replace(x, F.lit(m), F.lit(""))
    point = lambda x: F.replace(x, F.lit(","), F.lit("."))
    digits = (
        F.when(bare.contains(",") & bare.contains("."), F.when(tail(",") < tail("."), point(without(bare, "."))).otherwise(without(bare, ",")))
        .when(bare.contains(","), F.when(tail(",").between(1, 2), point(bare)).otherwise(without(bare, ",")))
        .when(F.length(bare) - F.length(without(bare, ".")) > 1, without(bare, "."))
        .otherwise(bare)
    )
    value = digits.try_cast("double")
    times = F.lit(1.0)
    for m, p in reversed(SCALES.items()):
        times = F.when(F.regexp_like(scale, F.lit("(?iuU)" + p)), F.lit(m)).otherwise(times)
    return F.when(t.startswith("(") & t.endswith(")"), -F.abs(value)).otherwise(value) * times


def _candidates(window: Column, evidence: Column, last: int | None = None) -> Column:
    """(value, evidence) of the numbers in a window, years left out; of the last few, if so wished."""
    pattern = F.lit(rf"(?iuU)({NUMBER})\s*({SCALE})?")
    both = F.arrays_zip(F.regexp_extract_all(window, pattern, F.lit(1)).alias("raw"), F.regexp_extract_all(window, pattern, F.lit(2)).alias("scale"))
    if last:
        both = F.when(F.size(both) > last, F.slice(both, -last, last)).otherwise(both)
    found = F.transform(both, lambda x: F.struct(_numbers(x["raw"], x["scale"]).alias("value"), (x["scale"] == "").alias("bare"), evidence.alias("evidence")))
    year = lambda x: x["bare"] & F.abs(x["value"]).between(1900, 2100) & (x["value"] == F.floor(x["value"]))
    return F.filter(found, lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]) & ~year(x))


def running_sums(sizes: Column) -> Column:
    """Sums before each element, without copying what was summed so far at every step: by runs, then within a run."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def within(a: Column) -> Column:
        runs = F.transform(numbers(F.ceil(F.size(a) / RUN).cast("int")), lambda i: total(F.slice(a, i * RUN + 1, RUN)))
        # one number for each run: few enough to be copied
        heads = F.aggregate(runs, F.array(F.lit(0)), lambda h, x: F.concat(h, F.array(F.element_at(h, -1) + x)))
        place = lambda h: F.transform(numbers(F.size(a)), lambda i: h[F.floor(i / RUN).cast("int")] + total(F.slice(a, i - i % RUN + 1, i % RUN)))
        return once(heads, place)

    return once(sizes, within)


def once(value: Column, use) -> Column:
    """use(value), where the value is made once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyword_hits(text: Column, keyword: str | Column) -> Column:
    """start (characters before) and size of each occurrence: gaps and occurrences interleave."""
    pattern = F.concat(F.lit("(?iuU)(?:"), keyword, F.lit(")")) if isinstance(keyword, Column) else F.lit(f"(?iuU)(?:{keyword})")

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        steps = running_sums(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)))
        gap = F.transform(gaps, lambda g: F.length(g))
        return F.transform(F.arrays_zip(steps.alias("before"), gap.alias("gap"), hits.alias("hit")), lambda x: F.struct((x["before"] + x["gap"]).alias("start"), F.length(x["hit"]).alias("size")))

    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.when(F.regexp_like(text, pattern), once(hits, placed)).otherwise(F.array().cast("array<struct<start:int,size:int>>"))


def stretches(text: Column) -> Column:
    """The text in stretches of STRETCH characters, so that a window is found without counting from the start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{STRETCH}}}"), F.lit(0))


def window(parts: Column, start: Column, end: Column) -> Column:
    """Characters start to end of the text whose stretches are parts; it begins at 0 at least."""
    begin = F.greatest(start, F.lit(0))
    first = F.floor(begin / STRETCH).cast("int")
    near = F.array_join(F.slice(parts, first + 1, F.floor(F.greatest(end - 1, begin) / STRETCH).cast("int") - first + 1), "")
    return F.substring(near, begin - first * STRETCH + 1, F.greatest(end - begin, F.lit(0)))


def _after(parts: Column, hits: Column) -> Column:
    end = lambda h: h["start"] + h["size"]
    return F.flatten(F.transform(hits, lambda h: _candidates(window(parts, end(h), end(h) + AFTER), F.trim(window(parts, h["start"] - 80, h["start"] + AFTER)))))


def _before(parts: Column, hits: Column) -> Column:
    return F.flatten(F.transform(hits, lambda h: _candidates(window(parts, h["start"] - BEFORE, h["start"]), F.trim(window(parts, h["start"] - BEFORE, h["start"] + h["size"] + 80)), 3)))


def candidates_after(text: Column, keyword: str | Column) -> Column:
    """Numbers in the 260 characters after each occurrence."""
    return once(stretches(text), lambda parts: _after(parts, keyword_hits(text, keyword)))


def candidates_before(text: Column, keyword: str | Column) -> Column:
    """The last three numbers in the 180 characters before each occurrence."""
    return once(stretches(text), lambda parts: _before(parts, keyword_hits(text, keyword)))


def best_candidate(candidates: Column) -> Column:
    """The first that is not zero, else the first."""
    return F.coalesce(F.get(F.filter(candidates, lambda x: F.abs(x["value"]) > TINY), F.lit(0)), F.get(candidates, F.lit(0)))


def _is(metric: str):
    return lambda x: x["metric"] == metric


def extract_metrics(df: DataFrame, text: str = "text", metrics: Mapping[str, Sequence[str]] = METRICS, keep: Sequence[str] = (), clean: str | None = None, odd: str | None = None) -> DataFrame:
    """keep, and value and evidence of each metric.  Texts without a metric's keywords skip its expressions.

    clean and odd: columns with the text's signal_text and with whether that has ODD letters, where they are there already.
    """
    marked = df.select(*keep, normalise(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    # the patterns that may occur, as data: the expressions on them stand in the plan once
    low = F.col(clean) if clean else F.lower("_t")
    seen = F.struct(low.alias("low"), (F.col(odd) if odd else F.regexp_like(low, F.lit(ODD))).alias("odd"))
    every = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(w).alias("keyword"), F.lit(literal(w)).alias("literal")) for m, words in metrics.items() for w in words))
    marked = marked.withColumn("_k", once(seen, lambda x: F.filter(every, lambda k: x["odd"] | F.contains(x["low"], k["literal"]))))
    # the stretches of a text and the hits of a keyword are made once; the work grows with the text and its hits
    both = lambda parts, k: once(keyword_hits(F.col("_t"), k["keyword"]), lambda hits: F.concat(_after(parts, hits), _before(parts, hits)))
    every = once(stretches(F.col("_t")), lambda parts: F.transform("_k", lambda k: F.struct(k["metric"].alias("metric"), both(parts, k).alias("found"))))
    marked = marked.withColumn("_f", F.when(F.size("_k") > 0, every)).drop("_k", "_t")
    best = {m: best_candidate(F.flatten(F.transform(F.filter("_f", _is(m)), lambda x: x["found"]))).alias(f"_{m}") for m in metrics}
    out = marked.select(*keep, *best.values())
    return out.select(*keep, *(F.col(f"_{m}.value").alias(m) for m in metrics), *(F.substring(F.col(f"_{m}.evidence"), 1, EVIDENCE).alias(f"{m}_evidence") for m in metrics))


def signal_text(text: Column) -> Column:
    """The text that risk terms are counted in."""
    return F.lower(normalise(F.coalesce(text, F.lit(""))))


def signal_counts(text: Column, signals: Mapping[str, Sequence[str]] = SIGNALS) -> dict[str, Column]:
    """Text length, words, and the occurrences of each group of risk terms."""
    clean = signal_text(text)
    return counts_in(clean, F.regexp_like(clean, F.lit(ODD)), signals)


def counts_in(clean: Column, odd: Column, signals: Mapping[str, Sequence[str]] = SIGNALS) -> dict[str, Column]:
    """signal_counts of a signal_text and of whether it has ODD letters.  A pattern is looked for where its literal is."""
    count = lambda p: F.regexp_count(clean, F.lit(p)).cast("double")
    term = lambda p: F.when(odd | clean.contains(literal(p)), count("(?iuU)" + p)).otherwise(0.0)
    out = {"report_text_length": F.length(clean).cast("double"), "report_word_count": count(r"(?U)\w+")}
    for name, patterns in signals.items():
        n = term(patterns[0])
        for p in patterns[1:]:
            n = n + term(p)
        out[f"report_{name}_count"] = n
    return out


def signal_flags(signals: Mapping[str, Sequence[str]] = SIGNALS) -> dict[str, Column]:
    """Flags, total and density, from the counts as columns."""
    total = sum((F.col(f"report_{n}_count") for n in list(signals)[1:]), F.col(f"report_{list(signals)[0]}_count"))
    flags = {f"report_{n}_flag": (F.col(f"report_{n}_count") > 0).cast("double") for n in signals}
    return flags | {"report_text_risk_terms_total": total, "report_text_risk_density": total / F.greatest("report_word_count", F.lit(1.0))}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= TINY, F.try_divide(a, b))


def report_ratios() -> dict[str, Column]:
    """Eleven ratios of the metric columns."""
    c = lambda n: F.col(f"report_{n}")
    net_debt, revenue = c("total_debt") - c("cash_and_equivalents"), c("revenue")
    free = F.coalesce(c("free_cash_flow"), c("operating_cash_flow") - F.abs(c("capex")))
    return {
        "report_net_debt": net_debt,
        "report_net_debt_to_ebitda": _ratio(net_debt, c("ebitda")),
        "report_interest_coverage": _ratio(c("ebitda"), F.abs(c("interest_expense"))),
        "report_ebitda_margin": _ratio(c("ebitda"), revenue),
        "report_net_margin": _ratio(c("net_profit"), revenue),
        "report_operating_cf_margin": _ratio(c("operating_cash_flow"), revenue),
        "report_free_cf_margin": _ratio(free, revenue),
        "report_capex_intensity": _ratio(F.abs(c("capex")), revenue),
        "report_equity_ratio": _ratio(c("total_equity"), c("total_assets")),
        "report_debt_to_assets": _ratio(c("total_debt"), c("total_assets")),
        "report_short_debt_share": _ratio(c("short_term_debt"), c("total_debt")),
    }


def report_scores(metrics: Sequence[str] = tuple(METRICS)) -> dict[str, Column]:
    """Extraction quality, financial pressure and missing flags, from metrics, ratios and signals."""
    there = lambda names: sum((F.col(n).isNotNull().cast("double") for n in names), F.lit(0.0))
    ratios = ("report_net_debt_to_ebitda", "report_interest_coverage", "report_ebitda_margin", "report_free_cf_margin", "report_equity_ratio")
    bonus = F.least(F.coalesce(F.col("report_word_count"), F.lit(0.0)) / 5000.0, F.lit(1.0))
    quality = F.least(F.lit(1.0), there(metrics) / 10.0 * 0.55 + there(ratios) / 5.0 * 0.30 + bonus * 0.15)
    part = lambda x: F.coalesce(x, F.lit(0.0))
    pressure = (
        0.35 * part(clip(F.col("report_net_debt_to_ebitda"), -2, 8) / 8.0)
        + 0.25 * part(clip(-F.col("report_free_cf_margin"), -1, 1))
        + 0.20 * part(clip(1.0 / (1.0 + floor_at(F.col("report_interest_coverage"), 0)), 0, 1))
        + 0.20 * part(clip(F.col("report_text_risk_density") * 100.0, 0, 1))
    )
    return {"report_extraction_quality": quality, "report_financial_pressure": pressure, **{f"{m}_missing": F.col(m).isNull().cast("double") for m in metrics}}


def report_features(registry: DataFrame, files: DataFrame | None = None, text: str = "report_text", metrics: Mapping[str, Sequence[str]] = METRICS, signals: Mapping[str, Sequence[str]] = SIGNALS, min_chars: int = 1) -> DataFrame:
    """The feature row of every registry row; none is dropped.

    Text in the registry wins over a file's (files: path, text; joined to local_path).  parse_status says what
    was read: parsed_embedded_text, parsed_file, empty_text or missing_document.  A row without text has null
    features and report_document_available 0.
    """
    df = registry if text in registry.columns else registry.withColumn(text, F.lit(None).cast("string"))
    columns = df.columns
    if files is not None and "local_path" in columns:
        df = df.join(files.select(F.col("path").alias("local_path"), F.col("text").alias("_file")), "local_path", "left").select(*columns, "_file")
    else:
        df = df.withColumn("_file", F.lit(None).cast("string"))
    own, other = F.length(F.trim(text)) >= min_chars, F.length(F.trim("_file")) >= min_chars
    status = F.when(own, "parsed_embedded_text").when(other, "parsed_file").when(F.col(text).isNotNull() | F.col("_file").isNotNull(), "empty_text").otherwise("missing_document")
    df = df.withColumn("parse_status", status).withColumn("_text", F.when(own, F.col(text)).when(other, F.col("_file"))).drop("_file")
    # made once: expressions below a condition are not shared
    df = df.withColumn("_clean", signal_text(F.col("_text"))).withColumn("_odd", F.regexp_like("_clean", F.lit(ODD)))
    df = extract_metrics(df, "_text", metrics, keep=[*columns, "parse_status", "_text", "_clean", "_odd"], clean="_clean", odd="_odd")
    has = F.col("_text").isNotNull()
    for step in (counts_in(F.col("_clean"), F.col("_odd"), signals), signal_flags(signals), report_ratios(), report_scores(tuple(metrics))):
        df = df.withColumns({k: F.when(has, v) for k, v in step.items()})
    return previous_change(df.withColumn("report_document_available", has.cast("double")).drop("_text", "_clean", "_odd"))


def previous_change(df: DataFrame, columns: Sequence[str] = YOY, key: str = "ticker") -> DataFrame:
    """<c>_yoy_change: relative change to the previous report of the key (0 before: null)."""
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("report_period_end"), F.asc_nulls_last("publish_date"))
    change = lambda c: F.try_divide(F.col(c) - F.lag(c).over(order), F.abs(F.lag(c).over(order)))
    return df.withColumns({f"{c}_yoy_change": change(c) for c in columns if c in df.columns})


def period_end(text: Column, year: Column | None = None) -> Column:
    """The end of the period that a title names: quarter, half or nine months of its year, else its last day."""
    t = F.lower(F.coalesce(text, F.lit("")))
    y = F.coalesce(year if year is not None else F.lit(None).cast("int"), F.regexp_extract(t, r"(20\d{2})", 1).try_cast("int"))
    has = lambda p: F.regexp_like(t, F.lit("(?uU)" + p))
    return (
        F.when(has(r"(3\s*месяц|1\s*кв|q1|first\s+quarter)"), F.make_date(y, F.lit(3), F.lit(31)))
        .when(has(r"(6\s*месяц|2\s*кв|q2|half[-\s]?year|six\s+months)"), F.make_date(y, F.lit(6), F.lit(30)))
        .when(has(r"(9\s*месяц|3\s*кв|q3|nine\s+months)"), F.make_date(y, F.lit(9), F.lit(30)))
        .otherwise(F.make_date(y, F.lit(12), F.lit(31)))
    )


def report_type(text: Column) -> Column:
    """The kind of report that a title names, by the first rule that fits."""
    t = F.lower(F.coalesce(text, F.lit("")))
    # Words of each kind, in order.
    rules = {"annual_report": ("annual", "годов"), "ifrs_9m": ("9m", "9 months", "9 мес"), "ifrs_h1": ("h1", "6m", "half", "полуг"), "ifrs_q": ("q1", "1q", "quarter", "кварт"), "ifrs": ("ifrs", "мсфо", "consolidated")}
    out = F.lit("report")
    for kind, words in reversed(rules.items()):
        hit = t.contains(words[0])
        for w in words[1:]:
            hit = hit | t.contains(w)
        out = F.when(hit, kind).otherwise(out)
    return out


def last_modified_date(header: Column, start: str, end: str) -> Column:
    """The date of an RFC 822 header, if it lies in the window."""
    d = F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy")).cast("date")
    return F.when(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")), d)


def coverage(panel: DataFrame, key: str = "ticker", date: str = "decision_date") -> DataFrame:
    """Per key: rows, rows with a report, their rate, ends and the median lag."""
    there = F.col("report_available") > 0
    return panel.groupBy(key).agg(F.count("*").alias("panel_rows"), F.count_if(there).alias("covered_rows"), (F.count_if(there) / F.count("*")).alias("coverage_rate"), F.min(F.when(there, F.col(date))).alias("first_covered"), F.max(F.when(there, F.col(date))).alias("last_covered"), F.percentile(F.when(there, F.col("report_lag_days")), 0.5).alias("median_lag"))


def layer_summary(panel: DataFrame, key: str = "ticker") -> DataFrame:
    return panel.agg(F.count("*").alias("panel_rows"), F.count_distinct(F.when(F.col("report_available") > 0, F.col(key))).alias("issuers"), F.count_if(F.col("report_available") > 0).alias("covered_rows"))


def dataset_summary(panel: DataFrame, key: str = "ticker", sector: str = "sector", date: str = "decision_date") -> DataFrame:
    return panel.agg(F.count("*").alias("panel_rows"), F.count_distinct(key).alias("tickers"), F.count_distinct(sector).alias("sectors"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
