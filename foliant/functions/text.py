"""String, JSON and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Formats and patterns that results must equal.
SOURCES_BLOCK = r"(?is)```sources\s*(\[.*?\])\s*```"
TABLE_TITLE = r"(?i)^TABLE\s+([IVXLCDM]+|\d+)"
STOP_WORDS = "REFERENCE|CONCLUSION|APPENDIX|FIGURE"
CONTEXT_HEAD = "CONTEXT CHUNKS (use these and only these to answer):"
REFUSAL = "I cannot answer this question based on the provided documents."
PERMANENT_ERRORS = ["Docling conversion failed", "pipeline terminated early", "PDF file not found", "CUDA out of memory"]
SOURCES_TYPE = "array<struct<ref:string,document_id:string,page_no:int,chunk_type:string,excerpt:string>>"


def falsy(c: Column) -> Column:
    """Null or empty text."""
    return c.isNull() | (c == "")


def clean_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, "[­￾]", "")


def alnum_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]"))


def ascii_alnum_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z0-9]"))


def non_space_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S"))


def page_class(c: Column, min_alnum: int = 100, min_ratio: float = 0.70) -> Column:
    a, n = alnum_count(c), non_space_count(c)
    return F.when(a < min_alnum, "empty").when(a / n < min_ratio, "garbled").otherwise("ok")


def is_separator(line: Column) -> Column:
    """Whether a table line only draws the rule under a header."""
    t = F.trim(line)
    return t.rlike(r"^\|[|:\- ]*$") & t.contains("-")


def column_count(line: Column) -> Column:
    """Columns of a table line; 0 if it does not begin with a bar."""
    t = F.trim(line)
    inner = F.btrim(t, F.lit("|"))
    return F.when(t.startswith("|"), F.length(inner) - F.length(F.replace(inner, F.lit("|"), F.lit(""))) + 1).otherwise(0)


def longest_cell(line: Column) -> Column:
    cells = F.split(F.btrim(F.trim(line), F.lit("|")), r"\|")
    return F.array_max(F.transform(cells, lambda x: F.length(F.trim(x))))


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30)))), "")


def figure_text(figure_type: Column, caption: Column, description: Column) -> Column:
    lead = F.when(falsy(caption), "").otherwise(F.concat(caption, F.lit(" - ")))
    return F.concat(F.lit("["), title_case(F.coalesce(figure_type, F.lit("figure"))), F.lit(": "), lead, F.coalesce(description, F.lit("")), F.lit("]"))


def formula_text(latex: Column, number: Column, description: Column) -> Column:
    core = F.concat(F.lit("$$"), F.coalesce(latex, F.lit("")), F.lit("$$"), F.when(falsy(number), "").otherwise(F.concat(F.lit(" "), number)))
    return F.when(falsy(description), core).otherwise(F.concat(description, F.lit("\n"), core))


def formula_id(given: Column, page_no: Column, index: Column) -> Column:
    return F.when(falsy(given), F.concat(F.lit("p"), page_no, F.lit("_f"), index)).otherwise(given)


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    text = F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))
    return F.when(seconds.isNull(), "N/A").otherwise(text)


def progress_bar(percent: Column, width: int = 40) -> Column:
    filled = F.floor(F.lit(width) * percent / 100).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled), F.lit("]"))


def short_error(c: Column) -> Column:
    return F.when(F.length(c) > 60, F.concat(F.left(c, F.lit(57)), F.lit("..."))).otherwise(c)


def short_query(c: Column) -> Column:
    return F.when(F.length(c) > 80, F.concat(F.left(c, F.lit(80)), F.lit("..."))).otherwise(c)


def megabytes(c: Column) -> Column:
    return F.when(c >= 1024, F.format_string("%.1f GB", c / 1024)).otherwise(F.format_string("%d MB", c.cast("long")))


def uptime(seconds: Column) -> Column:
    """The two largest units of a running time, the second of two digits."""
    s = F.floor(seconds).cast("long")
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    return (
        F.when(s < 60, F.format_string("%ds", s)).when(m < 60, F.format_string("%dm%02ds", m, s % 60))
        .when(h < 24, F.format_string("%dh%02dm", h, m % 60)).otherwise(F.format_string("%dd%02dh", d, h % 24))
    )


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def batch_id(ts: Column) -> Column:
    return F.concat(F.lit("batch_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def sources(answer: Column) -> Column:
    """Citations of the first fenced sources block; an empty list if there is none or it is malformed."""
    return F.coalesce(F.from_json(F.regexp_extract(answer, SOURCES_BLOCK, 1), SOURCES_TYPE), F.array().cast(SOURCES_TYPE))


def sse(payload: Column) -> Column:
    """One event-stream frame of a struct."""
    return F.concat(F.lit("data: "), F.to_json(payload, {"ignoreNullFields": "false"}), F.lit("\n\n"))


def model_json(text: Column, schema: str) -> Column:
    """Struct (value, error, raw): JSON between the first and last brace of a model's answer, or an error with the first 500 characters."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    value = F.from_json(F.when(F.try_parse_json(inner).isNotNull(), inner), schema)
    bad = value.isNull()
    return F.struct(value.alias("value"), F.when(bad, "invalid JSON").alias("error"), F.when(bad, F.left(text, F.lit(500))).alias("raw"))


def stream_delta(line: Column) -> Column:
    """Text that a line of a model's event stream adds; null for the end, malformed lines and empty deltas."""
    body = F.trim(F.regexp_replace(line, "^data: ", ""))
    got = F.get_json_object(F.when(body != "[DONE]", body), "$.choices[0].delta.content")
    return F.when(got != "", got)


def decoded(value: Column) -> Column:
    """Canonical JSON where the value parses, else the raw text."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def first_pdf_link(downloads: Column) -> Column:
    """First usable link of an array of (mimetype, links(pdf, original)) with a PDF type."""
    links = F.transform(downloads, lambda d: F.when(d["mimetype"] == "application/pdf", F.coalesce(F.when(d["links"]["pdf"] != "", d["links"]["pdf"]), F.when(d["links"]["original"] != "", d["links"]["original"]))))
    return F.get(F.filter(links, lambda x: x.isNotNull()), 0)


def retryable(error: Column, retries: Column, most: int = 1) -> Column:
    permanent = F.lit(False)
    for text in PERMANENT_ERRORS:
        permanent = permanent | error.contains(text)
    return (retries < most) & ~F.coalesce(permanent, F.lit(False))
