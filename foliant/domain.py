"""The domain's tables derived from the test tables, by one SQL text for Spark and DuckDB.

Each entry of SQL is a query over earlier entries and raw tables; DuckDB takes them as common
table expressions, Spark as nested DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

RAW = ("documents", "embeddings", "benchmark", "conversations", "events", "pages")

SQL: dict[str, str] = {
    "boxes": """
        SELECT doc_id, CAST(2 * pos AS INT) AS seq, pos, CASE pos % 10 WHEN 2 THEN 'table' WHEN 7 THEN 'picture' ELSE 'text' END AS item_type,
               CASE WHEN pos % 9 = 0 THEN 'section_header' WHEN pos % 19 = 8 THEN 'formula' ELSE 'text' END AS label,
               CAST(1 + pos % 3 AS INT) AS level, text, CAST(floor(pos / 20) + 1 AS INT) AS page_no,
               CAST(CASE WHEN pos % 13 = 5 THEN 60 ELSE 50 END AS DOUBLE) AS l,
               CAST(CASE WHEN pos % 13 = 5 AND pos % 20 > 0 THEN 780 - 36 * (pos % 20 - 1) - 5 ELSE 780 - 36 * (pos % 20) END AS DOUBLE) AS t,
               CAST(CASE WHEN pos % 13 = 5 THEN 90 WHEN pos % 17 = 4 THEN 65 ELSE 550 END AS DOUBLE) AS r,
               CAST(CASE WHEN pos % 13 = 5 AND pos % 20 > 0 THEN 780 - 36 * (pos % 20 - 1) - 25 WHEN pos % 17 = 4 THEN 780 - 36 * (pos % 20) - 8 ELSE 780 - 36 * (pos % 20) - 30 END AS DOUBLE) AS b
        FROM lines""",
    "items": """
        SELECT doc_id, seq, item_type, label, level, text, page_no, l, t, r, b FROM boxes
        UNION ALL
        SELECT doc_id, CAST(2 * pos + 1 AS INT), 'picture', 'text', level, '', page_no, CAST(50 AS DOUBLE), CAST(780 - 36 * (pos % 20) AS DOUBLE), CAST(550 AS DOUBLE), CAST(780 - 36 * (pos % 20) - 30 AS DOUBLE)
        FROM boxes WHERE pos % 10 = 2 AND doc_id % 2 = 0""",
    "chunks": """
        SELECT doc_id, CAST(pos AS INT) AS ord, CASE WHEN pos % 10 = 2 THEN 'table' ELSE 'text' END AS chunk_type, text, CAST(floor(pos / 20) + 1 AS INT) AS page_no,
               CAST(floor(pos / 7) AS INT) AS section FROM lines""",
    "points": """
        SELECT d.doc_id AS point_id, d.source AS doc_id, d.text AS text, CAST(1 + d.doc_id % 9 AS INT) AS page_no, CASE WHEN d.doc_id % 10 = 0 THEN 'table' ELSE 'text' END AS chunk_type, d.lang AS lang
        FROM documents d""",
    "vlm": """
        SELECT doc_id, seq, page_no, t + (pos % 4) - 1 AS t, TRUE AS success,
               CASE doc_id % 3 WHEN 0 THEN 'Title' || chr(10) || '| Name | Value |' || chr(10) || '|---|---|' || chr(10) || '| a | ' || text || ' |'
                               WHEN 1 THEN '| Name | Value | Unit |' || chr(10) || '| :-- | --: | - |' || chr(10) || '| a | b | ' || replace(text, '|', ' ') || ' |' || chr(10) || '| x | y | z |'
                               ELSE '| a | b | c | d |' || chr(10) || '| 1 | 2 | 3 | 4 |' END AS markdown
        FROM boxes WHERE item_type = 'table'""",
    "state": """
        SELECT CAST(user_id % 10 AS INT) AS batch, event_id AS doc_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'complete' END AS state,
               CAST(1000 + event_id % 5000 AS DOUBLE) AS start_ts, CAST(1000 + event_id % 5000 AS DOUBLE) + abs(value) AS end_ts, CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE abs(value) END AS duration,
               CAST(event_id % 7 AS INT) AS pages, CASE WHEN event_type = 'error' AND event_id % 3 > 0 THEN 'worker ' || CAST(event_id AS VARCHAR(20)) || ' stopped: CUDA out of memory while it was running the layout model' END AS error
        FROM events""",
    "slices": """
        SELECT doc_id, CAST(pos + 1 AS INT) AS page_no, text FROM numbered""",
}

DUCK_BASE = {
    "lines": "SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)",
    "numbered": "SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS text FROM (SELECT doc_id, regexp_extract_all(text, '(?s).{1,500}') AS a FROM documents)",
}
DEPENDS = {"boxes": ["lines"], "items": ["boxes"], "chunks": ["lines"], "vlm": ["boxes"], "slices": ["numbered"], "points": ["documents"], "state": ["events"]}


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived or raw table as a DataFrame."""
    if name == "lines":
        d = _raw(spark, sf_dir, "documents")
        return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    if name == "numbered":
        d = _raw(spark, sf_dir, "documents")
        return d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,500}"), F.lit(0))).alias("pos", "text"))
    if name not in SQL:
        return _raw(spark, sf_dir, name)
    needs = DEPENDS[name]
    text = reduce(lambda s, n: s.replace(f"FROM {n}", f"FROM {{{n}}}"), needs, SQL[name])
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in needs})


def ctes(*names: str) -> str:
    """WITH clause for DuckDB with the named tables and what they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        for n in DEPENDS.get(name, []):
            if n in DUCK_BASE or n in SQL:
                add(n)
        if name in DUCK_BASE or name in SQL:
            done.setdefault(name, DUCK_BASE.get(name) or SQL[name])

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in done.items())
