"""The jobs as registered queries: each runs its job twice over the whole table into one new folder and gives the output after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.domain import ctes
from foliant.session import fresh_folder
from jobs import chunk_ingest, text_triage
from jobs.common import config


def job1_text_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = fresh_folder(spark, "text_triage")
    for _ in range(2):
        out = text_triage.run(spark, f"{sf_dir}/documents.parquet", output, config("text_triage"))
    return out


def job2_chunk_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "chunk_ingest")
    for _ in range(2):
        out = chunk_ingest.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/chunks", f"{folder}/checkpoint", config("chunk_ingest"))
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_text_triage, job2_chunk_ingest)}

ORACLE_SQL: dict[str, str] = {
    "job1_text_triage": ctes("slices")
    + r""",
pq AS (SELECT doc_id, page_no, len(regexp_extract_all(text, '[\p{L}\p{N}]')) AS a, len(regexp_extract_all(text, '[^\s\x{00A0}\x{0085}\x{000B}\x{001C}-\x{001F}]')) AS n, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS alphanum FROM slices WHERE doc_id IS NOT NULL),
pc AS (SELECT doc_id, page_no, alphanum, CASE WHEN a < 100 THEN 'empty' WHEN a / n < 0.7 THEN 'garbled' ELSE 'ok' END AS kind FROM pq),
dq AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE kind = 'ok') AS ok_pages, count(*) FILTER (WHERE kind = 'empty') AS empty_pages, count(*) FILTER (WHERE kind = 'garbled') AS garbled_pages,
  CAST(sum(alphanum) AS BIGINT) AS alphanum_chars, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER (WHERE kind = 'garbled') AS ocr_pages FROM pc GROUP BY doc_id),
one AS (SELECT doc_id, min(source) AS source, min(lang) AS lang FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
j AS (SELECT one.*, coalesce(pages, 0) AS pages, coalesce(ok_pages, 0) AS ok_pages, coalesce(empty_pages, 0) AS empty_pages, coalesce(garbled_pages, 0) AS garbled_pages, coalesce(alphanum_chars, 0) AS alphanum_chars, coalesce(ocr_pages, '') AS ocr_pages FROM one LEFT JOIN dq USING (doc_id))
SELECT *, CASE WHEN pages = empty_pages THEN 'empty' WHEN garbled_pages / (pages - empty_pages) > 0.3 THEN 'ocr' WHEN garbled_pages > 0 THEN 'partial' ELSE 'text' END AS route FROM j""",
    "job2_chunk_ingest": r"""WITH d AS (SELECT doc_id, max(text) AS text, max(lang) AS lang FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
l AS (SELECT doc_id, lang, CAST(generate_subscripts(a, 1) - 1 AS INT) AS ord, unnest(a) AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS a FROM d)),
c AS (SELECT *, CASE WHEN regexp_matches(trim(text, ' '), '^\|.*\|$') THEN 'table' ELSE 'text' END AS chunk_type FROM l WHERE trim(text, ' ') <> ''),
m AS (SELECT *, CASE WHEN chunk_type = 'text' AND length(text) < 150 AND coalesce(lag(chunk_type) OVER w = 'text', FALSE) THEN 0 ELSE 1 END AS starts FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY ord) AS gid FROM m),
s AS (SELECT doc_id, min(ord) AS ord, arg_min(chunk_type, ord) AS chunk_type, string_agg(text, chr(10) ORDER BY ord) AS text, min(lang) AS lang FROM g GROUP BY doc_id, gid)
SELECT 'documents' AS collection, sha256('documents|' || doc_id || '|' || ord) AS point_id, doc_id, ord, chunk_type, text, CAST(1 + floor(ord / 40) AS INT) AS page_no, lang, length(text) AS n_chars, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n_terms FROM s""",
}
