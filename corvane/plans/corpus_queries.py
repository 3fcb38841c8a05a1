"""Ingestion, pseudo-documents, chunks and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import SPACE, TIMESTAMP_LINE, joined
from corvane.operators import chunking, ingest
from corvane.sources.tables import table


def _block_files(spark: SparkSession, directory: str) -> DataFrame:
    """One file per pseudo-document: its comments as blocks, each with its written time before it."""
    comments = table(spark, directory, "comments").select("source_id", "text", "timestamp").distinct()
    spans = table(spark, directory, "pseudo_spans").select("doc_id", "source_id", "start_pos").distinct()
    block = F.concat(F.coalesce(F.concat("timestamp", F.lit("\n")), F.lit("")), "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_pos", block.alias("block")))), lambda b: b.block)
    return spans.join(comments, "source_id").groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("content")).withColumnRenamed("doc_id", "path")


def block_records(spark: SparkSession, directory: str) -> DataFrame:
    parsed = ingest.parse_blocks(_block_files(spark, directory))
    return parsed.select("path", F.col("block_no").cast("long").alias("block_no"), ingest.source_tag(F.col("path")).alias("tag"), "timestamp", F.md5("text").alias("text_md5"))


def corpus_dedup(spark: SparkSession, directory: str) -> DataFrame:
    corpus = ingest.deduplicated_corpus(table(spark, directory, "comments"))
    return corpus.select("source_id", "source", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("size"))


def corpus_source_ids(spark: SparkSession, directory: str) -> DataFrame:
    return ingest.corpus_ids(ingest.deduplicated_corpus(table(spark, directory, "comments"))).select("source_id", "corpus_id")


def pseudo_documents(spark: SparkSession, directory: str) -> DataFrame:
    spans = chunking.pseudo_spans(ingest.deduplicated_corpus(table(spark, directory, "comments")))
    return spans.select("doc_id", "source_id", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.document_texts(table(spark, directory, "pseudo_spans"), table(spark, directory, "comments"))


def chunk_fixed(spark: SparkSession, directory: str) -> DataFrame:
    windows = chunking.fixed_windows(_documents(spark, directory))
    return windows.select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.col("start_pos").cast("long").alias("start_pos"), F.md5("text").alias("text_md5"))


def chunk_provenance(spark: SparkSession, directory: str) -> DataFrame:
    found = chunking.provenance(table(spark, directory, "chunks"), table(spark, directory, "pseudo_spans"))
    return found.select("chunk_id", joined(F.col("source_ids")).alias("source_ids"))


def chunk_recursive(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.chunk_ids(chunking.recursive_chunks(_documents(spark, directory)))


QUERIES = {f.__name__: f for f in (block_records, corpus_dedup, corpus_source_ids, pseudo_documents, chunk_fixed, chunk_provenance, chunk_recursive)}

CORPUS_SQL = f"""corpus AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY ingested_at, source_id) AS place
    FROM (SELECT source_id, lower(trim(source)) AS source, ingested_at, trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) AS text FROM comments)
    WHERE length(text) >= {ingest.LEAST_LENGTH})
  WHERE place = 1)"""
DOCUMENTS_SQL = """docs AS (
  SELECT doc_id, string_agg(text, chr(10) ORDER BY start_pos) AS doc_text
  FROM (SELECT DISTINCT doc_id, source_id, start_pos FROM pseudo_spans) JOIN (SELECT DISTINCT source_id, text FROM comments) USING (source_id) GROUP BY doc_id)"""

ORACLES = {
    "block_records": f"""
WITH files AS (
  SELECT doc_id AS path, string_agg(coalesce("timestamp" || chr(10), '') || text, chr(10) || chr(10) ORDER BY start_pos) AS content
  FROM (SELECT DISTINCT doc_id, source_id, start_pos FROM pseudo_spans) JOIN (SELECT DISTINCT source_id, text, "timestamp" FROM comments) USING (source_id) GROUP BY doc_id),
split AS (SELECT path, regexp_split_to_array(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '\\n{SPACE}*\\n') AS blocks FROM files),
blocks AS (SELECT path, unnest(range(len(blocks))) AS block_no, unnest(blocks) AS block FROM split),
lines AS (SELECT path, block_no, list_filter(list_transform(string_split(block, chr(10)), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '') AS lines FROM blocks),
parsed AS (
  SELECT path, block_no, CASE WHEN regexp_matches(lines[1], '{TIMESTAMP_LINE}') THEN lines[1] END AS "timestamp",
    CASE WHEN regexp_matches(lines[1], '{TIMESTAMP_LINE}') THEN array_to_string(lines[2:], ' ') ELSE array_to_string(lines, ' ') END AS text
  FROM lines WHERE len(lines) > 0)
SELECT path, block_no, CASE WHEN contains(lower(path), 'reddit') THEN 'reddit' ELSE 'yt' END AS tag, "timestamp", md5(text) AS text_md5 FROM parsed WHERE text <> ''""",
    "corpus_dedup": f"WITH {CORPUS_SQL} SELECT source_id, source, md5(text) AS text_md5, length(text) AS size FROM corpus",
    "corpus_source_ids": f"WITH {CORPUS_SQL} SELECT source_id, format('{{}}:{{:05d}}', source, row_number() OVER (PARTITION BY source ORDER BY ingested_at, source_id) - 1) AS corpus_id FROM corpus",
    "pseudo_documents": f"""
WITH {CORPUS_SQL},
placed AS (SELECT source_id, length(text) AS size, row_number() OVER (ORDER BY ingested_at, source_id) - 1 AS rn FROM corpus),
spans AS (SELECT *, rn // {chunking.GROUP} AS d, coalesce(sum(size + 1) OVER (PARTITION BY rn // {chunking.GROUP} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos FROM placed)
SELECT format('doc{{:04d}}', d) AS doc_id, source_id, CAST(start_pos AS BIGINT) AS start_pos, CAST(start_pos + size AS BIGINT) AS end_pos FROM spans""",
    "chunk_fixed": f"""
WITH {DOCUMENTS_SQL},
numbers AS (SELECT doc_id, doc_text, unnest(range(greatest(CAST(ceil((length(doc_text) - 64) / 448.0) AS BIGINT), 1))) AS window_no FROM docs WHERE doc_text <> '')
SELECT doc_id, window_no, window_no * 448 AS start_pos, md5(substring(doc_text, CAST(window_no * 448 + 1 AS BIGINT), 512)) AS text_md5 FROM numbers""",
    "chunk_provenance": """
WITH once AS (SELECT DISTINCT chunk_id, doc_id, start_pos, start_pos + length(text) AS stop FROM chunks),
parts AS (SELECT DISTINCT doc_id, source_id, start_pos, end_pos FROM pseudo_spans)
SELECT c.chunk_id, coalesce(string_agg(s.source_id, ',' ORDER BY s.start_pos), '') AS source_ids
FROM once c LEFT JOIN parts s ON c.doc_id = s.doc_id AND s.start_pos < c.stop AND s.end_pos > c.start_pos GROUP BY c.chunk_id""",
}
