"""Indexes, searches, fusion, gates and second scores over the chunks and golden questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import RetrievalConfig
from corvane.functions.text import TOKEN
from corvane.operators import bm25, fusion, reranking, vectors
from corvane.operators.durable import cut
from corvane.operators.ranking import rounded
from corvane.sources.tables import table

DEPTH = 20
GATE = RetrievalConfig(rerank="auto", k=10, rerank_candidates=DEPTH, auto_top=0.55, auto_margin=0.05)


def questions(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "golden_items").select(F.col("id").alias("qid"), "question").distinct()


def long_ranks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.col("rank").cast("long"))


def term_stats(spark: SparkSession, directory: str) -> DataFrame:
    index = bm25.build_bm25(table(spark, directory, "chunks"))
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def bm25_idf(spark: SparkSession, directory: str) -> DataFrame:
    return bm25.build_bm25(table(spark, directory, "chunks")).idf.select("term", "df", rounded(F.col("idf")).alias("idf"))


def sparse_list(spark: SparkSession, directory: str, n: int = DEPTH) -> DataFrame:
    return bm25.search_bm25(bm25.build_bm25(table(spark, directory, "chunks")), questions(spark, directory), n)


def bm25_topk(spark: SparkSession, directory: str) -> DataFrame:
    return long_ranks(sparse_list(spark, directory, 10))


def dense_topk(spark: SparkSession, directory: str) -> DataFrame:
    """Every hundredth vector against all vectors but itself."""
    found = table(spark, directory, "embeddings").select("vec_id", "embedding")
    asked = found.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return long_ranks(vectors.search_vectors(asked, found, 10, query_id="query_id", item_id="vec_id", leave_out_self=True))


def dense_top_score(spark: SparkSession, directory: str) -> DataFrame:
    found = dense_topk(spark, directory).withColumnRenamed("query_id", "qid")
    asked = table(spark, directory, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"))
    return vectors.top_scores(found, asked)


def hash_embed(spark: SparkSession, directory: str) -> DataFrame:
    embedded = vectors.hash_embed(table(spark, directory, "chunks").select("chunk_id", "text").distinct())
    return embedded.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0").select("chunk_id", F.col("bucket").cast("long").alias("bucket"), rounded(F.col("weight")).alias("weight"))


def dense_list(spark: SparkSession, directory: str, n: int = DEPTH) -> DataFrame:
    asked = vectors.hash_embed(questions(spark, directory), id_col="qid", text_col="question")
    return vectors.search_vectors(asked, vectors.hash_embed(table(spark, directory, "chunks").select("chunk_id", "text").distinct()), n)


def dense_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return long_ranks(dense_list(spark, directory))


def hybrid_list(spark: SparkSession, directory: str, n: int = DEPTH) -> DataFrame:
    return fusion.fuse([dense_list(spark, directory, n), sparse_list(spark, directory, n)], n)


def hybrid_rrf(spark: SparkSession, directory: str) -> DataFrame:
    return long_ranks(hybrid_list(spark, directory))


def adaptive_gate(spark: SparkSession, directory: str) -> DataFrame:
    """The gate over the given ranked lists; items without candidates aren't confident and not reranked."""
    ranked = table(spark, directory, "ranked").select("qid", "score", "rank").distinct()
    asked = questions(spark, directory)
    sure = reranking.confidence(ranked, asked, GATE)
    return sure.join(reranking.gate(ranked, asked, GATE), "qid")


def second_scores(spark: SparkSession, directory: str, ranked: DataFrame) -> DataFrame:
    return reranking.coverage_scores(ranked, questions(spark, directory), bm25.build_bm25(table(spark, directory, "chunks")))


def rerank_topk(spark: SparkSession, directory: str) -> DataFrame:
    """Dense candidates, all reranked."""
    ranked = cut(dense_list(spark, directory))
    gated = reranking.gate(ranked, questions(spark, directory), GATE.with_(rerank="always"))
    return long_ranks(reranking.rerank(ranked, gated, second_scores(spark, directory, ranked), 10)).drop("signal")


def adaptive_rerank(spark: SparkSession, directory: str) -> DataFrame:
    """Dense candidates, reranked where the first doesn't stand out; the scorer sees only those."""
    ranked = cut(dense_list(spark, directory))
    gated = cut(reranking.gate(ranked, questions(spark, directory), GATE))
    needed = ranked.join(gated.where("rerank"), "qid", "left_semi")
    return long_ranks(reranking.rerank(ranked, gated, second_scores(spark, directory, needed), 10))


QUERIES = {f.__name__: f for f in (term_stats, bm25_idf, bm25_topk, dense_topk, dense_top_score, hash_embed, dense_chunks, hybrid_rrf, adaptive_gate, rerank_topk, adaptive_rerank)}

BASE_SQL = f"""ch AS (SELECT DISTINCT chunk_id, text FROM chunks),
qs AS (SELECT DISTINCT id AS qid, question FROM golden_items),
lens AS (SELECT chunk_id, text, regexp_extract_all(lower(text), '{TOKEN}', 1) AS terms FROM ch),
totals AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM lens),
tf AS (SELECT chunk_id, term, dl, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM lens) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, totals),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {bm25.EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def sparse_sql(n: int) -> str:
    return f"""qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '{TOKEN}', 1)) AS term FROM qs) GROUP BY ALL),
bm AS (SELECT qid, chunk_id, round(sum(qtf * idf * tf * {bm25.K1 + 1} / (tf + {bm25.K1} * (1 - {bm25.B} + {bm25.B} * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term), totals GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT qid, chunk_id, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0.0) DESC, chunk_id) - 1 AS rank FROM qs CROSS JOIN ch LEFT JOIN bm USING (qid, chunk_id)) WHERE rank < {n})"""


def dense_sql(n: int) -> str:
    embed = "SELECT {id}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {id})) AS weight FROM (SELECT {id}, cast('0x' || substr(md5(t), 1, 8) AS bigint) % 64 AS bucket, CAST(count(*) AS DOUBLE) AS c FROM (SELECT {id}, unnest({terms}) AS t FROM {table}) GROUP BY ALL)"
    return f"""cv AS ({embed.format(id="chunk_id", terms="terms", table="lens")}),
qv AS ({embed.format(id="qid", terms=f"regexp_extract_all(lower(question), '{TOKEN}', 1)", table="qs")}),
dots AS (SELECT qid, chunk_id, round(sum(qv.weight * cv.weight), 6) AS score FROM qv JOIN cv USING (bucket) GROUP BY ALL),
dense AS (SELECT * FROM (SELECT qid, chunk_id, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0.0) DESC, chunk_id) - 1 AS rank FROM qs CROSS JOIN ch LEFT JOIN dots USING (qid, chunk_id)) WHERE rank < {n})"""


PAIR_SQL = f"""qw AS (SELECT qid, term, coalesce(idf, ln(n + 0.5) - ln(0.5)) AS w FROM (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(question), '{TOKEN}', 1)) AS term FROM qs) LEFT JOIN idf USING (term), totals),
whole AS (SELECT qid, sum(w) AS whole FROM qw GROUP BY qid),
pairs AS (SELECT qid, chunk_id, round(10 * coalesce(sum(w) FILTER (WHERE list_contains(terms, term)) / any_value(whole), 0.0) - 5, 6) AS pair_score
  FROM dense JOIN lens USING (chunk_id) LEFT JOIN qw USING (qid) LEFT JOIN whole USING (qid) GROUP BY qid, chunk_id)"""
DENSE_GATE_SQL = f"""sure AS (SELECT qid, max(score) FILTER (WHERE rank = 0) AS top, round(max(score) FILTER (WHERE rank = 0) - coalesce(avg(score) FILTER (WHERE rank > 0), max(score) FILTER (WHERE rank = 0)), 6) AS margin FROM dense GROUP BY qid),
gated AS (SELECT qid, NOT coalesce(top >= {GATE.auto_top} AND margin >= {GATE.auto_margin}, false) AS rerank FROM sure)"""
_VECTORS = "vs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), found AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 6) AS score FROM vs a, vs b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM found) WHERE rank < 10)"

ORACLES = {
    "term_stats": f"WITH {BASE_SQL} SELECT term, df, occurrences FROM dfs",
    "bm25_idf": f"WITH {BASE_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {BASE_SQL}, {sparse_sql(10)} SELECT qid, chunk_id, score, rank FROM sparse",
    "dense_topk": f"WITH {_VECTORS} SELECT query_id, vec_id, score, rank FROM top",
    "dense_top_score": f"WITH {_VECTORS} SELECT vec_id AS qid, coalesce(max(score), 0.0) AS top_score FROM (SELECT vec_id FROM vs WHERE vec_id % 100 = 0) q LEFT JOIN (SELECT query_id, score FROM top) t ON q.vec_id = t.query_id GROUP BY vec_id",
    "hash_embed": f"WITH {BASE_SQL}, {dense_sql(1)} SELECT chunk_id, bucket, round(weight, 6) AS weight FROM cv",
    "dense_chunks": f"WITH {BASE_SQL}, {dense_sql(DEPTH)} SELECT qid, chunk_id, score, rank FROM dense",
    "hybrid_rrf": f"""WITH {BASE_SQL}, {dense_sql(DEPTH)}, {sparse_sql(DEPTH)},
fused AS (SELECT qid, chunk_id, round(sum(1 / (60.0 + rank)), 6) AS score FROM (SELECT qid, chunk_id, rank FROM dense UNION ALL SELECT qid, chunk_id, rank FROM sparse) GROUP BY ALL)
SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS rank FROM fused) WHERE rank < {DEPTH}""",
    "adaptive_gate": f"""WITH r AS (SELECT DISTINCT qid, score, rank FROM ranked), q AS (SELECT DISTINCT id AS qid FROM golden_items),
s AS (SELECT qid, max(score) FILTER (WHERE rank = 0) AS top, avg(score) FILTER (WHERE rank > 0) AS tail FROM r GROUP BY qid),
j AS (SELECT qid, top, round(top - coalesce(tail, top), 6) AS margin FROM s)
SELECT qid, top, margin, coalesce(top >= {GATE.auto_top} AND margin >= {GATE.auto_margin}, false) AS confident,
  top IS NOT NULL AND NOT coalesce(top >= {GATE.auto_top} AND margin >= {GATE.auto_margin}, false) AS rerank FROM q LEFT JOIN j USING (qid)""",
    "rerank_topk": f"WITH {BASE_SQL}, {dense_sql(DEPTH)}, {PAIR_SQL} SELECT * FROM (SELECT qid, chunk_id, pair_score AS score, row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, chunk_id) - 1 AS rank FROM pairs) WHERE rank < 10",
    "adaptive_rerank": f"""WITH {BASE_SQL}, {dense_sql(DEPTH)}, {PAIR_SQL}, {DENSE_GATE_SQL}
SELECT * FROM (SELECT qid, chunk_id, pair_score AS score, row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, chunk_id) - 1 AS rank, 'ce' AS signal FROM pairs JOIN gated USING (qid) WHERE rerank) WHERE rank < 10
UNION ALL SELECT qid, chunk_id, score, rank, 'cosine' AS signal FROM dense JOIN gated USING (qid) WHERE NOT rerank AND rank < 10""",
}
