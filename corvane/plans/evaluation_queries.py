"""Golden items, metrics, statistics, grading, the corrective loop, prompts and judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.config import RetrievalConfig
from corvane.engine import Engine
from corvane.functions.text import SPACE, TOKEN, phrase_pattern
from corvane.models import ChatModel, ScriptedChat
from corvane.operators import corrective, generation, golden, metrics, stats
from corvane.operators.durable import cut
from corvane.operators.ranking import rounded
from corvane.plans.retrieval_queries import BASE_SQL, PAIR_SQL, dense_sql, questions
from corvane.sources.tables import table

PHRASES = [
    ("r01", ["main camera"]),
    ("r02", ["charging brick", "barely lasts"]),
    ("r03", ["fingerprint*"]),
    ("r04", ["night mode", "get* warm*"]),
    ("r05", ["sim tray"]),
    ("r06", ["144hz"]),
    ("r07", ["wifi chip", "rain*"]),
    ("r08", []),
    ("r09", ["bater*"]),
    ("r10", ["no such phrase anywhere"]),
    ("r11", ["fold 2"]),
    ("r12", ["über*"]),
]
THRESHOLDS = [0.25, 0.30, 0.35, 0.40, 0.45, 0.50]
CORRECTIVE = RetrievalConfig(k=5, rerank="auto", auto_top=0.6, auto_margin=0.05, cosine_relevant=0.68, cosine_incorrect=0.62, scored_relevant=1.0, scored_incorrect=-1.0, relax_step=0.05, mode="crag")
REWRITES = [(r"Query: [^\n]*(battery|charg)", "battery life of the phone"), (r"Query: [^\n]*camera", "camera in the dark")]
FLOORS = [("given", "recall_5", 0.05), ("given", "mrr", 0.9), ("by_id", "recall_5", 0.05)]


def golden_resolve(spark: SparkSession, directory: str) -> DataFrame:
    return golden.resolve(PHRASES, table(spark, directory, "comments"))


def golden_set(spark: SparkSession, directory: str) -> DataFrame:
    return golden.golden_set(table(spark, directory, "golden_items"))


def golden_type_counts(spark: SparkSession, directory: str) -> DataFrame:
    rows = golden_set(spark, directory)
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("is_refuse").cast("long")).alias("n_refuse"), F.sum("n_gold").alias("n_gold"))


def arm_lists(spark: SparkSession, directory: str) -> DataFrame:
    """(arm, qid, chunk_id, rank): the given lists, and the same candidates in two other orders."""
    given = table(spark, directory, "ranked").select("qid", "chunk_id", F.length("text").alias("size"), F.col("rank").cast("int").alias("rank")).distinct()
    ways = {"given": [F.col("rank"), F.col("chunk_id")], "by_length": [F.desc("size"), F.col("chunk_id")], "by_id": [F.col("chunk_id")]}
    parts = [given.select(F.lit(arm).alias("arm"), "qid", "chunk_id", (F.row_number().over(Window.partitionBy("qid").orderBy(*order)) - 1).alias("rank")) for arm, order in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _judged(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hits, answerable items, relevant counts, arms)."""
    items = table(spark, directory, "golden_items")
    gold, sources = golden.gold_pairs(items), golden.chunk_sources(table(spark, directory, "chunks"))
    hits = metrics.hit_ranks(arm_lists(spark, directory), sources, gold)
    answerable = golden.golden_set(items).where(~F.col("is_refuse")).select(F.col("id").alias("qid"), "type")
    arms = spark.createDataFrame([("given",), ("by_length",), ("by_id",)], "arm string")
    return hits, answerable, metrics.relevant_chunks(answerable, sources, gold), arms


def hit_ranks(spark: SparkSession, directory: str) -> DataFrame:
    return _judged(spark, directory)[0].withColumn("rank", F.col("rank").cast("long"))


def n_relevant_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return _judged(spark, directory)[2]


def retrieval_metrics(spark: SparkSession, directory: str) -> DataFrame:
    hits, items, relevant, arms = _judged(spark, directory)
    return metrics.retrieval_metrics(hits, items.select("qid"), relevant, arms)


def per_type_breakdown(spark: SparkSession, directory: str) -> DataFrame:
    hits, items, _, arms = _judged(spark, directory)
    return metrics.by_type(hits, items, arms)


def _top(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "ranked").groupBy("qid").agg(F.max("score").alias("top_score"))


def refusal_metrics(spark: SparkSession, directory: str) -> DataFrame:
    items = golden_set(spark, directory).select(F.col("id").alias("qid"), "is_refuse")
    return metrics.refusals(_top(spark, directory), items, [RetrievalConfig().refusal_cosine])


def risk_coverage(spark: SparkSession, directory: str) -> DataFrame:
    items = golden_set(spark, directory).select(F.col("id").alias("qid"), "is_refuse")
    return metrics.refusals(_top(spark, directory), items, THRESHOLDS)


def latency_mean_p95(spark: SparkSession, directory: str) -> DataFrame:
    found = metrics.nearest_rank(table(spark, directory, "events"), "event_type", "value", 0.95)
    return found.select("event_type", "n", rounded(F.col("mean")).alias("mean_value"), F.col("at").alias("p95"))


def mcnemar(spark: SparkSession, directory: str) -> DataFrame:
    hits, items, _, arms = _judged(spark, directory)
    return stats.compare(stats.paired(hits, items.select("qid"), arms, "given"))


def bootstrap_ci(spark: SparkSession, directory: str) -> DataFrame:
    hits, items, _, arms = _judged(spark, directory)
    return stats.bootstrap(cut(stats.paired(hits, items.select("qid"), arms, "given")))


def grade_threshold(spark: SparkSession, directory: str) -> DataFrame:
    ranked = table(spark, directory, "ranked").select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), F.lit("cosine").alias("signal")).distinct()
    return corrective.grade(ranked, questions(spark, directory), RetrievalConfig()).drop("signal")


def _corrected(spark: SparkSession, directory: str, config: RetrievalConfig = CORRECTIVE, model: ChatModel | None = None) -> corrective.Loop:
    return Engine(table(spark, directory, "chunks"), config, model=model).corrective(questions(spark, directory))


def _rounds(loop: corrective.Loop) -> DataFrame:
    kept = F.array_join("kept_chunk_ids", ",").alias("kept")
    return corrective.all_rounds(loop).select("qid", F.col("round_idx").cast("long").alias("round_idx"), "query", "n_candidates", "reranked", "action", kept, "n_kept", "correction")


def corrective_trace(spark: SparkSession, directory: str) -> DataFrame:
    """Every round of every question, by the keyless loop, which gates, scores and widens."""
    return _rounds(_corrected(spark, directory))


def corrective_contexts(spark: SparkSession, directory: str) -> DataFrame:
    """The final contexts; a refused question has one row without a chunk."""
    contexts = _corrected(spark, directory).contexts
    return questions(spark, directory).select("qid").join(contexts, "qid", "left").select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").isNull().alias("refused"))


def corrective_calls(spark: SparkSession, directory: str) -> DataFrame:
    """How often each question's candidates were scored again, in its rounds and for a pool of mixed signals."""
    found = _corrected(spark, directory, CORRECTIVE.with_(loop="plain")).calls
    return questions(spark, directory).select("qid").join(found, "qid", "left").select("qid", F.coalesce("calls", F.lit(0)).alias("calls"))


def corrective_rewrite(spark: SparkSession, directory: str) -> DataFrame:
    """The rounds of a loop whose scripted model rewrites questions about batteries and cameras; the others are widened."""
    return _rounds(_corrected(spark, directory, CORRECTIVE.with_(rerank="never", correction_rounds=1), ScriptedChat(REWRITES, "")))


def _contexts(spark: SparkSession, directory: str, n: int) -> DataFrame:
    return table(spark, directory, "ranked").where(F.col("rank") < n).select("qid", "chunk_id", "text", F.col("rank").cast("int").alias("rank")).distinct()


def prompt_build(spark: SparkSession, directory: str) -> DataFrame:
    return generation.build_prompts(questions(spark, directory), _contexts(spark, directory, 3))


def citation_expand(spark: SparkSession, directory: str) -> DataFrame:
    """The golden answers with made-up citations, one of them beyond every list."""
    answers = table(spark, directory, "golden_items").select(F.col("id").alias("qid"), F.concat(F.coalesce("answer", F.lit("")), F.lit(" [2][1] and [99], [2] ")).alias("answer")).distinct()
    return generation.expand_citations(answers, _contexts(spark, directory, 5))


def judge_means(spark: SparkSession, directory: str) -> DataFrame:
    """Mean judgements of the answerable golden answers against their first five contexts, by type."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s.text), " ")
    contexts = _contexts(spark, directory, 5).groupBy("qid").agg(lines.alias("context"))
    items = table(spark, directory, "golden_items").select(F.col("id").alias("qid"), "question", "answer", "type").distinct()
    answerable = golden_set(spark, directory).where(~F.col("is_refuse")).select(F.col("id").alias("qid"))
    samples = items.join(answerable, "qid", "left_semi").join(contexts, "qid", "left")
    judged = generation.judge(samples).join(items.select("qid", "type"), "qid")
    return judged.groupBy("type").agg(F.count("*").alias("n"), rounded(F.avg("faithfulness")).alias("faithfulness"), rounded(F.avg("relevancy")).alias("relevancy"))


def regression_gate(spark: SparkSession, directory: str) -> DataFrame:
    """Each floor against what its arm reached, and whether all hold."""
    floors = spark.createDataFrame(FLOORS, "arm string, metric string, floor double")
    reached = retrieval_metrics(spark, directory).select("arm", F.expr("stack(2, 'recall_5', recall_5, 'mrr', mrr) AS (metric, got)"))
    rows = floors.join(reached, ["arm", "metric"], "left").withColumn("passed", F.coalesce(F.col("got") >= F.col("floor"), F.lit(False)))
    return rows.withColumn("all_passed", F.min("passed").over(Window.partitionBy()))


QUERIES = {
    f.__name__: f
    for f in (corrective_calls, corrective_rewrite, golden_resolve, golden_set, golden_type_counts, hit_ranks, n_relevant_chunks, retrieval_metrics, per_type_breakdown, refusal_metrics, risk_coverage, latency_mean_p95, mcnemar, bootstrap_ci, grade_threshold, corrective_trace, corrective_contexts, prompt_build, citation_expand, judge_means, regression_gate)
}

GOLDEN_SQL = """gs AS (SELECT DISTINCT id, type, difficulty, coalesce(type = 'refuse', false) OR coalesce(len(list_distinct(gold_source_ids)), 0) = 0 AS is_refuse, coalesce(len(list_distinct(gold_source_ids)), 0) AS n_gold FROM golden_items),
gold AS (SELECT DISTINCT id AS qid, unnest(gold_source_ids) AS source_id FROM golden_items),
src AS (SELECT DISTINCT chunk_id, unnest(source_ids) AS source_id FROM chunks),
answerable AS (SELECT id AS qid, type FROM gs WHERE NOT is_refuse),
relevant AS (SELECT qid, count(DISTINCT chunk_id) AS n_relevant FROM answerable LEFT JOIN gold USING (qid) LEFT JOIN src USING (source_id) GROUP BY qid)"""
ARMS_SQL = """given AS (SELECT DISTINCT qid, chunk_id, length(text) AS size, rank FROM ranked),
lists AS (
  SELECT 'given' AS arm, qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank, chunk_id) - 1 AS rank FROM given
  UNION ALL SELECT 'by_length', qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY size DESC, chunk_id) - 1 FROM given
  UNION ALL SELECT 'by_id', qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) - 1 FROM given),
arms AS (SELECT DISTINCT arm FROM (VALUES ('given'), ('by_length'), ('by_id')) t(arm))"""
METRICS_SQL = """serving AS (SELECT DISTINCT qid, chunk_id FROM src JOIN gold USING (source_id)),
hits AS (SELECT arm, qid, l.chunk_id, rank, s.chunk_id IS NOT NULL AS hit FROM lists l LEFT JOIN serving s USING (qid, chunk_id)),
items AS (SELECT arm, qid, type, first, coalesce(dcg, 0.0) AS dcg, coalesce(1.0 / (first + 1), 0.0) AS rr FROM answerable CROSS JOIN arms LEFT JOIN
  (SELECT arm, qid, min(rank) FILTER (WHERE hit AND rank < 10) AS first, sum(CASE WHEN hit AND rank < 10 THEN 1 / log2(rank + 2) ELSE 0 END) AS dcg FROM hits GROUP BY ALL) USING (arm, qid)),
met AS (SELECT arm, count(*) AS n,
  round(avg(CASE WHEN first < 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first < 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3,
  round(avg(CASE WHEN first < 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN first < 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10,
  round(avg(rr), 6) AS mrr,
  round(avg(coalesce(dcg / nullif(list_sum(list_transform(range(least(n_relevant, 10)), lambda i: 1 / log2(i + 2))), 0), 0.0)), 6) AS ndcg
  FROM items LEFT JOIN relevant USING (qid) GROUP BY arm)"""

PAIRED_SQL = """versus AS (SELECT a.arm, coalesce(a.first < 5, false) AS arm_hit, coalesce(b.first < 5, false) AS base_hit, a.rr - b.rr AS d FROM items a JOIN items b USING (qid) WHERE b.arm = '{base}' AND a.arm <> '{base}'),
c AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE arm_hit AND NOT base_hit) AS won, count(*) FILTER (WHERE base_hit AND NOT arm_hit) AS lost, round(avg(d), 6) AS delta_mrr FROM versus GROUP BY arm)
SELECT arm, n, won, lost, delta_mrr, CASE WHEN won + lost = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(least(won, lost) + 1), lambda i: exp(lgamma(won + lost + 1) - lgamma(i + 1) - lgamma(won + lost - i + 1) - (won + lost) * ln(2))))), 6) END AS p_value FROM c"""


def _refusal_sql(thresholds: list[float]) -> str:
    levels = ", ".join(f"(CAST({t} AS DOUBLE))" for t in thresholds)
    return f"""WITH {GOLDEN_SQL}, levels AS (SELECT * FROM (VALUES {levels}) t(threshold)),
top AS (SELECT qid, max(score) AS top_score FROM ranked GROUP BY qid),
rows AS (SELECT threshold, is_refuse, CASE WHEN coalesce(top_score, 0.0) < threshold THEN 1.0 ELSE 0.0 END AS refused FROM (SELECT id AS qid, is_refuse FROM gs) LEFT JOIN top USING (qid) CROSS JOIN levels)
SELECT threshold, count(*) FILTER (WHERE is_refuse) AS n_refuse, round(coalesce(avg(refused) FILTER (WHERE is_refuse), 0.0), 6) AS refusal_accuracy,
  count(*) FILTER (WHERE NOT is_refuse) AS n_answerable, round(coalesce(avg(refused) FILTER (WHERE NOT is_refuse), 0.0), 6) AS false_refusal FROM rows GROUP BY threshold"""


def _resolve_sql() -> str:
    parts = []
    for name, phrases in PHRASES:
        condition = " AND ".join(f"regexp_matches(low, '{phrase_pattern(p)}')" for p in phrases) or "false"
        parts.append(f"SELECT '{name}' AS item_id, source_id FROM low WHERE {condition}")
    names = ", ".join(f"('{name}')" for name, _ in PHRASES)
    return f"WITH low AS (SELECT DISTINCT source_id, lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))) AS low FROM comments), served AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})) SELECT item_id, source_id FROM (VALUES {names}) n(item_id) LEFT JOIN served USING (item_id)"


def corrective_sql(c: RetrievalConfig) -> str:
    """Tables of the keyless loop over `dense` and `pairs`: per round t its graded candidates k<t>, then pool, mixed, best and calls."""
    rounds, active, turns = [], "SELECT DISTINCT qid FROM qs", range(c.correction_rounds + 1)
    for t in turns:
        n, relax = c.rerank_candidates * c.widen_factor**t, f"CAST({c.relax_step} AS DOUBLE) * {t}"
        rounds.append(f"""active{t} AS ({active}),
l{t} AS (SELECT qid, chunk_id, score, rank FROM active{t} JOIN dense USING (qid) WHERE rank < {n}),
c{t} AS (SELECT qid, NOT coalesce(max(score) FILTER (WHERE rank = 0) >= {c.auto_top} AND round(max(score) FILTER (WHERE rank = 0) - coalesce(avg(score) FILTER (WHERE rank > 0), max(score) FILTER (WHERE rank = 0)), 6) >= {c.auto_margin}, false) AS rerank FROM l{t} GROUP BY qid),
r{t} AS (SELECT qid, chunk_id, rerank, CASE WHEN rerank THEN pair_score ELSE score END AS score, CASE WHEN rerank THEN row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, chunk_id) - 1 ELSE rank END AS rank FROM l{t} JOIN c{t} USING (qid) JOIN pairs USING (qid, chunk_id)),
g{t} AS (SELECT *, score >= (CASE WHEN rerank THEN CAST({c.scored_relevant} AS DOUBLE) ELSE CAST({c.cosine_relevant} AS DOUBLE) END) - {relax} AS rel, score > (CASE WHEN rerank THEN {c.scored_incorrect} ELSE {c.cosine_incorrect} END) AS above FROM r{t}),
a{t} AS (SELECT qid, CASE WHEN bool_or(rel) THEN 'CORRECT' WHEN NOT bool_or(above) THEN 'INCORRECT' ELSE 'AMBIGUOUS' END AS action FROM g{t} GROUP BY qid),
k{t} AS (SELECT *, CASE WHEN action = 'CORRECT' THEN rel WHEN action = 'AMBIGUOUS' THEN above ELSE false END AS kept FROM g{t} JOIN a{t} USING (qid))""")
        active = f"SELECT qid FROM a{t} WHERE action <> 'CORRECT'"
    every = " UNION ALL ".join(f"SELECT qid, chunk_id, score, rerank FROM k{t} WHERE kept" for t in turns)
    asked = " UNION ALL ".join(f"SELECT DISTINCT qid FROM k{t} WHERE rerank" for t in turns)
    return ",\n".join(rounds) + f""",
pool AS ({every}),
mixed AS (SELECT qid FROM pool GROUP BY qid HAVING count(DISTINCT rerank) > 1),
final AS (SELECT qid, chunk_id, CASE WHEN qid IN (SELECT qid FROM mixed) THEN any_value(pair_score) ELSE max(score) END AS score FROM pool JOIN pairs USING (qid, chunk_id) GROUP BY qid, chunk_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS rank FROM final) WHERE rank < {c.k}),
calls AS (SELECT qid, count(*) AS calls FROM ({asked} UNION ALL SELECT qid FROM mixed) GROUP BY qid)"""


REWRITTEN_SQL = """asked AS (SELECT DISTINCT id, question, CASE WHEN regexp_matches(question, '(?i)(battery|charg)') THEN 'battery life of the phone' WHEN regexp_matches(question, '(?i)camera') THEN 'camera in the dark' END AS rewritten FROM golden_items),
qs AS (SELECT id || '#0' AS qid, question FROM asked UNION ALL SELECT id || '#1', rewritten FROM asked WHERE rewritten IS NOT NULL)"""
_CORRECTIVE_SQL = f"WITH {BASE_SQL}, {dense_sql(CORRECTIVE.deepest)}, {PAIR_SQL}, {corrective_sql(CORRECTIVE)}"
_TURNS = range(CORRECTIVE.correction_rounds + 1)
_BAR, _FLOOR = RetrievalConfig().cosine_relevant, RetrievalConfig().cosine_incorrect

ORACLES = {
    "golden_resolve": _resolve_sql(),
    "golden_set": f"WITH {GOLDEN_SQL} SELECT * FROM gs",
    "golden_type_counts": f"WITH {GOLDEN_SQL} SELECT type, count(*) AS n, CAST(sum(CAST(is_refuse AS INT)) AS BIGINT) AS n_refuse, CAST(sum(n_gold) AS BIGINT) AS n_gold FROM gs GROUP BY type",
    "hit_ranks": f"WITH {GOLDEN_SQL}, {ARMS_SQL}, {METRICS_SQL} SELECT arm, qid, chunk_id, rank, hit FROM hits",
    "n_relevant_chunks": f"WITH {GOLDEN_SQL} SELECT qid, n_relevant FROM relevant",
    "retrieval_metrics": f"WITH {GOLDEN_SQL}, {ARMS_SQL}, {METRICS_SQL} SELECT * FROM met",
    "per_type_breakdown": f"WITH {GOLDEN_SQL}, {ARMS_SQL}, {METRICS_SQL} SELECT arm, type, count(*) AS n, round(avg(CASE WHEN first < 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(rr), 6) AS mrr FROM items GROUP BY arm, type",
    "refusal_metrics": _refusal_sql([RetrievalConfig().refusal_cosine]),
    "risk_coverage": _refusal_sql(THRESHOLDS),
    "latency_mean_p95": """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS mean FROM events WHERE value IS NOT NULL)
SELECT event_type, n, round(mean, 6) AS mean_value, value AS p95 FROM e WHERE rn = least(n - 1, CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT))""",
    "mcnemar": f"WITH {GOLDEN_SQL}, {ARMS_SQL}, {METRICS_SQL}, {PAIRED_SQL.format(base='given')}",
    "grade_threshold": f"""WITH r AS (SELECT DISTINCT qid, chunk_id, score, CAST(rank AS BIGINT) AS rank FROM ranked), q AS (SELECT DISTINCT id AS qid FROM golden_items),
m AS (SELECT *, score >= {_BAR} AS is_relevant, score > {_FLOOR} AS above FROM r),
a AS (SELECT qid, CASE WHEN bool_or(is_relevant) THEN 'CORRECT' WHEN NOT bool_or(above) THEN 'INCORRECT' ELSE 'AMBIGUOUS' END AS action FROM m GROUP BY qid)
SELECT qid, chunk_id, score, rank, is_relevant, CASE WHEN chunk_id IS NULL THEN false WHEN action = 'CORRECT' THEN is_relevant WHEN action = 'AMBIGUOUS' THEN above ELSE false END AS kept, coalesce(action, 'AMBIGUOUS') AS action
FROM q LEFT JOIN a USING (qid) LEFT JOIN m USING (qid)""",
    "corrective_trace": _CORRECTIVE_SQL
    + " UNION ALL ".join(
        f" SELECT qid, CAST({t} AS BIGINT) AS round_idx, question AS query, count(*) AS n_candidates, rerank AS reranked, action, coalesce(string_agg(chunk_id, ',' ORDER BY rank) FILTER (WHERE kept), '') AS kept, count(*) FILTER (WHERE kept) AS n_kept, "
        + ("CAST(NULL AS VARCHAR)" if t == _TURNS[-1] else "CASE WHEN action <> 'CORRECT' THEN 'widen' END")
        + f" AS correction FROM k{t} JOIN qs USING (qid) GROUP BY qid, question, rerank, action"
        for t in _TURNS
    ),
    "corrective_contexts": f"{_CORRECTIVE_SQL} SELECT qid, chunk_id, score, rank, chunk_id IS NULL AS refused FROM (SELECT DISTINCT qid FROM qs) LEFT JOIN best USING (qid)",
    "corrective_calls": f"{_CORRECTIVE_SQL} SELECT qid, coalesce(calls, 0) AS calls FROM (SELECT DISTINCT qid FROM qs) LEFT JOIN calls USING (qid)",
    "corrective_rewrite": f"""WITH {BASE_SQL.replace("qs AS (SELECT DISTINCT id AS qid, question FROM golden_items)", REWRITTEN_SQL)}, {dense_sql(2 * CORRECTIVE.rerank_candidates)},
g0 AS (SELECT id, question, rewritten, chunk_id, score, rank, score >= {CORRECTIVE.cosine_relevant} AS rel, score > {CORRECTIVE.cosine_incorrect} AS above FROM asked JOIN dense ON qid = id || '#0' WHERE rank < {CORRECTIVE.rerank_candidates}),
a0 AS (SELECT id, CASE WHEN bool_or(rel) THEN 'CORRECT' WHEN NOT bool_or(above) THEN 'INCORRECT' ELSE 'AMBIGUOUS' END AS action FROM g0 GROUP BY id),
g1 AS (SELECT id, coalesce(rewritten, question) AS question, chunk_id, score, rank, score >= {CORRECTIVE.cosine_relevant} - (CASE WHEN rewritten IS NULL THEN CAST({CORRECTIVE.relax_step} AS DOUBLE) ELSE 0 END) AS rel, score > {CORRECTIVE.cosine_incorrect} AS above
  FROM asked JOIN a0 USING (id) JOIN dense ON qid = id || (CASE WHEN rewritten IS NULL THEN '#0' ELSE '#1' END) WHERE action <> 'CORRECT' AND rank < (CASE WHEN rewritten IS NULL THEN 2 ELSE 1 END) * {CORRECTIVE.rerank_candidates}),
a1 AS (SELECT id, CASE WHEN bool_or(rel) THEN 'CORRECT' WHEN NOT bool_or(above) THEN 'INCORRECT' ELSE 'AMBIGUOUS' END AS action FROM g1 GROUP BY id),
rounds AS (SELECT 0 AS round_idx, id, question, rewritten, chunk_id, rank, action, CASE action WHEN 'CORRECT' THEN rel WHEN 'AMBIGUOUS' THEN above ELSE false END AS kept FROM g0 JOIN a0 USING (id)
  UNION ALL SELECT 1, id, question, NULL, chunk_id, rank, action, CASE action WHEN 'CORRECT' THEN rel WHEN 'AMBIGUOUS' THEN above ELSE false END FROM g1 JOIN a1 USING (id))
SELECT id AS qid, CAST(round_idx AS BIGINT) AS round_idx, question AS query, count(*) AS n_candidates, false AS reranked, action, coalesce(string_agg(chunk_id, ',' ORDER BY rank) FILTER (WHERE kept), '') AS kept, count(*) FILTER (WHERE kept) AS n_kept,
  CASE WHEN round_idx = 0 AND action <> 'CORRECT' THEN CASE WHEN any_value(rewritten) IS NULL THEN 'widen' ELSE 'reformulate' END END AS correction FROM rounds GROUP BY round_idx, id, question, action""",
    "prompt_build": f"""WITH q AS (SELECT DISTINCT id AS qid, question FROM golden_items), c AS (SELECT DISTINCT qid, text, rank FROM ranked WHERE rank < 3),
s AS (SELECT qid, string_agg('[' || (rank + 1) || '] ' || text, chr(10) ORDER BY rank, text) AS sources FROM c GROUP BY qid)
SELECT qid, '{generation.HEADER.replace("'", "''")}' || chr(10) || chr(10) || 'Sources:' || chr(10) || coalesce(sources, '') || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || 'Answer:' AS prompt FROM q LEFT JOIN s USING (qid)""",
    "citation_expand": """WITH a AS (SELECT DISTINCT id AS qid, coalesce(answer, '') || ' [2][1] and [99], [2] ' AS answer FROM golden_items),
n AS (SELECT qid, answer, unnest(regexp_extract_all(answer, '\\[([0-9]{1,6})\\]', 1)) AS number, unnest(range(len(regexp_extract_all(answer, '\\[([0-9]{1,6})\\]', 1)))) AS place FROM a),
f AS (SELECT qid, CAST(number AS INT) AS number, min(place) AS place FROM n GROUP BY ALL),
c AS (SELECT DISTINCT qid, rank + 1 AS number, chunk_id, text FROM ranked WHERE rank < 5),
l AS (SELECT qid, string_agg('[' || number || '] ' || chunk_id || ': ' || text, chr(10) ORDER BY place) AS sources FROM f JOIN c USING (qid, number) GROUP BY qid)
SELECT qid, CASE WHEN sources IS NULL THEN trim(answer) ELSE trim(answer) || chr(10) || chr(10) || 'Sources:' || chr(10) || sources END AS expanded FROM a LEFT JOIN l USING (qid)""",
    "judge_means": f"""WITH {GOLDEN_SQL}, c AS (SELECT qid, string_agg(text, ' ' ORDER BY rank, text) AS context FROM (SELECT DISTINCT qid, chunk_id, text, rank FROM ranked WHERE rank < 5) GROUP BY qid),
t AS (SELECT i.qid, i.type, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '{TOKEN}', 1)) AS q, list_distinct(regexp_extract_all(lower(coalesce(answer, '')), '{TOKEN}', 1)) AS a, regexp_extract_all(lower(coalesce(context, '')), '{TOKEN}', 1) AS c
  FROM (SELECT DISTINCT id AS qid, question, answer, type FROM golden_items) i SEMI JOIN answerable USING (qid) LEFT JOIN c USING (qid)),
j AS (SELECT type, round(coalesce(len(list_intersect(a, c)) / nullif(len(a), 0), 0.0), 6) AS faithfulness, round(coalesce(len(list_intersect(q, a)) / nullif(len(q), 0), 0.0), 6) AS relevancy FROM t)
SELECT type, count(*) AS n, round(avg(faithfulness), 6) AS faithfulness, round(avg(relevancy), 6) AS relevancy FROM j GROUP BY type""",
    "regression_gate": f"""WITH {GOLDEN_SQL}, {ARMS_SQL}, {METRICS_SQL},
floors AS (SELECT arm, metric, CAST(floor AS DOUBLE) AS floor FROM (VALUES {", ".join(f"('{a}', '{m}', {f})" for a, m, f in FLOORS)}) t(arm, metric, floor)),
reached AS (SELECT arm, 'recall_5' AS metric, recall_5 AS got FROM met UNION ALL SELECT arm, 'mrr', mrr FROM met)
SELECT arm, metric, floor, got, coalesce(got >= floor, false) AS passed, bool_and(coalesce(got >= floor, false)) OVER () AS all_passed FROM floors LEFT JOIN reached USING (arm, metric)""",
}
