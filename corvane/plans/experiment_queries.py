"""Experiment arms, the chunk sweep, tools and the scripted models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import experiment, models, tools
from corvane.config import RetrievalConfig
from corvane.engine import Engine
from corvane.functions.text import TOKEN
from corvane.models import ScriptedTurns
from corvane.operators import chunking, corrective, generation
from corvane.operators.durable import cut
from corvane.operators.ranking import rounded
from corvane.plans.corpus_queries import DOCUMENTS_SQL
from corvane.plans.evaluation_queries import GOLDEN_SQL, METRICS_SQL, PAIRED_SQL, corrective_sql
from corvane.plans.retrieval_queries import BASE_SQL, PAIR_SQL, dense_sql, questions, sparse_sql
from corvane.sources.tables import table

SWEEP = [(256, 32), (512, 64), (1024, 128)]
EXPRESSIONS = ["60/200*100", "57.59 + 6", "2**10", "9**9**9**9", "2**1000", "abs(1)", "-3 % 5", "1/0", "", "+7 - -2"]
ANSWERS = ["30.0", "63.59", "1024", None, None, None, "2", None, None, "9"]
BARS = [0.55, 0.60, 0.65, 0.70, 0.75, 0.80]
FLOORS = [("baseline", "recall@5", 0.01), ("baseline", "mrr", 0.9), ("reranked", "recall@10", 0.01), ("nobody", "mrr", 0.0)]
FETCHED = ["c00000", "c00010", "c00100", "c01000", "c03000", "nothing"]


class FirstSource:
    """A stand-in for a model: it answers with the first source of its prompt."""

    def chat(self, prompt: str) -> str:
        return next((line[4:] for line in prompt.splitlines() if line.startswith("[1] ")), "I don't know.")


def calculator(spark: SparkSession, directory: str) -> DataFrame:
    """Fixed expressions; those that must fail show only that they do."""
    rows = spark.createDataFrame([(e,) for e in EXPRESSIONS], "expression string").withColumn("result", tools.calculated(F.col("expression")))
    return rows.select("expression", F.when(F.col("result").startswith("Error"), "Error").otherwise(F.col("result")).alias("result"))


def fetch_chunk(spark: SparkSession, directory: str) -> DataFrame:
    ids = spark.createDataFrame([(i,) for i in FETCHED], "chunk_id string")
    return tools.fetch_chunk(table(spark, directory, "chunks"), ids)


def chunk_sweep(spark: SparkSession, directory: str) -> DataFrame:
    """For each window size: how many windows, how long, and how many comments each touches."""
    comments, spans = table(spark, directory, "comments"), table(spark, directory, "pseudo_spans")
    texts = chunking.document_texts(spans, comments)
    parts = []
    for size, overlap in SWEEP:
        windows = chunking.fixed_windows(texts, size=size, overlap=overlap).withColumn("chunk_id", F.concat_ws(":", "doc_id", "window_no"))
        touched = chunking.provenance(windows, spans).select("chunk_id", F.size("source_ids").alias("touched"))
        parts.append(windows.join(touched, "chunk_id").agg(F.lit(size).cast("long").alias("size"), F.count("*").alias("windows"), rounded(F.avg(F.length("text"))).alias("mean_length"), rounded(F.avg("touched")).alias("mean_comments")))
    return reduce(DataFrame.unionByName, parts)


def _evaluation(spark: SparkSession, directory: str, names: list[str] | None = None) -> experiment.Evaluation:
    return experiment.Evaluation.of(Engine(table(spark, directory, "chunks")), table(spark, directory, "golden_items"), experiment.arms(names))


def arm_table(spark: SparkSession, directory: str) -> DataFrame:
    """The six arms over the golden items: what each finds, refuses and costs."""
    return _evaluation(spark, directory).table()


def arm_refusals(spark: SparkSession, directory: str) -> DataFrame:
    """Refusals and second scorings of an arm of each kind."""
    return _evaluation(spark, directory, ["baseline", "crag", "no such arm"]).refusals()


def significance_table(spark: SparkSession, directory: str) -> DataFrame:
    """Each arm against the baseline, without the drawn interval, which SQL can't state."""
    return _evaluation(spark, directory, ["baseline", "reranked", "crag"]).significance(exact=False).select("arm", "n", "won", "lost", "p_value", "delta_mrr")


def arm_types(spark: SparkSession, directory: str) -> DataFrame:
    """Two arms by kind of item."""
    return _evaluation(spark, directory, ["baseline", "reranked"]).by_type()


def risk_coverage_dense(spark: SparkSession, directory: str) -> DataFrame:
    """What bars for the best cosine would refuse."""
    return _evaluation(spark, directory, ["baseline"]).risk_coverage(BARS)


def gate_result(spark: SparkSession, directory: str) -> DataFrame:
    """Floors, one of them for an arm that isn't run, against what the arms reach."""
    return _evaluation(spark, directory, ["baseline", "reranked"]).gate(spark.createDataFrame(FLOORS, "arm string, metric string, floor double"))


def generation_means(spark: SparkSession, directory: str) -> DataFrame:
    """Answers of a scripted model in two arms, judged; the model repeats its first source."""
    return _evaluation(spark, directory, ["baseline", "crag"]).generation(FirstSource())


def sweep_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Three chunkings without and with second scores, measured by the golden comments they hold."""
    comments, spans = table(spark, directory, "comments"), table(spark, directory, "pseudo_spans")
    texts, engines = cut(chunking.document_texts(spans, comments)), {}
    for size, overlap in SWEEP:
        windows = chunking.fixed_windows(texts, size=size, overlap=overlap).withColumn("chunk_id", F.concat_ws(":", "doc_id", F.format_string("%05d", "window_no")))
        chunks = windows.join(chunking.provenance(windows, spans), "chunk_id").select("chunk_id", "text", "source_ids", "doc_id")
        engines[size, overlap] = Engine(cut(chunks), RetrievalConfig(chunk_size=size, chunk_overlap=overlap))
    return experiment.sweep(engines, table(spark, directory, "golden_items")).select(F.col("size").cast("long").alias("size"), "arm", "n", "recall_1", "recall_5", "recall_10", "mrr")


def corrective_llm(spark: SparkSession, directory: str) -> DataFrame:
    """Grading by a scripted model: yes where the candidate names a battery, a camera or a brick."""
    model = models.ScriptedChat([(r"Passage:.*(battery|camera|brick)", "YES")])
    ranked = table(spark, directory, "ranked").select("qid", "chunk_id", "text", "score", F.col("rank").cast("int").alias("rank"), F.lit("cosine").alias("signal")).distinct()
    asked = questions(spark, directory)
    prompt = F.concat(F.lit("Does the passage help to answer? YES or NO.\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\nPassage: "), F.coalesce("text", F.lit("")))
    judged = ranked.join(asked, "qid").withColumn("says", F.coalesce(models.says_yes(model, prompt), F.lit(False))).drop("text", "question")
    return corrective.grade(judged, asked, RetrievalConfig(), says=F.col("says")).select("qid", "chunk_id", "is_relevant", "kept", "action")


def tool_agent_trace(spark: SparkSession, directory: str) -> DataFrame:
    """Scripted agents over all golden questions: a search, a calculation and a lookup, an answer."""
    script = [
        {"calls": [{"name": "search_corpus", "input": {"query": "charging brick barely lasts", "k": 3}}]},
        {"calls": [{"name": "calculator", "input": {"expression": "60/200*100"}}, {"name": "fetch_chunk", "input": {"chunk_id": "c00000"}}, {"name": "dance", "input": {}}]},
        {"text": " About a third. ", "calls": []},
    ]
    run = Engine(table(spark, directory, "chunks"), RetrievalConfig(mode="agent", retrieval="sparse"), agent=ScriptedTurns(script)).tool_agent(questions(spark, directory))
    steps = run.trace.select("qid", F.col("step").cast("long").alias("step"), F.col("call_no").cast("long").alias("call_no"), "tool", "output")
    return steps.unionByName(run.answers.select("qid", F.col("steps").cast("long").alias("step"), F.lit(0).cast("long").alias("call_no"), F.lit("answer").alias("tool"), F.col("answer").alias("output")))


QUERIES = {
    f.__name__: f
    for f in (calculator, fetch_chunk, chunk_sweep, sweep_metrics, arm_table, arm_refusals, significance_table, arm_types, risk_coverage_dense, gate_result, generation_means, corrective_llm, tool_agent_trace)
}


def _windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT CAST({size} AS BIGINT) AS size, count(*) AS windows, round(avg(length(text)), 6) AS mean_length, round(avg(touched), 6) AS mean_comments FROM (
  SELECT w.doc_id, w.no, any_value(w.text) AS text, count(s.source_id) AS touched FROM (
    SELECT doc_id, no, no * {step} AS a, substring(doc_text, CAST(no * {step} + 1 AS BIGINT), {size}) AS text FROM (SELECT doc_id, doc_text, unnest(range(greatest(CAST(ceil((length(doc_text) - {overlap}) / {float(step)}) AS BIGINT), 1))) AS no FROM docs WHERE doc_text <> '')) w
  LEFT JOIN (SELECT DISTINCT doc_id, source_id, start_pos, end_pos FROM pseudo_spans) s ON s.doc_id = w.doc_id AND s.start_pos < w.a + length(w.text) AND s.end_pos > w.a GROUP BY w.doc_id, w.no)"""


_CRAG = experiment.arms()["crag"]
_ARMS_SQL = f"""WITH {BASE_SQL}, {dense_sql(_CRAG.deepest)}, {sparse_sql(10)}, {PAIR_SQL}, {corrective_sql(_CRAG)}, {GOLDEN_SQL},
first20 AS (SELECT * FROM dense WHERE rank < 20),
gated AS (SELECT qid, NOT coalesce(max(score) FILTER (WHERE rank = 0) >= 0.55 AND round(max(score) FILTER (WHERE rank = 0) - coalesce(avg(score) FILTER (WHERE rank > 0), max(score) FILTER (WHERE rank = 0)), 6) >= 0.05, false) AS rerank FROM first20 GROUP BY qid),
fused AS (SELECT qid, chunk_id, round(sum(1 / (60.0 + rank)), 6) AS score FROM (SELECT qid, chunk_id, rank FROM dense WHERE rank < 10 UNION ALL SELECT qid, chunk_id, rank FROM sparse) GROUP BY ALL),
again AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, chunk_id) - 1 AS rank FROM pairs SEMI JOIN first20 USING (qid, chunk_id)),
lists AS (
  SELECT 'baseline' AS arm, qid, chunk_id, rank FROM dense WHERE rank < 10
  UNION ALL SELECT 'sparse', qid, chunk_id, rank FROM sparse
  UNION ALL SELECT 'hybrid', qid, chunk_id, rank FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS rank FROM fused) WHERE rank < 10
  UNION ALL SELECT 'reranked', qid, chunk_id, rank FROM again WHERE rank < 10
  UNION ALL SELECT 'adaptive', qid, chunk_id, rank FROM again JOIN gated USING (qid) WHERE rerank AND rank < 10
  UNION ALL SELECT 'adaptive', qid, chunk_id, rank FROM dense JOIN gated USING (qid) WHERE NOT rerank AND rank < 10
  UNION ALL SELECT 'crag', qid, chunk_id, rank FROM best),
arms AS (SELECT DISTINCT arm FROM (VALUES ('baseline'), ('sparse'), ('hybrid'), ('reranked'), ('adaptive'), ('crag')) t(arm)),
{METRICS_SQL},
outcomes AS (SELECT arm, qid, CASE WHEN arm = 'crag' THEN qid NOT IN (SELECT qid FROM best) ELSE coalesce(top_score, 0.0) < 0.35 END AS refused,
    CASE arm WHEN 'reranked' THEN 1 WHEN 'adaptive' THEN CAST(coalesce(rerank, false) AS INT) WHEN 'crag' THEN coalesce(calls, 0) ELSE 0 END AS calls
  FROM arms CROSS JOIN (SELECT DISTINCT qid FROM qs) LEFT JOIN (SELECT qid, max(score) AS top_score FROM dense GROUP BY qid) USING (qid) LEFT JOIN gated USING (qid) LEFT JOIN calls USING (qid)),
ref AS (SELECT arm, count(*) FILTER (WHERE is_refuse) AS n_refuse, round(coalesce(avg(CAST(refused AS INT)) FILTER (WHERE is_refuse), 0.0), 6) AS refusal_accuracy,
    round(coalesce(avg(CAST(refused AS INT)) FILTER (WHERE NOT is_refuse), 0.0), 6) AS false_refusal, round(avg(calls), 6) AS calls_per_question
  FROM outcomes JOIN (SELECT id AS qid, is_refuse FROM gs) USING (qid) GROUP BY arm)"""
_BARS_SQL = ", ".join(f"(CAST({b} AS DOUBLE))" for b in BARS)
_FLOORS_SQL = ", ".join(f"('{a}', '{m}', CAST({f} AS DOUBLE))" for a, m, f in FLOORS)


def _sweep_part(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT CAST({size} AS BIGINT) AS size, arm, n, recall_1, recall_5, recall_10, mrr FROM (WITH {DOCUMENTS_SQL},
win AS (SELECT doc_id, no, no * {step} AS a, substring(doc_text, CAST(no * {step} + 1 AS BIGINT), {size}) AS text FROM (SELECT doc_id, doc_text, unnest(range(greatest(CAST(ceil((length(doc_text) - {overlap}) / {float(step)}) AS BIGINT), 1))) AS no FROM docs WHERE doc_text <> '')),
cut AS (SELECT w.doc_id || ':' || lpad(CAST(w.no AS VARCHAR), 5, '0') AS chunk_id, any_value(w.text) AS text, list(s.source_id) FILTER (WHERE s.source_id IS NOT NULL) AS source_ids FROM win w
  LEFT JOIN (SELECT DISTINCT doc_id, source_id, start_pos, end_pos FROM pseudo_spans) s ON s.doc_id = w.doc_id AND s.start_pos < w.a + length(w.text) AND s.end_pos > w.a GROUP BY w.doc_id, w.no),
{BASE_SQL.replace("FROM chunks)", "FROM cut)", 1)}, {dense_sql(20)}, {PAIR_SQL}, {GOLDEN_SQL.replace("FROM chunks)", "FROM cut)", 1)},
lists AS (SELECT 'baseline' AS arm, qid, chunk_id, rank FROM dense WHERE rank < 10 UNION ALL SELECT 'reranked', qid, chunk_id, rank FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, chunk_id) - 1 AS rank FROM pairs) WHERE rank < 10),
arms AS (SELECT DISTINCT arm FROM (VALUES ('baseline'), ('reranked')) t(arm)), {METRICS_SQL} SELECT * FROM met)"""


ORACLES = {
    "calculator": "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(e, a or "Error") for e, a in zip(EXPRESSIONS, ANSWERS)) + ") t(expression, result)",
    "fetch_chunk": f"""WITH ids AS (SELECT * FROM (VALUES {", ".join(f"('{i}')" for i in FETCHED)}) t(chunk_id)),
once AS (SELECT * FROM (SELECT chunk_id, coalesce(source_ids, []) AS s, coalesce(text, '') AS t, row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(source_ids, []), coalesce(text, '')) AS n FROM chunks) WHERE n = 1)
SELECT chunk_id, coalesce('[' || chunk_id || '] sources=' || array_to_string(s, ',') || chr(10) || t, 'No chunk with id ' || chunk_id || '.') AS output FROM ids LEFT JOIN once USING (chunk_id)""",
    "chunk_sweep": f"WITH {DOCUMENTS_SQL} " + " UNION ALL ".join(_windows_sql(s, o) for s, o in SWEEP),
    "sweep_metrics": " UNION ALL ".join(_sweep_part(s, o) for s, o in SWEEP),
    "arm_table": f"{_ARMS_SQL} SELECT * FROM met JOIN ref USING (arm)",
    "arm_refusals": f"{_ARMS_SQL} SELECT * FROM ref WHERE arm IN ('baseline', 'crag')",
    "arm_types": f"{_ARMS_SQL} SELECT arm, type, count(*) AS n, round(avg(CASE WHEN first < 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(rr), 6) AS mrr FROM items WHERE arm IN ('baseline', 'reranked') GROUP BY arm, type",
    "significance_table": f"{_ARMS_SQL}, {PAIRED_SQL.format(base='baseline')} WHERE arm IN ('reranked', 'crag')",
    "risk_coverage_dense": f"""WITH {BASE_SQL}, {dense_sql(1)}, {GOLDEN_SQL}, levels AS (SELECT * FROM (VALUES {_BARS_SQL}) t(threshold)),
rows AS (SELECT threshold, is_refuse, CASE WHEN coalesce(score, 0.0) < threshold THEN 1.0 ELSE 0.0 END AS refused FROM (SELECT id AS qid, is_refuse FROM gs) LEFT JOIN dense USING (qid) CROSS JOIN levels)
SELECT threshold, count(*) FILTER (WHERE is_refuse) AS n_refuse, round(coalesce(avg(refused) FILTER (WHERE is_refuse), 0.0), 6) AS refusal_accuracy,
  count(*) FILTER (WHERE NOT is_refuse) AS n_answerable, round(coalesce(avg(refused) FILTER (WHERE NOT is_refuse), 0.0), 6) AS false_refusal FROM rows GROUP BY threshold""",
    "gate_result": f"""{_ARMS_SQL}, floors AS (SELECT * FROM (VALUES {_FLOORS_SQL}) t(arm, metric, floor)),
reached AS (UNPIVOT (SELECT arm, recall_1 AS "recall@1", recall_3 AS "recall@3", recall_5 AS "recall@5", recall_10 AS "recall@10", mrr, ndcg AS "ndcg@10" FROM met) ON "recall@1", "recall@3", "recall@5", "recall@10", mrr, "ndcg@10" INTO NAME metric VALUE got)
SELECT arm, metric, floor, got, coalesce(got >= floor, false) AS passed FROM floors LEFT JOIN reached USING (arm, metric)""",
    "generation_means": f"""{_ARMS_SQL},
told AS (SELECT arm, qid, string_agg(text, chr(10) ORDER BY rank) AS context, regexp_extract(max(text) FILTER (WHERE rank = 0), '^[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]*') AS first FROM lists JOIN ch USING (chunk_id) GROUP BY arm, qid),
t AS (SELECT a.arm, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '{TOKEN}', 1)) AS q,
    list_distinct(regexp_extract_all(lower(CASE WHEN first IS NULL THEN '{generation.REFUSAL.replace("'", "''")}' ELSE first END), '{TOKEN}', 1)) AS a, regexp_extract_all(lower(coalesce(context, '')), '{TOKEN}', 1) AS c
  FROM (SELECT arm, qid FROM arms, answerable WHERE arm IN ('baseline', 'crag')) a JOIN qs USING (qid) LEFT JOIN told USING (arm, qid)),
j AS (SELECT arm, round(coalesce(len(list_intersect(a, c)) / nullif(len(a), 0), 0.0), 6) AS f, round(coalesce(len(list_intersect(q, a)) / nullif(len(q), 0), 0.0), 6) AS r FROM t)
SELECT arm, count(*) AS judged, round(avg(f), 6) AS faithfulness, round(avg(r), 6) AS answer_relevancy FROM j GROUP BY arm""",
    "tool_agent_trace": f"""WITH {BASE_SQL.replace("SELECT DISTINCT id AS qid, question FROM golden_items", "SELECT 'q' AS qid, 'charging brick barely lasts' AS question")}, {sparse_sql(3)},
once AS (SELECT * FROM (SELECT chunk_id, coalesce(source_ids, []) AS s, coalesce(text, '') AS t, row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(source_ids, []), coalesce(text, '')) AS n FROM chunks) WHERE n = 1),
steps AS (SELECT 0 AS step, 0 AS call_no, 'search_corpus' AS tool, substring(string_agg('[' || chunk_id || '] ' || t, chr(10) ORDER BY rank), 1, 800) AS output FROM sparse JOIN once USING (chunk_id)
  UNION ALL SELECT 1, 0, 'calculator', '30.0'
  UNION ALL SELECT 1, 1, 'fetch_chunk', substring('[' || chunk_id || '] sources=' || array_to_string(s, ',') || chr(10) || t, 1, 800) FROM once WHERE chunk_id = 'c00000'
  UNION ALL SELECT 1, 2, 'dance', 'Unknown tool: dance'
  UNION ALL SELECT 3, 0, 'answer', 'About a third.')
SELECT qid, CAST(step AS BIGINT) AS step, CAST(call_no AS BIGINT) AS call_no, tool, output FROM (SELECT DISTINCT id AS qid FROM golden_items), steps""",
    "corrective_llm": """WITH q AS (SELECT DISTINCT id AS qid, question FROM golden_items), r AS (SELECT DISTINCT qid, chunk_id, text, score, rank FROM ranked),
m AS (SELECT qid, chunk_id, regexp_matches(lower(coalesce(text, '')), '(battery|camera|brick)') AS is_relevant FROM r JOIN q USING (qid)),
a AS (SELECT qid, CASE WHEN bool_or(is_relevant) THEN 'CORRECT' ELSE 'INCORRECT' END AS action FROM m GROUP BY qid)
SELECT qid, chunk_id, is_relevant, coalesce(is_relevant AND action = 'CORRECT', false) AS kept, coalesce(action, 'INCORRECT') AS action FROM q LEFT JOIN a USING (qid) LEFT JOIN m USING (qid)""",
}
