"""Arms of an experiment over one corpus and golden set: what each finds, refuses, costs and answers, and how they compare."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import RetrievalConfig
from corvane.engine import Engine
from corvane.models import ChatModel
from corvane.operators import generation, golden, metrics, stats
from corvane.operators.durable import broadcast_below, cut
from corvane.operators.ranking import rounded

DEPTH = 10
BASELINE = "baseline"
THRESHOLDS = [0.25, 0.30, 0.35, 0.40, 0.45, 0.50]


def arms(names: list[str] | None = None) -> dict[str, RetrievalConfig]:
    """The six arms, or those of the names; names that aren't known are passed over."""
    base = RetrievalConfig(k=DEPTH, rerank_candidates=20)
    known = {
        "baseline": base,
        "sparse": base.with_(retrieval="sparse"),
        "hybrid": base.with_(retrieval="hybrid"),
        "reranked": base.with_(rerank="always"),
        "adaptive": base.with_(rerank="auto"),
        "crag": base.with_(rerank="auto", mode="crag"),
    }
    return known if not names else {a: c for a, c in known.items() if a in names}


@dataclass(frozen=True)
class Runs:
    """lists (arm, qid, chunk_id, rank); outcomes (arm, qid, refused, calls), a row for every arm and question."""

    lists: DataFrame
    outcomes: DataFrame


def run_arms(engine: Engine, items: DataFrame, chosen: dict[str, RetrievalConfig]) -> Runs:
    """Every arm over all questions.

    Each first stage is searched once, as deep as the deepest arm needs, and the
    arms are plans over these lists.  An arm refuses a question whose best cosine
    is under its bar, the corrective one a question without contexts; calls
    counts how often a question's candidates were scored again.
    """
    questions = cut(items.select(F.col("id").alias("qid"), "question").distinct())
    stages = {"dense"} | ({"sparse"} if any(c.retrieval != "dense" for c in chosen.values()) else set())
    deepest = max(c.deepest if c.mode == "crag" and c.retrieval != "hybrid" else max(c.depth, DEPTH) for c in chosen.values())
    lists = engine.prepared(questions, deepest, stages)
    lists_, outcomes = [], []
    for arm, config in chosen.items():
        own = engine.with_config(config, lists=lists)
        if config.mode == "crag":
            loop = own.corrective(questions)
            found, calls = cut(loop.contexts), loop.calls
            refused = questions.select("qid").join(found.select("qid").distinct().withColumn("some", F.lit(True)), "qid", "left").select("qid", F.col("some").isNull().alias("refused"))
        else:
            found = cut(own.retrieve(questions, DEPTH))
            calls = found.where("signal = 'ce'").select("qid").distinct().withColumn("calls", F.lit(1).cast("long"))
            refused = own.dense_top(questions).select("qid", (F.col("top_score") < config.refusal_cosine).alias("refused"))
        lists_.append(found.select(F.lit(arm).alias("arm"), "qid", "chunk_id", "rank"))
        outcomes.append(refused.join(calls, "qid", "left").select(F.lit(arm).alias("arm"), "qid", "refused", F.coalesce("calls", F.lit(0)).alias("calls")))
    return Runs(cut(reduce(DataFrame.unionByName, lists_)), cut(reduce(DataFrame.unionByName, outcomes)))


@dataclass(frozen=True)
class Evaluation:
    """The tables of a report; each is made when it is asked for."""

    engine: Engine
    items: DataFrame
    chosen: dict[str, RetrievalConfig]
    runs: Runs

    @classmethod
    def of(cls, engine: Engine, items: DataFrame, chosen: dict[str, RetrievalConfig] | None = None) -> Evaluation:
        chosen = chosen or arms()
        return cls(engine, items, chosen, run_arms(engine, items, chosen))

    @property
    def names(self) -> DataFrame:
        return self.items.sparkSession.createDataFrame([(a,) for a in self.chosen], "arm string")

    @property
    def answerable(self) -> DataFrame:
        return golden.golden_set(self.items).where(~F.col("is_refuse")).select(F.col("id").alias("qid"), "type")

    @property
    def hits(self) -> DataFrame:
        return metrics.hit_ranks(self.runs.lists, golden.chunk_sources(self.engine.sources), golden.gold_pairs(self.items))

    def retrieval(self) -> DataFrame:
        """(arm, n, recall_*, mrr, ndcg) over the answerable items."""
        relevant = metrics.relevant_chunks(self.answerable, golden.chunk_sources(self.engine.sources), golden.gold_pairs(self.items))
        return metrics.retrieval_metrics(self.hits, self.answerable.select("qid"), relevant, self.names)

    def refusals(self) -> DataFrame:
        """(arm, n_refuse, refusal_accuracy, false_refusal, calls_per_question): right refusals among the items to be refused, wrong ones among the others; a rate over none is 0."""
        kinds = golden.golden_set(self.items).select(F.col("id").alias("qid"), "is_refuse")
        rows = self.runs.outcomes.join(kinds, "qid")
        refused = F.col("refused").cast("double")
        rate = lambda condition: rounded(F.coalesce(F.avg(F.when(condition, refused)), F.lit(0.0)))
        return rows.groupBy("arm").agg(
            F.count(F.when(F.col("is_refuse"), 1)).alias("n_refuse"),
            rate(F.col("is_refuse")).alias("refusal_accuracy"),
            rate(~F.col("is_refuse")).alias("false_refusal"),
            rounded(F.avg("calls")).alias("calls_per_question"),
        )

    def significance(self, *, exact: bool = True) -> DataFrame | None:
        """(arm, n, won, lost, p_value, delta_mrr, low, high, significant) against the baseline; None where it didn't run."""
        if BASELINE not in self.chosen:
            return None
        pairs = cut(stats.paired(self.hits, self.answerable.select("qid"), self.names, BASELINE))
        return stats.compare(pairs).join(stats.bootstrap(pairs, exact=exact), "arm")

    def by_type(self) -> DataFrame:
        """(arm, type, n, recall_5, mrr)."""
        return metrics.by_type(self.hits, self.answerable, self.names)

    def risk_coverage(self, thresholds: list[float] | None = None) -> DataFrame:
        """(threshold, n_refuse, refusal_accuracy, n_answerable, false_refusal): what other bars for the best cosine would refuse."""
        kinds = golden.golden_set(self.items).select(F.col("id").alias("qid"), "is_refuse")
        questions = self.items.select(F.col("id").alias("qid"), "question").distinct()
        return metrics.refusals(self.engine.dense_top(questions), kinds, thresholds or THRESHOLDS)

    def table(self) -> DataFrame:
        """(arm, n, recall_*, mrr, ndcg, n_refuse, refusal_accuracy, false_refusal, calls_per_question)."""
        return self.retrieval().join(self.refusals(), "arm", "left")

    def gate(self, floors: DataFrame) -> DataFrame:
        """(arm, metric, floor, got, passed): each floor (arm, metric, floor) against what the arm reached; an arm or metric without result fails."""
        reached = self.retrieval().select("arm", F.expr("stack(6, 'recall@1', recall_1, 'recall@3', recall_3, 'recall@5', recall_5, 'recall@10', recall_10, 'mrr', mrr, 'ndcg@10', ndcg) AS (metric, got)"))
        return floors.join(reached, ["arm", "metric"], "left").select("arm", "metric", "floor", "got", F.coalesce(F.col("got") >= F.col("floor"), F.lit(False)).alias("passed"))

    def latencies(self, asked: int = 20) -> DataFrame:
        """(arm, n, mean_ms, p95_ms): the first `asked` questions by id, put to each arm one at a time, as a user would wait for them."""
        rows = self.items.select(F.col("id").alias("qid"), "question").distinct().orderBy("qid").limit(asked).collect()
        spark, took = self.items.sparkSession, []
        for arm, config in self.chosen.items():
            own = self.engine.with_config(config)
            own.lists = None
            for r in rows:
                one = spark.createDataFrame([(r.qid, r.question)], "qid string, question string")
                began = time.perf_counter()
                own.contexts(one)[0].collect()
                took.append((arm, 1000 * (time.perf_counter() - began)))
        found = metrics.nearest_rank(spark.createDataFrame(took, "arm string, ms double"), "arm", "ms", 0.95)
        return found.select("arm", "n", F.col("mean").alias("mean_ms"), F.col("at").alias("p95_ms"))

    def samples(self, model: ChatModel) -> DataFrame:
        """(arm, qid, question, answer, context): every answerable item answered by each arm, without sources below the answer."""
        asked = self.items.select(F.col("id").alias("qid"), "question").distinct().join(self.answerable.select("qid"), "qid", "left_semi")
        parts = []
        for arm, config in self.chosen.items():
            own = self.engine.with_config(config)
            answers = own.answer(asked, model, expand=False)
            told = self.runs.lists.where(F.col("arm") == arm).join(own.chunks, "chunk_id")
            lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s.text), "\n")
            contexts = told.groupBy("qid").agg(lines.alias("context"))
            parts.append(asked.join(answers, "qid").join(contexts, "qid", "left").select(F.lit(arm).alias("arm"), "qid", "question", "answer", "context"))
        return cut(reduce(DataFrame.unionByName, parts))

    def generation(self, model: ChatModel, judge: generation.Judge | None = None) -> DataFrame:
        """(arm, judged, faithfulness, answer_relevancy): mean judgements of the samples."""
        judged = generation.judge(self.samples(model).withColumn("qid", F.struct("arm", "qid")), judge)
        return judged.groupBy(F.col("qid.arm").alias("arm")).agg(F.count("*").alias("judged"), rounded(F.avg("faithfulness")).alias("faithfulness"), rounded(F.avg("relevancy")).alias("answer_relevancy"))


def arm_table(engine: Engine, items: DataFrame, chosen: dict[str, RetrievalConfig] | None = None) -> DataFrame:
    """One row per arm: what it found, refused and cost."""
    return Evaluation.of(engine, items, chosen).table()


def sweep(engines: dict[tuple[int, int], Engine], items: DataFrame) -> DataFrame:
    """(size, overlap, arm, recall_*, ...): chunkings, without and with second scores; gold is comments, so that all chunkings are measured alike."""
    parts = []
    for (size, overlap), engine in engines.items():
        base = engine.config.with_(k=DEPTH, chunk_size=size, chunk_overlap=overlap)
        found = Evaluation.of(engine, items, {"baseline": base.with_(rerank="never"), "reranked": base.with_(rerank="always")}).retrieval()
        parts.append(found.select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), *found.columns))
    return reduce(DataFrame.unionByName, parts)
