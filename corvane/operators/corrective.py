"""Grading of candidates, and the corrective loop that rewrites or widens its search, or abstains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import RetrievalConfig
from corvane.models import ChatModel, replies, rewritten, says_yes
from corvane.operators.durable import cut
from corvane.operators.ranking import top_k

CORRECT, AMBIGUOUS, INCORRECT = "CORRECT", "AMBIGUOUS", "INCORRECT"
RELEVANT = "Does the passage help to answer the question? Answer YES or NO.\nQuestion: "
REWRITE = "This search query found little. Write one better query for the same need, with fuller or more specific words. Answer with the query alone.\nQuery: "
SAMPLE, SAMPLE_LENGTH = 3, 160


def grade(ranked: DataFrame, questions: DataFrame, config: RetrievalConfig, relax: Column | None = None, *, says: Column | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank, signal, is_relevant, kept, action): one row per candidate, one with nulls for a question without any.

    By thresholds of the candidate's signal (ce or cosine), the one for relevance
    lowered by relax; or by `says`, a column of yes and no.  Any relevant:
    CORRECT, and the relevant are kept.  None above the incorrect bar, or nothing
    said yes: INCORRECT, nothing kept.  Else AMBIGUOUS, those above the bar kept;
    an empty list is AMBIGUOUS too, INCORRECT where `says` judges.
    """
    scored = F.col("signal") == "ce"
    bar = F.when(scored, config.scored_relevant).otherwise(config.cosine_relevant) - (relax if relax is not None else F.lit(0.0))
    floor = F.when(scored, config.scored_incorrect).otherwise(config.cosine_incorrect)
    relevant = says if says is not None else F.col("score") >= bar
    marked = ranked.withColumn("is_relevant", relevant).withColumn("above", F.lit(False) if says is not None else F.col("score") > floor)
    overall = marked.groupBy("qid").agg(F.bool_or("is_relevant").alias("some"), F.bool_or("above").alias("any_above"))
    action = F.when(F.col("some"), CORRECT).when(~F.col("any_above"), INCORRECT).otherwise(AMBIGUOUS)
    judged = questions.select("qid").join(overall, "qid", "left").select("qid", F.coalesce(F.when(F.col("some").isNotNull(), action), F.lit(AMBIGUOUS if says is None else INCORRECT)).alias("action"))
    kept = F.when(F.col("action") == CORRECT, F.col("is_relevant")).when(F.col("action") == AMBIGUOUS, F.col("above")).otherwise(False)
    return judged.join(marked, "qid", "left").select("qid", "chunk_id", "score", "rank", "signal", "is_relevant", F.coalesce(F.when(F.col("chunk_id").isNotNull(), kept), F.lit(False)).alias("kept"), "action")


def judged_by(ranked: DataFrame, questions: DataFrame, texts: DataFrame, model: ChatModel) -> DataFrame:
    """(qid, chunk_id, says): whether the model calls the chunk relevant; a failing answer is no."""
    told = ranked.select("qid", "chunk_id").distinct().join(questions.select("qid", "question"), "qid").join(texts.select("chunk_id", "text").distinct(), "chunk_id")
    prompt = F.concat(F.lit(RELEVANT), F.coalesce("question", F.lit("")), F.lit("\nPassage: "), F.coalesce("text", F.lit("")))
    return told.select("qid", "chunk_id", F.coalesce(says_yes(model, prompt), F.lit(False)).alias("says"))


def reformulated(questions: DataFrame, weak: DataFrame, texts: DataFrame, model: ChatModel) -> DataFrame:
    """(qid, rewritten): the model's new query, told the first few weak results of (qid, chunk_id, rank); null where it fails or repeats the old one."""
    shown = weak.where(F.col("rank") < SAMPLE).join(texts.select("chunk_id", "text").distinct(), "chunk_id")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, SAMPLE_LENGTH).alias("t")))), lambda s: F.concat(F.lit("- "), s.t)), "\n")
    sample = shown.groupBy("qid").agg(lines.alias("sample"))
    prompt = F.concat(F.lit(REWRITE), F.coalesce("question", F.lit("")), F.lit("\nFound:\n"), F.coalesce("sample", F.lit("(nothing)")))
    answered = questions.select("qid", "question").join(sample, "qid", "left").select("qid", "question", replies(model, prompt).alias("reply"))
    return answered.select("qid", rewritten(F.col("question"), F.col("reply")).alias("rewritten"))


@dataclass(frozen=True)
class Steps:
    """What the loop calls, each for a batch of questions (qid, question).

    candidates(questions, n) -> (qid, chunk_id, score, rank), cheap to read twice; gate(ranked,
    questions) -> (qid, rerank); second(pairs, questions) -> (qid, chunk_id,
    pair_score); says(ranked, questions) -> (qid, chunk_id, says), None to grade
    by thresholds; rewrite(questions, weak) -> (qid, rewritten), None for a loop
    that can only widen.
    """

    candidates: Callable[[DataFrame, int], DataFrame]
    gate: Callable[[DataFrame, DataFrame], DataFrame]
    second: Callable[[DataFrame, DataFrame], DataFrame]
    says: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    rewrite: Callable[[DataFrame, DataFrame], DataFrame] | None = None


@dataclass
class Loop:
    """The state of a batch: questions still open with their settings, and what each round found.

    active is (qid, question, widened), widened the number of times that a
    question's search was widened; a round works on it, written to the shared
    folder, so no plan grows with the rounds.
    """

    questions: DataFrame
    config: RetrievalConfig
    steps: Steps
    turn: int = 0
    active: DataFrame | None = None
    graded: DataFrame | None = None
    judged: DataFrame | None = None
    trace: list[DataFrame] = field(default_factory=list)
    pools: list[DataFrame] = field(default_factory=list)
    ranked: DataFrame | None = None
    contexts: DataFrame | None = None
    calls: DataFrame | None = None

    @property
    def last(self) -> bool:
        return self.turn >= self.config.correction_rounds

    def start(self) -> None:
        self.active = cut(self.questions.select("qid", "question", F.lit(0).alias("widened")).distinct())

    def retrieve(self) -> None:
        """The round's lists: as many candidates as each question has widened to, second scores where the gate or an uncalibrated first stage asks for them."""
        config, asked = self.config, self.active
        depths = range(self.turn + 1) if self.steps.rewrite is not None else [self.turn]  # without rewrites all have widened as often
        parts = [asked.where(F.col("widened") == w).select("qid", "question") for w in depths]
        found = [self.steps.candidates(p, config.rerank_candidates * config.widen_factor**w) for w, p in zip(depths, parts) if len(parts) == 1 or p.limit(1).count()]
        ranked = reduce(DataFrame.unionByName, found)
        gated = self.steps.gate(ranked, asked).select("qid", "rerank", (F.col("rerank") if config.retrieval == "dense" else F.lit(True)).alias("scored"))
        decided = cut(ranked.join(gated, "qid"))
        again = self.steps.second(decided.where("scored").select("qid", "chunk_id"), asked)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("pair_score"), "chunk_id")) - 1
        told = decided.join(again, ["qid", "chunk_id"], "left").select(
            "qid", "chunk_id", F.when(F.col("scored"), F.col("pair_score")).otherwise(F.col("score")).alias("score"), F.when(F.col("rerank"), place).otherwise(F.col("rank")).alias("rank"), F.when(F.col("scored"), "ce").otherwise("cosine").alias("signal"), "rerank", "scored"
        )
        self.ranked = cut(told)

    def grade(self) -> None:
        """Actions and what is kept, and the round's row of the trace."""
        config = self.config
        ranked = self.ranked.join(self.active.select("qid", "widened"), "qid")
        says = None
        if self.steps.says is not None:
            ranked = ranked.join(self.steps.says(self.ranked, self.active), ["qid", "chunk_id"], "left").withColumn("says", F.coalesce("says", F.lit(False)))
            says = F.col("says")
        self.graded = cut(grade(ranked, self.active, config, F.lit(config.relax_step) * F.col("widened"), says=says))
        kept = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("rank", "chunk_id"))))
        seen = self.graded.groupBy("qid", "action").agg(F.count("chunk_id").alias("n_candidates"), F.transform(kept, lambda x: x.chunk_id).alias("kept_chunk_ids"))
        how = self.ranked.select("qid", "rerank", "scored").distinct()
        told = seen.join(self.active, "qid").join(how, "qid", "left")
        self.judged = told.select("qid", "question", "widened", "action", "n_candidates", F.coalesce("rerank", F.lit(False)).alias("reranked"), F.coalesce("scored", F.lit(False)).alias("scored"), "kept_chunk_ids")
        self.pools.append(self.graded.where("kept").select("qid", "chunk_id", "score", "signal"))

    def transform(self) -> None:
        """Another query where the model has one, else a wider search; who is CORRECT leaves."""
        if self.steps.rewrite is not None and not self.last:
            self.judged = cut(self.judged)
            open_ = self.judged.where(F.col("action") != CORRECT)
            weak = self.ranked.join(open_.select("qid"), "qid", "left_semi")
            changed = cut(self.judged.join(self.steps.rewrite(open_.select("qid", "question"), weak), "qid", "left"))  # a model may answer otherwise when asked again
        else:
            changed = self.judged.withColumn("rewritten", F.lit(None).cast("string"))
        ends = (F.col("action") == CORRECT) | F.lit(self.last)
        correction = F.when(~ends, F.when(F.col("rewritten").isNotNull(), "reformulate").otherwise("widen"))
        told = cut(changed.select("qid", F.lit(self.turn).alias("round_idx"), F.col("question").alias("query"), "n_candidates", "reranked", "scored", "action", "kept_chunk_ids", F.size("kept_chunk_ids").cast("long").alias("n_kept"), correction.alias("correction"), "widened", "rewritten"))
        self.trace.append(told.drop("widened", "rewritten"))
        wider = F.col("widened") + F.when(F.col("correction") == "widen", 1).otherwise(0)
        self.active = told.where("correction is not null").select("qid", F.coalesce("rewritten", "query").alias("question"), wider.alias("widened"))
        self.turn += 1

    @property
    def done(self) -> bool:
        return self.turn > self.config.correction_rounds or not self.active.limit(1).count()

    def finalize(self) -> None:
        """The contexts: of each question the k best of all rounds."""
        pool = cut(reduce(DataFrame.unionByName, self.pools))
        mixed = mixed_signals(pool)
        second = self.steps.second(pool.join(mixed, "qid", "left_semi").select("qid", "chunk_id").distinct(), self.questions)
        self.contexts = finalise(pool, second, self.config.k)
        once = reduce(DataFrame.unionByName, [t.where("scored").select("qid") for t in self.trace]).unionByName(mixed)
        self.calls = once.groupBy("qid").agg(F.count("*").alias("calls"))


# The loop as a graph: from each node its successors, the first whose condition holds.
GRAPH: dict[str, list[tuple[str, str, Callable[[Loop], bool]]]] = {
    "start": [("retrieve", "", lambda loop: True)],
    "retrieve": [("grade", "", lambda loop: True)],
    "grade": [("transform", "", lambda loop: True)],
    "transform": [("finalize", "CORRECT or no round left", lambda loop: loop.done), ("retrieve", "rewritten or widened", lambda loop: True)],
    "finalize": [],
}


def diagram() -> str:
    """The graph in Mermaid's notation."""
    lines = [f"  {a} -->{f'|{label}|' if label else ''} {b}" for a, edges in GRAPH.items() for b, label, _ in edges]
    return "\n".join(["graph TD", *lines]) + "\n"


def _by_graph(loop: Loop) -> None:
    """Walks the graph; a round takes three steps, and more than a loop can need are an error."""
    at, walked = "start", 0
    while True:
        getattr(loop, at)()
        if not GRAPH[at]:
            return
        walked += 1
        if walked > 3 * (loop.config.correction_rounds + 1) + 5:
            raise RuntimeError("the graph took more steps than its rounds allow")
        at = next(to for to, _, holds in GRAPH[at] if holds(loop))


def _plainly(loop: Loop) -> None:
    loop.start()
    for _ in range(loop.config.correction_rounds + 1):
        loop.retrieve()
        loop.grade()
        loop.transform()
        if loop.done:
            break
    loop.finalize()


def correct(questions: DataFrame, config: RetrievalConfig, steps: Steps) -> Loop:
    """The finished loop over (qid, question): its trace, contexts and calls.

    trace is (qid, round_idx, query, n_candidates, reranked, scored, action,
    kept_chunk_ids, n_kept, correction), ids in order of rank; contexts is (qid,
    chunk_id, score, rank), and a question without contexts is refused; calls is
    (qid, calls), the second scorings of a question's lists.  Each round gates
    and scores, stops who is CORRECT, and for the others rewrites the query or,
    where there is no rewrite, widens the search and lowers the bar.
    """
    loop = Loop(questions.select("qid", "question").distinct(), config, steps)
    (_by_graph if config.loop == "graph" else _plainly)(loop)
    return loop


def all_rounds(loop: Loop) -> DataFrame:
    """The trace of every round as one table."""
    return reduce(DataFrame.unionByName, loop.trace)


def mixed_signals(pool: DataFrame) -> DataFrame:
    """The questions whose pool has scores of both kinds, which can't be compared and are scored again."""
    return pool.groupBy("qid").agg(F.countDistinct("signal").alias("n")).where("n > 1").select("qid")


def finalise(pool: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank): best score per chunk; where signals are mixed the second scores (qid, chunk_id, pair_score) stand for all."""
    mixed = mixed_signals(pool).withColumn("mixed", F.lit(True))
    best = pool.groupBy("qid", "chunk_id").agg(F.max("score").alias("best")).join(mixed, "qid", "left").join(second, ["qid", "chunk_id"], "left")
    return top_k(best.select("qid", "chunk_id", F.when(F.coalesce("mixed", F.lit(False)), F.col("pair_score")).otherwise(F.col("best")).alias("score")), k)
