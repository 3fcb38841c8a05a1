"""Second scores for candidates, and the gate that decides who needs them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import RetrievalConfig
from corvane.functions.text import tokens
from corvane.models import ChatModel, PairScorer, says_yes
from corvane.operators.bm25 import Bm25Index
from corvane.operators.durable import broadcast_below
from corvane.operators.ranking import rounded, top_k


def confidence(ranked: DataFrame, questions: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(qid, top, margin, confident): whether the first candidate stands out.

    margin is the top score less the mean of the others; a single candidate has
    margin 0; a question without candidates has nulls and isn't confident.
    """
    seen = ranked.groupBy("qid").agg(F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("top"), F.avg(F.when(F.col("rank") > 0, F.col("score"))).alias("tail"))
    judged = seen.select("qid", "top", rounded(F.col("top") - F.coalesce("tail", "top")).alias("margin"))
    sure = (F.col("top") >= config.auto_top) & (F.col("margin") >= config.auto_margin)
    return questions.select("qid").join(judged, "qid", "left").withColumn("confident", F.coalesce(sure, F.lit(False)))


def gate(ranked: DataFrame, questions: DataFrame, config: RetrievalConfig, *, asks: DataFrame | None = None) -> DataFrame:
    """(qid, rerank): by policy; an empty list isn't reranked.

    auto reranks who isn't confident, which only cosines can tell: lists of the
    other first stages are always reranked.  llm does what asks (qid, asks) says,
    and as auto where that is null or missing.
    """
    sure = confidence(ranked, questions, config)
    auto = ~F.col("confident") if config.retrieval == "dense" else F.lit(True)
    chosen = {"always": F.lit(True), "never": F.lit(False), "auto": auto}.get(config.policy)
    if chosen is None:
        if asks is None:
            raise ValueError("the policy llm needs a model that is asked")
        sure = sure.join(asks.select("qid", "asks"), "qid", "left")
        chosen = F.coalesce("asks", auto)
    return sure.select("qid", (F.col("top").isNotNull() & chosen).alias("rerank"))


ROUTE = "You route search queries. Is this one so ambiguous, broad or comparative that its results deserve a second, careful scoring? Answer YES or NO.\nQuery: "


def routed(questions: DataFrame, model: ChatModel) -> DataFrame:
    """(qid, asks): whether the model wants a second score for the question; null where it fails."""
    return questions.select("qid", says_yes(model, F.concat(F.lit(ROUTE), F.coalesce("question", F.lit("")))).alias("asks"))


def model_scores(pairs: DataFrame, questions: DataFrame, texts: DataFrame, scorer: PairScorer) -> DataFrame:
    """(qid, chunk_id, pair_score) by any scorer of (question, text), batch by batch."""

    @F.pandas_udf("double")
    def score(asked: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(scorer.score(asked.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

    told = pairs.select("qid", "chunk_id").distinct().join(questions.select("qid", "question"), "qid").join(texts.select("chunk_id", "text").distinct(), "chunk_id")
    return told.select("qid", "chunk_id", rounded(score("question", "text")).alias("pair_score"))


def coverage_scores(pairs: DataFrame, questions: DataFrame, index: Bm25Index) -> DataFrame:
    """(qid, chunk_id, pair_score): the default second scorer, from -5 to 5.

    The share of the question's distinct terms that the chunk holds, by the sparse
    index's terms, weighted by idf; pairs should be cheap to count; a term of no chunk weighs as one of half a chunk would.  A question
    without terms scores -5.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    unseen = F.log(F.col("n") + 0.5) - F.log(F.lit(0.5))
    weighed = asked.join(index.idf, "term", "left").crossJoin(F.broadcast(index.totals.select("n"))).select("qid", "term", F.coalesce("idf", unseen).alias("w"))
    needed = weighed.groupBy("qid").agg(F.sum("w").alias("whole"), F.collect_list(F.struct("term", "w")).alias("terms"))
    met = broadcast_below(pairs.select("qid", "chunk_id").distinct(), 50_000).join(index.counted.select("chunk_id", F.col("counts.term").alias("words")), "chunk_id")
    held = met.join(needed, "qid", "left")
    covered = F.aggregate(F.filter("terms", lambda t: F.array_contains(F.col("words"), t.term)), F.lit(0.0), lambda a, t: a + t.w)
    return held.select("qid", "chunk_id", rounded(10 * F.coalesce(F.try_divide(covered, F.col("whole")), F.lit(0.0)) - 5).alias("pair_score"))


def rerank(ranked: DataFrame, gated: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank, signal): gated questions' candidates by their second score, the others' as they were; cut to k.

    scores need only hold the pairs of gated questions: the scorer never sees the rest.
    """
    decided = ranked.join(gated, "qid")
    again = decided.where("rerank").join(scores, ["qid", "chunk_id"]).select("qid", "chunk_id", F.col("pair_score").alias("score"))
    kept = decided.where(~F.col("rerank") & (F.col("rank") < k)).select("qid", "chunk_id", "score", "rank", F.lit("cosine").alias("signal"))
    return top_k(again, k).withColumn("signal", F.lit("ce")).unionByName(kept)
