"""Prompts from contexts, citations in answers, and judges of both."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators.ranking import rounded

HEADER = "Answer the question from the numbered sources alone and cite them like [1]. Say so if they don't hold the answer."
REFUSAL = "The sources don't hold an answer to this question."


def build_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, prompt): header, sources numbered from 1 in order of rank, and the question; no sources leave that part empty.

    contexts is (qid, rank, text), a short list per question.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: F.concat(F.lit("["), (s.rank + 1).cast("string"), F.lit("] "), s.text))
    sources = contexts.groupBy("qid").agg(F.array_join(lines, "\n").alias("sources"))
    whole = F.concat(F.lit(HEADER + "\n\nSources:\n"), F.coalesce("sources", F.lit("")), F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer:"))
    return questions.join(sources, "qid", "left").select("qid", whole.alias("prompt"))


def cited_numbers(answer: Column) -> Column:
    """The numbers in square brackets, each once, in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,6})\]"), F.lit(1)), lambda n: n.cast("int")))


def expand_citations(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, expanded): the trimmed answer, and below it the cited sources in order of first mention.

    Numbers beyond the list are ignored; an answer without a valid citation
    stays as it is; a null answer stays null.
    """
    numbers = answers.select("qid", "answer", F.posexplode_outer(cited_numbers(F.col("answer"))).alias("at", "number"))
    known = contexts.select("qid", (F.col("rank") + 1).alias("number"), "chunk_id", "text").distinct()
    lines = numbers.join(known, ["qid", "number"], "left")
    line = F.when(F.col("chunk_id").isNotNull(), F.struct("at", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("chunk_id"), F.lit(": "), F.col("text")).alias("line")))
    listed = lines.groupBy("qid", "answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s.line), "\n").alias("sources"))
    return listed.select("qid", F.when(F.col("sources") == "", F.trim("answer")).otherwise(F.concat(F.trim("answer"), F.lit("\n\nSources:\n"), F.col("sources"))).alias("expanded"))


class Judge(Protocol):
    """(faithfulness, relevancy) of answers, each from 0 to 1, for lists of questions, answers and contexts."""

    def judge(self, questions: list[str], answers: list[str], contexts: list[str]) -> list[tuple[float, float]]: ...


def judge(samples: DataFrame, by: Judge | None = None) -> DataFrame:
    """(qid, faithfulness, relevancy) from (qid, question, answer, context), by the given judge or the default one.

    The default's faithfulness is the share of the answer's distinct tokens that
    the contexts hold, its relevancy the share of the question's that the answer
    holds; 0 without tokens.
    """
    if by is not None:

        @F.pandas_udf("faithfulness double, relevancy double")
        def ask(questions: pd.Series, answers: pd.Series, contexts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(by.judge(*(x.fillna("").tolist() for x in (questions, answers, contexts))), columns=["faithfulness", "relevancy"], dtype=float)

        return samples.select("qid", ask("question", "answer", "context").alias("j")).select("qid", rounded(F.col("j.faithfulness")).alias("faithfulness"), rounded(F.col("j.relevancy")).alias("relevancy"))

    def share(part: Column, whole: Column) -> Column:
        distinct = F.array_distinct(part)
        return rounded(F.coalesce(F.try_divide(F.size(F.array_intersect(distinct, whole)), F.size(distinct)), F.lit(0.0)))

    q, a, c = (tokens(F.coalesce(F.col(x), F.lit(""))) for x in ("question", "answer", "context"))
    return samples.select("qid", share(a, c).alias("faithfulness"), share(q, a).alias("relevancy"))
