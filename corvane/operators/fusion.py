"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.ranking import rounded, top_k


def fuse(lists: list[DataFrame], n: int, *, rrf_k: int = 60) -> DataFrame:
    """(qid, chunk_id, score, rank): the n chunks with the largest sum of 1 / (rrf_k + rank), ranks from 0.

    A union and one aggregation stand for the outer join of all lists.
    """
    rows = reduce(DataFrame.unionByName, [x.select("qid", "chunk_id", "rank") for x in lists])
    return top_k(rows.groupBy("qid", "chunk_id").agg(rounded(F.sum(1 / (F.lit(float(rrf_k)) + F.col("rank")))).alias("score")), n)
