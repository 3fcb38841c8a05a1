"""Ranked lists: rows (qid, chunk_id, score, rank), rank from 0, ties by chunk_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECIMALS = 6


def rounded(score: Column) -> Column:
    """Scores are ranked as rounded, so that the order in which a sum was made can't change a rank."""
    return F.round(score, DECIMALS)


def top_k(scored: DataFrame, k: int, *, key: str = "qid", item: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k best items of each key with their rank; each partition keeps only its k best before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc(score), item)
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", (F.col("rank") - 1).cast("int"))


class Best:
    """The n best items of each query over all batches of a task, so that a task sends n rows a query however much it reads.

    Queries are numbers; ties go to the smaller item.  Rows gather until they are
    several times what will be kept, then all but the best are dropped.
    """

    def __init__(self, queries: int, n: int):
        self.n, self.most = n, 100_000 + 4 * n * queries
        self.least = np.full(queries, -np.inf)  # what a score must reach to be among the best
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, scores: np.ndarray, items: pa.Array, wanted: np.ndarray) -> None:
        """scores and wanted (which of them count) are queries by items."""
        wanted = wanted & (scores >= self.least[:, None])
        if scores.shape[1] > self.n:
            wanted &= scores >= np.partition(np.where(wanted, scores, -np.inf), scores.shape[1] - self.n, axis=1)[:, [scores.shape[1] - self.n]]
        q, i = np.nonzero(wanted)
        if len(q):
            self.parts.append(pa.table({"q": pa.array(q.astype(np.int32)), "item": items.take(pa.array(i)), "score": pa.array(scores[q, i])}))
            self.rows += len(q)
            if self.rows > self.most:
                self._reduce()

    def _reduce(self) -> None:
        whole = pa.concat_tables(self.parts)
        whole = whole.take(pc.sort_indices(whole, [("q", "ascending"), ("score", "descending"), ("item", "ascending")]))
        q = whole.column("q").to_numpy()
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        last = place == self.n - 1
        self.least[q[last]] = whole.column("score").to_numpy()[last]
        whole = whole.filter(pa.array(place < self.n))
        self.parts, self.rows = [whole], len(whole)

    def batches(self, names: pa.Array, columns: list[str]) -> list[pa.RecordBatch]:
        """(query, item, score) under the given names; names are the queries' ids by number."""
        if not self.parts:
            return []
        self._reduce()
        whole = self.parts[0].combine_chunks()
        return pa.table([names.take(whole.column("q").combine_chunks()), whole.column("item"), whole.column("score")], names=columns).to_batches()
