"""Vectors of texts, and exact search by inner product in blocks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions.text import TOKEN
from corvane.models import Embedder
from corvane.operators.ranking import DECIMALS, Best, top_k

DIMENSIONS = 64
_TOKEN = re.compile(TOKEN).findall


class _Buckets(dict):
    """Token to bucket; emptied when it holds a million."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dimensions
        return self[token]


class HashEmbedder:
    """The default embedder: counts of tokens by the bucket of their hash, scaled to length 1; a text without tokens is the zero vector."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.buckets = dimensions, _Buckets(dimensions)

    def encode(self, texts: list[str]) -> np.ndarray:
        table = np.zeros((len(texts), self.dimensions))
        for i, text in enumerate(texts):
            if text:
                table[i] = np.bincount([self.buckets[t] for t in _TOKEN(text.lower())], minlength=self.dimensions)
        lengths = np.sqrt((table * table).sum(1, keepdims=True))
        return table / np.where(lengths == 0, 1, lengths)


def embed(rows: DataFrame, embedder: Embedder, *, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, embedding) by any embedder, batch by batch; it sees a null text as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                table = np.asarray(embedder.encode([t or "" for t in b.column(1).to_pylist()]), float)
                lists = pa.ListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "embedding"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, embedding array<double>").withColumnRenamed("id", id_col)


def hash_embed(rows: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, embedding) by the default embedder."""
    return embed(rows, HashEmbedder(dimensions), id_col=id_col, text_col=text_col)


def normalised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The vectors scaled to length 1, as doubles; the zero vector stays."""
    length = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.withColumn(column, F.transform(column, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0))))


def search_vectors(queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str = "qid", item_id: str = "chunk_id", column: str = "embedding", block: int = 4096, leave_out_self: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank): for each query the k items of largest inner product.

    The queries go out in blocks of a fixed size, each as a matrix to every
    batch of items; a task answers with the k best per query of all it read, and
    these few are ranked.  Items are read once per block and never shuffled.  With
    leave_out_self an item with the query's id isn't an answer to it.
    """
    kind, item_kind = (queries.schema[query_id].dataType.simpleString(), vectors.schema[item_id].dataType.simpleString())
    id_type = to_arrow_type(queries.schema[query_id].dataType)
    asked = queries.select(F.col(query_id).alias("q"), F.col(column).cast("array<double>").alias("v"))
    parts = max(1, -(-asked.count() // block))
    found = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).collect()
        ids = [r.q for r in rows]
        matrix = np.array([r.v for r in rows], float).reshape(len(rows), -1) if rows else np.zeros((0, 0))
        sent = queries.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, asked_for = sent.value
            best = Best(len(names), k)
            for whole in batches:
                step = max(64, 8_000_000 // max(len(names), 1))  # items whose scores take 64 MB
                for start in range(0, whole.num_rows if names else 0, step):
                    b = whole.slice(start, step)
                    table = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                    scores = np.round(asked_for @ table.T, DECIMALS)
                    wanted = np.ones(scores.shape, bool)
                    if leave_out_self:
                        place = {x: i for i, x in enumerate(b.column(0).to_pylist())}
                        for q, name in enumerate(names):
                            if name in place:
                                wanted[q, place[name]] = False
                    best.add(scores, b.column(0), wanted)
            yield from best.batches(pa.array(names, id_type), ["q", "item", "score"])

        answers = vectors.select(F.col(item_id).alias("item"), column).where(F.col(column).isNotNull()).mapInArrow(run, f"q {kind}, item {item_kind}, score double")
        found = answers if found is None else found.union(answers)
    best = top_k(found, k, key="q", item="item")
    return best.select(F.col("q").alias(query_id), F.col("item").alias(item_id), "score", "rank")


def top_scores(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, top_score): the best score of each question, 0 where its list is empty."""
    best = ranked.groupBy("qid").agg(F.max("score").alias("top"))
    return questions.select("qid").join(best, "qid", "left").select("qid", F.coalesce("top", F.lit(0.0)).alias("top_score"))
