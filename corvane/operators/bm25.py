"""BM25 over chunks, for many questions at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions.text import TOKEN, tokens
from corvane.operators.durable import cut
from corvane.operators.ranking import DECIMALS, Best, top_k

K1, B, EPSILON = 1.5, 0.75, 0.25
_TERM = re.compile(TOKEN).findall


@dataclass(frozen=True)
class Bm25Index:
    """counted (chunk_id, dl, counts: terms with their tf), idf (term, df, idf) and totals (n, avgdl), the last one row."""

    counted: DataFrame
    idf: DataFrame
    totals: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(chunk_id, term, tf, dl)."""
        return self.counted.select("chunk_id", "dl", F.explode("counts").alias("c")).select("chunk_id", "c.term", "c.tf", "dl")

    @property
    def chunks(self) -> DataFrame:
        return self.counted.select("chunk_id")


def _counted(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, counts): a chunk's terms are counted where its text is, so no term is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, bounds, terms, counts = [], [0], [], []
            for text in b.column(1).to_pylist():
                found = Counter(_TERM(text.lower())) if text else Counter()
                lengths.append(found.total())
                terms += found.keys()
                counts += found.values()
                bounds.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)], ["chunk_id", "dl", "counts"])

    return chunks.mapInArrow(run, "chunk_id string, dl int, counts array<struct<term: string, tf: bigint>>")


def build_bm25(chunks: DataFrame) -> Bm25Index:
    """The index of (chunk_id, text), written to the shared folder, so that texts are cut into terms once; chunks that occur twice count once.

    A term that more than half of the chunks hold would get a negative weight
    and gets EPSILON times the mean weight instead.  A chunk without tokens
    counts for the averages.
    """
    once = chunks.select("chunk_id", "text").distinct()
    counted = cut(_counted(once))
    totals = cut(counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    found = Bm25Index(counted, counted, totals).postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals.select("n")))
    raw = found.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    raw = cut(raw)
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(counted, cut(idf), totals)


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, term, qtf) of (qid, question)."""
    return questions.select("qid", F.explode(tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def search_bm25(index: Bm25Index, questions: DataFrame, n: int, *, block: int = 512) -> DataFrame:
    """(qid, chunk_id, score, rank): the n best chunks of each question.

    Questions go out in blocks of a fixed size, as a matrix of their terms'
    weights; each batch of chunks is a matrix over the same terms, and a task
    answers with the n best per question of all it read.  So postings are never joined or moved,
    however common a term is.  A chunk without a common term scores 0; such
    chunks fill a list that would be shorter than n, in order of chunk_id.
    """
    weighed = cut(question_terms(questions).join(index.idf, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("w")))
    totals = index.totals.first()
    parts = max(1, -(-questions.select("qid").distinct().count() // block))
    id_kind = questions.schema["qid"].dataType
    id_type = to_arrow_type(id_kind)
    found = None
    for part in range(parts):
        rows = weighed.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).collect()
        names = sorted({r.qid for r in rows})
        terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        matrix, place = np.zeros((len(terms), len(names))), {q: i for i, q in enumerate(names)}
        for r in rows:
            matrix[terms[r.term], place[r.qid]] = r.w
        sent = questions.sparkSession.sparkContext.broadcast((names, terms, matrix, float(totals.avgdl or 0) or 1.0))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, known, weights, mean = sent.value
            step = max(64, min(4096, 4_000_000 // max(len(known), 1)))  # rows whose matrix takes 32 MB
            vocabulary, best = pa.array(list(known), pa.string()), Best(len(asked), n)
            for whole in batches:
                for start in range(0, whole.num_rows if asked else 0, step):
                    b = whole.slice(start, step)
                    counts = b.column(2)
                    owner = np.repeat(np.arange(b.num_rows), np.diff(counts.offsets.to_numpy()))
                    pairs = counts.flatten()
                    at = pc.fill_null(pc.index_in(pairs.field(0), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                    hit = at >= 0
                    owner, at, tf = owner[hit], at[hit], pairs.field(1).to_numpy()[hit].astype(float)
                    norm = K1 * (1 - B + B * b.column(1).to_numpy().astype(float) / mean)
                    table = np.zeros((b.num_rows, len(known)))
                    table[owner, at] = tf * (K1 + 1) / (tf + norm[owner])
                    scores = np.round(table @ weights, DECIMALS).T
                    best.add(scores, b.column(0), scores != 0)
            yield from best.batches(pa.array(asked, id_type), ["qid", "chunk_id", "score"])

        answers = index.counted.select("chunk_id", "dl", "counts").mapInArrow(run, f"qid {id_kind.simpleString()}, chunk_id string, score double")
        found = answers if found is None else found.union(answers)
    best = cut(top_k(found, n).select("qid", "chunk_id", "score"))
    short = questions.select("qid").distinct().join(best.groupBy("qid").count(), "qid", "left").where(F.coalesce("count", F.lit(0)) < n).select("qid")
    spare = index.chunks.orderBy("chunk_id").limit(2 * n)
    filled = short.crossJoin(F.broadcast(spare)).join(best, ["qid", "chunk_id"], "left_anti").select("qid", "chunk_id", F.lit(0.0).alias("score"))
    return top_k(best.unionByName(filled), n)
