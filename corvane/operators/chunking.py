"""Pseudo-documents of consecutive comments, chunks of them, and the comments that a chunk touches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.numbering import numbered

GROUP = 40


def pseudo_spans(corpus: DataFrame, *, order: list[str] | None = None, group: int = GROUP) -> DataFrame:
    """(doc_id, source_id, start_pos, end_pos): `group` consecutive comments make a document, parted by one newline; null texts are left out."""
    order = order or ["ingested_at", "source_id"]
    known = corpus.where("text is not null").select("source_id", *(c for c in order if c != "source_id"), F.length("text").alias("size"))
    placed = numbered(known, order).withColumn("d", F.floor(F.col("rn") / group))
    before = Window.partitionBy("d").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("int")
    return placed.select(F.format_string("doc%04d", "d").alias("doc_id"), "source_id", start.alias("start_pos"), "size").select("doc_id", "source_id", "start_pos", (F.col("start_pos") + F.col("size")).alias("end_pos"))


def document_texts(spans: DataFrame, comments: DataFrame) -> DataFrame:
    """(doc_id, doc_text): the comments' texts in order of position, parted by one newline."""
    texts = comments.select("source_id", "text").distinct()
    parts = spans.select("doc_id", "source_id", "start_pos").distinct().join(texts, "source_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "text"))), lambda p: p.text)
    return parts.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("doc_text"))


def fixed_windows(documents: DataFrame, *, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, window_no, start_pos, text): windows of `size` code points, each beginning size - overlap after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be shorter than the window")
    step = size - overlap
    last = F.greatest(F.ceil((F.length("doc_text") - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
    numbers = documents.where("doc_text <> ''").select("doc_id", "doc_text", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    start = F.col("window_no") * step
    return numbers.select("doc_id", "window_no", start.alias("start_pos"), F.substring("doc_text", start + 1, F.lit(size)).alias("text"))


def provenance(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(chunk_id, source_ids): the comments that share a character with each chunk, in order of position.

    An equality on the document and two inequalities; a chunk that touches none
    has an empty list.  Chunks are (chunk_id, doc_id, start_pos, text).
    """
    once = chunks.select("chunk_id", "doc_id", "start_pos", (F.col("start_pos") + F.length("text")).alias("stop")).distinct().alias("c")
    parts = spans.select("doc_id", "source_id", "start_pos", "end_pos").distinct().alias("s")
    meets = (F.col("c.doc_id") == F.col("s.doc_id")) & (F.col("s.start_pos") < F.col("c.stop")) & (F.col("s.end_pos") > F.col("c.start_pos"))
    found = once.join(parts, meets, "left").groupBy("c.chunk_id").agg(F.array_sort(F.collect_list(F.when(F.col("s.source_id").isNotNull(), F.struct(F.col("s.start_pos").alias("at"), F.col("s.source_id").alias("id"))))).alias("found"))
    return found.select("chunk_id", F.array_distinct(F.transform("found", lambda s: s.id)).alias("source_ids"))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size`: cut at the first separator that occurs, which stays at the head of what follows; longer parts are cut at the next one."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        head, *tail = text.split(separator)
        parts = [p for p in [head, *(separator + t for t in tail)] if p]
    else:
        parts = list(text)
    pieces: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        whole = "".join(held).strip()
        if whole:
            pieces.append(whole)

    for part in parts:
        if len(part) > size and finer:
            flush()
            held, length = [], 0
            pieces += split_recursively(part, size, overlap, finer)
            continue
        if length + len(part) > size and held:
            flush()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    flush()
    return pieces


def recursive_chunks(documents: DataFrame, *, size: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, chunk_no, start_pos, text): split_recursively of each document, with where each piece is found in it.

    The search for a piece begins where the one before ends, less the overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                at, previous = 0, 0
                for n, piece in enumerate(split_recursively(text or "", size, overlap)):
                    at = text.find(piece, max(0, at + previous - overlap) if n else 0)
                    previous = len(piece)
                    owner.append(i)
                    out.append((n, at, piece))
            columns = zip(*out) if out else [()] * 3
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int32())), *arrays], ["doc_id", "chunk_no", "start_pos", "text"])

    return documents.select("doc_id", "doc_text").mapInArrow(run, "doc_id string, chunk_no int, start_pos int, text string")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """The chunks with `chunk_id`, c and a five-digit counter over all documents in order."""
    return numbered(chunks, ["doc_id", "chunk_no"]).withColumn("chunk_id", F.format_string("c%05d", "rn")).drop("rn")
