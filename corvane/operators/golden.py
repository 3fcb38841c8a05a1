"""Golden items: their gold comments, found by phrases, and their kinds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import anchor_tokens, phrase_anchor, phrase_pattern, squeeze
from corvane.operators.durable import broadcast_below, cut


FEW = 5_000


def as_items(spark: SparkSession, items: list[tuple[str, list[str]]] | DataFrame) -> DataFrame:
    """Items as a table (item_id, phrases)."""
    return items if isinstance(items, DataFrame) else spark.createDataFrame(items, "item_id string, phrases array<string>")


def _marked(mark: str) -> Callable[[Column], Column]:
    """A token as a key: whole after w:, its first characters after their number."""
    return lambda t: F.concat(F.lit(mark + ":"), t if mark == "w" else F.substring(t, 1, int(mark)))


def resolve(items: list[tuple[str, list[str]]] | DataFrame, comments: DataFrame) -> DataFrame:
    """(item_id, source_id): the comments that hold all phrases of an item.

    An item's longest word, or stem, must stand in such a comment: comments meet
    items by an equality join of their distinct tokens, or beginnings of tokens,
    with these, and only pairs that meet are tested by the phrases' patterns.  An
    item without phrases or without comment has one row with a null source_id;
    phrases without any letter or digit are an error.
    """
    spark = comments.sparkSession
    asked = as_items(spark, items).select("item_id", "phrases")

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, phrases in zip(b.item_id, b.phrases):
                if phrases is None or not len(phrases):
                    continue
                anchor = phrase_anchor(list(phrases))
                if anchor is None:
                    raise ValueError(f"the phrases of {name} have no letter or digit")
                rows.append((name, f"{len(anchor[0]) if anchor[1] else 'w'}:{anchor[0]}", [phrase_pattern(p) for p in phrases]))
            yield pd.DataFrame(rows, columns=["item_id", "key", "patterns"])

    anchors = cut(asked.mapInPandas(prepare, "item_id string, key string, patterns array<string>"))
    marks = [r.mark for r in anchors.select(F.substring_index("key", ":", 1).alias("mark")).distinct().orderBy("mark").limit(1_000).collect()]  # a stem is a word: lengths are few
    if not marks:
        return asked.select("item_id", F.lit(None).cast("string").alias("source_id"))
    keys = F.concat(*[F.transform("words", _marked(m)) for m in marks])
    low = comments.where("text is not null").select("source_id", F.lower(squeeze(F.col("text"))).alias("low"))
    low = low.withColumn("words", anchor_tokens(F.col("low")))
    few = [r.key for r in anchors.select("key").distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:  # a set of constants sorts the keys out before each makes a row
        keys = F.filter(keys, lambda k: k.isin(few))
    met = low.select("source_id", "low", F.explode(keys).alias("key")).join(broadcast_below(anchors, 50_000), "key")
    served = met.where(F.forall("patterns", lambda p: F.rlike(F.col("low"), p))).select("item_id", "source_id").distinct()
    return asked.select("item_id").join(served, "item_id", "left")


def unresolved(items: list[tuple[str, list[str]]] | DataFrame, resolved: DataFrame) -> DataFrame:
    """The items that have phrases and found no comment; a golden set with such items shouldn't be written."""
    asked = as_items(resolved.sparkSession, items).where(F.size("phrases") > 0).select("item_id")
    return resolved.where(F.col("source_id").isNull()).join(asked, "item_id", "left_semi").select("item_id")


def golden_set(items: DataFrame) -> DataFrame:
    """(id, type, difficulty, is_refuse, n_gold): an item is to be refused by its type or for want of gold."""
    gold = F.coalesce(F.size(F.array_distinct("gold_source_ids")), F.lit(0))
    n = F.when(F.col("gold_source_ids").isNull(), 0).otherwise(gold)
    return items.select("id", "type", "difficulty", (F.coalesce(F.col("type") == "refuse", F.lit(False)) | (n == 0)).alias("is_refuse"), n.cast("long").alias("n_gold")).distinct()


def gold_pairs(items: DataFrame) -> DataFrame:
    """(qid, source_id) of all gold comments."""
    return items.select(F.col("id").alias("qid"), F.explode("gold_source_ids").alias("source_id")).distinct()


def chunk_sources(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source_id), each once; chunks without sources have no row."""
    return chunks.select("chunk_id", F.explode("source_ids").alias("source_id")).distinct()
