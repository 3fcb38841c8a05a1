"""Raw blocks to a deduplicated corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import SPACE, TIMESTAMP_LINE, squeeze
from corvane.operators.numbering import numbered

LEAST_LENGTH = 3


def source_tag(path: Column) -> Column:
    """reddit where the file's name contains that word, else yt."""
    return F.when(F.lower(F.element_at(F.split(path, "/"), -1)).contains("reddit"), "reddit").otherwise("yt")


def parse_blocks(files: DataFrame, *, path_col: str = "path", content_col: str = "content", keep: list[str] | None = None) -> DataFrame:
    """(path, block_no, timestamp, text): blocks parted by blank lines, with the columns named in keep.

    Lines are stripped and empty ones dropped; a first line that is a timestamp
    becomes the block's timestamp, the others are joined by blanks.  A block
    that has no text is dropped, and keeps its number.  A null or empty content
    has no block.
    """
    kept = keep or []
    unix = F.regexp_replace(F.col(content_col), r"\r\n?", "\n")
    blocks = files.where(F.col(content_col).isNotNull()).select(F.col(path_col).alias("path"), *kept, F.posexplode(F.split(unix, rf"\n{SPACE}*\n")).alias("block_no", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")
    parsed = blocks.select("path", *kept, "block_no", lines.alias("lines")).where(F.size("lines") > 0)
    dated = F.element_at("lines", 1).rlike(TIMESTAMP_LINE)
    parsed = parsed.select("path", *kept, "block_no", F.when(dated, F.element_at("lines", 1)).alias("timestamp"), F.array_join(F.when(dated, F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines")), " ").alias("text"))
    return parsed.where(F.col("text") != "")


def first_of_each(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Of the rows with equal key the first in order, found by a minimum that is combined before the shuffle, so that a key of a third of all rows is no burden."""
    rest = [c for c in rows.columns if c not in order]
    packed = rows.select(key.alias("__key"), F.struct(*order, *rest).alias("__row"))
    kept = packed.groupBy("__key").agg(F.min("__row").alias("__row"))
    return kept.select(*[F.col(f"__row.{c}").alias(c) for c in rows.columns])


def deduplicated_corpus(comments: DataFrame) -> DataFrame:
    """(source_id, source, text, order columns) of the first comment of each text.

    Texts are compared after white space is squeezed and case is lowered; texts
    shorter than three code points are dropped.  The first is the one ingested
    first, of several the one with the smallest source_id; a redelivered comment
    is thereby taken once.
    """
    clean = comments.select("ingested_at", "source_id", F.lower(F.trim("source")).alias("source"), squeeze(F.col("text")).alias("text"))
    long_enough = clean.where(F.length("text") >= LEAST_LENGTH)
    return first_of_each(long_enough, F.lower("text"), ["ingested_at", "source_id"])


def corpus_ids(corpus: DataFrame) -> DataFrame:
    """The corpus with `corpus_id`, the tag and a five-digit counter of its survivors in order of ingestion."""
    counted = numbered(corpus, ["ingested_at", "source_id"], within=["source"])
    return counted.withColumn("corpus_id", F.format_string("%s:%05d", "source", "rn")).drop("rn")
