"""Corpus, chunks and indexes on disk, one folder per configuration."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corvane.config import RetrievalConfig
from corvane.operators.bm25 import Bm25Index

COMMENT = StructType([StructField(n, StringType(), n == "timestamp") for n in ("source_id", "source", "text", "timestamp")])
CHUNK = StructType([StructField("chunk_id", StringType()), StructField("text", StringType()), StructField("source_ids", ArrayType(StringType())), StructField("doc_id", StringType())])
GOLDEN = StructType([StructField(n, ArrayType(StringType()) if n == "gold_source_ids" else StringType()) for n in ("id", "question", "answer", "gold_source_ids", "type", "difficulty")])
FOLDER_VARIABLE = "CORVANE_DATA"


def data_folder(given: str | None = None) -> str:
    """The argument, else the environment's, else `data` here."""
    return given or os.environ.get(FOLDER_VARIABLE) or str(Path.cwd() / "data")


def read_blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, start, seq, content) of text files, a row for each stretch between empty lines, in the order of (path, start, seq).

    Files are split like any other, so a file of any size fills many tasks; only
    where lines end in CR LF, and so no two LF stand together, is a file one row.
    """
    rows = spark.read.text(paths, lineSep="\n\n")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("content"))


def read_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines by a fixed schema: a malformed record fails, and so does one with a key that the schema hasn't."""
    known = F.array(*[F.lit(n) for n in schema.fieldNames()])
    raw = spark.read.text(path).where(F.trim("value") != "")
    strange = F.size(F.array_except(F.json_object_keys("value"), known)) > 0
    checked = raw.select(F.when(strange, F.raise_error(F.concat(F.lit("unknown key in "), F.col("value")))).otherwise(F.col("value")).alias("value"))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_golden(rows: DataFrame, path: str) -> None:
    """Golden items as JSON lines; refused where an item that is to be answered has no gold comment."""
    empty = rows.where((F.coalesce("type", F.lit("")) != "refuse") & (F.coalesce(F.size("gold_source_ids"), F.lit(-1)) < 1)).select("id").limit(20).collect()
    if empty:
        raise ValueError(f"no comment found for {', '.join(str(r.id) for r in empty)}")
    rows.select(*GOLDEN.fieldNames()).write.mode("overwrite").json(path)


def read_floors(spark: SparkSession, path: str) -> DataFrame:
    """(arm, metric, floor) from JSON {"arms": {arm: {metric: floor}}}; other keys are remarks."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "arms map<string, map<string, double>>").alias("r"))
    return raw.select(F.explode("r.arms").alias("arm", "metrics")).select("arm", F.explode("metrics").alias("metric", "floor"))


class Artifacts:
    """Paths by configuration, and what is read from them."""

    def __init__(self, spark: SparkSession, folder: str, config: RetrievalConfig):
        self.spark, self.base = spark, f"{folder.rstrip('/')}/{config.tag}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """The artifact's rows; a missing one is an error that names it."""
        try:
            return self.spark.read.parquet(self.path(name))
        except Exception as problem:
            raise FileNotFoundError(f"no artifact {self.path(name)}; build it first") from problem

    def write_bm25(self, index: Bm25Index) -> Bm25Index:
        return Bm25Index(self.write("bm25_counted", index.counted), self.write("bm25_idf", index.idf), self.write("bm25_totals", index.totals))

    def read_bm25(self) -> Bm25Index:
        index = Bm25Index(*(self.read(f"bm25_{n}") for n in ("counted", "idf", "totals")))
        counted = index.totals.first()
        if counted is None or counted.n != index.chunks.count():
            raise ValueError("the sparse index and its chunks differ in number; build it again")
        return index

    def read_vectors(self) -> DataFrame:
        vectors, chunks = self.read("vectors"), self.read("chunks")
        if vectors.count() != chunks.select("chunk_id").distinct().count():
            raise ValueError("vectors and chunks differ in number; build the index again")
        return vectors
