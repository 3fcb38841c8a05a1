"""Results that outlive the loss of executors: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def cut(rows: DataFrame, *, by: str | None = None) -> DataFrame:
    """rows written as Parquet to the shared folder and read again: the lineage ends there.

    With `by`, a column of few values, reads that ask for some of them skip the rest.

    The table lasts as long as this process, since plans read it lazily; on file
    systems other than a mounted one the folder's owner clears it.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/corvane-{uuid.uuid4().hex}"
    rows.write.parquet(path, partitionBy=by)
    if path.startswith("file://"):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return spark.read.schema(rows.schema).parquet(path)


def broadcast_below(rows: DataFrame, most: int) -> DataFrame:
    """rows marked for broadcast if they are at most so many (they should be cheap to count), else as they are, to be shuffled."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
