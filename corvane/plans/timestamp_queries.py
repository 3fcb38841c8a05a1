"""Problem 1: written times to UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.timestamps import is_exact_utc, normalise_timestamps
from corvane.sources.tables import table


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Comments whose time isn't already exact, with the instant or the mark why there is none."""
    comments = table(spark, directory, "comments").where(~F.coalesce(is_exact_utc(F.col("timestamp")), F.lit(True)))
    return normalise_timestamps(comments, table(spark, directory, "source_zones"), table(spark, directory, "zone_names")).distinct()


def p1_months(spark: SparkSession, directory: str) -> DataFrame:
    """Comments by source and UTC month, over all comments; marks count under themselves, absent times under null."""
    comments = table(spark, directory, "comments")
    instants = normalise_timestamps(comments, table(spark, directory, "source_zones"), table(spark, directory, "zone_names")).distinct()
    known = comments.select("source_id", F.lower(F.trim("source")).alias("source")).distinct()
    month = F.when(F.col("utc_ts").endswith("Z"), F.substring("utc_ts", 1, 7)).otherwise(F.col("utc_ts"))
    return known.join(instants, "source_id", "left").groupBy("source", month.alias("utc_month")).agg(F.count("*").alias("comments"))


QUERIES = {"p1_found": p1_found, "p1_months": p1_months}
ORACLES: dict[str, str] = {}
