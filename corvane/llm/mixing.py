"""Mixing sources to target shares of the total size, without sorting the records.

Every record has a place in its source given by a hash.  Sizes are summed by
source and by the hash's leading bits; the running sum shows in which bucket a
source's budget ends, and only that bucket is opened by the next bits, until a
single hash value is left.  The result is a threshold per source: all records
below it are taken, so that a larger budget takes a superset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.durable import cut

BITS, STEP = 60, 12


@dataclass(frozen=True)
class MixRule:
    """total: the size of the mixture, None for the size of all records of the sources that have a target. seed: another draw."""

    total: int | None = None
    seed: int = 7
    most_sources: int = 10_000


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold, below): the largest hash such that the records under it have at most `rest` of size, and that size.

    sized is (source, place, size) with place in 0 .. 2^60 - 1; budgets is
    (source, rest) with one row per source.
    """
    found = budgets.select("source", "rest", F.lit(0).cast("long").alias("threshold"), F.lit(0).cast("long").alias("below"))
    known = sized
    for done in range(0, BITS, STEP):
        width = 1 << (BITS - done - STEP)
        inside = known.join(F.broadcast(found.select("source", "threshold")), "source")
        if done:
            inside = inside.where((F.col("place") >= F.col("threshold")) & (F.col("place") < F.col("threshold") + width * (1 << STEP)))
        bucket = F.shiftright(F.col("place") - F.col("threshold"), BITS - done - STEP)
        histogram = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        running = histogram.withColumn("up_to", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        over = running.join(F.broadcast(found), "source").where(F.col("below") + F.col("up_to") > F.col("rest"))
        ends = over.groupBy("source").agg(F.min("bucket").alias("bucket"))
        full = running.join(F.broadcast(ends), "source", "left_semi").join(F.broadcast(ends.withColumnRenamed("bucket", "end")), "source").where(F.col("bucket") < F.col("end")).groupBy("source").agg(F.sum("size").alias("passed"))
        step = found.join(F.broadcast(ends), "source", "left").join(F.broadcast(full), "source", "left")
        moved = F.col("threshold") + F.when(F.col("bucket").isNull(), F.lit(width * (1 << STEP))).otherwise(F.col("bucket") * width)
        everything = histogram.groupBy("source").agg(F.sum("size").alias("all"))
        step = step.join(F.broadcast(everything), "source", "left")
        gained = F.when(F.col("bucket").isNull(), F.coalesce("all", F.lit(0))).otherwise(F.coalesce("passed", F.lit(0)))
        found = cut(step.select("source", "rest", moved.alias("threshold"), (F.col("below") + gained).cast("long").alias("below")))
    return found.select("source", "threshold", "below")


def plan_mixture(sized: DataFrame, targets: DataFrame, rule: MixRule | None = None) -> DataFrame:
    """One row per target: (source, target_share, max_repeats, available, budget, full_repeats, threshold, selected, capped).

    Every record of a source is used full_repeats times, those whose place lies
    under the threshold once more.  A budget beyond max_repeats times what is
    there is capped.  Sizes are whole numbers; the last record that would exceed
    a budget is left out, so a source misses its budget by less than one record.
    """
    rule = rule or MixRule()
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    if wanted.limit(rule.most_sources + 1).count() > rule.most_sources:
        raise ValueError(f"more than {rule.most_sources} sources have a target")
    available = sized.groupBy("source").agg(F.sum("size").alias("available"))
    plan = wanted.join(available, "source", "left").select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("available", F.lit(0)).cast("long").alias("available"))
    plan = cut(plan)
    total = rule.total if rule.total is not None else plan.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
    plan = plan.withColumn("budget", F.floor(F.coalesce("target_share", F.lit(0.0)) * F.lit(total)).cast("long"))
    most = F.when(F.col("available") == 0, F.lit(0)).otherwise(F.least(F.floor(F.col("budget") / F.greatest("available", F.lit(1))), F.col("max_repeats"))).cast("int")
    plan = cut(plan.withColumn("full_repeats", most).withColumn("capped", F.col("budget") > F.col("available") * F.col("max_repeats")))
    rest = plan.select("source", F.when(F.col("full_repeats") < F.col("max_repeats"), F.col("budget") - F.col("full_repeats") * F.col("available")).otherwise(F.lit(0)).alias("rest"))
    found = thresholds(sized, rest)
    done = plan.join(found, "source")
    return done.withColumn("threshold", F.when(F.col("full_repeats") < F.col("max_repeats"), F.col("threshold")).otherwise(F.lit(0))).withColumn("selected", F.col("full_repeats") * F.col("available") + F.when(F.col("full_repeats") < F.col("max_repeats"), F.col("below")).otherwise(F.lit(0))).drop("below")


def mix_sources(records: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size_col: str = "tokens", rule: MixRule | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of a mixture.

    selection is (id, source, size, repeats) with repeats >= 1; shares has a row
    per target: target_share, available, budget, selected, reached_share, capped.
    Records of size null count as 0; a record of a null source or of one without
    target is not used; records with equal ids share a place and are taken or
    left together; a target without records reaches 0; with nothing selected the
    shares are 0.  Other columns are left out, so none can clash.
    """
    rule = rule or MixRule()
    place = F.pmod(F.xxhash64(F.lit(rule.seed), F.col(id_col)), F.lit(1 << BITS))
    sized = cut(records.where(F.col(source_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"), place.alias("place")))
    plan = cut(plan_mixture(sized, targets, rule))
    repeats = F.col("full_repeats") + (F.col("place") < F.col("threshold")).cast("int")
    used = sized.join(F.broadcast(plan.select("source", "full_repeats", "threshold")), "source").select(F.col("id").alias(id_col), "source", F.col("size").alias(size_col), repeats.alias("repeats"))
    whole = F.sum("selected").over(Window.partitionBy())
    shares = plan.select("source", "target_share", "max_repeats", "available", "budget", "selected", F.coalesce(F.try_divide(F.col("selected").cast("double"), whole), F.lit(0.0)).alias("reached_share"), "capped")
    return used.where("repeats >= 1"), shares
