"""Retrieval metrics over ranked lists, one row per arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.durable import broadcast_below, cut
from corvane.operators.ranking import rounded

DEPTHS = (1, 3, 5, 10)
DEPTH = 10


def hit_ranks(lists: DataFrame, sources: DataFrame, gold: DataFrame) -> DataFrame:
    """(arm, qid, chunk_id, rank, hit): whether a listed chunk holds a gold comment of the question."""
    serving = lists.select("qid", "chunk_id").distinct().join(sources, "chunk_id").join(gold, ["qid", "source_id"], "left_semi").select("qid", "chunk_id").distinct()
    return lists.join(serving.withColumn("hit", F.lit(True)), ["qid", "chunk_id"], "left").select("arm", "qid", "chunk_id", "rank", F.coalesce("hit", F.lit(False)).alias("hit"))


def relevant_chunks(items: DataFrame, sources: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, n_relevant): how many chunks of the whole corpus hold a gold comment, 0 where none does."""
    found = gold.join(sources, "source_id").select("qid", "chunk_id").distinct().groupBy("qid").agg(F.count("*").alias("n"))
    return items.select("qid").distinct().join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n_relevant"))


def ideal_gain(n: Column, k: int) -> Column:
    """The gain of the best possible list of depth k with n relevant chunks."""
    gains = F.array(*[F.lit(0.0)] + [F.lit(1.0) / F.log2(F.lit(i + 2.0)) for i in range(k)])
    return F.aggregate(F.slice(gains, F.lit(1), (F.least(n, F.lit(k)) + 1).cast("int")), F.lit(0.0), lambda a, g: a + g)


def per_item(hits: DataFrame, items: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, qid, first, dcg): the rank of the first hit (null: none) and the gain, for every arm and item, lists or not."""
    gain = F.when(F.col("hit") & (F.col("rank") < DEPTH), 1 / F.log2(F.col("rank") + F.lit(2.0))).otherwise(0.0)
    seen = hits.groupBy("arm", "qid").agg(F.min(F.when(F.col("hit") & (F.col("rank") < DEPTH), F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    every = items.crossJoin(broadcast_below(arms, 10_000))
    return every.join(seen, ["arm", "qid"], "left").withColumn("dcg", F.coalesce("dcg", F.lit(0.0)))


def reciprocal(first: Column) -> Column:
    return F.coalesce(1.0 / (first + 1), F.lit(0.0))


def success_at(first: Column, k: int) -> Column:
    return F.coalesce(first < k, F.lit(False)).cast("double")


def retrieval_metrics(hits: DataFrame, items: DataFrame, relevant: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, n, recall_1, recall_3, recall_5, recall_10, mrr, ndcg) over items (qid); items without a list count as misses."""
    rows = per_item(hits, items, arms).join(relevant, "qid", "left")
    ideal = ideal_gain(F.coalesce("n_relevant", F.lit(0)), DEPTH)
    ndcg = F.coalesce(F.try_divide(F.col("dcg"), ideal), F.lit(0.0))
    recalls = [rounded(F.coalesce(F.avg(success_at(F.col("first"), k)), F.lit(0.0))).alias(f"recall_{k}") for k in DEPTHS]
    return rows.groupBy("arm").agg(F.count("*").alias("n"), *recalls, rounded(F.avg(reciprocal(F.col("first")))).alias("mrr"), rounded(F.avg(ndcg)).alias("ndcg"))


def by_type(hits: DataFrame, items: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, type, n, recall_5, mrr) over items (qid, type)."""
    rows = per_item(hits, items, arms)
    return rows.groupBy("arm", "type").agg(F.count("*").alias("n"), rounded(F.avg(success_at(F.col("first"), 5))).alias("recall_5"), rounded(F.avg(reciprocal(F.col("first")))).alias("mrr"))


def refusals(top: DataFrame, items: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n_refuse, refusal_accuracy, n_answerable, false_refusal): refused is a best score under the threshold.

    top is (qid, top_score), items (qid, is_refuse).  A rate over no item is 0.
    """
    levels = items.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    rows = items.join(top, "qid", "left").crossJoin(F.broadcast(levels))
    refused = (F.coalesce("top_score", F.lit(0.0)) < F.col("threshold")).cast("double")

    def rate(condition: Column) -> Column:
        return rounded(F.coalesce(F.avg(F.when(condition, refused)), F.lit(0.0)))

    return rows.groupBy("threshold").agg(
        F.count(F.when(F.col("is_refuse"), 1)).alias("n_refuse"),
        rate(F.col("is_refuse")).alias("refusal_accuracy"),
        F.count(F.when(~F.col("is_refuse"), 1)).alias("n_answerable"),
        rate(~F.col("is_refuse")).alias("false_refusal"),
    )


def nearest_rank(rows: DataFrame, key: str, value: str, share: float, *, buckets: int = 1024, together: int = 10_000) -> DataFrame:
    """(key, n, mean, at): the mean, and the value at place min(n - 1, floor(share * n)) of each key's values in order.

    Values are counted in buckets between each key's least and largest; the
    place's bucket is found by a running sum over counts, and its values are cut
    into buckets again until at most `together` or one value is left to sort, so
    no task orders all values of a key, however they are spread.  Null values
    don't count.
    """
    known = rows.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    spot = F.least(F.count("*") - 1, F.floor(F.count("*") * F.lit(share)).cast("long"))
    span = cut(known.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), spot.alias("place"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("left")))
    several, before_ = (F.col("left") > together) & (F.col("low") < F.col("high")), None
    while (remaining := span.where(several).agg(F.sum("left")).first()[0]) is not None and remaining != before_:
        before_ = remaining  # infinite values can't be cut into buckets: they are sorted together
        position = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
        bucket = F.coalesce(F.least(F.floor(position * buckets).cast("int"), F.lit(buckets - 1)), F.lit(0))
        inside = known.join(broadcast_below(span, 100_000), key).where(F.col("v").between(F.col("low"), F.col("high")))
        counts = inside.groupBy(key, "n", "mean", "place", bucket.alias("bucket")).agg(F.count("*").alias("left"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("left").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        spread = counts.withColumn("before", before).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("left")))
        span = cut(spread.select(key, "n", "mean", (F.col("place") - F.col("before")).alias("place"), "low", "high", "left"))
    one = span.where(F.col("low") == F.col("high")).select(key, "n", "mean", F.col("low").alias("at"))
    several = known.join(broadcast_below(span.where(F.col("low") < F.col("high")), 100_000), key).where(F.col("v").between(F.col("low"), F.col("high")))
    ordered = several.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("v")) - 1)
    return one.unionByName(ordered.where(F.col("rn") == F.col("place")).select(key, "n", "mean", F.col("v").alias("at")))
