"""Paired comparison of arms: McNemar's exact test and a bootstrap interval."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.metrics import per_item, reciprocal, success_at
from corvane.operators.ranking import rounded

RESAMPLES, SEED = 10_000, 20260707


def mcnemar(won: Column, lost: Column) -> Column:
    """The exact two-sided p-value: twice the lower binomial tail, at most 1; 1 without discordant pairs.

    Terms are built as logarithms, so thousands of pairs don't overflow.
    """
    n, few = won + lost, F.least(won, lost)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a.log + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (a.sum + F.exp(log)).alias("sum"))

    numbers = F.when(few >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(few, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(numbers, start, step, lambda a: a.sum)))


def paired(hits: DataFrame, items: DataFrame, arms: DataFrame, baseline: str) -> DataFrame:
    """(arm, qid, base_hit, arm_hit, base_rr, arm_rr) for every arm but the baseline; every arm has every item, so pairs are never short."""
    rows = per_item(hits, items, arms).select("arm", "qid", success_at(F.col("first"), 5).alias("hit"), reciprocal(F.col("first")).alias("rr"))
    base = rows.where(F.col("arm") == baseline).select("qid", F.col("hit").alias("base_hit"), F.col("rr").alias("base_rr"))
    return rows.where(F.col("arm") != baseline).join(base, "qid").select("arm", "qid", "base_hit", F.col("hit").alias("arm_hit"), "base_rr", F.col("rr").alias("arm_rr"))


def compare(pairs: DataFrame) -> DataFrame:
    """(arm, n, won, lost, p_value, delta_mrr)."""
    won, lost = ((F.col(a) > F.col(b)).cast("long") for a, b in (("arm_hit", "base_hit"), ("base_hit", "arm_hit")))
    counted = pairs.groupBy("arm").agg(F.count("*").alias("n"), F.sum(won).alias("won"), F.sum(lost).alias("lost"), rounded(F.avg(F.col("arm_rr") - F.col("base_rr"))).alias("delta_mrr"))
    return counted.withColumn("p_value", rounded(mcnemar(F.col("won"), F.col("lost"))))


def _bounds(means: Sequence[float], alpha: float) -> tuple[float, float]:
    """The percentiles of ordered means."""
    return float(means[int(alpha / 2 * len(means))]), float(means[min(len(means) - 1, int((1 - alpha / 2) * len(means)))])


def bootstrap_interval(differences: list[float], *, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05) -> tuple[float, float]:
    """The percentile interval of the mean of paired differences, by the draws that the seed gives one index at a time."""
    if not differences:
        raise ValueError("no pairs")
    draw, n = random.Random(seed).randrange, len(differences)
    means = []
    for _ in range(resamples):
        total = 0.0
        for _ in range(n):
            total += differences[draw(n)]
        means.append(total / n)
    return _bounds(sorted(means), alpha)


def paired_interval(base: list[float], arm: list[float], **settings: object) -> tuple[float, float]:
    """bootstrap_interval of arm - base; lists of unlike length are no pairs."""
    if len(base) != len(arm):
        raise ValueError("paired lists must be of one length")
    return bootstrap_interval([y - x for x, y in zip(base, arm)], **settings)


def counted_interval(values: list[float], counts: list[int], *, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05) -> tuple[float, float]:
    """The same interval from how often each distinct difference occurs: a resample of n items is one multinomial draw, however large n is."""
    n = sum(counts)
    if not n:
        raise ValueError("no pairs")
    drawn = np.random.default_rng(seed).multinomial(n, np.array(counts) / n, size=resamples)
    return _bounds(np.sort(drawn @ np.array(values, float) / n), alpha)


def bootstrap(pairs: DataFrame, *, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05, exact: bool = True, most_items: int = 200_000) -> DataFrame:
    """(arm, low, high, significant): the interval of the arm's mean gain in reciprocal rank, and whether it or McNemar's test says so.

    exact draws items one at a time, in order of qid, so that a seed gives the
    interval it always gave; that is for question sets, and more than most_items
    are refused.  Otherwise differences are counted first, of which reciprocal
    ranks have few: that holds for any number of items.
    """
    rows = pairs.select("arm", "qid", (F.col("arm_rr") - F.col("base_rr")).alias("d"))
    settings = {"resamples": resamples, "seed": seed, "alpha": alpha}
    if exact:
        if pairs.groupBy("arm").count().where(F.col("count") > most_items).limit(1).count():
            raise ValueError(f"an arm has more than {most_items} items; count them with exact=False")
        small = rows
    else:
        small = rows.groupBy("arm", rounded(F.col("d")).alias("d")).agg(F.count("*").alias("n"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("qid" if exact else "d")
        low, high = bootstrap_interval(part.d.tolist(), **settings) if exact else counted_interval(part.d.tolist(), part.n.tolist(), **settings)
        return pd.DataFrame({"arm": [part.arm.iloc[0]], "low": [low], "high": [high]})

    intervals = small.groupBy("arm").applyInPandas(run, "arm string, low double, high double")
    tested = compare(pairs).select("arm", "p_value")
    return intervals.join(tested, "arm").select("arm", "low", "high", ((F.col("p_value") < alpha) | (F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))
