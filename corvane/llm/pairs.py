"""Turning pairs of classes into pairs of their members, and linked classes into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.durable import broadcast_below, cut


def expand_class_pairs(pairs: DataFrame, members: DataFrame, key: list[str], id_col: str, rows_per_task: int = 20_000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every member of one class with every member of the other.

    pairs has the columns of `key` twice, with _a and _b appended; a class may be
    paired with itself.  members is (id, *key), each id once in a class.  Only
    pairs that are results are enumerated, and the members of a large class are
    spread over count / rows_per_task tasks, so no hot class fills one task.
    """
    pairs = cut(pairs)
    used = pairs.select(*[F.col(f"{k}_a").alias(k) for k in key]).union(pairs.select(*[F.col(f"{k}_b").alias(k) for k in key])).distinct()
    concerned = cut(members.join(broadcast_below(cut(used), 500_000), key, "left_semi"))
    parts = concerned.groupBy(*key).agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("parts"))
    salted = concerned.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    for x in "ab":
        named = [f"{k}_{x}" for k in key]
        sizes = parts.select(*[F.col(k).alias(f"{k}_{x}") for k in key], "parts")
        pairs = pairs.join(sizes, named).withColumn(f"part_{x}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        side = salted.select(*[F.col(k).alias(f"{k}_{x}") for k in key], F.col("part").alias(f"part_{x}"), F.col("id").alias(f"id_{x}"))
        pairs = pairs.join(side, [*named, f"part_{x}"])
    same = F.lit(True)
    for k in key:
        same = same & (F.col(f"{k}_a") == F.col(f"{k}_b"))
    kept = pairs.where((F.col("id_a") < F.col("id_b")) | (~same & (F.col("id_a") > F.col("id_b"))))
    return kept.select(F.least("id_a", "id_b").alias(f"{id_col}_a"), F.greatest("id_a", "id_b").alias(f"{id_col}_b"))


def connected_groups(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node that can be reached.

    Large-star and small-star steps in turn: each is one aggregation and one
    join over the edges, the number of rounds grows with the logarithm of the
    longest path, and no component is gathered in one task.  Lineage is cut
    after every round.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = cut(small.where("u <> v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"groups not settled after {max_rounds} rounds")
    return links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(links.select("v", "v").distinct().toDF("node", "root"))
