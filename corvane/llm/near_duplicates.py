"""Near-duplicate texts, found through deletion variants of signature segments and verified exactly.

The signature of a set of word runs is a vector of minwise hash values, the
components playing the part of bits: two sets of similarity s agree in a
component with probability s.  It is cut into few segments, so few that similar
sets differ by at most one component in some segment.  Each segment is indexed
under its variants with one component left out; sets meeting under a variant
are compared by a 64-bit and a 128-bit sketch and then by the sets themselves.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.canonical import canonical
from corvane.llm.pairs import connected_groups, expand_class_pairs
from corvane.operators.durable import broadcast_below, cut


@dataclass(frozen=True)
class NearDuplicateRule:
    """What counts as similar, and the signature by which pairs are sought.

    With similarity s, a segment of m components has at most one that differs with
    probability s^m + m (1-s) s^(m-1), and a pair is missed when all segments fail:
    at the defaults 0.2 % of pairs at exactly 0.7, 0.03 % at 0.75.  More than
    about `together` classes under one variant are compared in several tasks.
    """

    words: int = 3
    similarity: float = 0.7
    least_words: int = 30
    segments: int = 6
    components: int = 4
    sketch_distance: int = 20
    long_sketch_distance: int = 36
    together: int = 5_000
    seed: int = 20_011


class _NoPunctuation(dict):
    def __missing__(self, code: int) -> str | None:
        self[code] = None if unicodedata.category(chr(code))[0] in "PS" else chr(code)
        return self[code]


_NO_PUNCTUATION = _NoPunctuation()
_SKETCH = 128


def words_of(text: str) -> list[str]:
    """White-space words of the text in its one form, lower-cased and freed of punctuation and symbols."""
    return canonical(text).lower().translate(_NO_PUNCTUATION).split()


class _WordHashes(dict):
    """64-bit hashes of words; emptied when it holds a million."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_WORD_HASHES = _WordHashes()


def runs_of(texts: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k consecutive words, ascending within each text, and where each text's begin (and the end)."""
    counts = np.array([len(t) for t in texts], np.int64)
    flat = np.fromiter(map(_WORD_HASHES.__getitem__, chain.from_iterable(texts)), np.uint64, int(counts.sum()))
    mixed = np.zeros(max(len(flat) - k + 1, 0), np.uint64)
    for j in range(k):
        mixed = (mixed ^ flat[j : len(flat) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint16 if len(texts) < 65_536 else np.uint32), counts)
    whole = owner[: len(mixed)] == owner[k - 1 : k - 1 + len(mixed)]
    mixed, owner = mixed[whole], owner[: len(mixed)][whole]
    order = np.argsort(mixed)
    order = order[np.argsort(owner[order], kind="stable")]  # by counting, as owners are small numbers
    mixed, owner = mixed[order], owner[order]
    fresh = np.ones(len(mixed), bool)
    fresh[1:] = (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1])
    return mixed[fresh], np.searchsorted(owner[fresh], np.arange(len(texts) + 1))


def _signatures(runs: np.ndarray, starts: np.ndarray, rule: NearDuplicateRule) -> tuple[np.ndarray, np.ndarray]:
    """(components by text, 2 x 64 sketch bits by text). Every text has at least one run."""
    rng = np.random.default_rng(rule.seed)
    xor = rng.integers(0, 2**32, _SKETCH, dtype=np.uint32)
    odd = rng.integers(0, 2**31, _SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    short = ((runs ^ (runs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    kept = rule.segments * rule.components
    values = np.empty((kept, len(starts)), np.int16)
    bits = np.zeros((2, len(starts)), np.uint64)
    for j in range(_SKETCH):
        mixed = (short ^ xor[j]) * odd[j]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(mixed, starts)
        if j < kept:
            values[j] = (least >> np.uint32(16)).astype(np.uint16).view(np.int16)
        bits[j // 64] |= ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint64) << np.uint64(j % 64)
    return values.T, bits


def _prepared(rows: DataFrame, id_col: str, text_col: str, rule: NearDuplicateRule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                texts = part.column(1).to_pylist()
                least = max(rule.least_words, rule.words)
                words = [words_of(t) if len(t.split()) >= least else [] for t in texts]
                keep = [i for i, w in enumerate(words) if len(w) >= least]
                if not keep:
                    continue
                runs, bounds = runs_of([words[i] for i in keep], rule.words)
                values, bits = _signatures(runs, bounds[:-1], rule)
                whole = [xxhash.xxh3_128_digest(runs[a:z].tobytes()) for a, z in zip(bounds[:-1], bounds[1:])]
                class_key = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
                signature = pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep)), pa.array(class_key[:, 0]), pa.array(class_key[:, 1]), signature, pa.array(bits[0].view(np.int64)), pa.array(bits[1].view(np.int64))],
                    ["id", "text", "c_hi", "c_lo", "signature", "s1", "s2"],
                )

    kind = rows.schema[id_col].dataType.simpleString()
    needed = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return needed.mapInArrow(run, f"id {kind}, text string, c_hi long, c_lo long, signature array<short>, s1 long, s2 long")


def _kept(prepared: DataFrame) -> DataFrame:
    """prepared, held where it was made and filled at once, so that stages that start together don't each make it."""
    held = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    return held


def _verified(candidates: DataFrame, rule: NearDuplicateRule) -> DataFrame:
    """Of rows (key columns, text_a, text_b), the keys of those whose sets of runs are similar enough."""
    keys = [c for c in candidates.columns if c not in ("text_a", "text_b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {t: k for k, t in enumerate({*b.column("text_a").to_pylist(), *b.column("text_b").to_pylist()})}
            if not at:
                continue
            runs, bounds = runs_of([words_of(t) for t in at], rule.words)
            similar = []
            for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist()):
                p, q = (runs[bounds[at[t]] : bounds[at[t] + 1]] for t in (x, y))
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                similar.append(both >= rule.similarity * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys], keys).filter(pa.array(similar))

    return candidates.mapInArrow(run, ", ".join(f"{k} long" for k in keys))


_ROWS_PER_TASK = 500_000
_SAMPLED = 64  # keys are hashes: one in so many is a fair sample


def _met(indexed: DataFrame, rule: NearDuplicateRule) -> DataFrame:
    """(c_hi_a, c_hi_b): the pairs of (c_hi, s1, variant) that share a variant and are near by s1, each once.

    A variant with many classes is cut into parts by a second hash, and each two
    parts meet in a task of their own, so that no task sees them all.  Which
    variants that concerns is told by a sample; the pairs don't depend on it.
    """
    near = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) <= rule.sketch_distance

    def pairs(joined: DataFrame) -> DataFrame:
        return joined.select(F.least("a.c_hi", "b.c_hi").alias("c_hi_a"), F.greatest("a.c_hi", "b.c_hi").alias("c_hi_b"))

    sampled = indexed.where(F.pmod("c_hi", F.lit(_SAMPLED)) == 0).groupBy("variant").agg((F.count("*") * _SAMPLED).alias("n"))
    hot = cut(sampled.where(F.col("n") > rule.together).select("variant", F.ceil(F.col("n") / rule.together).cast("int").alias("parts")))
    some = hot.limit(1).count() > 0
    cold = indexed.join(broadcast_below(hot, 100_000), "variant", "left_anti") if some else indexed
    a, b = cold.alias("a"), cold.alias("b")  # unrenamed, so that both sides read one exchange
    met = pairs(a.join(b, (F.col("a.variant") == F.col("b.variant")) & (F.col("a.c_hi") < F.col("b.c_hi")) & near))
    if some:
        parted = indexed.join(broadcast_below(hot, 100_000), "variant").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "c_hi"), F.col("parts")).cast("int"))
        a = parted.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1))).alias("a")
        b = parted.withColumn("other", F.explode(F.sequence(F.lit(0), "part"))).alias("b")
        cell = (F.col("a.variant") == F.col("b.variant")) & (F.col("a.part") == F.col("b.other")) & (F.col("a.other") == F.col("b.part"))
        met = met.unionByName(pairs(a.join(b, cell & ((F.col("a.part") < F.col("b.part")) | (F.col("a.c_hi") < F.col("b.c_hi"))) & near)))
    return met.distinct()


def _class_links(prepared: DataFrame, rule: NearDuplicateRule) -> DataFrame:
    """(c_hi_a, c_lo_a, c_hi_b, c_lo_b): links between classes of equal sets, each once."""
    classes = cut(prepared.groupBy("c_hi", "c_lo").agg(*[F.first(c).alias(c) for c in ("signature", "s1", "s2")]))
    variants = []
    for s in range(rule.segments):
        for out in range(rule.components):
            kept = [F.col("signature")[s * rule.components + j] for j in range(rule.components) if j != out]
            variants.append(F.xxhash64(F.lit(s), F.lit(out), *kept))
    indexed = classes.select("c_hi", "s1", F.explode(F.array(*variants)).alias("variant"))
    tasks = classes.count() * len(variants) // _ROWS_PER_TASK
    if tasks > int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        indexed = indexed.repartition(tasks, "variant")  # the session's number of partitions would make them too large
    met = _met(indexed, rule)
    for x in "ab":
        met = met.join(classes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("c_hi", "c_lo", "s1", "s2")]), f"c_hi_{x}")
    distance = F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))
    close = cut(met.where(distance <= rule.long_sketch_distance).select("c_hi_a", "c_lo_a", "c_hi_b", "c_lo_b"))
    needed = cut(close.select(F.explode(F.array(*[F.struct(F.col(f"c_hi_{x}").alias("c_hi"), F.col(f"c_lo_{x}").alias("c_lo")) for x in "ab"])).alias("c")).select("c.*").distinct())
    texts = prepared.join(broadcast_below(needed, 500_000), ["c_hi", "c_lo"], "left_semi").groupBy("c_hi", "c_lo").agg(F.min("text").alias("text"))
    for x in "ab":
        close = close.join(texts.select(*[F.col(c).alias(f"{c}_{x}") for c in ("c_hi", "c_lo", "text")]), [f"c_hi_{x}", f"c_lo_{x}"])
    return cut(_verified(close, rule))


def near_duplicate_pairs(rows: DataFrame, *, id_col: str = "source_id", text_col: str = "text", rule: NearDuplicateRule | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose word-run sets have at least the rule's similarity.

    Copies with equal sets form a class; signatures are indexed and compared by
    class, and pairs of classes (also a class with itself) expand to members at
    the end.  Null ids, null and empty texts and texts of fewer than least_words
    words are in no pair; long texts count whole; a row repeated with its id and
    text counts once.
    """
    rule = rule or NearDuplicateRule()
    prepared = _kept(_prepared(rows, id_col, text_col, rule))
    members = cut(prepared.select("id", "c_hi", "c_lo").distinct())
    links = _class_links(prepared, rule)
    prepared.unpersist()
    own = members.groupBy("c_hi", "c_lo").count().where("count > 1").select(*[F.col(c).alias(f"{c}_{x}") for x in "ab" for c in ("c_hi", "c_lo")])
    return expand_class_pairs(links.unionByName(own), members, ["c_hi", "c_lo"], id_col).distinct()


def near_duplicate_groups(rows: DataFrame, *, id_col: str = "source_id", text_col: str = "text", rule: NearDuplicateRule | None = None) -> DataFrame:
    """(id, group_id, links): one row per id with at least least_words words.

    group_id is the smallest id of the group that similarity links connect;
    links is how many other texts (classes of equal sets) are linked to its own.
    Same treatment of nulls and repeats as near_duplicate_pairs.
    """
    rule = rule or NearDuplicateRule()
    prepared = _kept(_prepared(rows, id_col, text_col, rule))
    members = cut(prepared.select("id", "c_hi", "c_lo").distinct())
    names = members.groupBy("c_hi", "c_lo").agg(F.min("id").alias("name"))
    links = _class_links(prepared, rule)
    prepared.unpersist()
    for x in "ab":
        links = links.join(names.select(*[F.col(c).alias(f"{c}_{x}") for c in ("c_hi", "c_lo")], F.col("name").alias(x)), [f"c_hi_{x}", f"c_lo_{x}"])
    edges = links.select("a", "b")
    roots = connected_groups(edges).withColumnRenamed("node", "name")
    degree = edges.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("links"))
    classes = names.join(roots, "name", "left").join(degree, "name", "left")
    classes = classes.select("c_hi", "c_lo", F.coalesce("root", "name").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(classes, ["c_hi", "c_lo"]).select(F.col("id").alias(id_col), "group_id", "links")
