from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from corvane.config import RetrievalConfig
from corvane.engine import Engine
from corvane.models import ScriptedChat
from corvane.operators import bm25, corrective, fusion, reranking, vectors

TEXTS = {"c0": "battery drains fast", "c1": "the battery lasts", "c2": "screen is bright the", "c3": "", "c4": "the camera the"}


@pytest.fixture
def chunks(spark):
    rows = [(k, v) for k, v in TEXTS.items()]
    return spark.createDataFrame(rows + rows[:2], "chunk_id string, text string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([("q0", "battery battery drains"), ("q1", "unknown words"), ("q2", "the screen"), ("q3", None)], "qid string, question string")


def by_hand(question: str) -> dict[str, float]:
    docs = {k: v.split() for k, v in TEXTS.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    idf = {t: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, r in raw.items()}
    score = {}
    for k, d in docs.items():
        tf = Counter(d)
        score[k] = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in (question or "").split() if t in tf)
    return score


def test_bm25_by_hand(chunks, asked):
    rows = bm25.search_bm25(bm25.build_bm25(chunks), asked, 4).collect()
    for q in asked.collect():
        expected = sorted(((round(s, 6), k) for k, s in by_hand(q.question).items()), key=lambda x: (-x[0], x[1]))[:4]
        got = sorted((r for r in rows if r.qid == q.qid), key=lambda r: r.rank)
        assert [r.chunk_id for r in got] == [k for _, k in expected]
        assert [r.score for r in got] == pytest.approx([s for s, _ in expected], abs=2e-6)


def test_bm25_of_nothing(chunks, asked):
    assert bm25.search_bm25(bm25.build_bm25(chunks.limit(0)), asked, 3).count() == 0
    assert bm25.search_bm25(bm25.build_bm25(chunks), asked.limit(0), 3).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(300, 8)).round(3)
    table[7] = table[8] = table[9]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "chunk_id int, embedding array<double>").repartition(5)
    asked = frame.where("chunk_id % 30 = 0").withColumnRenamed("chunk_id", "qid")
    rows = vectors.search_vectors(asked, frame, 5, block=block, leave_out_self=True).collect()
    for q in range(0, 300, 30):
        scores = (table @ table[q]).round(6)
        expected = [i for i in sorted(range(300), key=lambda i: (-scores[i], i)) if i != q][:5]
        assert [r.chunk_id for r in sorted((r for r in rows if r.qid == q), key=lambda r: r.rank)] == expected


def test_embedding_edges(spark):
    frame = spark.createDataFrame([("a", None), ("b", ""), ("c", "one two two")], "chunk_id string, text string")
    found = {r.chunk_id: np.array(r.embedding) for r in vectors.hash_embed(frame).collect()}
    assert not found["a"].any() and not found["b"].any() and np.linalg.norm(found["c"]) == pytest.approx(1)
    scaled = vectors.normalised(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<float>")).collect()
    assert scaled[0].embedding == pytest.approx([0.6, 0.8]) and scaled[1].embedding == [0.0, 0.0]


def test_fusion(spark):
    one = spark.createDataFrame([("q", "a", 0), ("q", "b", 1)], "qid string, chunk_id string, rank int")
    two = spark.createDataFrame([("q", "b", 0), ("q", "c", 1)], "qid string, chunk_id string, rank int")
    rows = fusion.fuse([one, two], 10).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"]
    assert rows[0].score == pytest.approx(1 / 60 + 1 / 61, abs=1e-6) and rows[1].score == pytest.approx(1 / 60, abs=1e-6)


@pytest.mark.parametrize(
    ("scores", "confident"),
    [([0.9, 0.5, 0.5], True), ([0.9, 0.88, 0.88], False), ([0.5, 0.1], False), ([0.9], False), ([], False)],
)
def test_confidence(spark, scores, confident):
    ranked = spark.createDataFrame([("q", f"c{i}", s, i) for i, s in enumerate(scores)], "qid string, chunk_id string, score double, rank int")
    asked = spark.createDataFrame([("q", "x")], "qid string, question string")
    config = RetrievalConfig(rerank="auto")
    assert reranking.confidence(ranked, asked, config).first().confident is confident
    assert reranking.gate(ranked, asked, config).first().rerank is (bool(scores) and not confident)
    assert reranking.gate(ranked, asked, RetrievalConfig(use_reranker=True)).first().rerank is bool(scores)
    assert reranking.gate(ranked, asked, RetrievalConfig()).first().rerank is False


def test_config_rules():
    with pytest.raises(ValueError):
        RetrievalConfig(rerank="sometimes")
    with pytest.raises(ValueError):
        RetrievalConfig(retrieval="other")
    assert RetrievalConfig().depth == 5 and RetrievalConfig(rerank="auto").depth == 20
    assert "hash64" in RetrievalConfig().tag


def test_grade_actions(spark):
    rows = [("good", "a", 0.5, 0), ("good", "b", 0.3, 1), ("weak", "a", 0.3, 0), ("weak", "b", 0.2, 1), ("bad", "a", 0.25, 0)]
    ranked = spark.createDataFrame([(*r, "cosine") for r in rows], "qid string, chunk_id string, score double, rank int, signal string")
    asked = spark.createDataFrame([(q,) for q in ("good", "weak", "bad", "none")], "qid string")
    found = corrective.grade(ranked, asked, RetrievalConfig()).collect()
    assert {r.qid: r.action for r in found} == {"good": "CORRECT", "weak": "AMBIGUOUS", "bad": "INCORRECT", "none": "AMBIGUOUS"}
    assert sorted((r.qid, r.chunk_id) for r in found if r.kept) == [("good", "a"), ("weak", "a")]


def scripted(spark, lists, *, second=None, gate=False, rewrite=None):
    """Steps over lists of (chunk_id, score) by question text; second scores by chunk."""
    rows = [(q, c, s, i) for q, found in lists.items() for i, (c, s) in enumerate(found)]
    table = spark.createDataFrame(rows, "question string, chunk_id string, score double, rank int")
    scores = spark.createDataFrame(list((second or {"-": 0.0}).items()), "chunk_id string, pair_score double")

    def rewritten(some, weak):
        return some.select("qid", F.lit(rewrite).alias("rewritten"))

    return corrective.Steps(
        lambda some, n: some.join(table, "question").where(F.col("rank") < n).select("qid", "chunk_id", "score", "rank"),
        lambda ranked, some: some.select("qid", F.lit(gate).alias("rerank")),
        lambda pairs, some: pairs.join(scores, "chunk_id"),
        None,
        rewritten if rewrite else None,
    )


LOOP = RetrievalConfig(k=3, rerank_candidates=20, cosine_relevant=0.45, cosine_incorrect=0.25)


@pytest.mark.parametrize("loop", ["graph", "plain"])
def test_the_loop_rewrites_then_succeeds(spark, loop):
    asked = spark.createDataFrame([("q", "how long does it last")], "qid string, question string")
    lists = {"how long does it last": [("j1", 0.2), ("j2", 0.1)], "battery endurance hours": [("g1", 0.8), ("g2", 0.6)]}
    done = corrective.correct(asked, LOOP.with_(loop=loop), scripted(spark, lists, rewrite="battery endurance hours"))
    rounds = corrective.all_rounds(done).orderBy("round_idx").collect()
    assert [(r.action, r.correction, r.query) for r in rounds] == [("INCORRECT", "reformulate", "how long does it last"), ("CORRECT", None, "battery endurance hours")]
    assert rounds[1].kept_chunk_ids == ["g1", "g2"] and [r.chunk_id for r in done.contexts.orderBy("rank").collect()] == ["g1", "g2"]


@pytest.mark.parametrize("loop", ["graph", "plain"])
def test_the_loop_widens_refuses_and_stops(spark, loop):
    asked = spark.createDataFrame([("bad", "bad"), ("good", "good"), ("none", "none"), ("low", "low")], "qid string, question string")
    lists = {"bad": [(f"j{i}", 0.1) for i in range(100)], "good": [("g1", 0.9)], "low": [("w", 0.4)]}
    done = corrective.correct(asked, LOOP.with_(loop=loop, correction_rounds=1), scripted(spark, lists))
    found = {(r.qid, r.round_idx): (r.action, r.n_candidates, r.correction) for r in corrective.all_rounds(done).collect()}
    assert found == {("bad", 0): ("INCORRECT", 20, "widen"), ("bad", 1): ("INCORRECT", 40, None), ("good", 0): ("CORRECT", 1, None), ("none", 0): ("AMBIGUOUS", 0, "widen"), ("none", 1): ("AMBIGUOUS", 0, None), ("low", 0): ("AMBIGUOUS", 1, "widen"), ("low", 1): ("CORRECT", 1, None)}
    assert {r.qid for r in done.contexts.collect()} == {"good", "low"} and done.calls.count() == 0


def test_the_loop_scores_again(spark):
    asked = spark.createDataFrame([("q", "q")], "qid string, question string")
    done = corrective.correct(asked, LOOP, scripted(spark, {"q": [("a", 0.9), ("b", 0.5)]}, second={"a": -5.0, "b": 2.0}, gate=True))
    row = corrective.all_rounds(done).first()
    assert (row.reranked, row.action, row.kept_chunk_ids) == (True, "CORRECT", ["b"]) and done.calls.first().calls == 1
    sparse = corrective.correct(asked, LOOP.with_(retrieval="sparse"), scripted(spark, {"q": [("a", 9.0), ("b", 8.0)]}, second={"a": 1.0, "b": 2.0}))
    row = corrective.all_rounds(sparse).first()
    assert (row.reranked, row.scored, row.kept_chunk_ids) == (False, True, ["a", "b"])


def test_who_is_asked(spark):
    ranked = spark.createDataFrame([(q, "c", 0.9, 0) for q in "abc"] + [(q, "d", 0.1, 1) for q in "abc"], "qid string, chunk_id string, score double, rank int")
    asked = spark.createDataFrame([("a", "compare them"), ("b", "price"), ("c", None)], "qid string, question string")
    said = reranking.routed(asked, ScriptedChat([("compare", "Yes."), ("price", "no")], "no"))
    found = reranking.gate(ranked, asked, RetrievalConfig(rerank="llm"), asks=said).collect()
    assert {r.qid: r.rerank for r in found} == {"a": True, "b": False, "c": False}
    with pytest.raises(ValueError):
        reranking.gate(ranked, asked, RetrievalConfig(rerank="llm"))


def test_models_plug_in(spark):
    class Lengths:
        def score(self, questions, texts):
            return [float(len(q) - len(t)) for q, t in zip(questions, texts)]

        def encode(self, texts):
            return [[1.0, 0.0] if "x" in t else [0.0, 1.0] for t in texts]

    chunks = spark.createDataFrame([("c1", "x", ["s"], "d"), ("c2", "yyy", ["t"], "d")], "chunk_id string, text string, source_ids array<string>, doc_id string")
    asked = spark.createDataFrame([("q", "ax")], "qid string, question string")
    engine = Engine(chunks, RetrievalConfig(rerank="always", k=2), embedder=Lengths(), scorer=Lengths())
    assert [(r.chunk_id, r.score) for r in engine.retrieve(asked).orderBy("rank").collect()] == [("c1", 1.0), ("c2", -1.0)]
    assert engine.dimension == 2 and engine.size == 2
    graded = Engine(chunks, RetrievalConfig(mode="crag", grader="llm"), embedder=Lengths(), model=ScriptedChat([("Passage: y", "YES")])).corrective(asked)
    assert [r.chunk_id for r in graded.contexts.collect()] == ["c2"]


def test_mixed_signals_are_scored_again(spark):
    pool = spark.createDataFrame([("q", "a", 0.9, "cosine"), ("q", "b", -1.0, "ce"), ("r", "a", 0.4, "cosine"), ("r", "a", 0.6, "cosine")], "qid string, chunk_id string, score double, signal string")
    second = spark.createDataFrame([("q", "a", -3.0), ("q", "b", 2.0)], "qid string, chunk_id string, pair_score double")
    rows = corrective.finalise(pool, second, 5).collect()
    assert [(r.chunk_id, r.score) for r in sorted((r for r in rows if r.qid == "q"), key=lambda r: r.rank)] == [("b", 2.0), ("a", -3.0)]
    assert [r.score for r in rows if r.qid == "r"] == [0.6]
