from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane import models, report, tools
from corvane.operators import generation, golden, metrics, stats
from corvane.sources import artifacts


@pytest.fixture
def arms(spark):
    return spark.createDataFrame([("a",)], "arm string")


def hits(spark, table):
    return spark.createDataFrame([("a", q, f"c{i}", i, h) for q, l in table.items() for i, h in enumerate(l)], "arm string, qid string, chunk_id string, rank int, hit boolean")


def test_metrics_by_hand(spark, arms):
    table = {"q0": [True, False], "q1": [False, False, True], "q2": [False] * 10, "q3": []}
    relevant = spark.createDataFrame([("q0", 1), ("q1", 20), ("q2", 3), ("q3", 0)], "qid string, n_relevant bigint")
    items = relevant.select("qid")
    row = metrics.retrieval_metrics(hits(spark, table), items, relevant, arms).first()
    ideal = sum(1 / math.log2(i + 2) for i in range(10))
    assert (row.n, row.recall_1, row.recall_3, row.recall_5) == (4, 0.25, 0.5, 0.5)
    assert row.mrr == pytest.approx((1 + 1 / 3) / 4, abs=1e-6)
    assert row.ndcg == pytest.approx((1 + 0.5 / ideal) / 4, abs=1e-6)
    empty = metrics.retrieval_metrics(hits(spark, {}), items, relevant, arms).first()
    assert (empty.n, empty.recall_10, empty.mrr, empty.ndcg) == (4, 0.0, 0.0, 0.0)


def test_hits_need_a_shared_comment(spark):
    lists = spark.createDataFrame([("a", "q", "c0", 0), ("a", "q", "c1", 1), ("a", "r", "c0", 0)], "arm string, qid string, chunk_id string, rank int")
    chunks = spark.createDataFrame([("c0", ["s1", "s1", "s2"]), ("c1", None), ("c0", ["s2"])], "chunk_id string, source_ids array<string>")
    items = spark.createDataFrame([("q", ["s2"], "factoid", None), ("r", [], "factoid", None), ("t", None, "refuse", None)], "id string, gold_source_ids array<string>, type string, difficulty string")
    found = metrics.hit_ranks(lists, golden.chunk_sources(chunks), golden.gold_pairs(items)).collect()
    assert sorted((r.qid, r.chunk_id, r.hit) for r in found) == [("q", "c0", True), ("q", "c1", False), ("r", "c0", False)]
    assert {r.id: (r.is_refuse, r.n_gold) for r in golden.golden_set(items).collect()} == {"q": (False, 1), "r": (True, 0), "t": (True, 0)}


def test_refusals(spark):
    items = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False)], "qid string, is_refuse boolean")
    top = spark.createDataFrame([("a", 0.2), ("b", 0.4), ("c", 0.9)], "qid string, top_score double")
    row = metrics.refusals(top, items, [0.35]).first()
    assert (row.refusal_accuracy, row.false_refusal) == (0.5, 0.5)
    only = metrics.refusals(top, items.where("is_refuse"), [0.35]).first()
    assert (only.n_answerable, only.false_refusal) == (0, 0.0)


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 1000])
def test_nearest_rank(spark, n):
    values = [float((i * 37) % n) if n > 2 else 5.0 for i in range(n)]
    frame = spark.createDataFrame([("k", v) for v in values] + [("k", None)], "k string, v double")
    assert metrics.nearest_rank(frame, "k", "v", 0.95).first()["at"] == sorted(values)[min(n - 1, int(0.95 * n))]


@pytest.mark.parametrize(("b", "c", "p"), [(0, 0, 1.0), (5, 0, 0.0625), (3, 3, 1.0), (9, 7, 0.804), (8, 2, 0.109), (13, 1, 0.002), (9, 1, 0.021), (4, 14, 0.031), (3000, 3100, 0.205)])
def test_mcnemar(spark, b, c, p):
    frame = spark.createDataFrame([(b, c)], "b bigint, c bigint")
    assert frame.select(stats.mcnemar(F.col("b"), F.col("c"))).first()[0] == pytest.approx(p, abs=6e-4)


@pytest.mark.parametrize("spread", ["even", "tail", "one value", "infinite"])
def test_nearest_rank_of_many(spark, spread):
    values = {"even": lambda i: i / 7, "tail": lambda i: 2.0 ** (i / 400), "one value": lambda i: 3.0, "infinite": lambda i: math.inf if i % 3 == 0 else float(i)}[spread]
    frame = spark.range(20_000).rdd.map(lambda r: ("k", float(values(r[0])))).toDF("k string, v double")
    expected = sorted(values(i) for i in range(20_000))
    for share in (0.5, 0.95):
        assert metrics.nearest_rank(frame, "k", "v", share, together=100).first()["at"] == expected[int(share * 20_000)]


def test_bootstrap_by_counts_agrees():
    values = [0.5] * 30 + [-0.25] * 50 + [0.0] * 120
    exact = stats.bootstrap_interval(values, resamples=4000)
    counted = stats.counted_interval([0.5, -0.25, 0.0], [30, 50, 120], resamples=4000)
    assert exact == pytest.approx(counted, abs=0.01)
    with pytest.raises(ValueError):
        stats.paired_interval([0.0], [1.0, 0.0])
    assert stats.paired_interval([0.0] * 20, [1.0] * 20, resamples=50) == (1.0, 1.0)


def test_bootstrap_draws_as_the_seed_says():
    draw, differences = random.Random(stats.SEED), [0.0, 0.5, -1.0, 0.25]
    means = sorted(sum(differences[draw.randrange(4)] for _ in range(4)) / 4 for _ in range(400))
    assert stats.bootstrap_interval(differences, resamples=400) == (means[10], means[390])


def test_bootstrap():
    assert stats.bootstrap_interval([0.0] * 20, resamples=200) == (0.0, 0.0)
    assert stats.bootstrap_interval([1.0] * 20, resamples=200) == (1.0, 1.0)
    mixed = [0.1 * i for i in range(10)]
    assert stats.bootstrap_interval(mixed, resamples=300) == stats.bootstrap_interval(mixed, resamples=300)
    with pytest.raises(ValueError):
        stats.bootstrap_interval([])


def test_golden_resolution(spark):
    comments = spark.createDataFrame([("s1", "The SD-card slot heats up"), ("s2", "cardboard"), ("s3", None), ("s4", "a 144 hz panel"), ("s5", "überhaupt 144Hz!"), ("s6", "x144hz")], "source_id string, text string")
    items = [("i1", ["sd card", "heat*"]), ("i2", []), ("i3", ["missing"]), ("i4", ["144hz"]), ("i5", ["über*"]), ("i6", None)]
    for asked in (items, golden.as_items(spark, items)):
        found = golden.resolve(asked, comments)
        assert {(r.item_id, r.source_id) for r in found.collect()} == {("i1", "s1"), ("i2", None), ("i3", None), ("i4", "s4"), ("i4", "s5"), ("i5", "s5"), ("i6", None)}
        assert [r.item_id for r in golden.unresolved(asked, found).collect()] == ["i3"]
    assert golden.resolve([("i", [])], comments).collect()[0].source_id is None
    with pytest.raises(Exception, match="no letter or digit"):
        golden.resolve([("i", ["++"])], comments).collect()


def test_golden_sink_refuses(spark, tmp_path):
    schema = "id string, question string, answer string, gold_source_ids array<string>, type string, difficulty string"
    good = spark.createDataFrame([("a", "q", "x", ["s"], "factoid", None), ("b", "q", "", None, "refuse", None)], schema)
    artifacts.write_golden(good, str(tmp_path / "good"))
    assert artifacts.read_lines(spark, str(tmp_path / "good"), artifacts.GOLDEN).count() == 2
    with pytest.raises(ValueError, match="no comment found for c"):
        artifacts.write_golden(good.union(spark.createDataFrame([("c", "q", "x", [], "factoid", None)], schema)), str(tmp_path / "bad"))


def test_prompts_and_citations(spark):
    asked = spark.createDataFrame([("q", "Why?"), ("r", None)], "qid string, question string")
    contexts = spark.createDataFrame([("q", 1, "c1", "second"), ("q", 0, "c0", "first")], "qid string, rank int, chunk_id string, text string")
    prompts = {r.qid: r.prompt for r in generation.build_prompts(asked, contexts.select("qid", "rank", "text")).collect()}
    assert "[1] first\n[2] second" in prompts["q"] and prompts["r"].endswith("Question: \nAnswer:")
    answers = spark.createDataFrame([("q", " See [2] and [9], [2], [1]. "), ("r", "none")], "qid string, answer string")
    expanded = {r.qid: r.expanded for r in generation.expand_citations(answers, contexts).collect()}
    assert expanded["q"] == "See [2] and [9], [2], [1].\n\nSources:\n[2] c1: second\n[1] c0: first" and expanded["r"] == "none"


VALUES = [
    ("60/200*100", "30.0"), ("57.59 + 6", "63.59"), ("2**10", "1024"), ("-2**2", "-4"), ("2**-1", "0.5"), ("2**3**2", "512"), ("(1 + 2) * -(3 - 5)", "6"), ("-7 % 3", "2"), ("1e3 + .5", "1000.5"), ("--3", "3"), ("8 / 2 / 2", "2.0"), ("1 - 2 - 3", "-4"),
    ("9**9**9**9", None), ("2**1000", None), ("10000000**2", None), ("abs(1)", None), ("", None), ("1/0", None), ("1 2", None), ("(1", None), ("1)", None), ("* 2", None), ("1 +", None), ("()", None), ("07", None),
]


@pytest.mark.parametrize(("expression", "value"), VALUES)
def test_calculator(expression, value):
    got = tools.calculate(expression)
    assert got == value if value else got.startswith("Error")


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.integers(0, 9).map(str) | st.sampled_from(["1.5", "0.25"]), lambda x: st.tuples(x, st.sampled_from(["+", "-", "*", "/", "%", " - -"]), x).map(lambda t: f"({t[0]}{t[1]}{t[2]})") | st.tuples(x, x).map(lambda t: f"{t[0]} + {t[1]}"), max_leaves=8))
def test_calculator_against_python(expression):
    try:
        expected = str(eval(expression))  # noqa: S307 - digits and operators made above
    except ZeroDivisionError:
        expected = None
    got = tools.calculate(expression)
    assert got == expected if expected else got.startswith("Error")


@pytest.fixture
def box(spark):
    chunks = spark.createDataFrame([("c1", "one", ["s2", "s1"]), ("c2", "two", None), ("c1", "one", ["s2", "s1"])], "chunk_id string, text string, source_ids array<string>")

    def search(calls, k):
        both = chunks.select("chunk_id").distinct().withColumn("rank", F.when(F.col("chunk_id") == "c1", 0).otherwise(1))
        return calls.where("query <> 'nothing'").select("call").crossJoin(both).where(F.col("rank") < k)

    return tools.ToolBox(chunks, search)


def test_tools_by_name(spark, box):
    given = [("search_corpus", {"query": "x", "k": 1}), ("search_corpus", {"query": "nothing"}), ("fetch_chunk", {"chunk_id": "c1"}), ("fetch_chunk", {"chunk_id": "c9"}), ("calculator", {"expression": "1+1"}), ("other", {})]
    script = [{"calls": [{"name": n, "input": i} for n, i in given]}, {"text": " done ", "calls": []}]
    asked = spark.createDataFrame([("q", "?"), ("r", None)], "qid string, question string")
    run = tools.run_agents(asked, models.ScriptedTurns(script), box)
    assert {(r.qid, r.answer, r.steps) for r in run.answers.collect()} == {("q", "done", 2), ("r", "done", 2)}
    outputs = {r.call_no: r.output for r in run.trace.where("qid = 'q'").collect()}
    assert outputs == {0: "[c1] one", 1: "No chunks found.", 2: "[c1] sources=s2,s1\none", 3: "No chunk with id c9.", 4: "2", 5: "Unknown tool: other"}
    assert [(r.chunk_id, r.text) for r in run.contexts.where("qid = 'r'").collect()] == [("c1", "one")]


def test_agents_stop_at_their_budget(spark, box):
    class Restless:
        def turn(self, question, history, final):
            if question == "broken":
                raise RuntimeError
            return {"text": f"after {len(history)}", "calls": [{"name": "search_corpus", "input": {"query": "a"}}]} if not final else {"text": f"after {len(history)}"}

    asked = spark.createDataFrame([("q", "?"), ("x", "broken")], "qid string, question string")
    run = tools.run_agents(asked, Restless(), box, most_steps=2)
    assert {(r.qid, r.answer, r.steps) for r in run.answers.collect()} == {("q", "after 2", 2), ("x", "", 1)}
    assert run.trace.count() == 2 and [r.chunk_id for r in run.contexts.orderBy("place").collect()] == ["c1", "c2"]


def test_models(spark):
    model = models.chat_model("scripted", [("battery", " yes ")])
    frame = spark.createDataFrame([("battery?",), ("screen?",), (None,)], "p string")
    assert [r[0] for r in frame.select(models.says_yes(model, F.col("p"))).collect()] == [True, False, None]
    pairs = spark.createDataFrame([("Q?", "q?"), ("Q?", " "), ("Q?", "new")], "q string, r string")
    assert [r[0] for r in pairs.select(models.rewritten(F.col("q"), F.col("r"))).collect()] == [None, None, "new"]
    with pytest.raises(ValueError):
        models.chat_model("nobody")
    assert models.text_of([{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]) == "ab"


def test_report():
    assert report.markdown([{"a": 0.12345, "b": None}], ["a", "b"]).splitlines()[-1] == "| 0.123 | — |"
