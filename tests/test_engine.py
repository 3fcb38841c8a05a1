from __future__ import annotations

import json

import pytest

from corvane import experiment, report
from corvane.__main__ import main
from corvane.config import RetrievalConfig
from corvane.engine import Engine
from corvane.models import ScriptedChat, ScriptedTurns
from corvane.operators import generation, ingest
from corvane.serve import Service
from corvane.sources import artifacts
from corvane.streaming import append_corpus, deduplicated_stream

BLOCKS = {
    "yt_one.txt": "2024-01-02T03:04:05Z\nThe battery lasts two full days with heavy use\n\nThe camera is blurry in low light\n\nScreen scratches far too easily",
    "reddit_two.txt": "the BATTERY lasts two full days  with heavy use\n\nSpeakers crackle at full volume",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    files = spark.createDataFrame(list(BLOCKS.items()), "path string, content string")
    return Engine.build(spark, files, str(tmp_path_factory.mktemp("data")), RetrievalConfig(chunk_size=60, chunk_overlap=8, k=3))


@pytest.mark.parametrize("mode", ["dense", "sparse", "hybrid"])
@pytest.mark.parametrize("policy", ["never", "always", "auto"])
def test_finds_the_comment(spark, engine, mode, policy):
    asked = spark.createDataFrame([("q", "how long does the battery last with heavy use")], "qid string, question string")
    own = engine.with_config(engine.config.with_(retrieval=mode, rerank=policy))
    best = own.retrieve(asked).join(own.chunks, "chunk_id").orderBy("rank").first()
    assert "battery" in best.text.lower()


def test_provenance_and_dedup(engine):
    rows = engine.sources.collect()
    assert sum("battery" in r.text.lower() for r in rows) == 1
    assert all(r.source_ids for r in rows)


def test_load_and_answer(spark, engine):
    folder = engine.sources.inputFiles()[0].split("/cs60")[0]
    loaded = Engine.load(spark, folder, engine.config)
    asked = spark.createDataFrame([("q", "battery lasts"), ("r", "zzz")], "qid string, question string")
    answers = {r.qid: r for r in loaded.answer(asked, ScriptedChat([("battery", "Two days [1].")], "No idea")).collect()}
    assert answers["q"].answer.startswith("Two days [1].\n\nSources:\n[1]")
    strict = loaded.with_config(loaded.config.with_(mode="crag", cosine_relevant=0.99, cosine_incorrect=0.95))
    assert {r.qid: r.answer for r in strict.answer(asked, ScriptedChat([])).collect()}["r"] == generation.REFUSAL


GOLDEN = [("g1", "how long does the battery last", "two days", ["yt:00000"], "factoid", None), ("g2", "what about the speakers", "crackle", ["reddit:00000"], "paraphrase", None), ("g3", "zzz unknown", "", None, "refuse", None)]


@pytest.fixture(scope="module")
def golden_items(spark):
    return spark.createDataFrame(GOLDEN, "id string, question string, answer string, gold_source_ids array<string>, type string, difficulty string")


def test_evaluation_report(engine, golden_items, tmp_path):
    evaluation = experiment.Evaluation.of(engine, golden_items, experiment.arms(["baseline", "crag"]))
    rows = report.arm_rows(evaluation, evaluation.latencies(1), evaluation.generation(ScriptedChat([], "two days [1]")))
    assert [r["arm"] for r in rows] == ["baseline", "crag"] and all(r["latency_ms"] != report.MISSING and r["faithfulness"] != report.MISSING for r in rows)
    text = report.whole(evaluation, rows, judged=True)
    assert all(h in text for h in ("### Arms", "McNemar p", "factoid recall@5", "| 0.25 |"))
    report.write(str(tmp_path), rows, text)
    assert (tmp_path / "results.csv").read_text().startswith("arm,recall@1")
    alone = experiment.Evaluation.of(engine, golden_items, experiment.arms(["sparse"]))
    assert "nothing to compare" in report.significance_lines(alone)


def test_command_line(engine, golden_items, tmp_path, capsys):
    (tmp_path / "one_yt.txt").write_text(BLOCKS["yt_one.txt"])
    assert main(["--data", str(tmp_path / "data"), "build", str(tmp_path / "one_yt.txt")]) == 0
    golden_items.coalesce(1).write.json(str(tmp_path / "golden"))
    for name, floor in (("low", 0.0), ("high", 1.1)):
        (tmp_path / f"{name}.json").write_text('{"arms": {"baseline": {"recall@5": %s}}, "remark": "x"}' % floor)
        assert main(["--data", str(tmp_path / "data"), "eval", str(tmp_path / "golden"), "--gate", str(tmp_path / f"{name}.json")]) == (floor > 1)
    assert main(["--data", str(tmp_path / "data"), "ask", "battery days", "--mode", "crag"]) == 0
    out = capsys.readouterr().out
    assert "gate passed" in out and "gate failed" in out and "round 0:" in out and "battery" in out


def test_service(engine):
    service = Service(engine.with_config(engine.config))
    service.engines.base.model = ScriptedChat([], "Two days [1].")
    service.engines.base.agent = ScriptedTurns([{"calls": [{"name": "search_corpus", "input": {"query": "battery", "k": 1}}]}, {"text": "done", "calls": []}])
    post = lambda path, **body: service.handle("POST", path, json.dumps(body).encode())
    assert service.handle("GET", "/healthz") == (200, {"status": "ok"})
    status, found = post("/retrieve", query="battery lasts", k=2)
    assert status == 200 and len(found["chunks"]) == 2 and set(found["chunks"][0]) == {"chunk_id", "text", "source_ids", "score"}
    assert post("/answer", query="battery lasts")[1]["answer"].startswith("Two days [1].")
    status, found = post("/crag", query="battery lasts", generate=True)
    assert status == 200 and found["trace"][0]["round_idx"] == 0 and "answer" in found
    status, found = post("/agent", query="battery?")
    assert found["answer"] == "done" and found["steps"] == 2 and len(found["chunks"]) == 1
    assert post("/retrieve")[0] == 422 and post("/retrieve", query=3)[0] == 422 and post("/retrieve", query="x", rerank_policy="odd")[0] == 422
    assert post("/nowhere")[0] == 404 and service.handle("GET", "/retrieve")[0] == 405
    service.engines.made.clear()
    service.engines.base.model = None
    assert post("/answer", query="x")[0] == 503


def test_files_come_in_stretches(spark, tmp_path):
    (tmp_path / "a_reddit.txt").write_text("one one\n\ntwo two\n \nthree three\n\n\nfour four")
    (tmp_path / "b.txt").write_bytes(b"five five\r\n\r\nsix six")
    blocks = ingest.parse_blocks(artifacts.read_blocks(spark, [str(tmp_path)]), keep=["start", "seq"])
    rows = [r.text for r in blocks.orderBy("path", "start", "seq", "block_no").collect()]
    assert rows == ["one one", "two two", "three three", "four four", "five five", "six six"]


def test_missing_artifact_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="chunks"):
        Engine.load(spark, str(tmp_path), RetrievalConfig())


def test_stream(spark, small, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{small}/comments.parquet").repartition(2).write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    append_corpus(deduplicated_stream(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("source_id").distinct().count() == spark.read.parquet(str(source)).select("source_id").distinct().count()
