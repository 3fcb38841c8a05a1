"""python -m corvane build | ask | eval | sweep | serve"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from corvane import experiment, models, report
from corvane.config import RetrievalConfig
from corvane.engine import Engine
from corvane.operators import corrective
from corvane.sources import artifacts

SWEEP = ((256, 32), (512, 64), (1024, 128))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corvane", description=__doc__, allow_abbrev=False)
    parser.add_argument("--data", help=f"folder of artifacts, else ${artifacts.FOLDER_VARIABLE}, else ./data")
    parser.add_argument("--model-url", help="a messages endpoint for whatever needs a model")
    parser.add_argument("--model-name", default="")
    parser.add_argument("--model-key", default="CHAT_API_KEY", help="the environment variable that holds its key")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("files", nargs="+")
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--retrieval", default="dense", choices=["dense", "sparse", "hybrid"])
    ask.add_argument("--rerank", default="auto", choices=["always", "never", "auto", "llm"])
    ask.add_argument("--mode", default="plain", choices=["plain", "crag", "agent"])
    ask.add_argument("--generate", action="store_true", help="also answer")
    ask.add_argument("-k", type=int, default=5)
    evaluate = commands.add_parser("eval")
    evaluate.add_argument("golden")
    evaluate.add_argument("--out", help="folder for results.csv and results.md")
    evaluate.add_argument("--arms", nargs="*", help="some of the arms")
    evaluate.add_argument("--gate", metavar="FLOORS", help="JSON of floors; the exit code is 1 where one isn't reached")
    evaluate.add_argument("--generate", action="store_true", help="also answer and judge")
    evaluate.add_argument("--timed", type=int, default=20, help="how many questions to time, 0 for none")
    swept = commands.add_parser("sweep")
    swept.add_argument("golden")
    swept.add_argument("files", nargs="*", help="block files, for chunkings that aren't built yet")
    swept.add_argument("--out")
    serve = commands.add_parser("serve")
    serve.add_argument("--port", type=int, default=8000)
    return parser


def _gate(engine: Engine, golden_path: str, floors_path: str) -> int:
    spark = engine.chunks.sparkSession
    floors = artifacts.read_floors(spark, floors_path)
    chosen = experiment.arms([r.arm for r in floors.select("arm").distinct().collect()])
    rows = report.small_rows(experiment.Evaluation.of(engine, artifacts.read_lines(spark, golden_path, artifacts.GOLDEN), chosen or None).gate(floors))
    for r in sorted(rows, key=lambda r: (r["arm"], r["metric"])):
        print(f"[{'ok' if r['passed'] else 'FAIL'}] {r['arm']} {r['metric']} = {report.cell(r['got'], 3)} (floor {r['floor']})")
    passed = bool(rows) and all(r["passed"] for r in rows)
    print("gate passed" if passed else "gate failed")
    return 0 if passed else 1


def main(arguments: list[str] | None = None) -> int:
    given = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName("corvane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    folder = artifacts.data_folder(given.data)
    model = models.MessagesChat(given.model_url, given.model_name, key_variable=given.model_key) if given.model_url else None
    plugged = {"model": model, "agent": model}

    if given.command == "build":
        engine = Engine.build(spark, artifacts.read_blocks(spark, given.files), folder)
        print(engine.size, "chunks")
        return 0
    if given.command == "sweep":
        engines = {}
        for size, overlap in SWEEP:
            config = RetrievalConfig(chunk_size=size, chunk_overlap=overlap)
            try:
                engines[size, overlap] = Engine.load(spark, folder, config)
            except FileNotFoundError:
                if not given.files:
                    raise
                engines[size, overlap] = Engine.build(spark, artifacts.read_blocks(spark, given.files), folder, config)
        rows = report.small_rows(experiment.sweep(engines, artifacts.read_lines(spark, given.golden, artifacts.GOLDEN)))
        text = report.markdown(sorted(rows, key=lambda r: (r["size"], r["arm"])), ["size", "overlap", "arm", "recall_1", "recall_5", "recall_10", "mrr"])
        if given.out:
            report.Path(given.out).mkdir(parents=True, exist_ok=True)
            (report.Path(given.out) / "chunk_sweep.md").write_text(text, encoding="utf-8")
        print(text)
        return 0
    if given.command == "ask":
        engine = Engine.load(spark, folder, RetrievalConfig(retrieval=given.retrieval, rerank=given.rerank, k=given.k, mode=given.mode), **plugged)
        asked = spark.createDataFrame([("q", given.question)], "qid string, question string")
        if given.mode == "agent":
            run = engine.tool_agent(asked)
            for r in run.trace.orderBy("step", "call_no").collect():
                print(f"step {r.step}: {r.tool} {r.input} -> {r.output[:200]}")
            print(run.answers.first().answer)
            return 0
        if given.mode == "crag":
            loop = engine.corrective(asked)
            print(report.trace_lines(report.small_rows(corrective.all_rounds(loop))))
            found = loop.contexts
        else:
            found = engine.retrieve(asked)
        print(report.chunk_lines(report.small_rows(found.join(engine.chunks, "chunk_id"))))
        if given.generate:
            print(engine.answer(asked).first().answer)
        return 0

    engine = Engine.load(spark, folder, **plugged)
    if given.command == "serve":
        from corvane.serve import Service, server

        print(f"http://127.0.0.1:{given.port}")
        server(Service(engine), port=given.port).serve_forever()
        return 0
    if given.gate:
        return _gate(engine, given.golden, given.gate)
    evaluation = experiment.Evaluation.of(engine, artifacts.read_lines(spark, given.golden, artifacts.GOLDEN), experiment.arms(given.arms) or None)
    judged = evaluation.generation(model) if given.generate and model else None
    rows = report.arm_rows(evaluation, evaluation.latencies(given.timed) if given.timed else None, judged)
    text = report.whole(evaluation, rows, judged=judged is not None)
    if given.out:
        report.write(given.out, rows, text)
    print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
