"""Questions over HTTP, one at a time, on the batch engine."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.engine import Engine, Engines
from corvane.operators import corrective, generation


@dataclass(frozen=True)
class RetrieveRequest:
    query: str
    k: int = 5
    retrieval_mode: str = "dense"
    rerank_policy: str = "never"


@dataclass(frozen=True)
class AskRequest:
    query: str
    rerank_policy: str = "auto"
    retrieval_mode: str = "dense"
    generate: bool = False


def request_of(kind: type, body: dict) -> RetrieveRequest | AskRequest:
    """The request in a JSON object; a missing query, a value of another type and an unknown policy or stage are errors, further keys are passed over."""
    known = {f.name: body[f.name] for f in fields(kind) if f.name in body}
    types = {"query": str, "k": int, "retrieval_mode": str, "rerank_policy": str, "generate": bool}
    for name, value in known.items():
        if type(value) is not types[name]:
            raise ValueError(f"{name} must be {types[name].__name__}")
    if "query" not in known:
        raise ValueError("query is missing")
    return kind(**known)


class Service:
    """The handlers: each takes a JSON object and gives one."""

    def __init__(self, engine: Engine):
        self.engines, self.spark = Engines(engine), engine.chunks.sparkSession
        self.routes: dict[str, Callable[[dict], dict]] = {"/retrieve": self.retrieve, "/answer": self.answer, "/crag": self.crag, "/agent": self.agent}

    def _asked(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([("q", query)], "qid string, question string")

    def _shown(self, engine: Engine, contexts: DataFrame) -> list[dict]:
        known = engine.sources.groupBy("chunk_id").agg(F.min(F.struct("text", "source_ids")).alias("c"))
        rows = contexts.join(known, "chunk_id").select("rank", "chunk_id", "c.text", "c.source_ids", "score").collect()
        return [{"chunk_id": r.chunk_id, "text": r.text, "source_ids": r.source_ids or [], "score": r.score} for r in sorted(rows, key=lambda r: r.rank)]

    def retrieve(self, body: dict) -> dict:
        given = request_of(RetrieveRequest, body)
        engine = self.engines.get("plain", given.rerank_policy, given.retrieval_mode)
        return {"query": given.query, "chunks": self._shown(engine, engine.retrieve(self._asked(given.query), given.k))}

    def _told(self, engine: Engine, query: str, contexts: DataFrame) -> str:
        """The model's answer to these contexts, which are retrieved once."""
        if engine.model is None:
            raise ValueError("answers need a model")
        prompts = generation.build_prompts(self._asked(query), contexts.join(engine.chunks, "chunk_id").select("qid", "rank", "text"))
        said = [(r.qid, engine.model.chat(r.prompt)) for r in prompts.collect()]
        answers = self.spark.createDataFrame(said, "qid string, answer string")
        return generation.expand_citations(answers, contexts.join(engine.chunks, "chunk_id")).first().expanded

    def answer(self, body: dict) -> dict:
        given = request_of(AskRequest, body)
        engine = self.engines.get("plain", given.rerank_policy, given.retrieval_mode)
        contexts = engine.retrieve(self._asked(given.query)).persist()
        return {"query": given.query, "answer": self._told(engine, given.query, contexts), "chunks": self._shown(engine, contexts)}

    def crag(self, body: dict) -> dict:
        given = request_of(AskRequest, body)
        engine = self.engines.get("crag", given.rerank_policy, given.retrieval_mode)
        loop = engine.corrective(self._asked(given.query))
        chunks = self._shown(engine, loop.contexts)
        trace = [r.asDict() for r in corrective.all_rounds(loop).drop("qid").orderBy("round_idx").collect()]
        found = {"query": given.query, "refused": not chunks, "trace": trace, "chunks": chunks}
        if given.generate:
            found["answer"] = self._told(engine, given.query, loop.contexts) if chunks else generation.REFUSAL
        return found

    def agent(self, body: dict) -> dict:
        given = request_of(AskRequest, body)
        engine = self.engines.get("agent", given.rerank_policy, given.retrieval_mode)
        run = engine.tool_agent(self._asked(given.query))
        last = run.answers.first()
        trace = [{"step": r.step, "name": r.tool, "tool_input": json.loads(r.input), "output": r.output} for r in run.trace.orderBy("step", "call_no").collect()]
        chunks = [{"chunk_id": r.chunk_id, "text": r.text} for r in run.contexts.orderBy("place").collect()]
        return {"query": given.query, "answer": last.answer, "steps": last.steps, "trace": trace, "chunks": chunks}

    def handle(self, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
        """(status, JSON object) of a request: 404 for another path, 405 for another method, 422 for a body that is no request, 503 where a model is missing."""
        if path == "/healthz":
            return (200, {"status": "ok"}) if method == "GET" else (405, {"detail": "use GET"})
        if path not in self.routes:
            return 404, {"detail": "no such path"}
        if method != "POST":
            return 405, {"detail": "use POST"}
        try:
            given = json.loads(body or b"{}")
            if not isinstance(given, dict):
                raise ValueError("the body must be an object")
            return 200, self.routes[path](given)
        except ValueError as problem:
            return (503 if "model" in str(problem) else 422), {"detail": str(problem)}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = service.handle(method, self.path.partition("?")[0], body)
            out = json.dumps(found, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def do_GET(self) -> None:
            self._reply("GET")

        def do_POST(self) -> None:
            self._reply("POST")

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
