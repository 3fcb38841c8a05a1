"""Models are plug-ins: what each kind must offer, and offline defaults that always answer alike."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


class ChatModel(Protocol):
    def chat(self, prompt: str) -> str: ...


class PairScorer(Protocol):
    """Scores of (question, text) pairs; above 0 means relevant."""

    def score(self, questions: list[str], texts: list[str]) -> list[float]: ...


class Embedder(Protocol):
    """Vectors of length 1, one per text."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class ToolModel(Protocol):
    """A turn of a conversation: history is the turns so far, each {"calls": [{"name", "input", "output"}]}; the turn is {"text", "calls": [{"name", "input"}]}, without calls where final."""

    def turn(self, question: str, history: list[dict], final: bool) -> dict: ...


class ScriptedChat:
    """Answers by the first rule whose pattern is found in the prompt, else by the default."""

    def __init__(self, rules: list[tuple[str, str]], default: str = "NO"):
        self.rules, self.default = [(re.compile(p, re.I | re.S), answer) for p, answer in rules], default

    def chat(self, prompt: str) -> str:
        return next((answer for pattern, answer in self.rules if pattern.search(prompt)), self.default)


class HttpChat:
    """A chat model behind an HTTP endpoint; the key is read when it is first needed."""

    def __init__(self, url: str, model: str, key: Callable[[], str], timeout: float = 60.0):
        self.url, self.model, self.key, self.timeout = url, model, key, timeout

    def chat(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(self.url, body, {"Authorization": f"Bearer {self.key()}", "Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            if reply.status != 200:
                raise RuntimeError(f"the chat endpoint answered {reply.status}")
            return json.loads(reply.read())["choices"][0]["message"]["content"]


class MessagesChat:
    """A model behind a messages endpoint with tools; the key is read from the environment when it is first needed, and missing it is an error that names it."""

    def __init__(self, url: str, model: str, *, key_variable: str = "CHAT_API_KEY", system: str = "", most_tokens: int = 512, timeout: float = 60.0, headers: dict[str, str] | None = None):
        self.headers = headers or {}
        self.url, self.model, self.key_variable, self.system, self.most_tokens, self.timeout = url, model, key_variable, system, most_tokens, timeout

    def _send(self, messages: list[dict], **more: object) -> list[dict]:
        key = os.environ.get(self.key_variable)
        if not key:
            raise RuntimeError(f"{self.key_variable} is not set; retrieval works without it, answers don't")
        body = {"model": self.model, "max_tokens": self.most_tokens, "temperature": 0.0, "messages": messages, **({"system": self.system} if self.system else {}), **more}
        headers = {"x-api-key": key, "Content-Type": "application/json", **self.headers}
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as reply:
            return json.loads(reply.read())["content"]

    def chat(self, prompt: str) -> str:
        return text_of(self._send([{"role": "user", "content": prompt}])).strip()

    def turn(self, question: str, history: list[dict], final: bool) -> dict:
        from corvane.tools import TOOLS

        messages: list[dict] = [{"role": "user", "content": question}]
        for n, turn in enumerate(history):
            ids = [f"call_{n}_{i}" for i in range(len(turn["calls"]))]
            messages.append({"role": "assistant", "content": [{"type": "tool_use", "id": i, "name": c["name"], "input": json.loads(c["input"])} for i, c in zip(ids, turn["calls"])]})
            messages.append({"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "content": c["output"]} for i, c in zip(ids, turn["calls"])]})
        blocks = self._send(messages, tools=TOOLS, **({"tool_choice": {"type": "none"}} if final else {}))
        return {"text": text_of(blocks), "calls": [{"name": b["name"], "input": b["input"]} for b in blocks if b.get("type") == "tool_use"]}


class ScriptedTurns:
    """An agent's turns by number: turn n is script[n], the last one for all that follow; where it may call nothing it gives its final word."""

    def __init__(self, script: list[dict], last_word: str = "No answer."):
        self.script, self.last_word = script, last_word

    def turn(self, question: str, history: list[dict], final: bool) -> dict:
        return {"text": self.last_word} if final else self.script[min(len(history), len(self.script) - 1)]


PROVIDERS: dict[str, Callable[..., ChatModel]] = {"scripted": ScriptedChat, "http": HttpChat, "messages": MessagesChat}


def chat_model(provider: str, *args: object, **settings: object) -> ChatModel:
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}")
    return PROVIDERS[provider](*args, **settings)


def text_of(blocks: str | list) -> str:
    """The text of a reply that may come as blocks of several kinds."""
    if isinstance(blocks, str):
        return blocks
    return "".join(b.get("text", "") if isinstance(b, dict) else getattr(b, "text", "") for b in blocks if (b.get("type") if isinstance(b, dict) else getattr(b, "type", None)) == "text")


def says_yes(model: ChatModel, prompt: Column) -> Column:
    """Whether the model's answer begins with Y, in batches; null where it fails."""

    @F.pandas_udf(BooleanType())
    def ask(prompts: pd.Series) -> pd.Series:
        def one(p: str | None) -> bool | None:
            try:
                return None if p is None else model.chat(p).strip().upper().startswith("Y")
            except Exception:  # noqa: BLE001 - a failing model means no opinion
                return None

        return prompts.map(one).astype("boolean")

    return ask(prompt)


def replies(model: ChatModel, prompt: Column) -> Column:
    """The model's answers, in batches; null where it fails."""

    @F.pandas_udf(StringType())
    def ask(prompts: pd.Series) -> pd.Series:
        def one(p: str | None) -> str | None:
            try:
                return None if p is None else model.chat(p)
            except Exception:  # noqa: BLE001
                return None

        return prompts.map(one)

    return ask(prompt)


def rewritten(question: Column, reply: Column) -> Column:
    """The reply as a new question; null where it is empty or the same but for case."""
    clean = F.trim(reply)
    return F.when((clean != "") & (F.lower(clean) != F.lower(F.trim(question))), clean)
