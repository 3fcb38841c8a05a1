from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvane.functions.text import phrase_pattern, squeeze, tokens
from corvane.operators import chunking, ingest
from corvane.operators.numbering import numbered
from corvane.sources import artifacts

RAW = "2024-01-02T03:04:05Z\nGreat battery life.\r\nLasts two days\n\n  \n  screen too dim \n\n2024-01-02T03:04:05Z\n\n\nGREAT   battery life. Lasts two days\n\nok\n"


def test_blocks(spark):
    files = spark.createDataFrame([("/x/reddit_one.txt", RAW), ("/x/b.txt", None), ("/x/c.txt", "")], "path string, content string")
    rows = ingest.parse_blocks(files).orderBy("block_no").collect()
    assert [(r.timestamp, r.text) for r in rows] == [("2024-01-02T03:04:05Z", "Great battery life. Lasts two days"), (None, "screen too dim"), (None, "GREAT   battery life. Lasts two days"), (None, "ok")]
    assert files.select(ingest.source_tag(F.col("path"))).distinct().count() == 2


def test_first_of_equal_texts_survives(spark):
    t = datetime(2024, 1, 1)
    rows = [(t, "yt:2", "yt", "Same  text"), (t, "yt:1", " YT", "same text "), (t, "yt:3", "yt", "xy"), (t, "yt:4", "yt", None), (t, "yt:1", "yt", "same text ")]
    corpus = ingest.deduplicated_corpus(spark.createDataFrame(rows, "ingested_at timestamp, source_id string, source string, text string"))
    assert [(r.source_id, r.text) for r in corpus.collect()] == [("yt:1", "same text")]
    assert [r.corpus_id for r in ingest.corpus_ids(corpus).collect()] == ["yt:00000"]
    assert ingest.corpus_ids(corpus.limit(0)).count() == 0


def test_numbers_are_consecutive(spark):
    frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), (F.col("id") % 3).alias("g"))
    whole = numbered(frame, ["x"]).collect()
    assert sorted((r.x, r.rn) for r in whole) == [(i, i) for i in range(1000)]
    for g in range(3):
        part = sorted((r.x, r.rn) for r in numbered(frame, ["x"], within=["g"]).where(F.col("g") == g).collect())
        assert [n for _, n in part] == list(range(len(part)))


def test_spans_texts_windows_and_provenance(spark):
    t = [datetime(2024, 1, 1, i) for i in range(5)]
    corpus = spark.createDataFrame([(t[i], f"s{i}", "yt", "abcde"[: i + 1]) for i in range(5)], "ingested_at timestamp, source_id string, source string, text string")
    spans = chunking.pseudo_spans(corpus, group=3)
    assert sorted((r.doc_id, r.source_id, r.start_pos, r.end_pos) for r in spans.collect()) == [("doc0000", "s0", 0, 1), ("doc0000", "s1", 2, 4), ("doc0000", "s2", 5, 8), ("doc0001", "s3", 0, 4), ("doc0001", "s4", 5, 10)]
    texts = chunking.document_texts(spans, corpus)
    assert {r.doc_id: r.doc_text for r in texts.collect()}["doc0000"] == "a\nab\nabc"
    windows = chunking.fixed_windows(texts, size=4, overlap=1).orderBy("doc_id", "window_no").collect()
    assert [(r.start_pos, r.text) for r in windows if r.doc_id == "doc0000"] == [(0, "a\nab"), (3, "b\nab"), (6, "bc")]
    chunks = spark.createDataFrame([("c0", "doc0000", 1, "\nab"), ("c1", "doc0000", 1, "\n"), ("c2", "nowhere", 0, "x")], "chunk_id string, doc_id string, start_pos int, text string")
    assert {r.chunk_id: r.source_ids for r in chunking.provenance(chunks.union(chunks), spans).collect()} == {"c0": ["s1"], "c1": [], "c2": []}


@pytest.mark.parametrize(("size", "overlap"), [(20, 5), (40, 0), (64, 16)])
def test_recursive_split_invariants(size, overlap):
    text = "one two three\nfour five six seven eight\n\nnine ten " + "x" * 90 + " end\n" * 7
    pieces = chunking.split_recursively(text, size, overlap)
    assert all(0 < len(p) <= size and p == p.strip() and p in text for p in pieces)
    assert set("".join(text.split())) <= set("".join("".join(pieces).split()))
    at = 0
    for p in pieces:
        at = text.find(p, max(0, at - size))
        assert at >= 0


def test_recursive_chunks(spark):
    docs = spark.createDataFrame([("d0", "alpha beta\ngamma " * 30), ("d1", ""), ("d2", None)], "doc_id string, doc_text string")
    rows = chunking.recursive_chunks(docs, size=50, overlap=10).collect()
    text = "alpha beta\ngamma " * 30
    assert rows and all(text[r.start_pos : r.start_pos + len(r.text)] == r.text for r in rows)
    assert chunking.chunk_ids(chunking.recursive_chunks(docs, size=50, overlap=10)).select("chunk_id").distinct().count() == len(rows)


@pytest.mark.parametrize(
    ("phrase", "text", "found"),
    [
        ("sd card", "no sd-card slot", True), ("sd card", "viendo el vídeo desde mi edge 50", False), ("144hz", "a 144 hz panel", True), ("144hz", "smooth 144hz display", True),
        ("low light", "great low-light shots", True), ("heat", "the heater and the theater", False), ("card", "cardboard box", False), ("heat*", "it heats up", True),
        ("heat*", "heating issue", True), ("heat*", "too much heat", True), ("heat*", "wheat bread", False),
    ],
)
def test_phrases(spark, phrase, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(phrase_pattern(phrase))).first()[0] is found


def test_squeeze_and_tokens_as_python_has_them(spark):
    samples = ["a b c", " \x1c x \n", "Ärger 5G wi-fi", "", None]
    got = spark.createDataFrame([(s,) for s in samples], "t string").select(squeeze(F.col("t")), tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if s is None else re.sub(r"\s+", " ", s).strip() for s in samples]
    assert [r[1] for r in got] == [None if s is None else re.findall("[a-z0-9]+", s.lower()) for s in samples]


def test_json_lines(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text('{"source_id": "a", "source": "yt", "text": "é", "timestamp": null}\n\n')
    assert artifacts.read_lines(spark, str(good), artifacts.COMMENT).collect()[0].text == "é"
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"source_id": "a", "source": "yt", "text": "x", "timestamp": null, "more": 1}\n')
    with pytest.raises(Exception, match="unknown key"):
        artifacts.read_lines(spark, str(bad), artifacts.COMMENT).collect()
