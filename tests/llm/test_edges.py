"""What every operator does with nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.llm import canonical, languages, mixing, near_duplicates, pii, splitting, subjects, tokens
from corvane.operators.durable import cut

LONG = "The battery lasts long. " * 8000
ROWS = [
    ("a", "yt", LONG, "en"),
    ("a", "yt", LONG, "en"),
    ("b", None, None, None),
    ("c", "yt", "", ""),
    (None, "yt", "Who wrote this good text about the battery?", "en"),
    ("d", "yt", "   ", "en"),
    ("e", "yt", "​﻿", "xx"),
    ("f", "yt", "x" * 50_000, "en"),
    ("g", "yt", "La batería no dura nada y la pantalla es muy frágil", "es"),
    ("h", "yt", "La batería no dura nada y la pantalla es muy frágil", "es"),
    ("i", "yt", "\x00\x07 control \x1b characters", "en"),
]
CLASHING = "id string, text_form string, seg_no int, piece_no int, group_id string, ids string, tokens long, subject string, part int, c_hi long, confidence double, key string"


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame(ROWS, "source_id string, source string, text string, lang string")
    for field in CLASHING.split(", "):
        name, kind = field.split()
        frame = frame.withColumn(name, F.lit(None).cast(kind))
    return frame


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("Ariard", "given"), ("Ariosh", "given"), ("Jorard", "given"), (None, "given"), ("Wexholt", None)], "name_part string, part_kind string")


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame([("en", "en"), ("EN", "en"), ("es", "es"), ("de", "de")], "code string, lang string")


@pytest.fixture(scope="module")
def topics(spark):
    subject = spark.createDataFrame([("power",), ("screen",), (None,)], "subject string")
    examples = spark.createDataFrame([("power", "The battery lasts long"), ("screen", "The display is bright"), (None, "I like it"), ("power", None)], "subject string, text string")
    return subject, examples


def operators(names, codes, topics):
    small = languages.LanguageRule(sample_per_language=20)
    rule = subjects.SubjectRule(rounds=1, steps=2)
    return {
        "normalise_text": lambda x: canonical.normalise_text(x),
        "look_alike_pairs": lambda x: canonical.look_alike_pairs(x),
        "label_languages": lambda x: languages.label_languages(x, languages.train_languages(x, codes, rule=small)),
        "relabelled": lambda x: languages.relabelled(x, codes, rule=small),
        "split_items": lambda x: splitting.split_items(x, id_col="source_id"),
        "near_duplicate_pairs": lambda x: near_duplicates.near_duplicate_pairs(x),
        "near_duplicate_groups": lambda x: near_duplicates.near_duplicate_groups(x),
        "find_personal_information": lambda x: pii.find_personal_information(x, names),
        "replace_personal_information": lambda x: pii.replace_personal_information(x, names),
        "encode_corpus": lambda x: tokens.encode_corpus(x, id_col="source_id"),
        "count_tokens": lambda x: tokens.count_tokens(x.drop("tokens"), keep=["source_id", "source"]),
        "mix_sources": lambda x: mixing.mix_sources(tokens.count_tokens(x.drop("tokens"), keep=["source_id", "source"]), x.sparkSession.createDataFrame([("yt", 1.0, 2), ("gone", 0.5, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int"), id_col="source_id")[0],
        "document_subjects": lambda x: subjects.document_subjects(x, subjects.train_subjects(x, *topics, id_col="source_id", rule=rule), id_col="source_id"),
    }


NAMES = list(operators(None, None, (None, None)))


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(rows, names, codes, topics, name):
    found = operators(names, codes, topics)[name](rows)
    got = found.collect()
    assert len(set(found.columns)) == len(found.columns)
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r)
    if name in ("normalise_text", "encode_corpus", "replace_personal_information"):
        assert len(got) == len(ROWS)
    if name == "normalise_text":
        assert by_id["b"][0][1] is None and by_id["c"][0][1] == "" and by_id["e"][0][1] == ""
    if name == "look_alike_pairs":
        assert [(r[0], r[1]) for r in got] == [("c", "e")]
    if name == "label_languages":
        assert "b" not in by_id and by_id["c"][0].lang == "und" and by_id["e"][0].lang == "und" and len(by_id["a"]) == 2
    if name == "split_items":
        assert "b" not in by_id and by_id["c"][0].piece_text == "" and all(len(r.piece_text) <= 512 for r in got)
        assert {r.boundary for r in by_id["f"]} == {"character", "end"}
    if name == "near_duplicate_pairs":
        assert got == []
    if name == "near_duplicate_groups":
        assert [tuple(r) for r in got] == [("a", "a", 0)]
    if name == "encode_corpus":
        assert by_id["b"][0].ids == [] and by_id["c"][0].ids == [] and len(by_id["a"][0].ids) > 30_000
    if name == "count_tokens":
        assert by_id["b"][0].tokens == 0
    if name == "mix_sources":
        assert "b" not in by_id and all(1 <= r.repeats <= 2 for r in got)
    if name == "replace_personal_information":
        assert by_id["b"][0][1] is None and by_id["a"][0][1] == LONG


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(rows, names, codes, topics, name):
    assert operators(names, codes, topics)[name](rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_all_texts_null(rows, names, codes, topics, name):
    empty = cut(rows.withColumn("text", F.lit(None).cast("string")))
    operators(names, codes, topics)[name](empty).collect()
