from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import languages, mixing, near_duplicates, subjects, tokens
from corvane.llm.pairs import connected_groups


@pytest.fixture(scope="module")
def documents():
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        words = draw.choices(vocabulary, k=draw.randrange(25, 90))
        texts.append(" ".join(words))
        for _ in range(draw.randrange(4)):
            copy = list(words)
            for _ in range(draw.randrange(5)):
                k = draw.randrange(len(copy))
                copy[k : k + draw.randrange(2)] = draw.choices(vocabulary, k=draw.randrange(3))
            texts.append(" ".join(copy).replace(" ", draw.choice([" ", "  ", " "])) + draw.choice(["", " !", "?!"]))
    return [(f"s{i:03d}", t) for i, t in enumerate(texts)]


def sets_of(texts):
    found = {}
    for key, t in texts:
        w = near_duplicates.words_of(t)
        if len(w) >= 30:
            found[key] = set(zip(w, w[1:], w[2:]))
    return found


def test_near_duplicates_against_brute_force(spark, documents):
    rows = spark.createDataFrame(documents + documents[:9], "source_id string, text string")
    sets = sets_of(documents)
    expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert len(expected) > 40
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(rows).collect()} == expected
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in expected:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    groups = {r.source_id: r.group_id for r in near_duplicates.near_duplicate_groups(rows).collect()}
    assert groups == {k: root(k) for k in sets}


@pytest.mark.parametrize("together", [5_000, 400, 7])
def test_a_hot_variant_is_split(spark, together):
    draw = random.Random(4)
    rows = [(draw.getrandbits(63) * draw.choice([1, -1]), draw.getrandbits(20), 5 if i % 3 else i % 50) for i in range(1500)]
    indexed = spark.createDataFrame(rows, "c_hi long, s1 long, variant long")
    rule = near_duplicates.NearDuplicateRule(sketch_distance=6, together=together)
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and (a[1] ^ b[1]).bit_count() <= 6}
    got = [tuple(r) for r in near_duplicates._met(indexed, rule).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_a_hot_group_of_copies(spark, documents):
    hot = [(f"h{i:04d}", documents[0][1]) for i in range(300)]
    rows = spark.createDataFrame(documents[:1] + hot, "source_id string, text string")
    n = 301 if len(near_duplicates.words_of(documents[0][1])) >= 30 else 0
    assert near_duplicates.near_duplicate_pairs(rows).count() == n * (n - 1) // 2


def test_signature_recall_at_the_threshold():
    rule = near_duplicates.NearDuplicateRule()
    draw, missed, pairs = np.random.default_rng(4), 0, 600
    for _ in range(pairs):
        both = draw.integers(0, 2**63, 70, dtype=np.uint64)
        a, b = (np.sort(np.concatenate([both, draw.integers(0, 2**63, 15, dtype=np.uint64)])) for _ in range(2))
        values, _ = near_duplicates._signatures(np.concatenate([a, b]), np.array([0, len(a)]), rule)
        same = (values[0] == values[1]).reshape(rule.segments, rule.components).sum(1)
        missed += not (same >= rule.components - 1).any()
    assert missed / pairs < 0.01


def test_groups_of_long_paths(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)] + [("z1", "z2"), ("z2", "z1"), ("z3", "z3")]
    found = {r.node: r.root for r in connected_groups(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {v for k, v in found.items() if k.startswith("n")} == {"n000"} and found["z2"] == "z1" and len(found) == 203


TEXTS = ["Hello world", "", None, "<|endoftext|> isn't special", "naïve café 日本語 🙂🙂", "a\x1cb \x85 c  \n\n d", "ab" * 3000, "१२३ ½ Ⅻ", "'LL they'll '' ", " lead and trail  ", "​﻿"]


@pytest.mark.parametrize("words", [0, 50])
def test_ids_as_the_tokenizer_has_them(spark, words):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(str(tokens.vocabulary_file().with_suffix(".json")))
    reference.encode_special_tokens = True
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(rows, lexicon_words=words).collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.tokens for r in tokens.count_tokens(rows, keep=["doc_id"]).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_the_automaton_is_minimal_and_exact():
    draw = random.Random(1)
    words = sorted({"".join(draw.choices("abc", k=draw.randrange(1, 7))).encode() for _ in range(500)})
    arrays = tokens.minimal_automaton(words)
    lexicon = tokens.Lexicon(arrays)
    assert [lexicon.number(w) for w in words] == list(range(len(words)))
    assert all(lexicon.number(w) == -1 for w in (b"", b"d", b"abcabcabc") if w not in words)
    right: dict[bytes, set] = {}
    for prefix in {w[:n] for w in words for n in range(len(w) + 1)}:
        right[prefix] = {w[len(prefix) :] for w in words if w.startswith(prefix)}
    assert len(arrays["final"]) == len({frozenset(r) for r in right.values()})


def test_long_words_merge_as_short_ones():
    ranks = tokens.read_ranks(tokens.vocabulary_file())
    draw = random.Random(3)
    for _ in range(40):
        word = "".join(draw.choices("abcthe ", k=150)).encode()
        assert tokens._merge_long(word, ranks) == tokens.merge_word(word, ranks) or word in ranks


def test_mixture_against_sorting(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice(["big", "big", "big", "mid", "small", None, "untargeted"]), draw.randrange(0, 200)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, tokens long").repartition(5)
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.5, 3), ("small", 0.4, 2), ("gone", 0.2, 9)], "source string, target_share double, max_repeats int")
    rule = mixing.MixRule(total=300_000)
    selection, shares = mixing.mix_sources(frame, targets, rule=rule)
    used = {r.doc_id: r for r in selection.collect()}
    place = {r.doc_id: r.p for r in frame.select("doc_id", F.pmod(F.xxhash64(F.lit(rule.seed), "doc_id"), F.lit(1 << mixing.BITS)).alias("p")).collect()}
    total = 0
    for source, share, most in (("big", 0.3, 1), ("mid", 0.5, 3), ("small", 0.4, 2)):
        mine = sorted((place[i], i, n) for i, s, n in rows if s == source)
        there, budget = sum(n for *_, n in mine), int(share * 300_000)
        full = min(budget // there, most)
        rest, once_more = (budget - full * there if full < most else 0), set()
        for _, i, n in mine:
            if n > rest:
                break
            rest -= n
            once_more.add(i)
        if full == most:
            once_more = set()
        expected = {i: full + (i in once_more) for _, i, _ in mine if full + (i in once_more)}
        assert {i: r.repeats for i, r in used.items() if r.source == source} == expected
        total += sum(n * expected.get(i, 0) for _, i, n in mine)
    found = {r.source: r for r in shares.collect()}
    assert found["gone"].selected == 0 and found["gone"].capped and sum(r.selected for r in found.values()) == total
    assert sum(r.reached_share for r in found.values()) == pytest.approx(1)
    assert {r.source for r in used.values()} <= {"big", "mid", "small"}


def test_a_larger_budget_takes_a_superset(spark):
    frame = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 17).alias("tokens"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    kept = [{r.doc_id for r in mixing.mix_sources(frame, targets, rule=mixing.MixRule(total=t))[0].collect()} for t in (500, 1500, 10**9)]
    assert kept[0] < kept[1] < kept[2] and len(kept[2]) == 500


def test_codewords_are_far_apart():
    codes = languages.codewords(8)
    assert min((codes[i] != codes[j]).sum() for i in range(8) for j in range(i)) >= codes.shape[1] // 2


WORDS = {
    "en": "the battery is very good but this screen was not what they promised after one week of use".split(),
    "es": "la batería es muy buena pero esta pantalla no era lo que prometían después de una semana de uso".split(),
    "de": "der akku ist sehr gut aber dieser bildschirm war nicht was versprochen wurde nach einer woche nutzung".split(),
}


def test_languages_held_out(spark):
    draw = random.Random(9)

    def say(lang, n):
        return " ".join(draw.sample(WORDS[lang], n))

    rows, truth = [], {}
    for i in range(600):
        lang = draw.choice(list(WORDS))
        label = draw.choice(list(WORDS)) if draw.random() < 0.2 else lang
        parts = [lang]
        text = say(lang, 9)
        if i % 5 == 0:
            parts.append(draw.choice([x for x in WORDS if x != lang]))
            text += ". " + say(parts[1], 9)
        rows.append((f"s{i}", text, label))
        truth[f"s{i}"] = parts
    rows += [("name", "Zorbax 9 💯", "en"), ("digits", "123 / 456", None)]
    truth |= {"name": ["und"], "digits": ["und"]}
    frame = spark.createDataFrame(rows, "source_id string, text string, lang string")
    codes = spark.createDataFrame([(x, x) for x in WORDS], "code string, lang string")
    got: dict[str, list] = {}
    for r in sorted(languages.label_languages(frame, languages.train_languages(frame, codes)).collect(), key=lambda r: r.seg_no):
        got.setdefault(r.source_id, []).append(r.lang)
        assert 0 <= r.confidence <= 1
    assert sum(got[k] == v for k, v in truth.items()) / len(truth) > 0.97
    kept = {r.source_id for r in languages.relabelled(frame, codes).collect()}
    assert {"name", "digits"} <= kept


def test_subjects_held_out(spark):
    draw = random.Random(4)
    nouns = {"power": ["battery", "charger", "cable", "socket", "adapter"], "screen": ["display", "pixel", "panel", "glass", "brightness"], None: ["parcel", "neighbour", "thread", "box", "colour"]}
    verbs = {"power": ["drains overnight", "charges slowly", "lost capacity"], "screen": ["flickers badly", "looks washed out", "has dead spots"], None: ["arrived early", "smells odd", "asked twice"]}

    def sentence(s, known):
        return f"The {draw.choice(nouns[s][:3] if known else nouns[s])} {draw.choice(verbs[s][:2] if known else verbs[s])}."

    examples = spark.createDataFrame([(s, sentence(s, True)) for s in nouns for _ in range(12)], "subject string, text string")
    rows, truth = [], {}
    for i in range(300):
        wanted = draw.choice([["power"], ["screen"], ["power", "screen"], []])
        parts = [sentence(s, False) for s in wanted for _ in range(4)] + [sentence(None, False) for _ in range(4)]
        draw.shuffle(parts)
        rows.append((i, " ".join(parts)))
        truth[i] = set(wanted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    topics = spark.createDataFrame([("power",), ("screen",)], "subject string")
    got = {i: set() for i in truth}
    for r in subjects.document_subjects(frame, subjects.train_subjects(frame, topics, examples)).collect():
        got[r.doc_id].add(r.subject)
    assert sum(got[i] == truth[i] for i in truth) / len(truth) > 0.95


def test_subjects_count_every_document(spark):
    texts = [" ".join(f"word{chr(97 + i // 2 % 26)}{chr(97 + i // 52 % 26)}{chr(97 + i // 1352)} battery{'s' * (k % 3)}." for k in range(7)) for i in range(2000)]
    texts.append(" ".join(["endless"] * 70) + ". An endless line.")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    topics = spark.createDataFrame([("power",)], "subject string")
    examples = spark.createDataFrame([("power", "The battery drains")], "subject string, text string")
    rule = subjects.SubjectRule(rounds=1, steps=1)
    model = subjects.train_subjects(frame, topics, examples, rule=rule)
    counts = {}
    for t in [*texts, "The battery drains"]:
        for w in t.lower().replace(".", "").split():
            counts[w] = counts.get(w, 0) + 1
    once = {"the", "drains", "an", "line"}
    assert set(model.vocabulary) == set(counts) - once
    assert all(model.importance[w] == pytest.approx(rule.common / (rule.common + counts[w] / sum(counts.values()))) for w in model.vocabulary)


def test_subjects_refuse_more_than_they_take(spark):
    frame = spark.createDataFrame([(1, "The battery drains.")], "doc_id long, text string")
    topics = spark.createDataFrame([("power",), ("screen",)], "subject string")
    examples = spark.createDataFrame([("power", "The battery drains"), ("screen", "The display flickers")], "subject string, text string")
    with pytest.raises(ValueError, match="subjects"):
        subjects.train_subjects(frame, topics, examples, rule=subjects.SubjectRule(most_subjects=1))
    with pytest.raises(ValueError, match="examples"):
        subjects.train_subjects(frame, topics, examples, rule=subjects.SubjectRule(most_examples=1))
