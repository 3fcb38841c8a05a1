"""Languages of texts and of their stretches, by error-correcting output codes.

Each language has a codeword; one binary classifier over n-grams predicts each
bit of it: the log-odds that a word belongs to the languages whose bit is 1.
Words are n-grams of their own, padded character n-grams stand in for words not
seen in training.  Bits of a stretch are decoded by the loss to every codeword;
close losses mark the result as ambiguous.  Stretches come from the best path
through the words, where a change of language costs less at a sentence's end.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.canonical import canonical
from corvane.operators.durable import broadcast_below

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageRule:
    """Parameters. sample_per_language bounds the labelled rows that the classifiers are fitted on."""

    sample_per_language: int = 2000
    longest_sample: int = 100_000
    rounds: int = 3
    least_count: int = 3
    grams: int = 4
    smoothing: float = 0.02
    change_cost: float = 12.0
    change_cost_at_end: float = 7.0
    least_words: int = 3
    word_limit: float = 4.0
    gram_weight: float = 0.6
    ambiguous_under: float = 0.8


def codewords(n: int) -> np.ndarray:
    """n codewords of ±1, rows of a Hadamard matrix, which differ in half of its columns; columns in which all n agree are left out."""
    size = 2
    while size < max(n + 1, 16):
        size *= 2
    matrix = np.array([[1]])
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    rows = matrix[1 : n + 1]
    telling = (rows != rows[:1]).any(0)
    return rows[:, telling] if telling.any() else np.ones((n, 1), int)


_NO_WORD = re.compile(r"[@\d]")


class _Bare(dict):
    """Token to its word: punctuation and digits at its ends removed; empty for handles, tags, codes and numbers."""

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        if _NO_WORD.search(token) or token[0] == "#":
            self[token] = ""
            return ""
        if token.isalpha():
            self[token] = token
            return token
        start, end = 0, len(token)
        while start < end and unicodedata.category(token[start])[0] not in "LM":
            start += 1
        while end > start and unicodedata.category(token[end - 1])[0] not in "LM":
            end -= 1
        word = token[start:end]
        self[token] = word = "" if "." in word else word
        return word


_BARE = _Bare()


def _grams(word: str, most: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for n in range(2, most + 1) for i in range(len(padded) - n + 1)]


@dataclass
class LanguageModel:
    """Log-odds of every bit for each known word and each n-gram, ready to be sent to the workers."""

    languages: list[str]
    codes: np.ndarray
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    neutral: set[str]
    rule: LanguageRule


class Reader(dict):
    """Decodes texts with a model; the dictionary is a memo from token to its number in the tables."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self._start()

    def _start(self) -> None:
        """Numbers 0 and 1 stand for every token that tells nothing, without and with a sentence's end after it."""
        self.clear()
        nothing = np.zeros(self.model.codes.shape[1], np.float32)
        self.losses: list[np.ndarray] = [np.zeros(len(self.model.languages), np.float32)] * 2
        self.bits: list[np.ndarray] = [nothing, nothing]
        self.evident, self.plain, self.ends = [False, False], [False, False], [False, True]

    def __missing__(self, token: str) -> int:
        bits, end = self._word_bits(token), token[-1] in ".!?…।:\n" or token in "-/|"
        if bits is None:
            self[token] = int(end)
            return int(end)
        losses = np.logaddexp(0, -self.model.codes * bits).mean(1)
        self.losses.append(np.minimum((losses - losses.min()) * 4, self.model.rule.word_limit).astype(np.float32))
        self.bits.append(bits.astype(np.float32))
        self.evident.append(True)
        self.plain.append(not _BARE[token][0].isupper())
        self.ends.append(end)
        self[token] = len(self.losses) - 1
        return self[token]

    def _word_bits(self, token: str) -> np.ndarray | None:
        """Log-odds of the bits, or nothing for a token that tells no language: a name, code, number or symbol."""
        word = _BARE[token]
        if not word:
            return None
        low = word.lower()
        if low in self.model.neutral:
            return None
        if low in self.model.words:
            return self.model.words[low]
        if word[0].isupper():
            return None
        known = [self.model.grams[g] for g in _grams(low, self.model.rule.grams) if g in self.model.grams]
        if not known:
            return None
        return np.mean(known, axis=0) * self.model.rule.gram_weight * min(len(known), 6) / 2

    def paths(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ids, path) over the tokens of all texts in a row: the language of each on its text's best path."""
        if len(self) > 1_000_000:
            self._start()
        counts = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids = np.fromiter((k for t in texts for k in map(self.__getitem__, t)), np.int64, int(starts[-1]))
        path = np.zeros(len(ids), np.int64)
        if len(ids):
            table, ends = np.stack(self.losses), np.array(self.ends)
            order = np.argsort(counts, kind="stable")
            order = order[counts[order] > 0]
            for first in range(0, len(order), 256):
                rows = order[first : first + 256]
                flat = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
                owner = np.repeat(np.arange(len(rows)), counts[rows])
                place = flat - np.repeat(starts[rows], counts[rows])
                path[flat] = self._best(table[ids[flat]], ends[ids[flat]], owner, place, counts[rows])[place, owner]
        return starts, ids, path

    def _best(self, losses: np.ndarray, ends: np.ndarray, owner: np.ndarray, place: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best paths of texts of similar length, as (position, text)."""
        rule = self.model.rule
        longest, rows, n = int(counts.max()), len(counts), losses.shape[1]
        loss = np.zeros((longest, rows, n), np.float32)
        loss[place, owner] = losses
        cost = np.full((longest + 1, rows), rule.change_cost, np.float32)
        cost[place[ends] + 1, owner[ends]] = rule.change_cost_at_end
        total = loss[0].copy()
        change = np.zeros((longest, rows, n), bool)
        source = np.zeros((longest, rows), np.int64)
        every = np.arange(rows)
        for k in range(1, longest):
            source[k] = best = total.argmin(1)
            switched = (total[every, best] + cost[k])[:, None]
            change[k] = switched < total
            total = np.minimum(total, switched) + loss[k]
        path = np.zeros((longest, rows), np.int64)
        path[-1] = total.argmin(1)
        for k in range(longest - 1, 0, -1):
            path[k - 1] = np.where(change[k, every, path[k]], source[k], path[k])
        return path

    def stretches(self, texts: list[str]) -> list[list[tuple[str, float, bool, int, int]]]:
        """For each text its stretches: (language, confidence, ambiguous, first word, word after the last)."""
        names = self.model.languages
        split = [_tokens(t) for t in texts]
        starts, ids, path = self.paths(split)
        result: list[list] = [[] for _ in texts]
        if len(ids):
            told = np.array(self.evident)[ids]
            sums = np.concatenate([[0], np.cumsum(told)])
            for i in np.flatnonzero(sums[starts[1:]] - sums[starts[:-1]] <= 2):
                told[starts[i] : starts[i + 1]] = self._without_names(split[i], told[starts[i] : starts[i + 1]].tolist())
            owner = np.repeat(np.arange(len(texts)), starts[1:] - starts[:-1])
            edge = np.ones(len(ids), bool)
            edge[1:] = (owner[1:] != owner[:-1]) | (path[1:] != path[:-1])
            firsts = np.flatnonzero(edge)
            evidence = np.add.reduceat(np.stack(self.bits)[ids] * told[:, None], firsts)
            weight = np.add.reduceat(told.astype(np.int64), firsts)
            losses = np.logaddexp(0, -(evidence[:, None, :] * self.model.codes[None])).sum(2)
            share = np.exp(-(losses - losses.min(1, keepdims=True)) / np.sqrt(np.maximum(weight, 1))[:, None])
            confidence = share[np.arange(len(firsts)), path[firsts]] / share.sum(1)
            ends = np.append(firsts[1:], len(ids))
            plain = np.add.reduceat((told & np.array(self.plain)[ids]).astype(np.int64), firsts)
            of_text = np.bincount(owner[firsts[weight > 0]], minlength=len(texts))
            # Beside other stretches, one of few words but names is an address or the like and belongs to its surroundings.
            kept = (weight > 0) & ((of_text[owner[firsts]] == 1) | (plain >= self.model.rule.least_words))
            kept |= (weight > 0) & (np.bincount(owner[firsts[kept]], minlength=len(texts)) == 0)[owner[firsts]]
            for k in np.flatnonzero(kept).tolist():
                i = int(owner[firsts[k]])
                first, end, lang, sure = int(firsts[k] - starts[i]), int(ends[k] - starts[i]), names[path[firsts[k]]], float(confidence[k])
                found = result[i]
                if found and found[-1][0] == lang:
                    found[-1] = (*found[-1][:4], end)
                else:
                    found.append((lang, sure, sure < self.model.rule.ambiguous_under, first, end))
        return [r or [(UNDETERMINED, 1.0, False, 0, len(t))] for r, t in zip(result, split)]

    def _without_names(self, tokens: list[str], told: list[bool]) -> list[bool]:
        """A capitalised word straight after a name is part of the name."""
        out, inside = list(told), False
        for k, t in enumerate(tokens):
            word = _BARE[t]
            named = word[:1].isupper() and (not told[k] or inside)
            if named:
                out[k] = False
            inside = named and t[-1:].isalnum() or (inside and t.isdigit())
        return out


def _tokens(text: str) -> list[str]:
    """White-space tokens of the text in one form; a token that ends a line keeps the line break."""
    form = canonical(text)
    if "\n" not in form:
        return form.split()
    return [t + "\n" * (k == len(line) - 1) for line in map(str.split, form.split("\n")) for k, t in enumerate(line)]


def _fit(counts: list[Counter], languages: list[str], rule: LanguageRule) -> LanguageModel:
    codes = codewords(len(languages))
    totals = np.array([max(sum(c.values()), 1) for c in counts], float)
    vocabulary = sorted({w for c in counts for w in c})
    table = np.array([[c[w] for c in counts] for w in vocabulary], float).reshape(len(vocabulary), len(languages))
    rates = table / totals
    spread = (rates >= 0.3 * rates.max(1, keepdims=True)).sum(1) >= max(3, (len(languages) + 2) // 2)
    neutral = {w for w, s in zip(vocabulary, spread) if s}

    def odds(share: np.ndarray, floor: float) -> np.ndarray:
        positive = (codes > 0).astype(float)
        p, q = share @ (positive / np.maximum(positive.sum(0), 1)), share @ ((1 - positive) / np.maximum((1 - positive).sum(0), 1))
        return np.log((p + floor) / (q + floor))

    common = table.sum(1) >= rule.least_count
    words = dict(zip((w for w, c in zip(vocabulary, common) if c), odds(rates[common], rule.smoothing / totals.mean()).astype(np.float32)))
    grams: dict[str, np.ndarray] = {}
    for w, row in zip(vocabulary, rates):
        if w not in neutral:
            for g in _grams(w, rule.grams):
                grams[g] = grams.get(g, 0) + row
    names = list(grams)
    weights = odds(np.array([grams[g] for g in names]).reshape(len(names), len(languages)), rule.smoothing * 20 / totals.mean()).astype(np.float32)
    return LanguageModel(languages, codes, words, dict(zip(names, weights)), neutral, rule)


def train_languages(rows: DataFrame, lang_codes: DataFrame, *, id_col: str = "source_id", text_col: str = "text", label_col: str = "lang", rule: LanguageRule | None = None) -> LanguageModel:
    """Fits the bit classifiers on at most sample_per_language rows of each label, chosen by the hash of their id (of their text where that is null), none longer than longest_sample.

    Labels may be wrong and texts mixed: after a first fit by label, every
    sampled text is cut into stretches and counted under the languages found,
    and the classifiers are fitted again.
    """
    rule = rule or LanguageRule()
    known = lang_codes.select(F.col("code").alias("label"), F.col("lang").alias("language")).distinct()
    labelled = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("text is not null").join(broadcast_below(known, 100_000), "label")
    languages = sorted({r.language for r in known.select("language").distinct().collect()})
    if len(languages) > 1000:
        raise ValueError("more than 1000 languages")
    sizes = {r.language: r["count"] for r in labelled.groupBy("language").count().collect()}
    chance = F.lit(None).cast("double")
    for x, n in sizes.items():
        chance = F.when(F.col("language") == x, min(1.0, 1.1 * rule.sample_per_language / n + 1e-9)).otherwise(chance)
    place = F.pmod(F.coalesce(F.when(F.col("id").isNotNull(), F.xxhash64("id")), F.xxhash64("text")), F.lit(1 << 40))
    drawn = labelled.where((place < chance * float(1 << 40)) & (F.length("text") <= rule.longest_sample)).select("language", "text", place.alias("place"), F.col("id").cast("string").alias("id"))
    first = Window.partitionBy("language").orderBy("place", "id", "text")
    bounded = drawn.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= rule.sample_per_language).collect()
    sample = sorted(bounded, key=lambda r: (r.place, str(r.id), r.text))
    at = {x: k for k, x in enumerate(languages)}
    split = [_tokens(r.text) for r in sample]
    counts = [Counter() for _ in languages]
    for r, tokens in zip(sample, split):
        counts[at[r.language]].update(w.lower() for t in tokens if (w := _BARE[t]))
    model = _fit(counts, languages, rule)
    for _ in range(rule.rounds - 1):
        counts = [Counter() for _ in languages]
        _, _, path = Reader(model).paths(split)
        for t, k in zip((t for tokens in split for t in tokens), path.tolist()):
            if w := _BARE[t]:
                counts[k][w.lower()] += 1
        model = _fit(counts, languages, rule)
    return model


def label_languages(rows: DataFrame, model: LanguageModel, *, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """(id, seg_no, segments, lang, confidence, ambiguous, first_word, end_word): the stretches of each text, numbered from 0 of segments.

    Every row with a text has at least one stretch; a text without words but
    names, codes, numbers or symbols, the empty text among them, is one stretch
    of `und`.  Null texts have none.  Long texts are read whole; repeated rows
    repeat their stretches; other columns are left out, so none can clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                d = part.column(1).dictionary_encode()
                by_text = reader.stretches(d.dictionary.to_pylist())
                owner, columns = [], []
                for i, k in enumerate(d.indices.to_pylist()):
                    for n, s in enumerate(by_text[k]):
                        owner.append(i)
                        columns.append((n, len(by_text[k]), *s))
                seg, of, lang, confidence, ambiguous, first, end = zip(*columns) if columns else [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int32())), pa.array(seg, pa.int32()), pa.array(of, pa.int32()), pa.array(lang, pa.string()), pa.array(confidence, pa.float64()), pa.array(ambiguous, pa.bool_()), pa.array(first, pa.int32()), pa.array(end, pa.int32())],
                    ["id", "seg_no", "segments", "lang", "confidence", "ambiguous", "first_word", "end_word"],
                )

    kind = rows.schema[id_col].dataType.simpleString()
    needed = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    schema = f"id {kind}, seg_no int, segments int, lang string, confidence double, ambiguous boolean, first_word int, end_word int"
    return needed.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def relabelled(rows: DataFrame, lang_codes: DataFrame, *, id_col: str = "source_id", text_col: str = "text", label_col: str = "lang", rule: LanguageRule | None = None) -> DataFrame:
    """(id, seg_no, lang): the stretches of rows whose label is missing, means another language, or whose text has several."""
    model = train_languages(rows, lang_codes, id_col=id_col, text_col=text_col, label_col=label_col, rule=rule)
    meaning = lang_codes.select(F.col("code").alias(label_col), F.col("lang").alias("meant")).distinct()
    kept = rows.join(broadcast_below(meaning, 100_000), label_col, "left").select(F.struct(F.col(id_col).alias("id"), F.col("meant")).alias("key"), F.col(text_col).alias("text"))
    found = label_languages(kept, model, id_col="key", text_col="text")
    wrong = F.col("key.meant").isNull() | (F.col("key.meant") != F.col("lang")) | (F.col("segments") > 1)
    return found.where(wrong).select(F.col("key.id").alias(id_col), "seg_no", "lang").distinct()
