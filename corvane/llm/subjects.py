"""Subjects of documents, from sentences scored by averaged word and subword embeddings.

A sentence is the average of its words' embeddings, frequent words counting
less, a word the average of its own and its character n-grams'; every subject has a logistic output of its own,
so a sentence may treat none, one or several.  Training is synchronous: each
partition sends the gradient of its sentences, the sum moves the parameters.
Labelled sentences come first; then sentences of all documents join in, once
the model is sure of them and knows enough of their words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.canonical import canonical
from corvane.operators.durable import cut


@dataclass(frozen=True)
class SubjectRule:
    """labelled_share is what the examples keep of the training, block_words how many words a task's arrays hold at a time.

    most_words bounds the vocabulary, and so what driver and tasks hold: rarer
    words than the most frequent that many are known by their n-grams alone.
    """

    least_share: float = 0.25
    labelled_share: float = 0.06
    block_words: int = 400_000
    dimensions: int = 16
    buckets: int = 8192
    rounds: int = 10
    steps: int = 12
    most_words: int = 200_000
    rate: float = 0.05
    smoothing: float = 0.02
    sure: float = 0.6
    known_words: float = 0.5
    common: float = 0.0005
    unknown_weight: float = 0.25
    least_margin: float = -2.0
    most_subjects: int = 10_000
    most_examples: int = 1_000_000
    seed: int = 11


_LETTERS = re.compile(r"[^\W\d_](?:[\w'’-]*[^\W\d_])?")
_END = (".", "!", "?", "…", "。", "।")
_CLOSING = "\"'”’)]»"


class _Words(dict):
    """Token to (its word in lower case or '', whether a sentence ends after it); emptied when it holds half a million."""

    def __missing__(self, token: str) -> tuple[str, bool]:
        if len(self) > 500_000:
            self.clear()
        found = _LETTERS.search(canonical(token))
        word = found.group().lower() if found and not any(c.isdigit() for c in token) else ""
        bare = token.rstrip(_CLOSING)
        self[token] = word, bare.endswith(_END) and not (len(bare) == 2 and bare[0].isupper())
        return self[token]


_WORDS = _Words()


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence; a line ends a sentence too, and stretches without words are none."""
    out, now = [], []
    for line in text.splitlines():
        for token in line.split():
            word, end = _WORDS[token]
            if word:
                now.append(word)
            if end and now:
                out.append(now)
                now = []
        if now:
            out.append(now)
            now = []
    return out


def _grams(word: str, buckets: int) -> list[int]:
    padded = f"<{word}>"
    return [xxhash.xxh32_intdigest(padded[i : i + n].encode("utf-8", "surrogatepass")) % buckets for n in (3, 4, 5) for i in range(len(padded) - n + 1)]


@dataclass
class SubjectModel:
    subjects: list[str]
    vocabulary: dict[str, int]
    embeddings: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    rule: SubjectRule
    seen: set[str] = field(default_factory=set)
    importance: dict[str, float] = field(default_factory=dict)
    features: dict[str, tuple[list[int], list[float]]] = field(default_factory=dict, repr=False)

    def word_features(self, word: str) -> tuple[list[int], list[float]]:
        """Rows of the embeddings and their weights, adding up to 1; none for a word without known part."""
        found = self.features.get(word)
        if found is None:
            base = len(self.vocabulary)
            grams = [base + g for g in _grams(word, self.rule.buckets)]
            own = self.vocabulary.get(word)
            if own is None:
                found = grams, [1 / len(grams)] * len(grams) if grams else []
            else:
                found = [own, *grams], [0.5 if grams else 1.0, *[0.5 / len(grams)] * len(grams)]
            self.features[word] = found
        return found

    def weight(self, word: str) -> float:
        """How much a word counts in the average: frequent words less, words in no sentence of the training little."""
        base = self.importance.get(word, self.rule.unknown_weight)
        return base if not self.seen or word in self.seen else base * self.rule.unknown_weight

    def word_scores(self, word: str) -> np.ndarray:
        rows, weights = self.word_features(word)
        return (np.array(weights, np.float32) @ self.embeddings[rows]) @ self.outputs if rows else np.zeros(self.outputs.shape[1], np.float32)


_SLICE = 16_384  # parameters that are averaged together


def _packed(values: list | np.ndarray, kind: type) -> bytes:
    return np.asarray(values, kind).tobytes()


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


class _Block:
    """Sentences of some documents as arrays: the bags of words that occur in them, each once, and which one every sentence is.

    A bag's words are numbers in `local` (rows of the vocabulary), then in the
    block's own words, which no other sentence of the corpus has; `part` is a
    word's share in the bag's average.  `targets` counts a bag's sentences by output.
    """

    COLUMNS = {"local": np.int32, "grams": np.int32, "gram_lengths": np.int32, "words": np.int32, "lengths": np.int32, "part": np.float32, "bags": np.int32, "sentences": np.int32, "targets": np.float32}
    SCHEMA = ", ".join(f"{c} binary" for c in COLUMNS) + ", given boolean, weight double"

    def __init__(self, row: dict) -> None:
        for name, kind in self.COLUMNS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.given = row["given"]
        self.starts = _bounds(self.lengths)

    def vectors(self, embeddings: np.ndarray, own: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """Dimensions by words; own are the vectors of the vocabulary, or of the words at `place`, embeddings those of the n-grams."""
        place = self.local if place is None else place
        if not len(self.gram_lengths):
            return np.ascontiguousarray(own[place].T)
        rest = np.add.reduceat(embeddings[self.grams], _bounds(self.gram_lengths), axis=0) / self.gram_lengths[:, None]
        return np.ascontiguousarray(np.concatenate([own[place], rest]).T)

    def means(self, vectors: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(v[self.words] * part, self.starts) for v in vectors], 1)


def _block(documents: list[list[list[str]]], vocabulary: dict[str, int], importance: np.ndarray, rule: SubjectRule, targets: np.ndarray | None = None) -> dict:
    """The row of a _Block; targets are those of the sentences, which then aren't merged."""
    local: dict[int, int] = {}
    rest: dict[str, int] = {}
    bags: dict[tuple, int] = {}
    which = []
    for d in documents:
        for s in d:
            key = tuple(sorted(s)) if targets is None else (len(which),)
            k = bags.get(key)
            if k is None:
                bags[key] = k = len(bags)
                which.append((k, s))
            else:
                which.append((k, None))
    words, counts, lengths = [], [], []
    for s in (s for _, s in which if s is not None):
        found: dict[int, int] = {}
        for w in s:
            v = vocabulary.get(w)
            n = local.setdefault(v, len(local)) if v is not None else -1 - rest.setdefault(w, len(rest))
            found[n] = found.get(n, 0) + 1
        words += found.keys()
        counts += found.values()
        lengths.append(len(found))
    ids, sizes, starts = np.array(words, np.int32), np.array(lengths, np.int32), _bounds(np.array(lengths))
    ids = np.where(ids < 0, len(local) - 1 - ids, ids)
    known = np.fromiter(local, np.int32, len(local))
    weights = np.concatenate([importance[known], np.full(len(rest), rule.unknown_weight)])[ids] * np.array(counts)
    part = weights / np.repeat(np.add.reduceat(weights, starts), sizes)
    grams = [_grams(w, rule.buckets) for w in rest]
    return {
        "local": _packed(known, np.int32),
        "grams": _packed([g for x in grams for g in x], np.int32),
        "gram_lengths": _packed([len(x) for x in grams], np.int32),
        "words": _packed(ids, np.int32),
        "lengths": _packed(sizes, np.int32),
        "part": _packed(part, np.float32),
        "bags": _packed([k for k, _ in which], np.int32),
        "sentences": _packed([len(d) for d in documents], np.int32),
        "targets": _packed([] if targets is None else targets, np.float32),
        "given": targets is not None,
        "weight": 0.0,
    }


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([*[(c, pa.binary()) for c in _Block.COLUMNS], ("given", pa.bool_()), ("weight", pa.float64())]))


def _blocks_of(documents: Iterator[list[list[str]]], size: int) -> Iterator[list[list[list[str]]]]:
    """Whole documents, until a block has `size` words."""
    part, held = [], 0
    for d in documents:
        if d:
            part.append(d)
            held += sum(map(len, d))
            if held >= size:
                yield part
                part, held = [], 0
    if part:
        yield part


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[str]]]:
    return (sentences_of(t) for b in batches for start in range(0, b.num_rows, 500) for t in b.column(0).slice(start, 500).to_pylist())


def _counted(texts: DataFrame) -> DataFrame:
    """(word, sentences, occurrences) over all sentences of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences, occurrences = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(occurrences), pa.string()), pa.array([sentences[w] for w in occurrences], pa.int64()), pa.array(list(occurrences.values()), pa.int64())], ["word", "sentences", "occurrences"])
            sentences.clear()
            occurrences.clear()
            return out

        for d in _texts_of(batches):
            for s in d:
                occurrences.update(s)
                sentences.update(set(s))
            if len(occurrences) > 300_000:
                yield flush()
        yield flush()

    parts = texts.mapInArrow(run, "word string, sentences bigint, occurrences bigint")
    return parts.groupBy("word").agg(F.sum("sentences").alias("sentences"), F.sum("occurrences").alias("occurrences"))


@dataclass
class _Vocabulary:
    """Of every word of the vocabulary, the n-grams; the rows of word w from bounds[w] on."""

    grams: np.ndarray
    lengths: np.ndarray

    def of(self, words: np.ndarray) -> _Vocabulary:
        """The same of some words."""
        starts, lengths = _bounds(self.lengths)[words] if len(self.lengths) else words, self.lengths[words]
        return _Vocabulary(self.grams[np.repeat(starts - _bounds(lengths), lengths) + np.arange(lengths.sum())], lengths)

    def vectors(self, embeddings: np.ndarray) -> np.ndarray:
        """The vectors of the words: half their own embedding, half the mean of their n-grams'."""
        own = embeddings[: len(self.lengths)]
        if not len(own):
            return own
        starts = _bounds(self.lengths)
        return np.stack([0.5 * own[:, d] + 0.5 * np.add.reduceat(embeddings[len(own) :, d][self.grams], starts) / self.lengths for d in range(own.shape[1])], 1)

    def back(self, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The gradient to the embeddings from that to the words and, from words outside the vocabulary, to the n-grams."""
        to_grams = [np.bincount(self.grams, np.repeat(0.5 * words[:, d] / np.maximum(self.lengths, 1), self.lengths), len(grams)) for d in range(words.shape[1])]
        return np.concatenate([0.5 * words, grams + np.stack(to_grams, 1)]).astype(np.float32)


def _gradient(block: _Block, place: np.ndarray, balance: np.ndarray, times: float, smoothing: float, own: np.ndarray, grams: np.ndarray, outputs: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the block's weighted logistic losses: the gradient to its local words, to the n-grams, the outputs and the bias; the sum of weights."""
    targets = block.targets.reshape(len(block.lengths), -1)
    if block.given:
        weights = targets @ balance * times
        wanted = targets * weights[:, None]
    else:
        wanted = targets * balance
        weights = wanted.sum(1)
    means = block.means(block.vectors(grams, own, place), block.part)
    scores = 1 / (1 + np.exp(-np.clip(means @ outputs + bias, -30, 30)))
    error = (scores - smoothing) * weights[:, None] - (1 - 2 * smoothing) * wanted
    down = np.ascontiguousarray((error @ outputs.T).T)
    owner = np.repeat(np.arange(len(block.lengths)), block.lengths)
    back = np.stack([np.bincount(block.words, d[owner] * block.part, len(block.local) + len(block.gram_lengths)) for d in down], 1)
    spread = np.repeat(back[len(block.local) :] / block.gram_lengths[:, None], block.gram_lengths, axis=0)
    to_grams = np.stack([np.bincount(block.grams, spread[:, k], len(grams)) for k in range(len(down))], 1)
    return back[: len(block.local)], to_grams, means.T @ error, error.sum(0), float(weights.sum())


class _Adam:
    """Steps of Adam over several parameters."""

    def __init__(self, parameters: tuple[np.ndarray, ...], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.state = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]

    def move(self, gradients: tuple[np.ndarray, ...]) -> None:
        self.step += 1
        for g, p, (first, second) in zip(gradients, self.parameters, self.state):
            first += 0.1 * (g - first)
            second += 0.02 * (g * g - second)
            p -= self.rate * (first / (1 - 0.9**self.step)) / (np.sqrt(second / (1 - 0.98**self.step)) + 1e-8)


def _train(model: SubjectModel, words: _Vocabulary, given: list[dict], joined: DataFrame | None, balance: np.ndarray, times: float) -> None:
    """Steps of Adam on the examples and the sentences of each partition, synchronised at the end.

    A task moves a copy of the parameters by the gradients of its own sentences,
    weighted as if they were all, and of the examples, which every task holds;
    the moves, weighted by the tasks' sentences, are averaged in Spark, each
    parameter's over the tasks that had a gradient for it, so that only one set
    of parameters reaches the driver however many tasks there are.
    Without other sentences the driver's own process takes the steps.
    """
    rule, known = model.rule, len(words.lengths)
    shapes = [model.embeddings.shape, model.outputs.shape, model.bias.shape]

    def moved(start: tuple[np.ndarray, ...], examples: list[_Block], own: list[_Block], share: float) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(rows of the embeddings that can move, the parameters after the steps, of the embeddings only these rows): words that don't occur cost nothing."""
        blocks = [*((b, share) for b in examples), *((b, 1.0) for b in own)]
        used = np.unique(np.concatenate([b.local for b, _ in blocks])) if blocks else np.zeros(0, np.int32)
        some = words.of(used)
        rows = np.concatenate([used, np.arange(known, len(start[0]))])
        parameters = (start[0][rows], start[1].copy(), start[2].copy())
        adam, places = _Adam(parameters, rule.rate), [np.searchsorted(used, b.local) for b, _ in blocks]
        for _ in range(rule.steps):
            embeddings, outputs, bias = parameters
            vectors, rest = some.vectors(embeddings).astype(np.float32), embeddings[len(used) :]
            to_words, to_rest = np.zeros(vectors.shape), None
            for (block, weight), place in zip(blocks, places):
                g = _gradient(block, place, balance, times, rule.smoothing, vectors, rest, outputs, bias)
                to_words[place] += weight * g[0]
                scaled = [weight * x for x in g[1:]]
                to_rest = scaled if to_rest is None else [x + y for x, y in zip(to_rest, scaled)]
            grams, to_outputs, to_bias, total = to_rest
            adam.move(tuple(x / total for x in (some.back(to_words, grams), to_outputs, to_bias)))
        return rows, parameters

    start = (model.embeddings, model.outputs, model.bias)
    whole = joined.agg(F.sum("weight")).first()[0] if joined is not None else None
    if not whole:
        rows, (moving, model.outputs, model.bias) = moved(start, [_Block(r) for r in given], [], 1.0)
        model.embeddings[rows] = moving
        return
    sent = joined.sparkSession.sparkContext.broadcast((start, given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in b.to_pylist()]
        if rows:
            first, examples = sent.value
            own = sum(r["weight"] for r in rows)
            moving, after = moved(first, [_Block(r) for r in examples], [_Block(r) for r in rows], own / whole)
            embeddings = np.zeros(first[0].shape)
            embeddings[moving] = after[0] - first[0][moving]
            change = np.concatenate([embeddings.ravel(), *((x - y).ravel() for x, y in zip(after[1:], first[1:]))]).astype(np.float64) * own
            change = np.concatenate([change, np.zeros(-len(change) % _SLICE)])
            bounds, numbers = np.arange(0, len(change) + 1, _SLICE, dtype=np.int32), np.arange(len(change) // _SLICE, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.float32))) for x in (change, np.where(change != 0, own, 0.0))]
            yield pa.RecordBatch.from_arrays([pa.array(numbers), *lists], ["at", "change", "weight"])

    def averaged(key: tuple, rows: pa.Table) -> pa.Table:
        change, weight = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(-1, _SLICE).sum(0, dtype=float) for c in ("change", "weight"))
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "change": pa.array([change / np.maximum(weight, 1e-9)], pa.list_(pa.float64()))})

    parts = joined.mapInArrow(run, "at int, change array<float>, weight array<float>").groupBy("at").applyInArrow(averaged, "at int, change array<double>").toArrow()
    sent.destroy()
    parts = parts.sort_by("at")
    flat, at, found = parts.column("change").combine_chunks().flatten().to_numpy(), 0, []
    for shape in shapes:
        size = int(np.prod(shape))
        found.append(flat[at : at + size].reshape(shape).astype(np.float32))
        at += size
    model.embeddings, model.outputs, model.bias = (p + c for p, c in zip(start, found))


def _with_context(scores: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Scores as shares over the outputs, weighed by what the document's other sentences are taken for: a document keeps to few subjects."""
    whole = np.stack([np.bincount(home, scores[:, k]) for k in range(scores.shape[1])], 1)
    size = np.bincount(home)[home][:, None]
    others = (whole[home] - scores) / np.maximum(size - 1, 1)
    others[:, -1] += 0.25  # sentences of no subject come in every document
    weighed = scores * (others + 0.02)
    return weighed / np.maximum(weighed.sum(1, keepdims=True), 1e-9)


def _told(blocks: DataFrame, model: SubjectModel, words: _Vocabulary, seen: np.ndarray, least_known: float) -> DataFrame:
    """Of each block the bags of sentences that join the training, with how many of them by output."""
    rule = model.rule
    sent = blocks.sparkSession.sparkContext.broadcast((words.vectors(model.embeddings).astype(np.float32), model.embeddings[len(seen) :], model.outputs, model.bias, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grams, outputs, bias, seen = sent.value
        for b in batches:
            for row in b.to_pylist():
                block = _Block(row)
                inside = np.concatenate([seen[block.local], np.zeros(len(block.gram_lengths), bool)])
                vocabulary = np.arange(len(inside)) < len(block.local)
                part = block.part * np.where(inside | ~seen.any(), 1, rule.unknown_weight)[block.words].astype(np.float32)
                means = block.means(block.vectors(grams, own), part) / np.add.reduceat(part, block.starts)[:, None]
                scores = (1 / (1 + np.exp(-np.clip(means @ outputs + bias, -30, 30))))[block.bags]
                shares = _with_context(scores, np.repeat(np.arange(len(block.sentences)), block.sentences))
                told, sure = (np.add.reduceat(block.part * flag[block.words], block.starts) for flag in (vocabulary, inside))
                certain = ((shares > rule.sure).sum(1) == 1) & ((told > 0) & (sure >= least_known * told))[block.bags]
                n, k = len(block.lengths), outputs.shape[1]
                targets = np.bincount(block.bags[certain] * k + shares[certain].argmax(1), minlength=n * k).reshape(n, k)
                kept = targets.sum(1) > 0
                if kept.any():
                    inner = np.repeat(kept, block.lengths)
                    row |= {"words": _packed(block.words[inner], np.int32), "lengths": _packed(block.lengths[kept], np.int32), "part": _packed(block.part[inner], np.float32), "targets": _packed(targets[kept], np.float32), "bags": b"", "sentences": b"", "weight": float(targets.sum())}
                    yield _rows([row])

    return blocks.mapInArrow(run, _Block.SCHEMA)


def _summary(data: DataFrame, known: int, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """How many sentences each output has in data, and which words of the vocabulary occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets, seen = np.zeros(outputs), np.zeros(known, bool)
        for b in batches:
            for row in b.to_pylist():
                block = _Block(row)
                targets += block.targets.reshape(-1, outputs).sum(0, dtype=float)
                seen[block.local[np.unique(block.words[block.words < len(block.local)])]] = True
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (targets.tobytes(), np.packbits(seen).tobytes())], ["t", "s"])

    parts = data.mapInArrow(run, "t binary, s binary").collect()
    targets = sum((np.frombuffer(p.t, float) for p in parts), np.zeros(outputs))
    seen = np.zeros(known, bool)
    for p in parts:
        seen |= np.unpackbits(np.frombuffer(p.s, np.uint8), count=known).astype(bool)
    return targets, seen


def _spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, where a small table has fewer."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def train_subjects(documents: DataFrame, subjects: DataFrame, examples: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: SubjectRule | None = None) -> SubjectModel:
    """Fits the classifier on all examples and on the sentences of all documents.

    Besides the subjects there is an output for treating none of them, so that
    a sentence of unknown words is not taken for one of no subject.  Words are
    counted over all texts; the vocabulary has those of at least two sentences,
    and the driver and each task hold it.  Sentences join the training where one
    output is sure, in the light of their document's other sentences, and half of
    their weight is in known words, less in later rounds.  However many join, the
    examples keep labelled_share of the training.  id_col isn't used: rows count,
    whatever their id.
    """
    rule = rule or SubjectRule()
    spark = documents.sparkSession
    names = sorted(r.subject for r in subjects.select("subject").where("subject is not null").distinct().limit(rule.most_subjects + 1).collect())
    if len(names) > rule.most_subjects:
        raise ValueError(f"more than {rule.most_subjects} subjects")
    given = examples.select("subject", "text").where("text is not null").limit(rule.most_examples + 1).collect()
    if len(given) > rule.most_examples:
        raise ValueError(f"more than {rule.most_examples} labelled examples")
    by_text: dict[str, set[str]] = {}
    for r in given:
        by_text.setdefault(r.text, set()).update([r.subject] if r.subject in names else [])
    labelled = [(s, [*(float(n in found) for n in names), float(not found)]) for text, found in by_text.items() if (s := [w for part in sentences_of(text) for w in part])]
    texts = _spread(documents.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")))

    sentences = spark.createDataFrame(pa.table({"text": pa.array([" ".join(s) for s, _ in labelled], pa.string())}), "text string")
    counts = cut(_counted(texts.union(sentences)))
    total = counts.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
    told = counts.where("sentences > 1").orderBy(F.desc("occurrences"), "word").limit(rule.most_words).orderBy("word").select("word", "occurrences").toArrow()
    vocabulary = {w: k for k, w in enumerate(told.column(0).to_pylist())}
    importance = rule.common / (rule.common + told.column(1).to_numpy() / max(total, 1))
    rng = np.random.default_rng(rule.seed)
    model = SubjectModel(
        names,
        vocabulary,
        rng.normal(0, 0.1, (len(vocabulary) + rule.buckets, rule.dimensions)).astype(np.float32),
        rng.normal(0, 0.1, (rule.dimensions, len(names) + 1)).astype(np.float32),
        np.full(len(names) + 1, -1.0, np.float32),
        rule,
    )
    if not labelled:
        model.outputs[:], model.bias[:] = 0, -30
        return model
    model.importance = dict(zip(vocabulary, importance.tolist()))
    lists = pa.array((_grams(w, rule.buckets) for w in vocabulary), pa.list_(pa.int32()))
    words = _Vocabulary(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))
    shared = spark.sparkContext.broadcast((vocabulary, importance))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks_of(_texts_of(batches), rule.block_words):
            yield _rows([_block(part, *shared.value, rule)])

    blocks = cut(texts.mapInArrow(number, _Block.SCHEMA))
    shares = np.array([y for _, y in labelled], np.float32)
    own = [_block([[s] for s, _ in labelled[k : k + 20_000]], vocabulary, importance, rule, shares[k : k + 20_000]) for k in range(0, len(labelled), 20_000)]
    base_targets, base_seen = shares.sum(0, dtype=float), np.zeros(len(vocabulary), bool)
    for row in own:
        block = _Block(row)
        base_seen[block.local] = True
    joined, targets, seen, times = None, np.zeros(len(names) + 1), base_seen, 1.0
    for turn in range(rule.rounds):
        balance = 1 / np.maximum(times * base_targets + targets, 1)
        _train(model, words, own, joined, balance, times)
        if turn < rule.rounds - 1:
            joined = cut(_told(blocks, model, words, seen, rule.known_words * min(1.0, 3 / (turn + 1))))
            targets, found = _summary(joined, len(vocabulary), len(names) + 1)
            seen = base_seen | found
            times = max(4.0, rule.labelled_share / (1 - rule.labelled_share) * targets.sum() / len(labelled))
    model.seen = {w for w, k in vocabulary.items() if seen[k]}
    shared.unpersist()
    return model


def document_subjects(documents: DataFrame, model: SubjectModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, subject, share, sentences): the subjects that at least least_share of a document's sentences treat.

    A null, empty or wordless text has no subject; a text of any length is
    scored whole; repeated rows repeat their subjects; other columns are left
    out, so none can clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        table: list[np.ndarray] = []
        own: list[bool] = []
        weights: list[float] = []

        def number(word: str) -> int:
            k = memo.get(word)
            if k is None:
                memo[word] = k = len(table)
                weights.append(model.weight(word))
                table.append(model.word_scores(word) * weights[-1])
                own.append(word in model.seen)
            return k

        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                split = [sentences_of(t) for t in part.column(1).to_pylist()]
                lengths = np.array([len(s) for d in split for s in d], np.int64)
                if not len(lengths):
                    continue
                if len(table) > 900_000:
                    memo.clear()
                    table.clear()
                    own.clear()
                    weights.clear()
                ids = np.fromiter((number(w) for d in split for s in d for w in s), np.int64, int(lengths.sum()))
                scores, known = np.stack(table)[ids], np.array(own)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                margin = np.add.reduceat(scores, starts) / np.add.reduceat(np.array(weights)[ids], starts)[:, None] + model.bias
                best = margin.argmax(1)
                undecided = (margin <= 0).all(1) & (margin.max(1) > model.rule.least_margin)
                margin[undecided, best[undecided]] = 1  # the likeliest output stands in where none is over a half
                treated = (margin[:, :-1] > 0) & (np.add.reduceat(known[ids], starts) > 0)[:, None]
                per_doc = np.array([len(d) for d in split])
                owner = np.repeat(np.arange(len(split)), per_doc)
                share = np.stack([np.bincount(owner, treated[:, k], len(split)) for k in range(len(model.subjects))], 1) / np.maximum(per_doc, 1)[:, None]
                docs, found = np.nonzero(share >= model.rule.least_share - 1e-9)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(docs)), pa.array([model.subjects[k] for k in found], pa.string()), pa.array(share[docs, found]), pa.array(per_doc[docs], pa.int32())],
                    ["id", "subject", "share", "sentences"],
                )

    kind = documents.schema[id_col].dataType.simpleString()
    needed = _spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null"))
    return needed.mapInArrow(run, f"id {kind}, subject string, share double, sentences int").withColumnRenamed("id", id_col)
