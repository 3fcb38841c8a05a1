"""Encoding by a public byte-level BPE tokenizer, exactly, through a lexicon of whole words.

Words of the vocabulary, and words frequent in the corpus with the ids that the
tokenizer gives them, are compiled into a minimal acyclic transducer: words with
equal endings share states, and a walk that adds up the counts on its way gives
the word's number, under which its ids lie.  The arrays are written once to the
folder that executors share and mapped into memory by every worker.  Words that
it doesn't hold are merged by rank.
"""

from __future__ import annotations

import base64
import importlib.util
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.durable import shared_folder

# Fixed value: the pattern by which this family of tokenizers cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII alone, in the faster engine.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
DEFAULT_TOKENIZER = "byte_bpe_50k"


def vocabulary_file(name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> Path:
    """The rank file of a public tokenizer; folder defaults to the installed package of vocabularies."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(spec.origin).parent) if spec else "/opt/tokenizers"
    return Path(folder) / f"{name}.tiktoken"


def read_ranks(path: Path) -> dict[bytes, int]:
    ranks = {}
    for line in path.read_bytes().splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the pair of lowest rank is merged, leftmost first, until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _merge_long(word, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over linked parts, so that a word of a million bytes takes no square of that."""
    import heapq

    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] is None or parts[j] is None or len(parts[i]) + len(parts[j]) != size or (parts[i] + parts[j]) not in ranks:
            continue
        if ranks[parts[i] + parts[j]] != _:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, len(parts[k]) + len(parts[after[k]])))
    return [ranks[p] for p in parts if p is not None]


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the smallest acyclic automaton of distinct words in byte order.

    State s has the edges first[s] to first[s + 1]: label, target and the number
    of words before the edge's; final[s] is 1 where a word ends.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    stack: list[list] = [[0, []]]
    previous = b""
    for word in words:
        same = 0
        while same < min(len(word), len(previous)) and word[same] == previous[same]:
            same += 1
        while len(stack) > same + 1:
            child = freeze(stack.pop())
            stack[-1][1].append((previous[len(stack) - 1], child))
        for _ in word[same:]:
            stack.append([0, []])
        stack[-1][0] = 1
        previous = word
    while len(stack) > 1:
        child = freeze(stack.pop())
        stack[-1][1].append((previous[len(stack) - 1], child))
    root = freeze(stack.pop())
    below = np.zeros(len(states), np.int64)
    for s, (final, edges) in enumerate(states):
        below[s] = final + sum(below[t] for _, t in edges)
    first, labels, targets, skips = [0], [], [], []
    for final, edges in states:
        passed = final
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(passed)
            passed += int(below[target])
        first.append(len(labels))
    return {
        "first": np.array(first, np.int32),
        "label": np.array(labels, np.uint8),
        "target": np.array(targets, np.int32),
        "skip": np.array(skips, np.int32),
        "final": np.array([f for f, _ in states], np.uint8),
        "root": np.array([root], np.int32),
    }


@dataclass
class Lexicon:
    """The transducer: automaton arrays, and for word number k the ids[bounds[k] : bounds[k + 1]]."""

    arrays: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        self._first, self._target, self._skip, self._final = (memoryview(self.arrays[k]) for k in ("first", "target", "skip", "final"))
        self._labels, self._root = self.arrays["label"].tobytes(), int(self.arrays["root"][0])

    def __getstate__(self) -> dict:
        return {"arrays": {k: np.array(v) for k, v in self.arrays.items()}}

    def __setstate__(self, state: dict) -> None:
        self.arrays = state["arrays"]
        self.__post_init__()

    def number(self, word: bytes) -> int:
        """The word's place in byte order, or -1."""
        first, target, skip, find = self._first, self._target, self._skip, self._labels.find
        state, number = self._root, 0
        for byte in word:
            k = find(byte, first[state], first[state + 1])
            if k < 0:
                return -1
            number += skip[k]
            state = target[k]
        return number if self._final[state] else -1

    def ids(self, word: bytes) -> list[int] | None:
        k = self.number(word)
        return None if k < 0 else self.arrays["ids"][self.arrays["bounds"][k] : self.arrays["bounds"][k + 1]].tolist()


def compile_lexicon(words: list[bytes], ranks: dict[bytes, int]) -> Lexicon:
    words = sorted(set(words))
    outputs = [merge_word(w, ranks) for w in words]
    arrays = minimal_automaton(words)
    arrays["bounds"] = np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int32)
    arrays["ids"] = np.array([i for o in outputs for i in o], np.int32)
    return Lexicon(arrays)


def frequent_words(texts: DataFrame, column: str, most: int) -> list[bytes]:
    """Of the space-separated words of all texts, the `most` most frequent, with the space before them."""
    words = texts.where(F.col(column).isNotNull()).select(F.explode(F.split(column, " ")).alias("w")).where(F.length("w").between(1, 40))
    counted = words.groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(most).select("w").collect()
    return [w for r in counted for w in (f" {r.w}".encode("utf-8", "surrogatepass"), r.w.encode("utf-8", "surrogatepass"))]


def save_lexicon(spark: SparkSession, lexicon: Lexicon) -> str | Lexicon:
    """Where workers find the arrays: a folder that all executors share, or the arrays themselves where that is no mounted folder."""
    base = shared_folder(spark)
    if "://" in base and not base.startswith("file://"):
        return lexicon
    folder = Path(base.removeprefix("file://")) / f"lexicon-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    for name, array in lexicon.arrays.items():
        np.save(folder / f"{name}.npy", array)
    return str(folder)


def open_lexicon(place: str | Lexicon) -> Lexicon:
    if isinstance(place, Lexicon):
        return place
    return Lexicon({p.stem: np.load(p, mmap_mode="r") for p in Path(place).glob("*.npy")})


def _compiled_merger(ranks: dict[bytes, int]) -> Callable[[str], list[int]] | None:
    """The same merging in compiled code, where a library for it is installed."""
    try:
        import tiktoken
    except ImportError:
        return None
    return tiktoken.Encoding("lexicon", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordIds(dict):
    """Word to ids, through the lexicon or by merging; remembered until it holds a million words."""

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]):
        super().__init__()
        self.lexicon, self.ranks = lexicon, ranks
        self.quick = _compiled_merger(ranks)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 1_000_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        found = self.lexicon.ids(raw) if len(raw) <= 64 else None
        if found is None:
            found = self.quick(word) if self.quick and len(raw) <= 200 else merge_word(raw, self.ranks)
        self[word] = ids = tuple(found)
        return ids


_WORDS = regex.compile(PATTERN, regex.V1).findall
_ASCII_WORDS = re.compile(ASCII_PATTERN, re.ASCII).findall
_WORKER: dict[tuple, WordIds] = {}


def cut_words(text: str) -> list[str]:
    return _ASCII_WORDS(text) if text.isascii() else _WORDS(text)


def _word_ids(place: str | Lexicon, vocabulary: str) -> WordIds:
    """This worker's memo for a lexicon, kept between tasks."""
    key = (place if isinstance(place, str) else id(place), vocabulary)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = WordIds(open_lexicon(place), read_ranks(Path(vocabulary)))
    return _WORKER[key]


def _prepared(texts: DataFrame, text_col: str, tokenizer: str, folder: str | None, lexicon_words: int) -> tuple[str | Lexicon, str]:
    vocabulary = vocabulary_file(tokenizer, folder)
    ranks = read_ranks(vocabulary)
    known = []
    for token in ranks:
        try:
            word = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if cut_words(word) == [word]:
            known.append(token)
    if lexicon_words:
        known += [w for w in frequent_words(texts, text_col, lexicon_words) if len(w) <= 64 and cut_words(w.decode("utf-8", "surrogatepass")) == [w.decode("utf-8", "surrogatepass")]]
    return save_lexicon(texts.sparkSession, compile_lexicon(known, ranks)), str(vocabulary)


def encode_corpus(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None, lexicon_words: int = 20_000) -> DataFrame:
    """(id, ids): one row per input row, the ids of its text without special tokens.

    A null or an empty text has an empty list; text that spells a special token
    is ordinary text; texts of any length are encoded whole.  Repeated rows stay
    repeated; other columns are left out, so none can clash.  lexicon_words
    bounds how many words of the corpus are compiled beside the vocabulary's;
    it changes speed, never ids.
    """
    place, vocabulary = _prepared(texts, text_col, tokenizer, folder, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_ids(place, vocabulary)
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                bounds, lists = [0], []
                for text in part.column(1).to_pylist():
                    ids = list(chain.from_iterable(map(memo.__getitem__, cut_words(text)))) if text else []
                    bounds.append(bounds[-1] + len(ids))
                    lists.append(ids)
                flat = np.fromiter(chain.from_iterable(lists), np.int32, bounds[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))], ["id", "ids"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(texts: DataFrame, *, keep: list[str], text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None, lexicon_words: int = 20_000) -> DataFrame:
    """The columns of keep and `tokens`, the length of what encode_corpus gives; 0 for null and empty texts."""
    place, vocabulary = _prepared(texts, text_col, tokenizer, folder, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_ids(place, vocabulary)
        for b in batches:
            counts = [sum(map(len, map(memo.__getitem__, cut_words(t)))) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(counts, pa.int64())], [*keep, "tokens"])

    schema = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keep) + ", tokens long"
    return texts.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
