"""Cutting oversized texts at natural boundaries, with an overlap between consecutive pieces.

A text is read as a tree: sections nested by the depth of their headings,
paragraphs, list items nested by indent, lines, sentences, words, characters.
A node that fits the limit is a leaf and never cut; only an oversized node is
opened.  Each opened node packs the pieces of its children, siblings merging
while they fit together, and hands the result up to its parent.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.durable import cut

_BULLET = r"(?:[-*+•] |\d{1,3}[.)] |<li[ >])"
# Where a node of each level ends; a separator stays with the node before it.
LEVELS = [
    *[("section", re.compile(rf"\n(?=#{{1,{depth}}} |<h[1-{depth}][ >])")) for depth in range(1, 7)],
    ("paragraph", re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:(?:\r\n?|\n)\s*)+|\n(?=<(?:p|div|ul|ol|table|blockquote|pre)[ >])")),
    *[("item", re.compile(rf"\n(?={indent}{_BULLET})")) for indent in ("", "(?: {2,3}|\t)?", "[ \t]*")],
    ("line", re.compile(r"(?:\r\n?|\n)")),
    ("sentence", re.compile(r"[.!?…।。！？]+[\"'”’)\]]*\s+")),
    ("word", re.compile(r"\s+")),
]
_BELOW_SECTIONS = 6
_BELOW_LINES = len(LEVELS) - 2
CHARACTER = "character"


@dataclass(frozen=True)
class SplitRule:
    limit: int = 512
    overlap: int = 64

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.limit:
            raise ValueError("the overlap must be shorter than the limit")


def _children(text: str, start: int, end: int, level: int) -> list[tuple[int, int]]:
    bounds = [start, *(m.end() for m in LEVELS[level][1].finditer(text, start, end) if start < m.end() < end), end]
    return list(zip(bounds, bounds[1:]))


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without white space around it: what a piece must hold of it."""
    while end > start and text[end - 1].isspace():
        end -= 1
    while start < end and text[start].isspace():
        start += 1
    return start, end


def _by_characters(text: str, start: int, end: int, rule: SplitRule) -> Iterator[tuple[int, int]]:
    """Cuts of a run without white space; a mark stays with the character that it is put on."""
    room = rule.limit - rule.overlap
    while end - start > room:
        at = start + room
        while at > start + 1 and (unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f"):
            at -= 1
        if at == start + 1:
            at = start + room
        yield start, at
        start = at
    yield start, end


def _packed(text: str, start: int, end: int, level: int, outer: str, rule: SplitRule, begin: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary at its end) of the node's pieces, which cover it; outer is the boundary at the node's own end.

    Children are packed first; then neighbours merge as far as they fit together
    and leave room for the overlap, which the piece at the text's begin doesn't need.
    """
    a, z = _core(text, start, end)
    if z - a <= rule.limit:
        return [(start, end, outer)]
    if level == len(LEVELS):
        cuts = list(_by_characters(text, a, z, rule))
        cuts = [(start, cuts[0][1]), *cuts[1:]]
        return [*((p, q, CHARACTER) for p, q in cuts[:-1]), (cuts[-1][0], end, outer)]
    children = _children(text, start, end, level)
    if len(children) == 1:
        return _packed(text, start, end, level + 1, outer, rule, begin)
    out: list[tuple[int, int, str]] = []
    for k, (p, q) in enumerate(children, 1):
        for piece in _packed(text, p, q, level + 1, outer if k == len(children) else LEVELS[level][0], rule, begin):
            if out and out[-1][2] != CHARACTER:
                low, high = _core(text, out[-1][0], piece[1])
                if high - low <= rule.limit - (rule.overlap if low > begin else 0):
                    out[-1] = (out[-1][0], *piece[1:])
                    continue
            out.append(piece)
    return out


def _first_level(text: str) -> int:
    """The highest level at which a text can be cut at all: most have neither headings nor lines."""
    if "\n#" in text or "\n<h" in text:
        return 0
    return _BELOW_SECTIONS if "\n" in text or "\r" in text else _BELOW_LINES


def spans_of(text: str, rule: SplitRule) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces: each within the limit, each but the first repeating up to `overlap` characters.

    The boundary is where the piece's end was cut; the last one's is `end`.
    All characters but white space at cuts are in some piece.  A text within
    the limit is one piece, as it is.  No node that fits the limit is cut: the
    overlap takes only the room that the piece's own nodes leave.
    """
    if len(text) <= rule.limit:
        return [(0, len(text), "end")]
    pieces: list[tuple[int, int, str]] = []
    after_characters = False
    for start, end, boundary in _packed(text, 0, len(text), _first_level(text), "end", rule, _core(text, 0, len(text))[0]):
        a, z = _core(text, start, end)
        if a == z:
            continue
        if pieces:
            low = max(pieces[-1][0] + 1, a - rule.overlap, z - rule.limit)
            word = re.compile(r"(?<=\s)\S").search(text, low, a)
            a = word.start() if word else min(low, a) if after_characters else a
        pieces.append((a, z, boundary))
        after_characters = boundary == CHARACTER
    if pieces:
        pieces[-1] = (*pieces[-1][:2], "end")
    return pieces or [(0, 0, "end")]


def split_items(rows: DataFrame, *, id_col: str, text_col: str = "text", rule: SplitRule | None = None, only_oversized: bool = False) -> DataFrame:
    """(id, size, piece_no, piece_text, start_pos, end_pos, boundary): the pieces of each text, numbered from 0.

    size is the whole text's number of code points, positions are code points in
    it.  boundary says where the piece's end was cut; `character` only where more
    than limit code points come without white space.  Null texts have no piece,
    the empty text has one empty piece; texts of any length are cut whole;
    repeated rows repeat their pieces; other columns are left out, so none can
    clash.  With only_oversized, texts within the limit are left out.
    """
    rule = rule or SplitRule()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for n, (a, z, boundary) in enumerate(spans_of(text, rule)):
                    owner.append(i)
                    out.append((len(text), n, text[a:z], a, z, boundary))
            columns = zip(*out) if out else [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int32())), *arrays], ["id", "size", "piece_no", "piece_text", "start_pos", "end_pos", "boundary"])

    kind = rows.schema[id_col].dataType.simpleString()
    needed = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    if only_oversized:
        needed = needed.where(F.length("text") > rule.limit)
    schema = f"id {kind}, size int, piece_no int, piece_text string, start_pos int, end_pos int, boundary string"
    return needed.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def split_chunks(chunks: DataFrame, spans: DataFrame, *, rule: SplitRule | None = None) -> DataFrame:
    """(chunk_id, piece_no, piece_text, start_pos, end_pos, source_ids): pieces of chunks with the comments that each touches.

    spans (doc_id, source_id, start_pos, end_pos) says where each comment stands
    in its pseudo-document; a piece touches a comment if they share a character.
    source_ids are in order of position, without repeats; a piece that touches
    none, or of a document without spans, has an empty list.  A chunk that occurs
    several times with the same text and place counts once.
    """
    once = chunks.where("text is not null").select(F.struct("chunk_id", "doc_id", F.col("start_pos").alias("chunk_start")).alias("key"), "text").distinct()
    pieces = cut(split_items(once, id_col="key", rule=rule).select("key.*", "piece_no", "piece_text", "start_pos", "end_pos").withColumn("piece_key", F.monotonically_increasing_id()))
    placed = pieces.select("piece_key", "doc_id", (F.col("chunk_start") + F.col("start_pos")).alias("a"), (F.col("chunk_start") + F.col("end_pos")).alias("z"))
    known = spans.select(F.col("doc_id").alias("span_doc"), "source_id", F.col("start_pos").alias("from_pos"), F.col("end_pos").alias("to_pos")).distinct()
    touches = placed.join(known, (F.col("doc_id") == F.col("span_doc")) & (F.col("from_pos") < F.col("z")) & (F.col("to_pos") > F.col("a")))
    ids = touches.groupBy("piece_key").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("from_pos", "source_id"))), lambda s: s.source_id)).alias("source_ids"))
    none = F.array().cast("array<string>")
    return pieces.join(ids, "piece_key", "left").select("chunk_id", "piece_no", "piece_text", "start_pos", "end_pos", F.coalesce("source_ids", none).alias("source_ids"))
