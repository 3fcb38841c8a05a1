"""One form for texts that look the same: compatibility forms, spaces, ignorable characters and look-alike letters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.pairs import expand_class_pairs
from corvane.operators.durable import cut

# Code points that are drawn as nothing (the Unicode property Default_Ignorable_Code_Point).
IGNORABLE_RANGES = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Greek and Cyrillic letters, and the Latin letters that they look like.
LOOK_ALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ" + "АВЕЅІЈКМНОРСТУХҮԚԜӀ" + "асеорхуіјѕһԁԛԝѵӏ",
        "ABEZHIKMNOPTYXovcj" + "ABESIJKMHOPCTYXYQWI" + "aceopxyijshdqwvl",
        strict=True,
    )
)
# Hyphens drawn like the ASCII one.
HYPHENS = "‐‑﹣－"
# Kinds of compatibility mapping that leave the look as it is. Raised, lowered, circled and stacked forms look different.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")


def _is_ignorable(code: int) -> bool:
    return any(a <= code <= b for a, b in IGNORABLE_RANGES)


class _Fold(dict):
    """Code point to its form, found on first use; for text in canonical decomposition."""

    def __init__(self, look_alikes: bool):
        super().__init__()
        self.look_alikes = look_alikes

    def __missing__(self, code: int) -> str:
        self[code] = form = self._form(chr(code))
        return form

    def _form(self, ch: str) -> str:
        if _is_ignorable(ord(ch)):
            return ""
        if ch in HYPHENS:
            return "-"
        if ch == "\t" or unicodedata.category(ch) == "Zs":
            return " "
        kind, _, codes = unicodedata.decomposition(ch).partition(" ")
        if kind in SAME_LOOK and "0020" not in codes.split():
            return "".join(self._form(chr(int(c, 16))) for c in codes.split())
        return LOOK_ALIKES.get(ch, ch) if self.look_alikes else ch


_LOOKS, _LETTERS = _Fold(look_alikes=True), _Fold(look_alikes=False)


def canonical(text: str, *, casefold: bool = False, look_alikes: bool = True) -> str:
    """The form of a text. With look_alikes, letters of other scripts that look Latin become Latin; without, scripts stay."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFD", text).translate(_LOOKS if look_alikes else _LETTERS)
        text = unicodedata.normalize("NFC", text)
    elif "\t" in text:
        text = text.replace("\t", " ")
    return unicodedata.normalize("NFC", text.casefold()) if casefold else text


def _distinct(values: pa.Array, convert) -> pa.Array:
    """convert(list of distinct values) placed back; null stays null."""
    d = values.dictionary_encode()
    return pa.array(convert(d.dictionary.to_pylist()), pa.string() if not len(d.dictionary) else None).take(d.indices)


def normalise_text(rows: DataFrame, *, id_col: str = "source_id", text_col: str = "text", casefold: bool = True, look_alikes: bool = True) -> DataFrame:
    """(id, text_form): each text in one form, converted once per distinct value of a batch.

    Equal forms mean equal looks; with casefold, looks up to letter case.
    Null stays null, empty stays empty, a text of only ignorable characters
    becomes empty; texts of any length are taken whole.  Repeated rows stay
    repeated; other columns are left out, so none can clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = _distinct(b.column(1), lambda texts: [canonical(t, casefold=casefold, look_alikes=look_alikes) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), forms.cast(pa.string())], ["id", "text_form"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, text_form string").withColumnRenamed("id", id_col)


def _keys(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form_hi, form_lo, text_key): 128 bits of the form and 64 of the text itself, so that no text is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column(1).dictionary_encode()
            high, low, own = [], [], []
            for t in d.dictionary.to_pylist():
                form = xxhash.xxh3_128_intdigest(canonical(t).encode("utf-8", "surrogatepass"))
                high.append((form >> 64) - (1 << 63))
                low.append((form & (1 << 64) - 1) - (1 << 63))
                own.append(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63))
            columns = [pa.array(x, pa.int64()).take(d.indices) for x in (high, low, own)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "form_hi", "form_lo", "text_key"])

    kind = rows.schema[id_col].dataType.simpleString()
    needed = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return needed.mapInArrow(run, f"id {kind}, form_hi long, form_lo long, text_key long")


def look_alike_pairs(rows: DataFrame, *, id_col: str = "source_id", text_col: str = "text", rows_per_task: int = 20_000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts differ but have the same form.

    Works on classes of equal texts: classes of one form are paired, then the
    members of both are joined on, so nothing is enumerated that isn't a result.
    The members of a class are spread over count / rows_per_task tasks.  A null
    id or text is in no pair; an empty text pairs with one that only looks
    empty; rows repeated with the same id and text count once.
    """
    form = ["form_hi", "form_lo"]
    members = _keys(rows, id_col, text_col).distinct()
    several = members.groupBy(*form).agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low < high").select(*form)
    shared = cut(members.join(several, form, "left_semi"))
    a, b = (shared.select(*form, "text_key").distinct().select(*[F.col(k).alias(f"{k}_{x}") for k in (*form, "text_key")]) for x in "ab")
    pairs = a.join(b, (F.col("form_hi_a") == F.col("form_hi_b")) & (F.col("form_lo_a") == F.col("form_lo_b")) & (F.col("text_key_a") < F.col("text_key_b")))
    return expand_class_pairs(pairs, shared, [*form, "text_key"], id_col, rows_per_task)
