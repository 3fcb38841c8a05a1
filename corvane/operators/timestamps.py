"""Timestamps of mixed formats, precisions and zones, brought to UTC instants.

Each written time becomes a mask in which every digit is 9 and every letter A.
A mask is compiled to a parser once; all times of a mask then form a matrix of
code points, and fields are read by position for all rows together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.zones import US, ZoneTable, build_zone_table

UNREADABLE, AMBIGUOUS, SKIPPED = "unreadable", "ambiguous", "skipped"

# Month names as written in English, Spanish, German, Portuguese, French and Italian.
MONTH_NAMES = """
january jan enero ene januar janeiro janvier gennaio
february feb febrero februar fevereiro février febbraio
march mar marzo märz mär março mars
april apr abril abr avril aprile
may mayo mai maio maggio
june jun junio juni junho juin giugno
july jul julio juli julho juillet luglio
august aug agosto août
september sep sept septiembre setembro septembre settembre
october oct octubre oktober okt outubro octobre ottobre
november nov noviembre novembro novembre
december dec diciembre dic dezember dez dezembro décembre dicembre
"""
MONTHS = {word: number for number, line in enumerate(MONTH_NAMES.strip().splitlines(), 1) for word in line.split()}
WEEKDAYS = set("mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday".split())
FILLERS = {"uhr", "de", "del"}

_DATES = [
    r"(?P<y>9999)(?P<sep>[-/.])(?P<m>99?)(?P=sep)(?P<d>99?)",
    r"(?P<y>9999)(?P<m>99)(?P<d>99)",
    r"(?P<y>9999)-?(?P<weekmark>A)(?P<w>99)-?(?P<wd>9)",
    r"(?P<y>9999)-(?P<j>999)",
    r"(?P<n1>99?)(?P<sep>[-/.])(?P<n2>99?)(?P=sep)(?P<n3>9999|99)",
    r"(?:(?P<weekday>A+),? )?(?P<d>99?)\.? (?:(?P<fill1>AA) )?(?P<mon>A+)\.? (?:(?P<fill2>AA) )?(?P<y>9999)",
    r"(?:(?P<weekday>A+),? )?(?P<mon>A+)\.? (?P<d>99?),? (?P<y>9999)",
]
_TIME = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?"
_COMPACT_TIME = r"(?P<H>99)(?P<M>99)(?P<S>99)?(?:[.,](?P<f>9+))?"
_TAIL = r"(?: ?(?P<word1>A+)(?![A/_]))?(?: ?(?P<sign>[-+])(?P<oh>99):?(?P<om>99)?)?(?: ?[\[(]?(?P<word2>A[A/_+-]*)[\])]?)?"
_SHAPES = [re.compile(f"{d}(?:(?:(?P<t>A)|,? ){_TIME}{_TAIL})?") for d in _DATES]
_SHAPES.append(re.compile(f"{_DATES[1]}(?P<t>A){_COMPACT_TIME}{_TAIL}"))
_SHAPES.append(re.compile(f"{_DATES[1]}{_COMPACT_TIME}"))
_COUNT = re.compile(r"9{9,20}(?:\.9{1,9})?")
_PLUS = str.maketrans({"−": "-", "‐": "-", "‑": "-"})


class _Classes(dict):
    """A translation table that fills itself as characters come."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = "9" if ch.isdecimal() else "A" if ch.isalpha() else " " if ch.isspace() else ch
        return self[code]


_CLASSES = _Classes()


def _plain(text: str) -> str:
    """Full-width forms, digits of any script and spaces made ordinary; quotes and padding around it removed."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_PLUS)
        text = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text if unicodedata.category(c) != "Cf")
    return " ".join(text.split()).strip("'\"` ")


@lru_cache(maxsize=50_000)
def compile_mask(mask: str) -> tuple[dict[str, tuple[int, int]], ...]:
    """The readings of a mask: the span of each field in it, or () where it is no time."""
    if _COUNT.fullmatch(mask) and len(mask) not in (12, 14):
        return ({"count": (0, len(mask))},)
    found = []
    for shape in _SHAPES:
        if m := shape.fullmatch(mask):
            found.append({k: m.span(k) for k, v in m.groupdict().items() if v is not None})
    return tuple(found)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of proleptic Gregorian dates; ok becomes false where there is no such date."""
    ok = ok & (y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12) & (d >= 1)
    ys, ms = np.where(ok, y, 2000), np.where(ok, m, 1)
    month = (ys - 1970) * 12 + ms - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    following = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (d <= following - first)


class Converter:
    """Turns arrays of (written time, source) into UTC strings or marks. One per worker; holds only small tables."""

    def __init__(self, zones: ZoneTable, homes: dict[str, tuple[str, str]], abbreviations: dict[str, int], first_us: int, last_us: int, longest: int = 128):
        self.zones, self.homes, self.first_us, self.last_us, self.longest = zones, homes, first_us, last_us, longest
        self.abbreviations = {k.upper(): v for k, v in abbreviations.items()} | {"Z": 0}
        self.by_lower = {z.lower(): z for z in zones.rules}

    def _word(self, word: str) -> tuple[str, object]:
        low = word.lower()
        if low in ("am", "pm"):
            return low, None
        if low in FILLERS:
            return "fill", None
        if word.upper() in self.abbreviations:
            return "fixed", self.abbreviations[word.upper()] * 60
        if low in self.by_lower:
            return "zone", self.by_lower[low]
        return "bad", None

    def convert(self, times: list[str], sources: list[str | None]) -> np.ndarray:
        out = np.full(len(times), UNREADABLE, dtype=object)
        plain = [_plain(t) for t in times]
        groups: dict[str, list[int]] = {}
        for i, t in enumerate(plain):
            if len(t) <= self.longest:
                groups.setdefault(t.translate(_CLASSES), []).append(i)
        for mask, rows in groups.items():
            readings = compile_mask(mask)
            if not readings:
                continue
            at = np.array(rows)
            matrix = np.array([plain[i] for i in rows], dtype=f"<U{len(mask)}").view(np.uint32).reshape(len(rows), len(mask))
            names = [(sources[i] or "").strip().lower() for i in rows]
            for spans in readings:
                us, state = self._read(spans, matrix, names)
                done = state != 0
                if done.any():
                    text = np.char.add(np.datetime_as_string(us.astype("datetime64[us]"), unit="us"), "Z").astype(object)
                    text[state == 2], text[state == 3] = AMBIGUOUS, SKIPPED
                    fill = done & (out[at] == UNREADABLE)
                    out[at[fill]] = text[fill]
        return out

    def _read(self, spans: dict, matrix: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Microseconds and a state by row: 0 unreadable, 1 an instant, 2 ambiguous, 3 skipped."""
        n = len(matrix)
        ok = np.ones(n, bool)

        def number(field: str, default: int = 0) -> np.ndarray:
            if field not in spans:
                return np.full(n, default, np.int64)
            value = np.zeros(n, np.int64)
            for k in range(*spans[field]):
                value = value * 10 + matrix[:, k] - 48
            return value

        def words(field: str) -> tuple[np.ndarray, np.ndarray]:
            a, b = spans[field]
            return np.unique(np.ascontiguousarray(matrix[:, a:b]).view(f"<U{b - a}").ravel(), return_inverse=True)

        def only(field: str, accepted: set[str]) -> None:
            nonlocal ok
            if field in spans:
                distinct, inverse = words(field)
                ok = ok & np.array([w.lower() in accepted for w in distinct])[inverse]

        if "count" in spans:
            whole = "".join(map(chr, matrix[0]))
            dot = whole.find(".")
            digits = dot if dot >= 0 else len(whole)
            us = np.zeros(n, np.int64)
            if digits > 19:
                return us, np.zeros(n, np.int8)
            spans = {"v": (0, digits), "f": (digits + 1, len(whole))} if dot >= 0 else {"v": (0, digits)}
            value, state = number("v"), np.zeros(n, np.int8)
            for multiply, divide in ((US, 1), (1000, 1), (1, 1), (1, 1000)):
                low, high = self.first_us * divide // multiply, self.last_us * divide // multiply
                hit = (value >= low) & (value <= high)
                state[hit] = 1
                us = np.where(hit, np.where(hit, value, 0) * multiply // divide, us)
                if multiply == US and "f" in spans:
                    a, b = spans["f"][0], min(spans["f"][1], spans["f"][0] + 6)
                    spans["f6"] = (a, b)
                    us = us + np.where(hit, number("f6") * 10 ** (6 - (b - a)), 0)
                    break
            return us, state

        only("weekday", WEEKDAYS)
        only("t", {"t"})
        only("weekmark", {"w"})
        only("fill1", FILLERS)
        only("fill2", FILLERS)

        if "n1" in spans:
            n1, n2, n3 = number("n1"), number("n2"), number("n3")
            orders = np.array([self.homes.get(s, ("", ""))[1] for s in names])
            short = spans["n3"][1] - spans["n3"][0] == 2
            dmy, mdy, ymd = orders == "dmy", orders == "mdy", orders == "ymd"
            ok = ok & (dmy | mdy | ymd)
            year = n3 + 2000 * short
            y = np.where(ymd, n1 + 2000, year) if short else year
            m = np.where(dmy, n2, np.where(mdy, n1, n2))
            d = np.where(dmy, n1, np.where(mdy, n2, n3))
            if not short:
                ok = ok & ~ymd
            day, ok = _days(y, m, d, ok)
        elif "w" in spans:
            y, w, wd = number("y"), number("w"), number("wd")
            fourth, ok = _days(y, np.ones(n, np.int64), np.full(n, 4), ok)
            monday = fourth - (fourth + 3) % 7
            nxt, _ = _days(y + 1, np.ones(n, np.int64), np.full(n, 4), ok & (y < 9999))
            weeks = (nxt - (nxt + 3) % 7 - monday) // 7
            ok = ok & (w >= 1) & (w <= weeks) & (wd >= 1) & (wd <= 7)
            day = monday + (w - 1) * 7 + wd - 1
        elif "j" in spans:
            y, j = number("y"), number("j")
            first, ok = _days(y, np.ones(n, np.int64), np.ones(n, np.int64), ok)
            after, _ = _days(y + 1, np.ones(n, np.int64), np.ones(n, np.int64), ok & (y < 9999))
            ok = ok & (j >= 1) & (j <= after - first)
            day = first + j - 1
        else:
            if "mon" in spans:
                distinct, inverse = words("mon")
                m = np.array([MONTHS.get(w.lower(), 0) for w in distinct])[inverse]
            else:
                m = number("m")
            day, ok = _days(number("y"), m, number("d"), ok)

        hour, minute, second, fraction = number("H"), number("M"), number("S"), np.zeros(n, np.int64)
        if "f" in spans:
            a, b = spans["f"][0], min(spans["f"][1], spans["f"][0] + 6)
            spans = spans | {"f6": (a, b)}
            fraction = number("f6") * 10 ** (6 - (b - a))

        fixed, has_fixed = np.zeros(n, np.int64), np.zeros(n, bool)
        zone = np.array([self.homes.get(s, ("", ""))[0] for s in names], dtype=object)
        for field in ("word1", "word2"):
            if field not in spans:
                continue
            distinct, inverse = words(field)
            for k, (kind, value) in enumerate(map(self._word, distinct)):
                rows = inverse == k
                if kind in ("am", "pm"):
                    ok = ok & ~(rows & ((hour < 1) | (hour > 12)))
                    hour = np.where(rows, hour % 12 + 12 * (kind == "pm"), hour)
                elif kind == "fixed":
                    if not (value == 0 and "sign" in spans):
                        fixed, has_fixed = np.where(rows, value, fixed), has_fixed | rows
                elif kind == "zone":
                    zone[rows] = value
                elif kind == "bad":
                    ok = ok & ~rows
        if "sign" in spans:
            oh, om = number("oh"), number("om")
            ok = ok & (oh <= 18) & (om <= 59)
            sign = np.where(matrix[:, spans["sign"][0]] == ord("-"), -1, 1)
            fixed, has_fixed = sign * (oh * 3600 + om * 60), np.ones(n, bool)
        ok = ok & (hour <= 23) & (minute <= 59) & (second <= 59)
        local = ((day * 24 + hour) * 60 + minute) * 60 + second
        local = np.where(ok, local, 0) * US + fraction

        us, state = np.zeros(n, np.int64), np.zeros(n, np.int8)
        rows = ok & has_fixed
        us[rows], state[rows] = (local - fixed * US)[rows], 1
        for name in set(zone[ok & ~has_fixed]):
            if name not in self.zones.rules:
                continue
            rows = np.flatnonzero(ok & ~has_fixed & (zone == name))
            instants, found = self.zones.to_utc(name, local[rows])
            us[rows], state[rows] = instants, np.where(found == 1, 1, np.where(found == 0, 3, 2))
        outside = (state == 1) & ((us < self.first_us) | (us > self.last_us))
        state[outside] = 0
        return us, state


def is_exact_utc(column: Column) -> Column:
    """Whether a string is a valid time written exactly as YYYY-MM-DDTHH:MM:SSZ (null: null)."""
    shaped = column.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z")
    return F.when(column.isNotNull(), shaped & F.try_to_timestamp(F.when(shaped, column), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull())


def normalise_timestamps(
    rows: DataFrame,
    source_zones: DataFrame,
    zone_names: DataFrame,
    *,
    id_col: str = "source_id",
    time_col: str = "timestamp",
    source_col: str = "source",
    first_year: int = 2022,
    last_year: int = 2026,
    longest: int = 128,
) -> DataFrame:
    """(id, utc_ts): one row per input row whose time is not null.

    `utc_ts` is YYYY-MM-DDTHH:MM:SS.ffffffZ or one of ambiguous, skipped,
    unreadable.  Empty and blank texts are unreadable, as is one that has more
    than `longest` characters once padding and quotes around it are gone, an
    instant outside first_year..last_year, a zone-less time of a source without
    home zone, and a numeric date of a source without date order.  Rows with a
    null id keep it; repeated rows stay repeated; other columns are left out, so
    none can clash.  An empty table gives an empty result.

    The two lookup tables hold a row per source or abbreviation and are read to
    the driver; more than 100,000 rows are refused.
    """
    bound = 100_000
    homes = {(r[0] or "").strip().lower(): (r[1] or "", r[2] or "") for r in source_zones.select("source", "home_zone", "date_order").limit(bound + 1).collect()}
    short = {r[0]: int(r[1]) for r in zone_names.select("abbr", "utc_offset_min").na.drop().limit(bound + 1).collect()}
    if max(len(homes), len(short)) > bound:
        raise ValueError(f"a zone lookup table has more than {bound} rows")
    zones = build_zone_table(first_year - 1, last_year + 1)
    low = int(np.datetime64(f"{first_year:04d}-01-01", "us").astype(np.int64))
    high = int(np.datetime64(f"{last_year + 1:04d}-01-01", "us").astype(np.int64)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        converter = Converter(zones, homes, short, low, high, longest)
        for b in batches:
            if b.num_rows:
                texts = converter.convert(b.column(1).to_pylist(), b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "utc_ts"])

    kind = rows.schema[id_col].dataType.simpleString()
    needed = rows.where(F.col(time_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(time_col).alias("t"), F.col(source_col).alias("s"))
    return needed.mapInArrow(run, f"id {kind}, utc_ts string").withColumnRenamed("id", id_col)
