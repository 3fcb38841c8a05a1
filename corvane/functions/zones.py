"""Versioned zone transition tables.

A table is made once, on the driver, from the zone database there, and travels
with the plan: every executor converts by the same version, whatever zone files
it has itself.
"""

from __future__ import annotations

import importlib.metadata
import zoneinfo
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np

US = 1_000_000


def database_version() -> str:
    """The release of the zone database that zoneinfo reads here."""
    for base in zoneinfo.TZPATH:
        for name in ("+VERSION", "tzdata.zi"):
            p = Path(base, name)
            if p.exists():
                return p.read_text(errors="replace").splitlines()[0].removeprefix("# version ").strip()
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """`rules[zone]` is (utc seconds from which an offset holds, that offset in seconds), ascending."""

    version: str
    first_year: int
    last_year: int
    rules: dict[str, tuple[np.ndarray, np.ndarray]]

    def to_utc(self, zone: str, local_us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Instants of wall-clock microseconds, and how many instants have that wall clock (0, 1 or 2).

        Each period of constant offset is a half-open range of wall-clock time;
        the periods around a moment are compared, all rows at once.
        """
        since, offset = self.rules[zone]
        local = np.floor_divide(local_us, US)
        at = np.clip(np.searchsorted(since, local - offset.max(), side="right") - 1, 0, len(since) - 1)
        found, result = np.zeros(len(local), np.int8), np.zeros(len(local), np.int64)
        until = np.append(since[1:], np.iinfo(np.int64).max // 4)
        for step in range(4):
            k = at + step
            inside = k < len(since)
            k = np.minimum(k, len(since) - 1)
            utc = local - offset[k]
            hit = inside & (utc >= since[k]) & (utc < until[k])
            result = np.where(hit & (found == 0), local_us - offset[k] * US, result)
            found += hit
        return result, found


def _offset(zone: zoneinfo.ZoneInfo, second: int) -> int:
    moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)
    return int(moment.astimezone(zone).utcoffset().total_seconds())


def build_zone_table(first_year: int = 2020, last_year: int = 2028, names: list[str] | None = None) -> ZoneTable:
    """Transitions of each zone, found by halving between samples four days apart where the offset differs."""
    start = int(datetime(first_year, 1, 1, tzinfo=timezone.utc).timestamp())
    end = int(datetime(last_year, 12, 31, tzinfo=timezone.utc).timestamp())
    rules = {}
    for name in sorted(names if names is not None else zoneinfo.available_timezones()):
        if name in ("localtime", "posixrules", "Factory"):
            continue
        zone = zoneinfo.ZoneInfo(name)
        since, offsets = [np.iinfo(np.int64).min // 4], [_offset(zone, start)]
        previous = start
        for second in range(start, end, 4 * 86_400):
            now = _offset(zone, second)
            if now != offsets[-1]:
                low, high = previous, second
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if _offset(zone, middle) == offsets[-1] else (low, middle)
                since.append(high)
                offsets.append(now)
            previous = second
        rules[name] = np.array(since, np.int64), np.array(offsets, np.int64)
    return ZoneTable(database_version(), first_year, last_year, rules)
