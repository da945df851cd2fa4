"""Mixed timestamp spellings and zones -> one UTC instant.

Method: a value becomes a character-class *shape mask* (every digit ``9``, every run of letters ``A``, all else as it
is; built JVM-side). Each distinct mask is compiled once per worker into a parser: one RE2 pattern plus the role of
every slot. All values of a batch that share the mask are converted together (Arrow regex extraction, NumPy calendar
arithmetic). Wall times go through zone transition tables that carry the tz-database version of the driver; a worker
whose tables have another version refuses to convert.

Defined results:
* null, empty or blank values, relative ages, other words, dates that do not exist (30 February): null instant
* no zone or offset: wall time of ``zone`` (null or unknown zone: UTC); an offset wins over a zone name beside it
* a wall time that occurs twice: the earlier instant; one that is skipped moves forward by the length of the gap
* bare date: its midnight; missing seconds are 0; digits past the microsecond are dropped; two-digit years are 20xx
* all-number dates with the year last: day first unless only month first is possible
* repeated rows stay repeated rows; further columns of the input are kept untouched
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zoneinfo
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.runtime import extended

US = 1_000_000
NONE = np.iinfo(np.int64).min

# Month names of the five feed languages with their usual short forms, without accents.
MONTHS = {
    1: "january jan januar janvier janv enero ene janeiro jaenner",
    2: "february feb februar fevrier fevr febrero fevereiro fev",
    3: "march mar marz mars marzo marco maerz mrz",
    4: "april apr avril avr abril abr",
    5: "may mai mayo maio",
    6: "june jun juni juin junio junho",
    7: "july jul juli juillet juil julio julho",
    8: "august aug aout agosto ago",
    9: "september sep sept septembre septiembre setembro set",
    10: "october oct oktober okt octobre octubre outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez decembre diciembre dic dezembro",
}
# Weekday names and short forms, and words that may stand in a date without meaning.
WEEKDAYS = (
    "monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun "
    "montag mo dienstag di mittwoch mi donnerstag do freitag fr samstag sa sonnabend sonntag so "
    "lundi lun mardi mercredi mer jeudi jeu vendredi ven samedi sam dimanche dim "
    "lunes martes miercoles mie jueves jue viernes vie sabado sab domingo dom "
    "segunda terca quarta quinta sexta feira"
)
FILLERS = "t h uhr um at on de del do da le el les a as la las o of the der den den am em en st nd rd th min s er hrs"
# Zone abbreviations in hours from UTC.
ZONES = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "IST": 5.5, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2,
    "EET": 2, "EEST": 3, "MSK": 3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "AKST": -9, "AKDT": -8, "HST": -10, "AST": -4, "ADT": -3, "NST": -3.5, "NDT": -2.5, "BRT": -3, "ART": -3, "CLT": -4,
    "JST": 9, "KST": 9, "SGT": 8, "HKT": 8, "PKT": 5, "ICT": 7, "WIB": 7, "SAST": 2, "EAT": 3, "WAT": 1,
    "AWST": 8, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
}


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


_MONTH = {plain(w): m for m, ws in MONTHS.items() for w in ws.split()}
_IDLE = {plain(w) for w in (WEEKDAYS + " " + FILLERS).split()}


# ---- zone transition tables ---------------------------------------------------------------------------------------


@functools.lru_cache(None)
def tz_version() -> str:
    """Version of the tz database in use: the system's, else the packaged one's."""
    for d in zoneinfo.TZPATH:
        p = Path(d, "tzdata.zi")
        if p.exists():
            return p.open().readline().strip().removeprefix("# version ")
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


#: 2100-01-01, and the seconds of the 400 years after which weekdays and leap years repeat.
FAR, CYCLE = 4_102_444_800, 146_097 * 86_400


@functools.lru_cache(None)
def zone_table(name: str, far: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """(first wall second of each era, its offset) from 1900 to 2100 (``far``: to 2500); None for a name the tz database lacks.

    An era starts, on the wall clock, at transition + max(old, new offset): so a repeated wall time takes the old
    (earlier) offset and a skipped one is read with the old offset, which moves it forward by the gap.
    """
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None
    import datetime as dt

    utc, epoch = dt.timezone.utc, dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

    def offset(s: int) -> int:
        return int((epoch + dt.timedelta(seconds=s)).astimezone(utc).astimezone(zone).utcoffset().total_seconds())

    step, lo, hi = 14 * 86400, -2_208_988_800, FAR + CYCLE if far else FAR
    walls, offsets = [np.iinfo(np.int64).min], [offset(lo)]
    old, a = offsets[0], lo
    while a < hi:
        b = a + step
        new = offset(b)
        if new != old:
            x, y = a, b
            while y - x > 1:
                m = (x + y) // 2
                x, y = (m, y) if offset(m) == old else (x, m)
            new = offset(y)
            walls.append(y + max(old, new))
            offsets.append(new)
            old, a = new, y
            continue
        a = b
    return np.array(walls, np.int64), np.array(offsets, np.int64)


def wall_offset(seconds: np.ndarray, name: str | None) -> np.ndarray:
    """Offset from UTC of wall-clock seconds in a zone; UTC where the name is null or unknown."""
    late = bool((seconds >= FAR - 2 * 86400).any())
    t = zone_table(name, late) if name else None
    if t is None:
        return np.zeros(len(seconds), np.int64)
    if late:  # a zone's last rule goes on, and the calendar repeats every 400 years
        seconds = np.where(seconds >= FAR + CYCLE - 2 * 86400, (seconds - FAR + 2 * 86400) % CYCLE + FAR - 2 * 86400, seconds)
    return t[1][np.searchsorted(t[0], seconds, side="right") - 1]


# ---- mask -> parser -----------------------------------------------------------------------------------------------


class Parser:
    """What one shape mask means: a pattern that cuts out its slots, and the role of each slot."""

    def __init__(self, mask: str):
        # tokens: number (n digits), word, or one other character
        tokens = [(m[0], "n" if m[0][0] == "9" else "w" if m[0][0] == "A" else "c") for m in re.finditer(r"9+|A|.", mask, re.S)]
        self.words: list[int] = []
        self.zone_words: list[list[int]] = []
        roles: dict[str, int] = {}
        kinds = [k for _, k in tokens]
        text = [t for t, _ in tokens]
        slot = {i: s for s, i in enumerate(i for i, k in enumerate(kinds) if k != "c")}
        self.pattern = "^" + "".join(f"(?P<s{slot[i]}>\\d{{{len(t)}}})" if k == "n" else f"(?P<s{slot[i]}>\\p{{L}}+)" if k == "w" else re.escape(t) for i, (t, k) in enumerate(tokens)) + "$"
        n = len(tokens)
        used: set[int] = set()
        self.ok, self.epoch, self.hm_word = False, None, None
        self.slots = len(slot)
        self.sign, self.frac = 0, None
        at = lambda i, k: 0 <= i < n and kinds[i] == k
        ch = lambda i, s: 0 <= i < n and kinds[i] == "c" and text[i] in s
        # a number alone: epoch, or a compact date
        if kinds in (["n"], ["n", "c", "n"]) and (len(kinds) == 1 or text[1] == "."):
            size = len(text[0])
            if size in (9, 10):
                self.epoch, self.frac = US, (slot[2], len(text[2])) if len(kinds) == 3 else None
            elif size == 13:
                self.epoch = 1000
            elif size == 16:
                self.epoch = 1
            elif size == 19:
                self.epoch = -1000
            if self.epoch:
                self.ok = True
                return
        # zone names: words joined by / _ -
        i = 0
        while i < n:
            if at(i, "w") and ch(i + 1, "/") and at(i + 2, "w"):
                run = [i]
                j = i
                while ch(j + 1, "/_-") and at(j + 2, "w"):
                    j += 2
                    run.append(j)
                used.update(range(i, j + 1))
                self.zone_words.append([(slot[x], text[x + 1] if x != run[-1] else "") for x in run])
                i = j + 1
            else:
                i += 1
        # time: n:nn[:nn[.n+]], or n<h>nn
        end = None
        for i in range(n):
            if at(i, "n") and len(text[i]) <= 2 and ch(i + 1, ":") and at(i + 2, "n") and len(text[i + 2]) == 2:
                roles["h"], roles["mi"] = i, i + 2
                end = i + 2
                if ch(end + 1, ":") and at(end + 2, "n") and len(text[end + 2]) == 2:
                    roles["s"] = end + 2
                    end += 2
                    if ch(end + 1, ".,") and at(end + 2, "n"):
                        roles["f"] = end + 2
                        end += 2
                used.update(range(i, end + 1))
                break
        if end is None:
            for i in range(n):
                if at(i, "n") and len(text[i]) <= 2 and at(i + 1, "w") and at(i + 2, "n") and len(text[i + 2]) == 2 and i > 0:
                    roles["h"], roles["mi"], self.hm_word = i, i + 2, slot[i + 1]
                    end = i + 2
                    used.update((i, i + 1, i + 2))
                    break
        if end is None:  # compact: 99999999A999999
            for i in range(n):
                if at(i, "n") and len(text[i]) == 8 and (at(i + 1, "w") or ch(i + 1, "T _-")) and at(i + 2, "n") and len(text[i + 2]) in (4, 6):
                    self.compact_time = (slot[i + 2], len(text[i + 2]))
                    end = i + 2
                    used.add(i + 2)
                    break
        # offset: sign and digits after the time
        if end is not None:
            for i in range(end + 1, n):
                if ch(i, "+-−") and at(i + 1, "n") and i + 1 not in used:
                    self.sign = -1 if text[i] != "+" else 1
                    if ch(i + 2, ":") and at(i + 3, "n"):
                        self.offset = (slot[i + 1], len(text[i + 1]), slot[i + 3])
                        used.update((i + 1, i + 3))
                    else:
                        self.offset = (slot[i + 1], len(text[i + 1]), None)
                        used.add(i + 1)
                    break
        self.words = [slot[i] for i in range(n) if kinds[i] == "w" and i not in used]
        left = [i for i in range(n) if kinds[i] == "n" and i not in used]
        sizes = [len(text[i]) for i in left]
        self.swap = False
        if len(left) == 1 and sizes == [8] and not self.words or len(left) == 1 and sizes == [8] and hasattr(self, "compact_time"):
            self.date = ("ymd8", slot[left[0]])
        elif len(left) == 1 and sizes == [14] and not self.words:
            self.date = ("ymd14", slot[left[0]])
        elif len(left) == 3 and all(s <= 2 or s == 4 for s in sizes) and sizes.count(4) <= 1 and sizes[1] != 4:
            y, m, d = (0, 1, 2) if sizes[0] == 4 else (2, 1, 0)
            self.swap = y == 2
            self.date = ("nums", slot[left[y]], slot[left[m]], slot[left[d]])
        elif len(left) == 2 and all(s <= 2 or s == 4 for s in sizes) and sizes.count(4) <= 1:
            y, d = (0, 1) if sizes[0] == 4 else (1, 0)
            self.date = ("month", slot[left[y]], slot[left[d]])
        else:
            return
        self.roles = {r: (slot[i], len(text[i])) for r, i in roles.items()}
        self.ok = True

    def parse(self, values: pa.Array, zones: np.ndarray) -> np.ndarray:
        """Microseconds since 1970 UTC, ``NONE`` where the value is no date; ``zones`` are the default zone names."""
        n = len(values)
        out = np.full(n, NONE, np.int64)
        if not self.ok:
            return out
        got = pc.extract_regex(values, self.pattern)
        fields = [f.name for f in got.type]
        slots = [pc.struct_field(got, f"s{i}") if f"s{i}" in fields else None for i in range(self.slots)]
        num = lambda s: pc.cast(slots[s], pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        if self.epoch:
            x = num(0)
            out = x // 1000 if self.epoch == -1000 else x * self.epoch
            if self.frac:
                out = out + self._micros(*self.frac, slots)
            return out
        good = ~np.asarray(got.is_null().to_numpy(zero_copy_only=False), bool)
        month, zone_off, pm = np.zeros(n, np.int64), np.full(n, NONE, np.int64), np.full(n, -1, np.int8)
        for s in self.words:
            d = slots[s].dictionary_encode()
            codes = d.indices.fill_null(0).to_numpy(zero_copy_only=False)
            kind = np.zeros((len(d.dictionary) or 1, 4), np.int64)  # month, zone (s), am/pm, known
            kind[:, 1], kind[:, 2] = NONE, -1
            for k, w in enumerate(d.dictionary.to_pylist()):
                p = plain(w)
                if w in ZONES or (w.upper() in ZONES and p not in _IDLE and p not in _MONTH):
                    kind[k, 1], kind[k, 3] = int(ZONES[w.upper()] * 3600), 1
                elif p in ("am", "pm"):
                    kind[k, 2], kind[k, 3] = p == "pm", 1
                elif p in _MONTH:
                    kind[k, 0], kind[k, 3] = _MONTH[p], 1
                elif p in _IDLE:
                    kind[k, 3] = 1
            row = kind[codes]
            month = np.where(row[:, 0] > 0, row[:, 0], month)
            zone_off = np.where(row[:, 1] != NONE, row[:, 1], zone_off)
            pm = np.where(row[:, 2] >= 0, row[:, 2], pm)
            good &= row[:, 3] == 1
        if self.hm_word is not None:
            good &= np.array([str(w).lower() in ("h", "uhr") for w in slots[self.hm_word].to_pylist()], bool)
        # the date
        how = self.date[0]
        if how == "ymd8":
            x = num(self.date[1])
            y, m, d = x // 10000, x // 100 % 100, x % 100
        elif how == "ymd14":
            x = num(self.date[1])
            y, m, d = x // 10**10, x // 10**8 % 100, x // 10**6 % 100
        elif how == "nums":
            y, m, d = (num(s) for s in self.date[1:])
            if self.swap:
                turn = (m > 12) & (d <= 12)
                m, d = np.where(turn, d, m), np.where(turn, m, d)
        else:
            y, d = (num(s) for s in self.date[1:])
            m = month
        y = np.where(y < 100, y + 2000, y)
        good &= (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
        m1 = np.clip(m, 1, 12)
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        good &= d <= np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[m1 - 1] + (leap & (m1 == 2))
        # days from civil
        yy = y - (m1 <= 2)
        era = yy // 400
        yoe = yy - era * 400
        doy = (153 * (m1 + np.where(m1 > 2, -3, 9)) + 2) // 5 + d - 1
        days = era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468
        # the time
        h = mi = s = np.zeros(n, np.int64)
        frac = np.zeros(n, np.int64)
        if hasattr(self, "compact_time"):
            t, size = self.compact_time
            x = num(t) * (1 if size == 6 else 100)
            h, mi, s = x // 10000, x // 100 % 100, x % 100
        elif how == "ymd14":
            x = num(self.date[1]) % 10**6
            h, mi, s = x // 10000, x // 100 % 100, x % 100
        else:
            if "h" in self.roles:
                h, mi = num(self.roles["h"][0]), num(self.roles["mi"][0])
            if "s" in self.roles:
                s = num(self.roles["s"][0])
            if "f" in self.roles:
                frac = self._micros(*self.roles["f"], slots)
        twelve = pm >= 0
        good &= ~twelve | ((h >= 1) & (h <= 12))
        h = np.where(twelve, h % 12 + 12 * (pm == 1), h)
        good &= (h <= 23) & (mi <= 59) & (s <= 60)
        wall = days * 86400 + h * 3600 + mi * 60 + s
        # the offset
        off = np.full(n, NONE, np.int64)
        if self.sign:
            a, size, b = self.offset
            x = num(a)
            oh, om = (x // 100, x % 100) if size >= 3 else (x, num(b) if b is not None else 0)
            off = self.sign * (oh * 3600 + om * 60)
            good &= (np.abs(off) <= 64800) & (om < 60)
        else:
            off = zone_off.copy()
            names = None
            if self.zone_words:
                parts = self.zone_words[-1]
                cols = []
                for sl, sep in parts:
                    cols += [slots[sl], pa.scalar(sep)]
                names = pc.binary_join_element_wise(*cols, "").to_pylist()
                known = np.array([x is not None and zone_table(x) is not None for x in names], bool)
                good &= known
            need = off == NONE
            use = np.array(names, object) if names is not None else zones
            for z in set(use[need & good].tolist()):
                k = need & good & np.array([v == z for v in use], bool)
                off[k] = wall_offset(wall[k], z)
            off = np.where(off == NONE, 0, off)
        out[good] = ((wall - off) * US + frac)[good]
        return out

    @staticmethod
    def _micros(slot: int, size: int, slots: list) -> np.ndarray:
        x = pc.cast(pc.utf8_slice_codeunits(slots[slot], 0, 6), pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        return x * 10 ** (6 - min(size, 6))


@functools.lru_cache(4096)
def parser(mask: str) -> Parser:
    return Parser(mask)


def convert(values: pa.Array, masks: pa.Array, zones: pa.Array) -> np.ndarray:
    """A batch: rows that share a mask are converted together."""
    d = masks.dictionary_encode()
    codes = d.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(d.dictionary) + 1))
    out = np.full(len(values), NONE, np.int64)
    zone = np.array(zones.to_pylist(), object)
    for k, mask in enumerate(d.dictionary.to_pylist()):
        rows = order[bounds[k] : bounds[k + 1]]
        out[rows] = parser(mask).parse(values.take(pa.array(rows)), zone[rows])
    return out


def tidy(value: Column) -> Column:
    """What the mask is taken of: outer white space off, inner runs one space, a.m./p.m. as one word, "sept." as a word."""
    v = F.regexp_replace(value, r"(?U)[\s​﻿]+", " ")
    v = F.regexp_replace(F.trim(v), r"(?i)\b([ap])\.\s?m\.?(?=\W|$)", "$1m")
    return F.regexp_replace(v, r"(?<=\p{L}{3})\.", "")


def shape_mask(value: Column) -> Column:
    """Every digit as 9, every run of letters as A."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "A"), r"[0-9]", "9")


def to_utc_micros(df: DataFrame, value: str, zone: str, out: str = "utc_us") -> DataFrame:
    """Append ``out`` (bigint, null where ``value`` states no date; a column of that name is replaced) to ``df``.
    ``zone`` holds the default zone's name."""
    df = df.drop(out) if out not in (value, zone) else df
    version = tz_version()
    v, m = "__value", "__mask"
    src = df.withColumn(v, tidy(F.col(value))).withColumn(m, shape_mask(F.col(v)))
    keep = list(df.columns)
    schema = extended(df, **{out: "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tz_version() != version:
            raise RuntimeError(f"tz database {tz_version()} here, {version} on the driver")
        for b in batches:
            us = convert(b.column(v).cast(pa.string()), b.column(m).cast(pa.string()), b.column(zone).cast(pa.string()))
            col = pa.array(us, pa.int64(), mask=us == NONE)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [col], names=[*keep, out])

    return src.mapInArrow(run, schema)
