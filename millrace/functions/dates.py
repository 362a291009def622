"""Dates: strftime and the markup's letter codes as Columns, part arithmetic, and a free-text parser.

Closed forms are Columns. Free text has a grammar with relative parts, so it is read by ``parse_time``
in an Arrow-batched UDF, after the plain ISO forms, which a Column reads."""

from __future__ import annotations

import calendar
import datetime as dt
import functools
import re
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_F = F.date_format


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def iso_year(t: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), t)


def _suffix(t: Column) -> Column:
    d = F.dayofmonth(t)
    return F.when(d.between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")


def _leap(t: Column) -> Column:
    y = F.year(t)
    return ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))).cast("int")


_STRFTIME = {
    "a": lambda t: _F(t, "EEE"), "A": lambda t: _F(t, "EEEE"), "b": lambda t: _F(t, "MMM"), "B": lambda t: _F(t, "MMMM"), "h": lambda t: _F(t, "MMM"),
    "C": lambda t: _two(F.floor(F.year(t) / 100)), "d": lambda t: _F(t, "dd"), "e": lambda t: F.lpad(F.dayofmonth(t).cast("string"), 2, " "), "D": lambda t: _F(t, "MM/dd/yy"), "F": lambda t: _F(t, "yyyy-MM-dd"),
    "g": lambda t: _two(iso_year(t) % 100), "G": lambda t: iso_year(t).cast("string"), "H": lambda t: _F(t, "HH"), "I": lambda t: _F(t, "hh"), "j": lambda t: F.lpad(F.dayofyear(t).cast("string"), 3, "0"),
    "k": lambda t: F.lpad(F.hour(t).cast("string"), 2, " "), "l": lambda t: F.lpad(((F.hour(t) + 11) % 12 + 1).cast("string"), 2, " "), "L": lambda t: F.lpad(F.pmod(F.unix_millis(t), F.lit(1000)).cast("string"), 3, "0"),
    "m": lambda t: _F(t, "MM"), "M": lambda t: _F(t, "mm"), "n": lambda t: F.lit("\n"), "p": lambda t: _F(t, "a"), "P": lambda t: F.lower(_F(t, "a")), "r": lambda t: _F(t, "hh:mm:ss a"), "R": lambda t: _F(t, "HH:mm"),
    "s": lambda t: F.unix_seconds(t).cast("string"), "S": lambda t: _F(t, "ss"), "t": lambda t: F.lit("\t"), "T": lambda t: _F(t, "HH:mm:ss"), "u": lambda t: ((F.dayofweek(t) + 5) % 7 + 1).cast("string"), "w": lambda t: (F.dayofweek(t) - 1).cast("string"),
    "U": lambda t: _two(F.floor((F.dayofyear(t) + 6 - (F.dayofweek(t) - 1)) / 7)), "W": lambda t: _two(F.floor((F.dayofyear(t) + 6 - (F.dayofweek(t) + 5) % 7) / 7)), "V": lambda t: _two(F.weekofyear(t)),
    "x": lambda t: _F(t, "MM/dd/yyyy"), "X": lambda t: _F(t, "HH:mm:ss"), "c": lambda t: _F(t, "EEE MMM d HH:mm:ss yyyy"), "y": lambda t: _F(t, "yy"), "Y": lambda t: _F(t, "yyyy"), "Z": lambda t: F.lit("UTC"), "z": lambda t: F.lit("+0000"), "%": lambda t: F.lit("%"),
}


def strftime(time: Column, pattern: str) -> Column:
    """A timestamp by a C pattern."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"%[-_0]?([A-Za-z%])", pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        own = _STRFTIME[m[1]](time) if m[1] in _STRFTIME else F.lit(m[0])
        if m[0][1] == "-" and len(m[0]) == 3:
            own = F.regexp_replace(own, "^[0 ]+(?=.)", "")
        parts.append(own)
        at = m.end()
    if at < len(pattern):
        parts.append(F.lit(pattern[at:]))
    return F.concat(*parts) if parts else F.lit("")


_LETTERS = {
    "d": lambda t: _F(t, "dd"), "D": lambda t: _F(t, "EEE"), "j": lambda t: F.dayofmonth(t).cast("string"), "l": lambda t: _F(t, "EEEE"), "F": lambda t: _F(t, "MMMM"), "m": lambda t: _F(t, "MM"), "M": lambda t: _F(t, "MMM"), "n": lambda t: F.month(t).cast("string"),
    "Y": lambda t: _F(t, "yyyy"), "y": lambda t: _F(t, "yy"), "a": lambda t: F.lower(_F(t, "a")), "A": lambda t: _F(t, "a"), "g": lambda t: ((F.hour(t) + 11) % 12 + 1).cast("string"), "G": lambda t: F.hour(t).cast("string"), "h": lambda t: _F(t, "hh"), "H": lambda t: _F(t, "HH"), "i": lambda t: _F(t, "mm"), "s": lambda t: _F(t, "ss"),
    "c": lambda t: _F(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), "r": lambda t: _F(t, "EEE, dd MMM yyyy HH:mm:ss '+0000'"), "e": lambda t: F.lit("UTC"), "O": lambda t: F.lit("+0000"), "P": lambda t: F.lit("+00:00"), "T": lambda t: F.lit("UTC"), "I": lambda t: F.lit("0"), "Z": lambda t: F.lit("0"),
    "w": lambda t: (F.dayofweek(t) - 1).cast("string"), "N": lambda t: ((F.dayofweek(t) + 5) % 7 + 1).cast("string"), "z": lambda t: (F.dayofyear(t) - 1).cast("string"), "W": lambda t: _two(F.weekofyear(t)), "t": lambda t: F.dayofmonth(F.last_day(t)).cast("string"), "L": lambda t: _leap(t).cast("string"), "o": lambda t: iso_year(t).cast("string"), "U": lambda t: F.unix_seconds(t).cast("string"),
    "S": _suffix, "u": lambda t: F.lpad(F.pmod(F.unix_micros(t), F.lit(1000000)).cast("string"), 6, "0"), "v": lambda t: F.lpad(F.pmod(F.unix_millis(t), F.lit(1000)).cast("string"), 3, "0"),
}


def letters(time: Column, pattern: str) -> Column:
    """A timestamp by the markup's letter codes; quoted text and escaped letters stand for themselves."""
    parts: list[Column] = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == '"' and '"' in pattern[i + 1 :]:
            end = pattern.index('"', i + 1)
            parts.append(F.lit(pattern[i + 1 : end]))
            i = end + 1
            continue
        if c == "\\" and i + 1 < len(pattern):
            parts.append(F.lit(pattern[i + 1]))
            i += 2
            continue
        if pattern.startswith("xr", i):  # roman numerals of the number that follows
            parts.append(roman(_LETTERS[pattern[i + 2]](time).try_cast("int")) if i + 2 < len(pattern) else F.lit(""))
            i += 3
            continue
        if pattern.startswith("xn", i):
            i += 2
            continue
        parts.append(_LETTERS[c](time) if c in _LETTERS else F.lit(c))
        i += 1
    return F.concat(*parts) if parts else F.lit("")


def moment(t: dt.datetime, pattern: str) -> str:
    """``letters`` for one time in Python."""
    iso = t.isocalendar()
    day = t.day
    values = {
        "d": f"{day:02}", "D": f"{t:%a}", "j": str(day), "l": f"{t:%A}", "F": f"{t:%B}", "m": f"{t.month:02}", "M": f"{t:%b}", "n": str(t.month), "Y": f"{t.year:04}", "y": f"{t.year % 100:02}",
        "a": f"{t:%p}".lower(), "A": f"{t:%p}", "g": str((t.hour + 11) % 12 + 1), "G": str(t.hour), "h": f"{(t.hour + 11) % 12 + 1:02}", "H": f"{t.hour:02}", "i": f"{t.minute:02}", "s": f"{t.second:02}",
        "c": f"{t:%Y-%m-%dT%H:%M:%S}+00:00", "r": f"{t:%a, %d %b %Y %H:%M:%S} +0000", "e": "UTC", "O": "+0000", "P": "+00:00", "T": "UTC", "I": "0", "Z": "0",
        "w": str((t.weekday() + 1) % 7), "N": str(t.weekday() + 1), "z": str(t.timetuple().tm_yday - 1), "W": f"{iso[1]:02}", "t": str(calendar.monthrange(t.year, t.month)[1]), "L": str(int(calendar.isleap(t.year))), "o": str(iso[0]),
        "U": str(int(t.replace(tzinfo=dt.timezone.utc).timestamp())), "S": "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th"), "u": f"{t.microsecond:06}", "v": f"{t.microsecond // 1000:03}",
    }

    def one(m: re.Match) -> str:
        if m["quoted"] is not None or m["escaped"] is not None:
            return m["quoted"] if m["quoted"] is not None else m["escaped"]
        if m["roman"]:
            n = values.get(m["roman"], "")
            return _roman(int(n)) if n.isdigit() else n
        return "" if m[0] == "xn" else values.get(m[0], m[0])

    return re.sub(r'"(?P<quoted>[^"]*)"|\\(?P<escaped>.)|xr(?P<roman>.)|xn|.', one, pattern, flags=re.S)


def _roman(n: int) -> str:
    signs = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    out = ""
    for value, sign in signs:
        out += sign * (n // value)
        n %= value
    return out


def roman(n: Column) -> Column:
    """Roman numerals of 1 to 3999."""
    one = lambda d, a, b, c: F.element_at(F.array(*map(F.lit, ["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c])), (d % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), one(F.floor(n / 100), "C", "D", "M"), one(F.floor(n / 10), "X", "L", "C"), one(n, "I", "V", "X"))


def make(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A timestamp of parts that may overflow."""
    start = F.make_timestamp(F.floor(year + F.floor((month - 1) / 12)).cast("int"), (F.pmod(month - 1, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.timestamp_seconds(F.unix_seconds(start) + (day - 1) * 86400 + hour * 3600 + minute * 60 + second)


#: Units of durations in seconds; a year has 365.2425 days.
UNITS = [("millennia", 31556952000), ("centuries", 3155695200), ("decades", 315569520), ("years", 31556952), ("weeks", 604800), ("days", 86400), ("hours", 3600), ("minutes", 60), ("seconds", 1)]


def duration(seconds: Column, units: list[str] | None = None) -> Column:
    """A struct of whole units, largest first; the least unit takes the rest."""
    chosen = [(u, s) for u, s in UNITS if units is None or u in units]
    rest, out = seconds.cast("long"), []
    for u, s in chosen:
        out.append(F.floor(rest / s).cast("long").alias(u))
        rest = F.pmod(rest, F.lit(s))
    return F.struct(*out)


#: Words of the current time, each a code of ``letters``.
WORDS = {"day": "j", "day2": "d", "dayname": "l", "dow": "w", "hour": "H", "month": "m", "month1": "n", "month2": "m", "monthabbrev": "M", "monthname": "F", "time": "H:i", "timestamp": "YmdHis", "week": "W", "year": "Y"}


def time_word(name: str, clock: Column) -> Column:
    """currentday, localmonthname and the like; the clock is the dump's date."""
    base = re.sub("^(current|local)", "", name.lower())
    pattern = WORDS[base]
    text = letters(clock, pattern)
    return F.regexp_replace(text, "^0(?=.)", "") if base == "week" else text


# --- free text -------------------------------------------------------------------------------------

_MONTHS = {m: i for i, names in enumerate(["jan january i", "feb february ii", "mar march iii", "apr april iv", "may v", "jun june vi", "jul july vii", "aug august viii", "sep sept september ix", "oct october x", "nov november xi", "dec december xii"], 1) for m in names.split()}
_DAYS = {d: i for i, names in enumerate(["mon monday mondays", "tue tues tuesday tuesdays", "wed wednesday wednesdays", "thu thur thurs thursday thursdays", "fri friday fridays", "sat saturday saturdays", "sun sunday sundays"]) for d in names.split()}
_NUMBERS = {n: i for i, n in enumerate("zero first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split())} | {"next": 1, "last": -1, "previous": -1, "this": 0, "eight": 8}
_UNIT = {u: k for k, us in {"microsecond": "usec usecs microsecond microseconds µs", "millisecond": "ms msec msecs millisecond milliseconds", "second": "sec secs second seconds", "minute": "min mins minute minutes", "hour": "hour hours", "day": "day days", "weekday": "weekday weekdays", "week": "week weeks", "fortnight": "fortnight fortnights forthnight forthnights", "month": "month months", "year": "year years"}.items() for u in us.split()}
_ZONES = {"utc": 0, "gmt": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "cet": 1, "cest": 2, "bst": 1, "wet": 0, "west": 1, "eet": 2, "eest": 3, "msk": 3, "ist": 5.5, "jst": 9, "aest": 10, "aedt": 11}
_M = "(?P<mon>" + "|".join(sorted(_MONTHS, key=len, reverse=True)) + ")"
_D = "(?:" + "|".join(sorted(_DAYS, key=len, reverse=True)) + ")"
_TIME = r"(?P<h>[01]?\d|2[0-4])[:.](?P<mi>[0-5]?\d)(?:[:.](?P<s>[0-5]?\d|60)(?:[.,:](?P<f>\d+))?)?(?:[ \t]*(?P<ap>[ap])\.?m\.?(?![a-z]))?"
_RULES = [(n, re.compile(r, re.I)) for n, r in [
    ("stamp", r"@(?P<v>-?\d+)(?:\.(?P<f>\d{1,6}))?"),
    ("of", r"(?P<end>first|last) day of"),
    ("nth", r"(?P<n>" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + r")[ \t]+(?P<d>" + _D[3:-1] + r")[ \t]+of"),
    ("back", r"(?P<w>back|front) of[ \t]+(?P<h>\d{1,2})(?:[ \t]*(?P<ap>[ap])\.?m\.?)?"),
    ("soap", r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})T(?P<h>\d{2}):(?P<mi>\d{2}):(?P<s>\d{2})(?:[.,](?P<f>\d+))?"),
    ("soap", r"(?P<y>\d{4}):(?P<m>\d{2}):(?P<d>\d{2})[ T](?P<h>\d{2}):(?P<mi>\d{2}):(?P<s>\d{2})"),
    ("soap", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T(?P<h>\d{1,2}):?(?P<mi>\d{2}):?(?P<s>\d{2})"),
    ("soap", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?!\d)"),
    ("clf", r"(?P<d>\d{1,2})/" + _M + r"/(?P<y>\d{4}):(?P<h>\d{2}):(?P<mi>\d{2}):(?P<s>\d{2})"),
    ("week", r"(?P<y>\d{4})-?W(?P<w>[0-5]\d)(?:-?(?P<d>[0-7]))?(?!\d)"),
    ("doy", r"(?P<y>\d{4})[.-]?(?P<doy>[0-3]\d\d)(?![\d.:-])"),
    ("ymd", r"(?P<y>[+-]?\d{4})-(?P<m>1[0-2]|0?\d)-(?P<d>3[01]|[0-2]?\d)(?!\d)"),
    ("ymd", r"(?P<y>\d{4})/(?P<m>1[0-2]|0?\d)/(?P<d>3[01]|[0-2]?\d)(?!\d)/?"),
    ("ymd", r"(?P<m>1[0-2]|0?\d)/(?P<d>3[01]|[0-2]?\d)/(?P<y>\d{4}|\d{2})(?!\d)"),
    ("ymd", r"(?P<d>3[01]|[0-2]?\d)[.\t-](?P<m>1[0-2]|0?\d)[.-](?P<y>\d{4})(?!\d)"),
    ("ymd", r"(?P<d>3[01]|[0-2]?\d)\.(?P<m>1[0-2]|0?\d)\.(?P<y>\d{2})(?![\d:.])"),
    ("ymd", r"(?P<y>\d{2})-(?P<m>1[0-2]|0\d)-(?P<d>3[01]|[0-2]\d)(?!\d)"),
    ("ymd", r"(?P<y>\d{4})(?P<m>1[0-2]|0\d)(?P<d>3[01]|[0-2]\d)(?!\d)"),
    ("text", r"(?P<d>3[01]|[0-2]?\d)(?:st|nd|rd|th)?[ \t.-]*" + _M + r"(?![a-z])(?:[ \t.,-]*(?P<y>\d{4}|(?<=-)\d{2})(?![\d:]))?"),
    ("text", r"(?P<y>\d{4})[ \t.-]*" + _M + r"(?![a-z])[ \t.-]*(?P<d>3[01]|[0-2]?\d)(?!\d)"),
    ("text", _M + r"(?![a-z])[ \t.-]*(?P<d>3[01]|[0-2]?\d)(?:st|nd|rd|th)?(?![\d:])(?:[ \t.,-]+(?P<y>\d{4})(?![\d:]))?"),
    ("text", _M + r"(?![a-z])[ \t.-]*(?P<y>\d{4})(?!\d)"),
    ("text", r"(?P<y>\d{4})[ \t.-]*" + _M + r"(?![a-z])"),
    ("american", r"(?P<m>1[0-2]|0?\d)/(?P<d>3[01]|[0-2]?\d)(?![\d/])"),
    ("gnu", r"(?P<y>\d{4})-(?P<m>1[0-2]|0?\d)(?![\d-])"),
    ("time", r"t?" + _TIME),
    ("hour", r"(?P<h>1[0-2]|0?[1-9])[ \t]*(?P<ap>[ap])\.?m\.?(?![a-z])"),
    ("zone", r"(?:(?:utc|gmt)?(?P<sg>[+-])(?P<zh>\d{1,2}):?(?P<zm>[0-5]\d)?(?![\d:]|[ \t]*(?:" + "|".join(sorted(_UNIT, key=len, reverse=True)) + r")))"),
    ("relative", r"(?P<n>[+-]*[ \t]*\d+)[ \t]*(?P<u>" + "|".join(sorted(_UNIT, key=len, reverse=True)) + r")(?![a-z])(?P<ago>[ \t]+ago)?"),
    ("relday", r"(?P<n>[+-]+[ \t]*\d+|\d{1,2})[ \t]*(?P<d>" + _D[3:-1] + r")(?![a-z])(?P<ago>[ \t]+ago)?"),
    ("named", r"(?P<n>" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + r")[ \t]+(?P<u>" + "|".join(sorted(_UNIT, key=len, reverse=True)) + r")(?![a-z])(?P<ago>[ \t]+ago)?"),
    ("nameday", r"(?P<n>" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + r")[ \t]+(?P<d>" + _D[3:-1] + r")(?![a-z])(?P<ago>[ \t]+ago)?"),
    ("word", r"(?P<w>now|today|midnight|noon|tomorrow|yesterday)(?![a-z])"),
    ("day", r"(?P<d>" + _D[3:-1] + r")(?![a-z])"),
    ("month", _M + r"(?![a-z])"),
    ("tz", r"\(?(?P<tz>[A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?|" + "|".join(sorted(_ZONES, key=len, reverse=True)) + r")\)?(?![a-z])"),
    ("year", r"(?P<y>\d{4})(?!\d)"),
    ("skip", r"[ \t,;.]+|[T](?=\d)"),
]]


def _hour(h: int, ap: str | None) -> int:
    if not ap:
        return h
    return h % 12 + (12 if ap.lower() == "p" else 0)


def _year(y: str) -> int:
    n = int(y)
    return n if len(y.lstrip("+-")) > 2 else n + (2000 if n < 70 else 1900)


def parse_time(text: str, now: dt.datetime, zone: str = "UTC") -> dt.datetime | None:
    """A free-text date as an aware UTC datetime, or None. Fields that the text leaves open come from ``now``."""
    try:
        return _parse(text, now, zone)
    except (ValueError, OverflowError):  # a part is out of range
        return None


@functools.lru_cache(1 << 16)
def _known(text: str, now: dt.datetime, zone: str) -> dt.datetime | None:
    """``parse_time``, remembered: columns hold the same dates again and again."""
    return parse_time(text, now, zone)


def _parse(text: str, now: dt.datetime, zone: str) -> dt.datetime | None:
    y = m = d = h = None
    mi = s = us = 0
    tz: dt.tzinfo = ZoneInfo(zone)
    rel = dict.fromkeys(["month", "day", "second", "us", "weekdays"], 0)
    weekday: tuple[int, int] | None = None
    counts_today = ago = weekdays = False
    special: tuple | None = None
    stamp = None
    reset = False
    i, body = 0, text.strip()
    if not body:
        return now.astimezone(dt.timezone.utc)
    while i < len(body):
        for name, rule in _RULES:
            if g := rule.match(body, i):
                break
        else:
            return None
        i = g.end()
        v = g.groupdict()
        if name == "stamp":
            stamp, us, tz = int(v["v"]), int((v["f"] or "0").ljust(6, "0")), dt.timezone.utc
            y, m, d, h, mi, s = 1970, 1, 1, 0, 0, 0
            rel["second"] += stamp
        elif name in ("soap", "clf"):
            y, d, h, mi, s = int(v["y"]), int(v["d"]), int(v["h"]), int(v["mi"]), int(v["s"])
            m = _MONTHS[v["mon"].lower()] if name == "clf" else int(v["m"])
            us = int((v.get("f") or "0")[:6].ljust(6, "0"))
        elif name == "week":
            first = dt.date(int(v["y"]), 1, 4)
            day = first - dt.timedelta(days=first.weekday()) + dt.timedelta(weeks=int(v["w"]) - 1, days=int(v["d"] if v["d"] is not None else 1) - 1)
            y, m, d, reset = day.year, day.month, day.day, True
        elif name == "doy":
            day = dt.date(int(v["y"]), 1, 1) + dt.timedelta(days=int(v["doy"]) - 1)
            y, m, d, reset = day.year, day.month, day.day, True
        elif name == "ymd":
            y, m, d, reset = _year(v["y"]), int(v["m"]), int(v["d"]), True
        elif name == "gnu":
            y, m, d, reset = int(v["y"]), int(v["m"]), 1, True
        elif name == "american":
            m, d, reset = int(v["m"]), int(v["d"]), True
        elif name == "text":
            m, reset = _MONTHS[v["mon"].lower()], True
            d = int(v["d"]) if v.get("d") else 1
            if v.get("y"):
                y = _year(v["y"])
        elif name == "month":
            m = _MONTHS[v["mon"].lower()]
        elif name == "year":
            if h is None and reset is False and y is None and int(v["y"][:2]) < 24 and int(v["y"][2:]) < 60:
                h, mi, s, us = int(v["y"][:2]), int(v["y"][2:]), 0, 0  # four digits alone are a time of day
            else:
                y = int(v["y"])
        elif name == "time":
            h, mi, s = _hour(int(v["h"]), v["ap"]), int(v["mi"]), int(v["s"] or 0)
            us = int((v["f"] or "0")[:6].ljust(6, "0"))
        elif name == "hour":
            h, mi, s, us = _hour(int(v["h"]), v["ap"]), 0, 0, 0
        elif name == "back":
            h, mi, s, us = _hour(int(v["h"]), v["ap"]) - (v["w"].lower() == "front"), 45 if v["w"].lower() == "front" else 15, 0, 0
        elif name == "zone":
            off = (int(v["zh"]) * 60 + int(v["zm"] or 0)) * (-1 if v["sg"] == "-" else 1)
            tz = dt.timezone(dt.timedelta(minutes=off))
        elif name == "tz":
            low = v["tz"].lower()
            try:
                tz = dt.timezone(dt.timedelta(hours=_ZONES[low])) if low in _ZONES else ZoneInfo(v["tz"])
            except (KeyError, ValueError, OSError):
                return None
        elif name == "word":
            w = v["w"].lower()
            if w != "now":
                h, mi, s, us = 12 if w == "noon" else 0, 0, 0, 0
                rel["day"] += {"tomorrow": 1, "yesterday": -1}.get(w, 0)
        elif name in ("relative", "named"):
            raw = v["n"].lower()
            n = _NUMBERS[raw] if name == "named" else int(re.sub(r"[^\d]", "", raw)) * (-1 if raw.count("-") % 2 else 1)
            n = -n if v["ago"] else n
            u = _UNIT[v["u"].lower()]
            if u in ("year", "month"):
                rel["month"] += n * (12 if u == "year" else 1)
            elif u in ("day", "week", "fortnight"):
                if u == "week" and name == "named" and raw in ("next", "last", "previous", "this"):
                    special = ("week", n)  # a day of that week, Monday if none is named
                else:
                    rel["day"] += n * {"day": 1, "week": 7, "fortnight": 14}[u]
            elif u == "weekday":
                rel["weekdays"] += n
                weekdays = True
            elif u in ("microsecond", "millisecond"):
                rel["us"] += n * (1 if u == "microsecond" else 1000)
            else:
                rel["second"] += n * {"second": 1, "minute": 60, "hour": 3600}[u]
        elif name == "day":
            weekday = (_DAYS[v["d"].lower()], 0)
            if h is None:
                h = mi = s = us = 0
        elif name in ("nameday", "relday"):
            raw = v["n"].lower()
            n = _NUMBERS[raw] if name == "nameday" else int(re.sub(r"[^\d]", "", raw)) * (-1 if raw.count("-") % 2 else 1)
            weekday = (_DAYS[v["d"].lower()], n)
            counts_today, ago = name == "relday", bool(v["ago"])
            if h is None and name == "nameday":
                h = mi = s = us = 0
        elif name == "of":
            special = (v["end"].lower(),)
        elif name == "nth":
            special = ("nth", _NUMBERS[v["n"].lower()], _DAYS[v["d"].lower()])
            if h is None:
                h = mi = s = us = 0
    if stamp is not None:
        tz = dt.timezone.utc  # a zone beside a stamp says nothing
    local = now.astimezone(tz)
    if h is None:
        if reset or y is not None and stamp is None:
            h = mi = s = us = 0
        else:
            h, mi, s, us = local.hour, local.minute, local.second, local.microsecond
    y, m, d = (local.year if y is None else y), (local.month if m is None else m), (local.day if d is None else d)
    k = y * 12 + m - 1 + rel["month"]
    y, m = divmod(k, 12)
    m += 1
    if special and special[0] in ("first", "last"):
        d = 1
        if special[0] == "last":
            m, rel["day"] = m + 1, rel["day"] - 1
    if m > 12:
        y, m = y + 1, m - 12
    if not 1 <= y <= 9999 or d > 31:
        return None
    day = dt.date(y, m, 1)
    if special and special[0] == "nth":
        n, want = special[1], special[2]
        if n >= 0:
            day += dt.timedelta(days=(want - day.weekday()) % 7 + 7 * (max(n, 1) - 1))
        else:
            after = dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1)
            day = after - dt.timedelta(days=(after.weekday() - want) % 7)
        day += dt.timedelta(days=rel["day"])
    else:
        day += dt.timedelta(days=d - 1)
        if special and special[0] == "week":
            day += dt.timedelta(days=(weekday[0] if weekday else 0) - day.weekday() + 7 * special[1])
        elif weekday:
            want, n = weekday
            ahead, back = (want - day.weekday()) % 7, (day.weekday() - want) % 7
            if ago:  # so many weeks less one before the day's last occurrence
                day -= dt.timedelta(days=(back or 7) + 7 * (n - 1 if n > 0 else n))
            elif n > 0:
                day += dt.timedelta(days=(ahead if counts_today else ahead or 7) + 7 * (n - 1))
            elif n < 0:
                day -= dt.timedelta(days=(back or 7) + 7 * (-n - 1))
            else:
                day += dt.timedelta(days=ahead)
        day += dt.timedelta(days=rel["day"])
    while weekdays and not rel["weekdays"] and day.weekday() > 4:
        day += dt.timedelta(days=1)
    step = 1 if rel["weekdays"] >= 0 else -1
    for _ in range(abs(rel["weekdays"])):
        day += dt.timedelta(days=step)
        while day.weekday() > 4:
            day += dt.timedelta(days=step)
    at = dt.datetime(day.year, day.month, day.day, tzinfo=tz) + dt.timedelta(hours=h, minutes=mi)
    at = at.replace(tzinfo=tz)
    return (at + dt.timedelta(seconds=s)).astimezone(dt.timezone.utc) + dt.timedelta(seconds=rel["second"], microseconds=us + rel["us"])


def free_text(text: Column, now: dt.datetime, zone: str = "UTC") -> Column:
    """A Column of free-text dates as timestamps, null where unreadable. ISO forms don't reach Python."""
    @F.pandas_udf("timestamp")
    def residual(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _known(x, now, zone) for x in s], dtype="datetime64[us, UTC]")

    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2})?$")
    return F.coalesce(F.when(iso, F.try_to_timestamp(text)), residual(F.when(~iso, text)))


def time_argument(text: Column, now: dt.datetime) -> Column:
    """The date argument of the time function: four digits are a year, empty text is the clock."""
    year = text.rlike(r"^\d{4}$")
    return F.when(F.trim(text) == "", F.lit(now)).when(year, F.make_timestamp(text.try_cast("int"), F.month(F.lit(now)), F.dayofmonth(F.lit(now)), F.lit(0), F.lit(0), F.lit(0))).otherwise(free_text(text, now))


def os_date(time: Column, pattern: str = "%c") -> Column:
    """A script's date: a C pattern, in UTC with or without '!', or with '*t' a struct of the parts."""
    pattern = pattern.removeprefix("!")
    if pattern != "*t":
        return strftime(time, pattern)
    return F.struct(F.year(time).alias("year"), F.month(time).alias("month"), F.dayofmonth(time).alias("day"), F.hour(time).alias("hour"), F.minute(time).alias("min"), F.floor(F.second(time)).cast("int").alias("sec"), F.dayofweek(time).alias("wday"), F.dayofyear(time).alias("yday"), F.lit(False).alias("isdst"))


def os_time(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None, second: Column | None = None) -> Column:
    """Epoch seconds of parts that may overflow; noon if no hour is given."""
    return F.unix_seconds(make(year, month, day, F.lit(12) if hour is None else hour, F.lit(0) if minute is None else minute, F.lit(0) if second is None else second))


# --- zones and auto formats ------------------------------------------------------------------------


def in_zone(time: Column, zone: str | Column) -> Column:
    """The wall clock of a zone at an instant."""
    return F.from_utc_timestamp(time, zone)


def offset_seconds(time: Column, zone: str) -> Column:
    """Seconds east of UTC of a zone at an instant."""
    return F.unix_seconds(F.from_utc_timestamp(time, zone)) - F.unix_seconds(time)


def is_dst(time: Column, zone: str) -> Column:
    """Whether a zone is ahead of the lesser of its January and July offsets at an instant."""
    year = F.year(time)
    ends = [offset_seconds(F.make_timestamp(year, F.lit(m), F.lit(1), F.lit(12), F.lit(0), F.lit(0)), zone) for m in (1, 7)]
    return offset_seconds(time, zone) > F.least(*ends)


def truncated(time: Column, unit: str) -> Column:
    """Cut to day, hour, minute, second or millisecond."""
    return F.date_trunc(unit, time)


def auto_format(time: Column) -> Column:
    """The shortest text that says what a time tick begins: a year, month, day, hour, minute, second or less."""
    at = lambda unit: F.date_trunc(unit, time) == time
    return F.when(at("year"), strftime(time, "%Y")).when(at("month"), strftime(time, "%B")).when(at("day") & (F.dayofweek(time) == 1), strftime(time, "%b %d")).when(at("day"), strftime(time, "%a %d")).when(at("hour"), strftime(time, "%I %p")).when(at("minute"), strftime(time, "%I:%M")).when(at("second"), F.concat(F.lit(":"), strftime(time, "%S"))).otherwise(F.concat(F.lit("."), strftime(time, "%L")))
