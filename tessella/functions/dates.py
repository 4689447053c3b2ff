"""Dates: strftime patterns as Spark patterns, and nanoseconds since the epoch."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strftime directives and the pattern letters that mean the same.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "j": "DDD", "z": "xx", "Z": "VV",
}
#: Directives that stand for several.
COMPOSED = {"D": "%m/%d/%y", "F": "%Y-%m-%d", "T": "%H:%M:%S", "R": "%H:%M"}
#: A directive (with a flag: - or # for no leading zeros, ^ for capitals; or digits of a second) or literal text.
PIECE = re.compile(r"%([-#^]?)(\d?)([A-Za-z%])|([^%]+)")
#: Names that are left out before a string is parsed: Spark's patterns have them in formatting only.
WEEKDAY = r"(?i)(?<![a-z])(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?(?![a-z])"
#: A year of two digits from this one on is of the last century.
PIVOT = 69


def pieces(pattern: str) -> list[tuple[str, str, str, str]]:
    """Flag, digits, directive and literal text of each piece of a strftime pattern."""
    for short, long in COMPOSED.items():
        pattern = pattern.replace(f"%{short}", long)
    out = PIECE.findall(pattern)
    for _, _, directive, _ in out:
        if directive and directive not in DIRECTIVES and directive not in "%P":
            raise ValueError(f"unknown directive %{directive}")
    if sum(len(f) + len(n) + len(t) + 2 * bool(d) for f, n, d, t in out) != len(pattern):
        raise ValueError(f"the pattern {pattern!r} ends within a directive")
    return out


def spark_pattern(pattern: str, parsing: bool = False) -> str:
    """A strftime pattern as one of Spark's; in parsing, single digits of day, month and hour are taken too."""
    own, out = pieces(pattern), []
    for at, (_, digits, directive, literal) in enumerate(own):
        if not directive or directive == "%":
            text = (literal or "%").replace("'", "''")
            out.append(f"'{text}'" if re.search(r"[A-Za-z\[\]#{}]", text) else text)
        elif parsing and directive in "aA":
            continue
        elif parsing and directive == "z":
            out.append("[XXX][XX][X]")
        else:
            letters = DIRECTIVES[directive.lower() if directive == "P" else directive]
            touches = any(0 <= k < len(own) and own[k][2] and own[k][2] not in "%pPzZaAbB" for k in (at - 1, at + 1))
            if directive == "f":
                letters = "S" * (int(digits or 6) if touches or not parsing else 9)
            out.append(letters[0] if parsing and not touches and letters in ("MM", "dd", "HH", "hh") else letters)
    return "".join(out)


def has_zone(pattern: str | None) -> bool:
    return bool(pattern) and ("%z" in pattern or "%Z" in pattern)


DAY = 86_400_000_000


def micros(x: Column, kind: T.DataType, pattern: str | None) -> Column:
    """Microseconds since the epoch; null where a string doesn't fit the pattern.

    A value without a zone (a date, a timestamp without one, most strings) counts as UTC,
    whatever zone the session has.
    """
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("long") * DAY
    if isinstance(kind, T.TimestampNTZType):
        # by parts: a difference of timestamps would be one of the session's zone
        seconds = F.hour(x) * 3600 + F.minute(x) * 60
        return F.unix_date(x.cast("date")).cast("long") * DAY + seconds.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), x) * 1_000_000).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x)
    text = x.cast("long").cast("string") if isinstance(kind, (T.DoubleType, T.FloatType)) else x.cast("string")
    if pattern is None:
        return F.coalesce(F.unix_micros(F.when(offset_of(text) != "", text).try_cast("timestamp")), micros(text.try_cast("timestamp_ntz"), T.TimestampNTZType(), None))
    if not isinstance(kind, T.StringType) and pattern[:2] in ("%m", "%d"):
        text = whole_pairs(text)
    own = spark_pattern(pattern, parsing=True)
    if "%A" in pattern or "%a" in pattern or "%^A" in pattern or "%^a" in pattern:
        text = F.regexp_replace(text, WEEKDAY, "")
    if not has_zone(pattern):
        text, own = F.concat(text, F.lit(" UTC")), f"{own} VV"
    found = F.unix_micros(F.try_to_timestamp(text, F.lit(own)))
    if "%y" not in pattern:
        return found
    # the parser's century is 2000 to 2099; from there to a hundred years before, there are 36525 days
    return F.when(found >= F.lit(((2000 + PIVOT - 1970) * 365 + (2000 + PIVOT - 1 - 1968) // 4) * DAY), found - F.lit(36525 * DAY)).otherwise(found)


def whole_pairs(text: Column) -> Column:
    """Digits of a number, which has no leading zero, as pairs of digits."""
    return F.when(F.length(text) % 2 == 1, F.concat(F.lit("0"), text)).otherwise(text)


def nanoseconds(micros: Column) -> Column:
    """Nanoseconds as a double."""
    return micros.cast("double") * F.lit(1000.0)


def to_kind(micros: Column, kind: T.DataType) -> Column:
    """Microseconds since the epoch as a date or timestamp."""
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.call_function("div", micros - F.pmod(micros, F.lit(DAY)), F.lit(DAY)).cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(micros)
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


def in_zone(micros: Column, zone: str) -> Column:
    """The microseconds that a zone's clock shows."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone))


def formatted(micros: Column, pattern: str) -> Column:
    """Text by a strftime pattern without zones: days by Spark's patterns, the clock by arithmetic, so no session's zone comes in."""
    clock = F.pmod(micros, F.lit(DAY))
    hour = F.call_function("div", clock, F.lit(3_600_000_000))
    half = F.when(hour < 12, F.lit("AM")).otherwise(F.lit("PM"))
    of_clock = {"H": hour, "I": (hour + 11) % 12 + 1, "M": F.call_function("div", clock, F.lit(60_000_000)) % 60, "S": F.call_function("div", clock, F.lit(1_000_000)) % 60}
    day, out = to_kind(micros, T.DateType()), []
    for flag, digits, directive, literal in pieces(pattern):
        if literal or directive == "%":
            out.append(F.lit(literal or "%"))
        elif directive in of_clock:
            text = of_clock[directive].cast("string")
            out.append(text if flag in ("-", "#") else F.lpad(text, 2, "0"))
        elif directive == "f":
            n = int(digits or 6)
            out.append(F.lpad(F.call_function("div", clock % 1_000_000, F.lit(10 ** (6 - n))).cast("string"), n, "0"))
        elif directive in "pP":
            out.append(half if directive == "p" else F.lower(half))
        else:
            letters = DIRECTIVES[directive]
            text = F.date_format(day, letters[0] if flag in ("-", "#") and letters in ("MM", "dd", "DDD") else letters)
            out.append(F.upper(text) if flag == "^" else text)
    return F.concat(*out) if out else F.lit("")


def offset_of(text: Column) -> Column:
    """The zone offset or name at the end of a string."""
    return F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2}|(?<=:\d{2}[.,\d]{0,10} {0,1})[+-]\d{2}|[A-Z]{3,5}|[A-Za-z]+/[A-Za-z_]+)$", 1)
