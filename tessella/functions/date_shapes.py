"""Patterns of date strings, inferred from their shapes and from the extremes of their numbers.

One scan turns each string into its shape (digits become 9) and keeps, by shape, the
extremes of the runs of digits. Here, shapes that differ only in the length of a number or
in the name of a month or weekday become one form; a form's numbers get the roles of year,
month, day, hour and so on in the order that suits their extremes. Where several orders
suit, the one that is usual for the separator holds: the day first with dots, else the
month. A form is a strftime pattern, with %-d for numbers without leading zeros, %3f for
three digits of a second, %P for a small am or pm, and %^b for a month in capitals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes that a column of dates may have, and characters of a date.
MOST_SHAPES, MOST_CHARACTERS = 4096, 64
#: Runs of digits whose extremes are kept; a run of more than five digits counts as pairs.
NUMBERS = 7
TOO_LONG = "too long"

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
#: Words that may stand between numbers.
BETWEEN = {"t", "at", "of", "on", "um", "de", "le"}
ZONE = re.compile(r"(?<=[9Mm])( ?)([+-]99(?::?99)?|Z|[A-Z]{3,5}|[A-Z][A-Za-z]+/[A-Z][A-Za-z_]+)$")
TOKEN = re.compile(r"9+|[^\W\d_]+|.", re.DOTALL)

#: What a number may be, as the least and the largest value.
RANGES = {"Y": (1, 9999), "y": (0, 99), "m": (1, 12), "d": (1, 31), "j": (1, 366), "H": (0, 23), "I": (1, 12), "M": (0, 59), "S": (0, 59)}


def shape(text: Column) -> Column:
    return F.when(F.length(text) > MOST_CHARACTERS, F.lit(TOO_LONG)).otherwise(F.translate(text, "012345678", "9" * 9))


def extremes(text: Column) -> list[Column]:
    """Aggregates: the least and the largest of each number."""
    numbers = F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{1,5}(?!\d)|\d\d"), F.lit(0))
    each = [F.get(numbers, F.lit(i)).cast("int") for i in range(NUMBERS)]
    return [F.array(*[F.min(n) for n in each]).alias("lows"), F.array(*[F.max(n) for n in each]).alias("highs")]


@dataclass
class Part:
    """A part of a form: a role or a literal, with the widths and the extremes that were seen."""

    kind: str
    text: str = ""
    place: int = 0
    widths: set[int] = field(default_factory=set)
    lows: list[int] = field(default_factory=list)
    highs: list[int] = field(default_factory=list)

    @property
    def key(self) -> tuple[str, str]:
        return self.kind, self.text

    def suits(self, role: str, at: int = 0) -> bool:
        low, high = RANGES[role]
        return self.lows[at] >= low and self.highs[at] <= high

    def merge(self, other: Part) -> None:
        self.widths |= other.widths
        self.lows = list(map(min, self.lows, other.lows))
        self.highs = list(map(max, self.highs, other.highs))


def _case(word: str) -> str:
    return "^" if word.isupper() and len(word) > 1 else ""


def _word(word: str) -> Part | None:
    small = word.lower()
    if small in MONTHS and small != "may":
        return Part("B", _case(word))
    if small in {m[:3] for m in MONTHS}:
        return Part("b", _case(word))
    if small in WEEKDAYS:
        return Part("A", _case(word))
    if small in {w[:3] for w in WEEKDAYS}:
        return Part("a", _case(word))
    if small in ("am", "pm"):
        return Part("P" if word.islower() else "p")
    return Part("literal", word) if small in BETWEEN else None


def parts_of(raw: str, lows: list[int | None], highs: list[int | None]) -> list[Part] | None:
    """The parts of a shape, with the clock's numbers told by their colons; None for what is no date."""
    zone = ZONE.search(raw)
    if zone and not re.search(r"(:99([.,]9+)?|[Tt]9{4,6}([.,]9+)?|9{12,14}([.,]9+)?|[AaPp][Mm])$", raw[: zone.start()]):
        zone = None  # a zone comes right after a time
    out: list[Part] = []
    place = 0
    for token in TOKEN.findall(raw[: zone.start()] if zone else raw):
        if token[0] == "9":
            width = len(token)
            count = 1 if width <= 5 else width // 2
            part = Part({1: "number", 2: "number"}.get(width, f"run{width}"), place=place, widths={width})
            part.lows, part.highs = (list(x[place : place + count]) for x in (lows, highs))
            place += count
        elif token.isalpha():
            part = _word(token)
            if part is None:
                return None
        else:
            part = Part("literal", token)
        out.append(part)
    _clock(out)
    if zone:
        out += [Part("literal", " ")] * len(zone[1]) + [Part("z" if zone[2][0] in "+-Z" else "Z")]
    return out


def _clock(parts: list[Part]) -> None:
    """Give roles to hour, minute, second and fraction: numbers around colons, or a run after a T or a date's run."""

    def literal(k: int, among: str) -> bool:
        return k < len(parts) and parts[k].kind == "literal" and parts[k].text in among

    def numeric(k: int) -> bool:
        return k < len(parts) and (parts[k].kind == "number" or parts[k].kind.startswith("run"))

    at = next((k for k in range(len(parts)) if parts[k].kind == "number" and literal(k + 1, ":") and numeric(k + 2)), None)
    if at is not None:
        parts[at].kind, parts[at + 2].kind = "H", "M"
        last = at + 2
        if literal(last + 1, ":") and numeric(last + 2):
            parts[last + 2].kind = "S"
            last += 2
    else:
        found = [k for k in range(1, len(parts)) if parts[k].kind in ("run4", "run6") and (literal(k - 1, "Tt") or literal(k - 1, " _-") and parts[k - 2].kind == "run8")]
        if not found:
            last = next((k for k in range(len(parts)) if parts[k].kind == "run14"), len(parts))
        else:
            last = found[0]
            parts[last].kind = "HMS" if parts[last].kind == "run6" else "HM"
    if last < len(parts) and (parts[last].kind in ("S", "HMS", "run14")) and literal(last + 1, ".,") and numeric(last + 2):
        parts[last + 2].kind = "f"


def _directive(role: str, part: Part) -> str:
    if role == "f":
        width = next(iter(part.widths)) if len(part.widths) == 1 else 6
        return "%f" if width >= 6 else f"%{width}f"
    loose = role in "mdHI" and 1 in part.widths
    return f"%{'-' if loose else ''}{role}"


def _runs(part: Part, twelve: bool) -> str | None:
    """The pattern of a run of digits without separators."""
    clock = {"HMS": ["HMS"], "HM": ["HM"]}.get(part.kind)
    dates = {"run8": ["Ymd", "mdY", "dmY"], "run6": ["ymd", "mdy", "dmy"], "run12": ["YmdHM", "ymdHMS"], "run14": ["YmdHMS"]}.get(part.kind, clock or [])
    for roles in dates:
        at, good = 0, True
        for role in roles:
            if role == "Y":
                good &= 10 <= part.lows[at] and part.highs[at] <= 29  # the century
                at += 2
            else:
                good &= part.suits(role, at)
                at += 1
        if good:
            return "".join(f"%{'I' if r == 'H' and twelve else r}" for r in roles)
    return None


def _date_roles(numbers: list[Part], named_month: bool, separator: str) -> str | None:
    """A role for each number of the date, in order; None if no order suits."""
    wide = [k for k, p in enumerate(numbers) if p.kind == "run4"]
    if len(wide) > 1 or any(p.kind not in ("number", "run4", "run3") for p in numbers):
        return None
    if wide:
        short = len(numbers) - 1
        orders = {0: [""], 1: ["d"] if named_month else ["j"] if any(p.kind == "run3" for p in numbers) else ["m"], 2: [] if named_month else ["md", "dm"]}.get(short, [])
        if short == 2 and separator == "." and wide[0] == 2:
            orders = ["dm", "md"]
        orders = [o[: wide[0]] + "Y" + o[wide[0] :] for o in orders]
    elif named_month:
        orders = ["dy"] if len(numbers) == 2 else []
    else:
        orders = (["dmy", "mdy", "ymd"] if separator == "." else ["mdy", "dmy", "ymd"]) if len(numbers) == 3 else []
    return next((o for o in orders if all(p.suits(r) and (p.kind == "run3") == (r == "j") for p, r in zip(numbers, o, strict=True))), None)


def pattern_of(parts: list[Part]) -> str | None:
    """The strftime pattern of a form, or None if its numbers make no date."""
    twelve = any(p.kind in "pP" for p in parts)
    clock = {"H": "I" if twelve else "H", "M": "M", "S": "S"}
    if any(p.kind in clock and not p.suits(clock[p.kind]) for p in parts):
        return None
    numbers = [p for p in parts if p.kind in ("number", "run3", "run4")]
    runs = [p for p in parts if p.kind in ("run6", "run8", "run12", "run14")]
    named = sum(p.kind in "Bb" for p in parts)
    if len(runs) > 1 or runs and (numbers or named) or named > 1:
        return None
    separator = next((parts[k + 1].text for k in range(len(parts) - 1) if parts[k].kind in ("number", "run4") and parts[k + 1].kind == "literal"), "")
    roles = "" if runs else _date_roles(numbers, bool(named), separator)
    if roles is None or not runs and not roles:
        return None
    of_date, out = iter(roles), []
    for p in parts:
        if p.kind == "literal":
            out.append("%%" if p.text == "%" else p.text)
        elif p.kind in ("number", "run3", "run4"):
            out.append(_directive(next(of_date), p))
        elif p.kind in ("run6", "run8", "run12", "run14", "HMS", "HM"):
            own = _runs(p, twelve)
            if own is None:
                return None
            out.append(own)
        elif p.kind in clock or p.kind == "f":
            out.append(_directive(clock.get(p.kind, "f"), p))
        else:
            out.append(f"%{p.text}{p.kind}")
    return "".join(out)


def infer(seen: list[tuple[str, int, list, list]]) -> tuple[list[str], str | None]:
    """Patterns for the shapes (shape, rows, lows, highs), of the most frequent form first, and a shape that has none."""
    forms: dict[tuple, list[Part]] = {}
    rows: dict[tuple, int] = {}
    example: dict[tuple, str] = {}
    for raw, n, lows, highs in sorted(seen):
        parts = parts_of(raw, lows, highs)
        if parts is None:
            return [], raw
        key = tuple(p.key for p in parts)
        if key in forms:
            for own, other in zip(forms[key], parts, strict=True):
                own.merge(other)
        forms.setdefault(key, parts)
        rows[key] = rows.get(key, 0) + n
        example.setdefault(key, raw)
    _short_may(forms, rows)
    out: list[str] = []
    for key in sorted(forms, key=lambda k: (-rows[k], k)):
        found = pattern_of(forms[key])
        if found is None:
            return [], example[key]
        if found not in out:
            out.append(found)
    return out, None


def _short_may(forms: dict[tuple, list[Part]], rows: dict[tuple, int]) -> None:
    """May is a whole and a short name: it goes with the form that has the other months."""
    for key in list(forms):
        whole = tuple(("B", t) if k == "b" else (k, t) for k, t in key)
        if whole != key and whole in forms:
            for own, other in zip(forms[whole], forms[key], strict=True):
                own.merge(other)
            rows[whole] += rows.pop(key)
            del forms[key]
