"""Enumeration of the strings that a regex matches, as a mixed-radix number per string.

A pattern becomes a tree of alphabets, sequences and choices. String number i is read
off i's digits, the last place changing fastest and shorter repeats coming first, so
any task makes any string without the ones before. A repeat that may be left out is
made once at least.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from re import _constants as names
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Repetitions that an unbounded repeat may have.
MOST_REPEATS = 16
#: Numbers that columns can hold; strings beyond aren't reached by row numbers.
MOST_NUMBERS = (1 << 63) - 1
PRINTABLE = string.printable
CLASSES = {
    names.CATEGORY_DIGIT: string.digits,
    names.CATEGORY_WORD: "".join(c for c in PRINTABLE if c.isalnum() or c == "_"),
    names.CATEGORY_SPACE: "".join(c for c in PRINTABLE if c.isspace()),
}
OPPOSITES = {names.CATEGORY_NOT_DIGIT: names.CATEGORY_DIGIT, names.CATEGORY_NOT_WORD: names.CATEGORY_WORD, names.CATEGORY_NOT_SPACE: names.CATEGORY_SPACE}


def _class(kind) -> str:
    return CLASSES[kind] if kind in CLASSES else "".join(c for c in PRINTABLE if c not in CLASSES[OPPOSITES[kind]])


def _set(items) -> str:
    out = ""
    for op, arg in items:
        if op is names.LITERAL:
            out += chr(arg)
        elif op is names.RANGE:
            out += "".join(map(chr, range(arg[0], arg[1] + 1)))
        elif op is names.CATEGORY:
            out += _class(arg)
        else:
            raise ValueError(f"{op} isn't supported in a set")
    return out


@dataclass(frozen=True)
class Alphabet:
    """One character of several."""

    characters: str

    @property
    def size(self) -> int:
        return len(self.characters)

    def string(self, i: int) -> str:
        return self.characters[i]

    def column(self, i: Column) -> Column:
        return F.lit(self.characters) if self.size == 1 else F.substr(F.lit(self.characters), (i + 1).cast("int"), F.lit(1))


@dataclass(frozen=True)
class Sequence:
    """Parts after one another."""

    parts: tuple

    @property
    def size(self) -> int:
        return math.prod(p.size for p in self.parts)

    def string(self, i: int) -> str:
        out = []
        for p in reversed(self.parts):
            i, own = divmod(i, p.size)
            out.append(p.string(own))
        return "".join(reversed(out))

    def column(self, i: Column) -> Column:
        out, weight = [], 1
        for p in reversed(self.parts):
            if weight > MOST_NUMBERS:
                out.append(F.lit(p.string(0)))
                continue
            own = F.call_function("div", i, F.lit(weight)) if weight > 1 else i
            out.append(p.column(own % F.lit(p.size) if p.size <= MOST_NUMBERS else own))
            weight *= p.size
        return F.concat(*reversed(out)) if len(out) != 1 else out[0]


@dataclass(frozen=True)
class Choice:
    """One part of several."""

    parts: tuple

    @property
    def size(self) -> int:
        return sum(p.size for p in self.parts)

    def string(self, i: int) -> str:
        for p in self.parts:
            if i < p.size:
                return p.string(i)
            i -= p.size
        raise IndexError("beyond the pattern's strings")

    def column(self, i: Column) -> Column:
        out, before = None, 0
        for p in self.parts:
            if before > MOST_NUMBERS:
                break
            made, fits = p.column(i - F.lit(before) if before else i), i < F.lit(min(before + p.size, MOST_NUMBERS))
            out = F.when(fits, made) if out is None else out.when(fits, made)
            before += p.size
        return out


def _sequence(items) -> Sequence:
    parts = []
    for op, arg in items:
        if op is names.LITERAL:
            parts.append(Alphabet(chr(arg)))
        elif op is names.IN:
            parts.append(Alphabet(_set(arg)))
        elif op is names.ANY:
            parts.append(Alphabet(PRINTABLE))
        elif op is names.CATEGORY:
            parts.append(Alphabet(_class(arg)))
        elif op is names.SUBPATTERN:
            parts.append(_sequence(arg[-1]))
        elif op is names.MAX_REPEAT:
            low, high, body = arg
            once, high = _sequence(body), MOST_REPEATS if high is names.MAXREPEAT else high
            repeats = tuple(Sequence((once,) * times) for times in range(max(low, 1), high + 1))
            parts += [repeats[0] if len(repeats) == 1 else Choice(repeats)] if repeats else []
        elif op is not names.AT:
            raise ValueError(f"{op} isn't supported in a pattern")
    return Sequence(tuple(parts))


def enumeration(pattern: str) -> Sequence:
    """The strings of a pattern, in order."""
    found = _sequence(parser.parse(pattern))
    if not found.parts:
        raise ValueError("the pattern makes no strings")
    return found
