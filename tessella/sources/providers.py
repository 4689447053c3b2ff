"""Fake values: templates over small word lists, filled from random numbers by key or from the digits of a rank.

A provider gives a column from a function that draws numbers for its parts. Draws are
uniform numbers of a row's key, or, where no value may come twice, the digits of a rank in
mixed radix: a function's values then are a space with a size, and different ranks below it
have different values. Word lists and formats are invented here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.errors import TransformerProcessingError
from tessella.functions.rng import uniform

Draw = Callable[[str], "Column | Digit"]

FIRST = ["Ada", "Bram", "Cleo", "Dario", "Elin", "Femi", "Goran", "Hana", "Ines", "Jonas", "Kaya", "Luis", "Mira", "Nils", "Oona", "Pavel", "Quinn", "Rosa", "Sami", "Tessa", "Uma", "Vera", "Wim", "Yara", "Zeno"]
LAST = ["Abbot", "Berg", "Costa", "Dahl", "Evers", "Fontana", "Gruber", "Hale", "Ivanov", "Jansen", "Keller", "Lindt", "Moreau", "Novak", "Okafor", "Price", "Quist", "Rossi", "Silva", "Tanaka", "Ueda", "Vance", "Weber", "Young", "Zeller"]
STREETS = ["Birch", "Canal", "Dover", "Elm", "Forest", "Garden", "Harbor", "Iris", "Jasmin", "King", "Lake", "Meadow", "North", "Orchard", "Park", "Quarry", "River", "Station", "Tower", "Union"]
KINDS = ["Street", "Avenue", "Road", "Lane", "Square"]
CITIES = ["Ashford", "Brookfield", "Clayton", "Danvers", "Easton", "Fairview", "Greenville", "Hillsboro", "Jackson", "Kingston", "Lakewood", "Milton", "Newport", "Oxford", "Princeton", "Riverside", "Salem", "Trenton", "Vernon", "Winston"]
STATES = ["AZ", "CA", "CO", "FL", "GA", "IL", "MA", "MI", "MN", "NC", "NJ", "NY", "OH", "OR", "PA", "TX", "VA", "WA", "WI"]
DOMAINS = ["example.com", "example.org", "example.net"]
COUNTRIES = ["Argentina", "Belgium", "Chile", "Denmark", "Estonia", "France", "Ghana", "Hungary", "India", "Japan", "Kenya", "Latvia", "Mexico", "Norway", "Oman", "Peru", "Romania", "Spain", "Turkey", "Uruguay"]
JOBS = ["Architect", "Baker", "Chemist", "Dentist", "Editor", "Farmer", "Geologist", "Joiner", "Lawyer", "Nurse", "Pilot", "Plumber", "Surveyor", "Teacher", "Writer"]
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


class Digits:
    """Draws that are the digits of a rank; the radix of each is what is chosen from."""

    def __init__(self, rank: Column | None = None):
        #: The values of the parts so far. Without a rank, only the size is of interest.
        self.rank, self.size = F.lit(0).cast("long") if rank is None else rank, 1

    def __call__(self, part: str) -> Digit:
        return Digit(self, part)


class Digit:
    def __init__(self, digits: Digits, part: str):
        self.digits, self.part = digits, part

    def below(self, radix: int) -> Column:
        """The digit. Ranks have 63 bits: parts beyond are drawn by the rank, which is distinct without them."""
        own = self.digits
        before, own.size = own.size, own.size * radix
        if before > MOST_RANKS:
            return F.floor(uniform(own.rank, self.part) * F.lit(float(radix))).cast("long")
        return F.call_function("div", own.rank, F.lit(before)) % F.lit(min(radix, MOST_RANKS)) if before > 1 else own.rank % F.lit(min(radix, MOST_RANKS))


MOST_RANKS = (1 << 63) - 1


def space_size(maker: Callable[..., Column], kwargs: dict) -> int:
    """How many different values a provider's function has, as far as ranks tell them apart."""
    digits = Digits()
    try:
        maker(digits, **kwargs)
    except (TypeError, AttributeError) as e:
        raise TransformerProcessingError("a function's values can be told apart only if all its draws go to whole, pick, number or filled") from e
    return min(digits.size, MOST_RANKS)


def whole(u: Column | Digit, low: int, high: int) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    if isinstance(u, Digit):
        return u.below(high - low + 1) + F.lit(low)
    return (F.floor(u * F.lit(float(high - low + 1))) + F.lit(low)).cast("long")


def pick(u: Column | Digit, items: list[str]) -> Column:
    if isinstance(u, Digit):
        items = list(dict.fromkeys(items))  # different digits have different items
        return F.element_at(F.array(*map(F.lit, items)), (u.below(len(items)) + 1).cast("int"))
    return F.element_at(F.array(*map(F.lit, items)), (F.floor(u * F.lit(float(len(items)))) + 1).cast("int"))


def number(u: Column | Digit, digits: int) -> Column:
    return F.lpad(whole(u, 0, 10**digits - 1).cast("string"), digits, "0")


def filled(draw: Draw, template: str, digit: str = "#", letter: str = "?", letters: str = LETTERS) -> Column:
    """A template whose marks for digits and letters are replaced one by one."""
    parts = [pick(draw(f"{i}"), list(DIGITS if c == digit else letters)) if c in (digit, letter) and c else F.lit(c) for i, c in enumerate(template)]
    return F.concat(*parts) if parts else F.lit("")


def _name(draw: Draw) -> Column:
    return F.concat_ws(" ", pick(draw("first"), FIRST), pick(draw("last"), LAST))


def _email(draw: Draw) -> Column:
    return F.concat(F.lower(pick(draw("first"), FIRST)), F.lit("."), F.lower(pick(draw("last"), LAST)), number(draw("n"), 4), F.lit("@"), pick(draw("domain"), DOMAINS))


def _address(draw: Draw) -> Column:
    return F.concat(whole(draw("house"), 1, 9999).cast("string"), F.lit(" "), pick(draw("street"), STREETS), F.lit(" "), pick(draw("kind"), KINDS), F.lit("\n"), pick(draw("city"), CITIES), F.lit(", "), pick(draw("state"), STATES), F.lit(" "), number(draw("zip"), 5))


def _groups(draw: Draw, n: int, digits: int, sep: str) -> Column:
    return F.concat_ws(sep, *[F.lower(F.lpad(F.hex(whole(draw(f"g{i}"), 0, 16**digits - 1)), digits, "0")) for i in range(n)])


def _agent(draw: Draw) -> Column:
    system = pick(draw("system"), ["X11; Linux x86_64", "Windows NT 10.0; Win64; x64", "Macintosh; Intel Mac OS X 10_15_7"])
    return F.concat(F.lit("Mozilla/5.0 ("), system, F.lit(") Browser/"), whole(draw("major"), 60, 140).cast("string"), F.lit("."), whole(draw("minor"), 0, 9).cast("string"))


#: Provider to function to column maker (which takes a drawing function and keyword arguments).
CATALOGUE: dict[str, dict[str, Callable[..., Column]]] = {
    "BaseProvider": {
        "lexify": lambda draw, text="????", letters=LETTERS: filled(draw, text, digit="\0", letters=letters),
        "numerify": lambda draw, text="###": filled(draw, text, letter="\0"),
        "bothify": lambda draw, text="## ??", letters=LETTERS: filled(draw, text, letters=letters),
        "random_int": lambda draw, min=0, max=9999, step=1: whole(draw("n"), 0, (max - min) // step) * step + min,
        "random_element": lambda draw, elements=("a", "b", "c"): pick(draw("e"), list(elements)),
    },
    "person": {"name": _name, "first_name": lambda draw: pick(draw("first"), FIRST), "last_name": lambda draw: pick(draw("last"), LAST)},
    "internet": {
        "email": _email,
        "ipv4": lambda draw: F.concat_ws(".", *[whole(draw(f"o{i}"), 0, 255).cast("string") for i in range(4)]),
        "ipv6": lambda draw: _groups(draw, 8, 4, ":"),
        "mac_address": lambda draw: _groups(draw, 6, 2, ":"),
        "user_name": lambda draw: F.concat(F.lower(pick(draw("first"), FIRST)), number(draw("n"), 3)),
    },
    "address": {
        "address": _address,
        "street_address": lambda draw: F.concat(whole(draw("house"), 1, 9999).cast("string"), F.lit(" "), pick(draw("street"), STREETS), F.lit(" "), pick(draw("kind"), KINDS)),
        "city": lambda draw: pick(draw("city"), CITIES),
        "country": lambda draw: pick(draw("country"), COUNTRIES),
        "postcode": lambda draw: number(draw("zip"), 5),
    },
    "phone_number": {"phone_number": lambda draw: F.concat(F.lit("+1-"), number(draw("a"), 3), F.lit("-555-"), number(draw("b"), 4))},
    "ssn": {"ssn": lambda draw: F.concat(F.lpad(whole(draw("a"), 1, 899).cast("string"), 3, "0"), F.lit("-"), F.lpad(whole(draw("b"), 1, 99).cast("string"), 2, "0"), F.lit("-"), F.lpad(whole(draw("c"), 1, 9999).cast("string"), 4, "0"))},
    "user_agent": {"user_agent": _agent},
    "job": {"job": lambda draw: pick(draw("job"), JOBS)},
    "credit_card": {"credit_card_number": lambda draw: F.concat(F.lit("4"), number(draw("a"), 7), number(draw("b"), 8))},
    "date_time": {"date": lambda draw: F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), whole(draw("d"), 0, 12_000).cast("int")), "yyyy-MM-dd")},
}
#: Sdtypes that have a provider and function of their own.
SDTYPE_ANONYMIZERS: dict[str, dict[str, str]] = {
    "address": {"provider_name": "address", "function_name": "address"},
    "email": {"provider_name": "internet", "function_name": "email"},
    "ipv4_address": {"provider_name": "internet", "function_name": "ipv4"},
    "ipv6_address": {"provider_name": "internet", "function_name": "ipv6"},
    "mac_address": {"provider_name": "internet", "function_name": "mac_address"},
    "name": {"provider_name": "person", "function_name": "name"},
    "phone_number": {"provider_name": "phone_number", "function_name": "phone_number"},
    "ssn": {"provider_name": "ssn", "function_name": "ssn"},
    "user_agent_string": {"provider_name": "user_agent", "function_name": "user_agent"},
}


def is_faker_function(function_name: str) -> bool:
    return get_provider_name(function_name) is not None


def get_provider_name(function_name: str) -> str | None:
    """The provider of a function; None for an unknown one."""
    return next((p for p, functions in CATALOGUE.items() if function_name in functions), None)


def register(provider_name: str, function_name: str, maker: Callable[..., Column]) -> None:
    """Add a function of one's own: ``maker(draw, **kwargs)`` gives a column.

    Rules of cardinality ask that it gives its draws to :func:`whole`, :func:`pick`,
    :func:`number` or :func:`filled`.
    """
    CATALOGUE.setdefault(provider_name, {})[function_name] = maker
