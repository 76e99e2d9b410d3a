"""Column expressions shared by the operators: times, text keys, outcomes, probabilities."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DAY_MICROS = 86_400_000_000
YEAR_DAYS = 365.25
PROBABILITIES = ("p_team2_win", "p_draw", "p_team1_win")

#: Spellings of booleans.
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]

#: Weight of the words in a tournament's name; the largest that occurs counts.
IMPORTANCE = {
    "friendly": 0.5,
    "qualification": 1.0,
    "qualifier": 1.0,
    "nations league": 1.0,
    "continental": 1.5,
    "copa": 1.5,
    "euro": 1.5,
    "world cup": 2.0,
}

#: Classes of tournaments, and names of continental finals.
CATEGORIES = ["friendly", "nations_league", "world_cup_qualifier", "continental_qualifier", "world_cup", "continental_final"]
CONTINENTAL = ["uefa euro", "african cup of nations", "asian cup", "copa am", "gold cup", "oceania nations cup", "confederations cup"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    """A time as microseconds since 1970 (UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(DAY_MICROS))


def parse_boolean(c: str | Column) -> Column:
    """true/1/yes/y/t and false/0/no/n/f in any case and spacing; anything else is null."""
    word = F.lower(F.trim(col(c).cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def nonnegative_int(c: str | Column) -> Column:
    """A whole number of at least 0, else null."""
    number = col(c).try_cast("double")
    return F.when((number >= 0) & (number == F.floor(number)), number.try_cast("int"))


def text(c: str | Column) -> Column:
    """Trimmed text, null where nothing is left."""
    trimmed = F.trim(col(c).cast("string"))
    return F.when(trimmed != "", trimmed)


def stable_id(source: str | Column, kickoff: str | Column, team1: str | Column, team2: str | Column) -> Column:
    """First 20 hex digits of the SHA-256 of source, ISO time and both teams."""
    iso = F.date_format(col(kickoff).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.substring(F.sha2(F.concat_ws("|", col(source), iso, col(team1), col(team2)), 256), 1, 20)


def outcome(goals1: str | Column = "team1_goals", goals2: str | Column = "team2_goals") -> Column:
    """2 if the first side won, 1 for a draw, 0 if the second side won."""
    a, b = col(goals1), col(goals2)
    return F.when(a > b, 2).when(a == b, 1).when(a < b, 0)


def importance(c: str | Column = "tournament", weights: dict[str, float] = IMPORTANCE, default: float = 1.0) -> Column:
    """Largest weight among the words that occur in the name."""
    name = F.lower(F.coalesce(col(c), F.lit("")))
    found = [F.when(name.contains(word), F.lit(w)) for word, w in weights.items()]
    return F.coalesce(F.greatest(*found), F.lit(default))


def category(c: str | Column = "tournament") -> Column:
    """One of ``CATEGORIES`` or "other", by the words in the name."""
    name = F.lower(F.coalesce(col(c), F.lit("")))
    cup = name.contains("world cup")
    return (
        F.when(name.contains("friendly"), "friendly")
        .when(name.contains("nations league"), "nations_league")
        .when(name.rlike("qualification|qualifier"), F.when(cup, "world_cup_qualifier").otherwise("continental_qualifier"))
        .when(cup & ~name.contains("conifa"), "world_cup")
        .when(name.rlike("|".join(CONTINENTAL)), "continental_final")
        .otherwise("other")
    )


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def normalised(columns=PROBABILITIES, eps: float = 1e-12) -> list[Column]:
    """Clipped to [eps, 1] and divided by their sum."""
    parts = [clip(col(c), eps, 1.0) for c in columns]
    total = sum(parts[1:], parts[0])
    return [(p / total).alias(str(c)) for p, c in zip(parts, columns)]


def top_class(columns=PROBABILITIES) -> Column:
    """Index of the largest probability; the first one at ties."""
    every = F.array(*map(col, columns))
    return (F.array_position(every, F.array_max(every)) - 1).cast("int")


def of_outcome(columns=PROBABILITIES, y: str = "outcome") -> Column:
    """The probability given to what happened."""
    return F.element_at(F.array(*map(col, columns)), (F.col(y) + 1).cast("int"))


def poisson_pmf(rate: Column, k: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, k.cast("double")) / F.factorial(k)


@F.pandas_udf(StringType())
def unicode_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility form, single spaces, case folded: for lookups over distinct names."""
    for names in batches:
        yield names.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).split()).casefold())


@F.pandas_udf(StringType())
def unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda s: None if s is None else html.unescape(s))
