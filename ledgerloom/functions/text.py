"""Text cleaning and identities as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that mean "no value".
EMPTY = ("", "-", "--", "n/a", "na", "n.a.", "null", "none", "nil", "nan", "undefined", "unknown", "?", "#n/a", "(blank)", "<na>")
_SPACES = r"(?U)\s+"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c computed once: an expression that uses another many times would repeat it each time, and plans grow as the product."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


#: A step of a computation: from the names so far to new columns. Steps make one projection each in a frame.
Step = Callable[[Callable[[str], Column]], dict[str, Column]]


def staged(df: DataFrame, *runs: tuple[str, dict[str, Column], list[Step]]) -> DataFrame:
    """df with the columns of each run, (prefix, inputs, steps), under its prefix.

    Each level of steps is one projection, which code generation covers and the
    optimizer keeps apart where a column is used more than once.
    """
    df = df.withColumns({p + k: c for p, inputs, _ in runs for k, c in inputs.items()})
    for level in range(max(len(steps) for *_, steps in runs)):
        df = df.withColumns({p + k: c for p, _, steps in runs if level < len(steps) for k, c in steps[level](lambda n, p=p: F.col(p + n)).items()})
    return df


def expressed(inputs: dict[str, Column], steps: list[Step], result: Callable[[Callable[[str], Column]], Column]) -> Column:
    """The same steps as one expression, for use where no frame is at hand."""

    def go(names: list[str], at: int, s: Column) -> Column:
        if at == len(steps):
            return result(lambda n: s[n])
        new = steps[at](lambda n: s[n])
        kept = [n for n in names if n not in new]
        return let(F.struct(*(s[n].alias(n) for n in kept), *(c.alias(n) for n, c in new.items())), lambda t: go([*kept, *new], at + 1, t))

    return let(F.struct(*(c.alias(n) for n, c in inputs.items())), lambda s: go(list(inputs), 0, s))


#: A step of a computation: from the names so far to new columns. Steps make one projection each in a frame.
Step = Callable[[Callable[[str], Column]], dict[str, Column]]


def staged(df: DataFrame, *runs: tuple[str, dict[str, Column], list[Step]]) -> DataFrame:
    """df with the columns of each run, (prefix, inputs, steps), under its prefix.

    Each level of steps is one projection, which code generation covers and the
    optimizer keeps apart where a column is used more than once.
    """
    df = df.withColumns({p + k: c for p, inputs, _ in runs for k, c in inputs.items()})
    for level in range(max(len(steps) for *_, steps in runs)):
        df = df.withColumns({p + k: c for p, _, steps in runs if level < len(steps) for k, c in steps[level](lambda n, p=p: F.col(p + n)).items()})
    return df


def expressed(inputs: dict[str, Column], steps: list[Step], result: Callable[[Callable[[str], Column]], Column]) -> Column:
    """The same steps as one expression, for use where no frame is at hand."""

    def go(names: list[str], at: int, s: Column) -> Column:
        if at == len(steps):
            return result(lambda n: s[n])
        new = steps[at](lambda n: s[n])
        kept = [n for n in names if n not in new]
        return let(F.struct(*(s[n].alias(n) for n in kept), *(c.alias(n) for n, c in new.items())), lambda t: go([*kept, *new], at + 1, t))

    return let(F.struct(*(c.alias(n) for n, c in inputs.items())), lambda s: go(list(inputs), 0, s))


def squeezed(c: Column) -> Column:
    """Without white space at the ends, and one space for each run within."""
    # Most texts are so already, which one look tells.
    return F.when(c.rlike(r"(?U)^\s|\s$|\s\s|[\s&&[^ ]]"), F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), _SPACES, " ")).otherwise(c)


def said(text: Column) -> Column:
    """A squeezed text, or null if it means "no value"."""
    return F.when(~F.lower(text).isin(*EMPTY), text)


def clean(c: Column) -> Column:
    """squeezed, or null for a text that means "no value"."""
    return let(squeezed(c), said)


def identity(c: Column, case_insensitive: bool = True) -> Column:
    text = squeezed(c)
    return F.lower(text) if case_insensitive else text


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[- ]", "_")


def compatible(c: Column) -> Column:
    """NFKC form; Spark has no such function, so this one goes through Arrow."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return nfkc(c)


def folded(c: Column) -> Column:
    """Full Unicode case folding, which lower() is not; through Arrow."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.casefold())

    return fold(c)


def literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def first_reasons(parts: Column) -> Column:
    """Reason codes joined by semicolons, blanks dropped, the first of equal ones kept."""
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), ";")
