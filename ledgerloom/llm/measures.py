"""Measurements of texts as native column expressions, shared by the quality operators.

Words are runs without the six ASCII white-space characters; a null text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WORD_BREAK)).otherwise(F.array().cast("array<string>"))


def removed(text: Column, characters: str) -> Column:
    """How many of the characters stand in the text."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_words(df: DataFrame, text: str = "__text", words: str = "__words") -> DataFrame:
    """Adds the words of column ``text`` (already null-free)."""
    return df.withColumn(words, words_of(F.col(text)))


def repeated_window_words(df: DataFrame, words: str = "__words", out: str = "n_repeat_words") -> DataFrame:
    """Adds how many words stand in 3-word windows found twice or more in the same text.

    Everything stays within the row: windows become 64-bit hashes; only where
    some hash occurs twice are they sorted with their places, and the places of
    repeated ones, in order, cover min(3, distance to the next) words each.
    """
    window = F.transform(
        F.slice(F.col(words), 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)),
    )
    df = df.withColumn("__windows", window)
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    df = df.withColumn("__sorted", F.when(repeats, placed))
    same = lambda e, k: F.get(F.col("__sorted"), k)["h"].eqNullSafe(e["h"])
    found = F.filter("__sorted", lambda e, k: same(e, k + 1) | same(e, k - 1))
    df = df.withColumn("__places", F.sort_array(F.transform(found, lambda e: e["i"])))
    covered = F.aggregate(
        "__places",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
    )["n"]
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("__windows", "__sorted", "__places")
