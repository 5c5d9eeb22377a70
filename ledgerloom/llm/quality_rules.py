"""Quality rules as a ledger of bits: each rule is evaluated once, policies come later.

``ledger`` gives each document its measurements and ``fail_bits``, one bit for
each rule that it fails. A policy is a mask of rules under a version number;
``verdicts`` applies one, ``ablations`` counts for each policy and rule, by
bitwise aggregation over the distinct bit patterns, what the rule rejects and
what it alone rejects. Measurements stay in the ledger, so a changed threshold
needs no second look at the texts. All of it is native DataFrame code.

Results for odd input: a null or empty text has zero for every measurement and
fails the word-count rule; repeated rows give repeated rows; an empty table
gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .measures import SYMBOLS, removed, repeated_window_words, with_words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang")


@dataclass(frozen=True)
class Rule:
    """fails: a condition in SQL over MEASURES."""

    name: str
    fails: str


#: The place of a rule is its bit: append only.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 15 * n_words"),
    Rule("duplicate_lines", "n_lines >= 8 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("upper_case", "100 * n_upper > 50 * word_chars"),
    Rule("exclamations", "100 * n_bang > 30 * n_words"),
)
BITS = {r.name: i for i, r in enumerate(RULES)}
BASE = ("few_words", "repeated_words")


def mask(*names: str) -> int:
    return sum(1 << BITS[n] for n in names)


#: Versioned policies; a published version never changes.
POLICIES = {
    1: mask(*BASE, "many_symbols", "duplicate_lines"),
    2: mask(*BASE, "many_symbols", "duplicate_lines", "long_words", "short_words", "upper_case", "exclamations"),
}
CURRENT = 2


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES (long)."""
    df = with_words(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")))
    # Lines with a word; equal lines differ in nothing, white space included.
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    df = df.withColumn("__lines", lines)
    df = repeated_window_words(df)
    return df.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        (F.length("__text") - removed(F.col("__text"), " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        removed(F.col("__text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("__lines").cast("long").alias("n_lines"),
        removed(F.col("__text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ").cast("long").alias("n_upper"),
        removed(F.col("__text"), "!").cast("long").alias("n_bang"),
    )


def fail_bits() -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES, fail_bits (bit i: RULES[i] fails)."""
    return measured(docs).withColumn("fail_bits", fail_bits())


def verdicts(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept, by the policy of this version."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(*BASE))) != 0
    rejected = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & ~rejected)


def ablations(rows: DataFrame) -> DataFrame:
    """(version, rule, n_failed, n_only): documents that the rule rejects, and those that no other rule of the policy does.

    The ledger is first reduced to its distinct bit patterns, at most 2**len(RULES) rows.
    """
    spark = rows.sparkSession
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    policies = spark.createDataFrame([(v, m, r.name, 1 << i) for v, m in POLICIES.items() for i, r in enumerate(RULES) if m >> i & 1], "version int, mask long, rule string, bit long")
    hit = policies.join(patterns, F.col("fail_bits").bitwiseAND(F.col("bit")) != 0)
    only = F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    counted = hit.groupBy("version", "rule").agg(F.sum("n").alias("n_failed"), F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"))
    return policies.select("version", "rule").join(counted, ["version", "rule"], "left").select("version", "rule", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("n_only", F.lit(0)).alias("n_only"))


def op5_quality_ledger(spark, sf_dir: str) -> DataFrame:
    out = verdicts(ledger(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: trim(x, {_SPACES}) <> '') AS ls
  FROM d
), places AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), often AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM places) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM often, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id,
    len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines,
    (length(t) - length(regexp_replace(t, '[A-ZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ]', '', 'g')))::BIGINT AS n_upper,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bang
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))})::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {mask(*BASE)}) <> 0 AS base_failed, (fail_bits & {POLICIES[CURRENT]}) = 0 AS kept, fail_bits
FROM f
"""
