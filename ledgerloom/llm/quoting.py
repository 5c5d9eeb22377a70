"""Reply-ordered conversations without quotations, all in native DataFrame code.

Lines that start with one or more ``>`` are quoted; a quoted passage is a run of
lines of the same level. Its text is normalised (letters and digits only, lower
case) and hashed, as are each message's own whole text, its paragraphs, and its
runs of as many consecutive lines as some quotation of the conversation has. A
passage links to the earliest message of its conversation that says it itself,
before the message that quotes it. A message replies to the latest message that
its level-1 passages link to, or else to the one before it.

Keys are pre-aggregated to the first speaker before the join, so a line that
stands in many messages costs one row for each conversation. Positions within a
conversation come from two levels of counts over parts that its quantiles bound,
and a turn that many rows share is parted further by a hash, so one conversation
or one turn may hold most of the rows.

Results for odd input: a null text counts as empty; rows with null conv_id form
one conversation, rows with null turn come last in theirs and nothing links to
them; rows with equal conv_id and turn are ordered by the MD5 of role and text,
and do not link to each other; a passage without a letter or digit links to
nothing; repeated rows stay; an empty table gives an empty table; only conv_id,
turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Messages of a conversation that are ranked in one part, and parts of a larger one.
PART, PARTS = 1 << 12, 256
_MARKS = r"^((?:[ \t]*>)+)[ \t]?"


def level(line: Column) -> Column:
    """How deep a line is quoted; 0 for the speaker's own lines."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _hash(plain: Column) -> Column:
    """Null for passages without a letter or digit."""
    return F.when(plain != "", F.sha2(plain, 256))


def passage_hash(text: Column) -> Column:
    return _hash(normal(text))


def _lines(text: Column) -> Column:
    """The normalised lines that have a letter or digit."""
    return F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != "")


def parsed(messages: DataFrame) -> DataFrame:
    """Adds own (the text without quoted lines) and quotes (array of level and text of each passage)."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("text")))
    df = messages.withColumn("__lines", lines)
    # A passage starts where a quoted line's level differs from that of the line before.
    quoted = F.exists("__lines", lambda x: x["level"] > 0)
    starts = F.filter(
        F.transform("__lines", lambda x, i: F.when((x["level"] > 0) & ~F.coalesce(F.get("__lines", i - 1)["level"], F.lit(0)).eqNullSafe(x["level"]), i)),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("__starts", F.when(quoted, starts).otherwise(F.array().cast("array<int>")))

    def passage(start: Column, k: Column) -> Column:
        until = F.coalesce(F.get("__starts", k + 1), F.size("__lines"))
        here = F.get("__lines", start)["level"]
        run = F.filter(F.slice("__lines", start + 1, until - start), lambda x: x["level"] == here)
        return F.struct(here.alias("level"), F.array_join(F.transform(run, lambda x: x["text"]), "\n").alias("text"))

    own = F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    own = F.when(quoted, F.regexp_replace(F.btrim(own, F.lit(" \t\n\x0b\f\r")), r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")).otherwise(F.coalesce("text", F.lit("")))
    return df.withColumn("quotes", F.transform("__starts", passage)).withColumn("own", own).drop("__lines", "__starts")


def _own_hashes() -> Column:
    """Hashes of what a message says itself: the whole, each paragraph, and each run of ``lengths`` consecutive lines."""
    parts = F.transform(F.concat(F.split("own", r"\n[ \t]*\n"), F.array("own")), passage_hash)

    def runs(n: Column) -> Column:
        starts = F.when(F.size("lines") >= n, F.sequence(F.lit(1), F.size("lines") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: _hash(F.array_join(F.slice(F.col("lines"), i, n), "")))

    return F.array_compact(F.array_distinct(F.concat(parts, F.flatten(F.transform("lengths", runs)))))


def positions(messages: DataFrame, out: str = "position") -> DataFrame:
    """Adds the place (from 0) of each row in its conversation: by turn (nulls last), then the MD5 of role and text."""
    turn = F.coalesce(F.col("turn").cast("double"), F.lit(float("inf")))
    said = F.md5(F.concat(F.coalesce(F.concat(F.lit("1"), "role"), F.lit("0")), F.lit("\x1f"), F.coalesce("text", F.lit(""))))
    df = messages.withColumns({"__turn": turn, "__said": said})
    cuts = F.percentile_approx("__turn", [i / PARTS for i in range(1, PARTS)], 10_000)
    stats = df.groupBy("conv_id").agg(F.count(F.lit(1)).alias("__n"), cuts.alias("__cuts"))
    stats = stats.select(F.col("conv_id").alias("__conv"), F.when(F.col("__n") > PART, F.array_distinct("__cuts")).alias("__cuts"))
    # A cut's own turn is a part by itself, between the turns below and above it; as it may be frequent, its rows are parted by their hash.
    below = 2 * F.size(F.filter("__cuts", lambda c: c < F.col("__turn")))
    at = F.array_contains("__cuts", F.col("__turn"))
    part = F.when(F.col("__cuts").isNull(), F.lit("")).when(at, F.concat_ws(".", F.lpad((below + 1).cast("string"), 6, "0"), F.substring("__said", 1, 2))).otherwise(F.lpad(below.cast("string"), 6, "0"))
    joined = df.join(stats, F.col("conv_id").eqNullSafe(F.col("__conv"))).withColumn("__part", part).drop("__conv", "__cuts")
    within = F.row_number().over(Window.partitionBy("conv_id", "__part").orderBy("__turn", "__said")) - 1
    counts = joined.groupBy("conv_id", "__part").agg(F.count(F.lit(1)).alias("__m"))
    before = F.sum("__m").over(Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("conv_id").alias("__conv"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    out_df = joined.withColumn("__within", within).join(counts, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__part") == F.col("__p")))
    return out_df.withColumn(out, (F.col("__before") + F.col("__within")).cast("long")).drop("__conv", "__p", "__part", "__before", "__within", "__turn", "__said")


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, position, quote, level, said_turn, said_position): what each quoted passage links to; unlinked ones have nulls.

    messages: parsed, with position.
    """
    quotes = messages.where(F.size("quotes") > 0).select("conv_id", "turn", "position", F.posexplode("quotes").alias("quote", "passage"))
    quotes = quotes.select("conv_id", "turn", "position", "quote", F.col("passage.level").alias("level"), F.size(_lines(F.col("passage.text"))).alias("length"), passage_hash(F.col("passage.text")).alias("hash"))
    # Only what somebody quotes is looked for, in conversations with quotations, so own lines meet the (few) quoted hashes first.
    wanted = quotes.where(F.col("hash").isNotNull()).select("conv_id", "hash", "length").distinct()
    lengths = wanted.groupBy(F.col("conv_id").alias("k")).agg(F.collect_set("length").alias("lengths"))
    said = messages.where(F.col("turn").isNotNull()).join(lengths, F.col("conv_id").eqNullSafe(F.col("k"))).withColumn("lines", _lines(F.col("own")))
    said = said.select(F.col("conv_id").alias("c"), "turn", "position", F.explode(_own_hashes()).alias("h"))
    met = said.join(wanted.select("conv_id", "hash").distinct(), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("h") == F.col("hash")), "left_semi")
    first = met.groupBy("c", "h").agg(F.min(F.struct("turn", "position")).alias("said"))
    joined = quotes.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("said.turn") < F.col("turn")), "left")
    return joined.select("conv_id", "position", "quote", "level", F.col("said.turn").alias("said_turn"), F.col("said.position").alias("said_position"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, text (without quotes), n_quotes, n_linked, reply_to (a position, null for the first)."""
    rows = parsed(positions(messages.select("conv_id", "turn", "role", "text")))
    # What is linked is found from a written table, so that the texts are parsed once.
    rows = materialize(rows.drop("text"), "messages")
    found = links(rows).groupBy("conv_id", "position").agg(
        F.count("said_position").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.struct("said_turn", "said_position"))).alias("parent")
    )
    found = found.withColumnsRenamed({"conv_id": "c", "position": "p"})
    out = rows.join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") == F.col("p")), "left")
    before = F.when(F.col("position") > 0, F.col("position") - 1)
    return out.select(
        "conv_id", "position", "turn", "role", F.col("own").alias("text"), F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("parent.said_position", before).alias("reply_to"),
    )


def op6_quotation_links(spark, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, md5(coalesce('1' || role, '0') || chr(31) || coalesce(text, ''))) - 1 AS position
  FROM conversations
), l AS (
  SELECT conv_id, turn, position, i, line,
    length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '') AS bare
  FROM (SELECT conv_id, turn, position, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m)
), r AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id, position ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN level > 0 AND level <> coalesce(lag(level) OVER (PARTITION BY conv_id, position ORDER BY i), 0) THEN 1 ELSE 0 END AS new FROM l)
), q AS (
  SELECT conv_id, turn, position, run, any_value(level) AS level,
    count(*) FILTER (WHERE regexp_replace(lower(bare), '[^\p{L}\p{N}]+', '', 'g') <> '') AS length,
    regexp_replace(lower(string_agg(bare, chr(10) ORDER BY i)), '[^\p{L}\p{N}]+', '', 'g') AS plain
  FROM r WHERE level > 0 GROUP BY conv_id, turn, position, run
), own AS (
  SELECT m.conv_id, m.turn, m.role, m.position,
    CASE WHEN bool_or(level > 0) THEN
      regexp_replace(trim(coalesce(string_agg(bare, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g')
    ELSE any_value(text) END AS text,
    any_value(text) AS whole
  FROM m JOIN l USING (conv_id, position) GROUP BY m.conv_id, m.turn, m.role, m.position
), runs AS (
  SELECT conv_id, turn, position, w.length,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '') AS ls
  FROM own JOIN (SELECT DISTINCT conv_id, length FROM q WHERE plain <> '') AS w USING (conv_id) WHERE turn IS NOT NULL
), said AS (
  SELECT conv_id, plain, min({'turn': turn, 'position': position}) AS said FROM (
    SELECT conv_id, turn, position, regexp_replace(lower(part), '[^\p{L}\p{N}]+', '', 'g') AS plain FROM (
      SELECT conv_id, turn, position, unnest(list_concat(regexp_split_to_array(text, '\n[ \t]*\n'), [text])) AS part FROM own WHERE turn IS NOT NULL
    )
    UNION ALL
    SELECT conv_id, turn, position, array_to_string(list_slice(ls, i, i + length - 1), '') FROM (
      SELECT *, unnest(range(1, len(ls) - length + 2)) AS i FROM runs
    )
  ) WHERE plain <> '' GROUP BY conv_id, plain
), linked AS (
  SELECT q.conv_id, q.position, count(*) AS n_quotes, count(said) AS n_linked,
    max(CASE WHEN level = 1 THEN {'t': said.turn, 'p': said.position} END) AS parent
  FROM q LEFT JOIN said ON q.conv_id = said.conv_id AND q.plain = said.plain AND said.turn < q.turn GROUP BY q.conv_id, q.position
)
SELECT own.conv_id, own.position, own.turn, own.role, own.text, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
  coalesce(parent.p, CASE WHEN own.position > 0 THEN own.position - 1 END) AS reply_to
FROM own LEFT JOIN linked USING (conv_id, position)
"""
