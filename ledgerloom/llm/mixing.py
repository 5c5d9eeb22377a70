"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents, in hash order, form one stream of words that is cut
into blocks of equal size. Slot k of the schedule has the point frac(k * phi)
of the golden-ratio sequence, which falls into one source's interval of the
cumulative targets; the r-th slot of a source takes its r-th block in shuffled
order, pass after pass over the stream. A source stops exactly at its target,
inside a block if need be; as targets are at most MAX_PASSES streams and each
pass takes a block once, no document is taken more than MAX_PASSES times.

Prefix sums and ranks are taken in two levels (within a part, then over parts),
so one source may hold most rows: no task gets a whole source. Tables of one row
for each source are handled on the driver, as are the weights themselves.

Results for odd input: a null or empty text has size 0 and is never taken;
repeated rows are separate documents of the same size; null sources form one
source, the last; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, table
from .measures import words_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
#: About how many slots a schedule has, and the bounds of a block in words.
SLOTS = 1 << 16
LEAST_BLOCK, MOST_BLOCK = 16, 1 << 20
#: Fraction of the golden ratio; 53 bits are exact in a double.
PHI = 0.6180339887498949

def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: int = MAX_PASSES) -> dict[str | None, float]:
    """Share the sum of all sizes by weight; a target above most times its size stops there, its excess goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _prefix(df: DataFrame, keys: list[str], part: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of the same keys; parts are ordered, too."""
    within = F.sum(value).over(Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, part, F.coalesce(before, F.lit(0)).alias("__before"))
    return df.withColumn("__within", F.coalesce(within, F.lit(0))).join(sums, [*keys, part]).withColumn(out, F.col("__before") + F.col("__within")).drop("__before", "__within")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of each row of docs (doc_id, text, source)."""
    size = F.size(words_of(F.coalesce("text", F.lit("")))).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("h"))


class Schedule:
    """What ``plan`` decides; tables are written in the shared folder.

    docs: doc_id, source, size, h, sid, start (of the document in its source's stream)
    blocks: slot, sid, pass, block, first, last (the words of the stream that the slot takes)
    sources: source, sid, size, target
    """

    def __init__(self, docs: DataFrame, blocks: DataFrame, sources: list[dict]):
        self.docs, self.blocks, self.sources = docs, blocks, sources


def _literal_table(spark: SparkSession, sources: list[dict], block: int) -> DataFrame:
    rows = [(s["sid"], s["source"], s["size"], s["target"], s["need"], -(-s["size"] // block)) for s in sources]
    return spark.createDataFrame(rows, "sid int, source string, source_size long, target double, need long, n_blocks long")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> Schedule:
    spark = docs.sparkSession
    rows = materialize(sized(docs), "mix-docs")
    sizes = {r.source: (r.size or 0, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    goal = targets({s: v[0] for s, v in sizes.items()}, weights)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    sources = [{"sid": i, "source": s, "size": sizes[s][0], "target": goal[s], "need": min(round(goal[s]), MAX_PASSES * sizes[s][0])} for i, s in enumerate(order)]
    total = sum(s["need"] for s in sources)
    block = min(max(total // SLOTS, LEAST_BLOCK), MOST_BLOCK)
    table_ = _literal_table(spark, sources, block)

    # Streams: parts of hash order, as many as a part holds documents, so that neither level grows faster than the root.
    parts = max(1, math.isqrt(sum(v[1] for v in sizes.values())))
    rows = rows.join(F.broadcast(table_.select("sid", F.col("source").alias("__source"))), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    part = F.shiftrightunsigned("h", 33) * F.lit(parts) / F.lit(1 << 31)
    # Unsigned order of the hash: its upper 31 bits are the part's, the whole of it the place within.
    rows = rows.withColumn("part", F.floor(part).cast("long"))
    place = [F.shiftrightunsigned("h", 1), F.col("h"), F.col("doc_id"), F.col("size")]
    rows = _prefix(rows, ["sid"], "part", place, "size", "start").drop("part")

    # Each source's blocks in the order of its passes, and how many words of them are still needed.
    some = table_.where("need > 0")
    passes = some.select("sid", "source_size", "need", F.explode(F.sequence(F.lit(1), F.ceil(F.col("need") / F.col("source_size")).cast("int"))).alias("pass"), "n_blocks")
    blocks = passes.select("sid", "source_size", "need", "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    # Stands for a random order of the blocks in this pass; the last pass is cut short, whichever blocks come first.
    blocks = blocks.withColumn("h", F.xxhash64("sid", "pass", "block"))
    blocks = blocks.withColumn("words", F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block))
    # Parts of root size again.
    wide = max(1, math.isqrt(total // block))
    blocks = blocks.withColumn("part", F.col("pass") * wide + F.floor(F.shiftrightunsigned("h", 33) * F.lit(wide) / F.lit(1 << 31)))
    by_h = [F.shiftrightunsigned("h", 1), F.col("h"), F.col("block")]
    blocks = _prefix(blocks, ["sid"], "part", by_h, "words", "before")
    blocks = _prefix(blocks.withColumn("one", F.lit(1).cast("long")), ["sid"], "part", by_h, "one", "rank").where("before < need")
    blocks = blocks.select("sid", "pass", "block", "rank", (F.col("block") * block).alias("first"), (F.col("block") * block + F.least("words", F.col("need") - F.col("before"))).alias("last"))

    # Slots: the golden-ratio points through the cumulative targets, ranked within each source.
    n_slots = total // block + len(sources) + 1
    edges, acc = [], 0.0
    for s in sources:
        edges.append((s["sid"], acc, acc := acc + s["need"] / max(total, 1)))
    slots = spark.range(n_slots).withColumn("point", (F.col("id") * F.lit(PHI)) % 1.0)
    bounds = F.array(*(F.lit(float(e[2])) for e in edges)) if edges else F.array().cast("array<double>")
    sid = F.size(F.filter(bounds, lambda b: b <= F.col("point")))
    slots = slots.withColumn("sid", F.least(sid, F.lit(max(len(sources) - 1, 0))).cast("int")).withColumn("part", F.floor(F.col("id") / F.lit(max(1, math.isqrt(n_slots))))).withColumn("one", F.lit(1).cast("long"))
    slots = _prefix(slots, ["sid"], "part", [F.col("id")], "one", "rank").select("sid", "rank", F.col("id").alias("slot"))
    # A source that the points give a slot too few gets its last blocks after all others.
    blocks = blocks.join(slots, ["sid", "rank"], "left").withColumn("slot", F.coalesce("slot", F.lit(n_slots) + F.col("rank")))
    return Schedule(materialize(rows, "mix-stream"), materialize(blocks.drop("rank"), "mix-blocks"), [s | {"block": block} for s in sources])


def pieces(schedule: Schedule) -> DataFrame:
    """(doc_id, h, sid, slot, pass, from, to): the words of a document that a slot takes, counted within the document."""
    block = schedule.sources[0]["block"] if schedule.sources else 1
    docs = schedule.docs.where("size > 0")
    spread = docs.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    met = spread.join(schedule.blocks, ["sid", "block"])
    first, last = F.greatest("start", "first") - F.col("start"), F.least(F.col("start") + F.col("size"), F.col("last")) - F.col("start")
    return met.select("doc_id", "h", "start", "sid", "slot", "pass", first.alias("from"), last.alias("to")).where("from < to")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (null if nothing is taken) for every row of docs."""
    schedule = plan(docs, weights)
    # (sid, start, h) names a row: documents of one source with words start at different places.
    taken = pieces(schedule).groupBy("sid", "start", "h").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.min("slot").alias("first_slot"))
    rows = schedule.docs.where("size > 0").join(taken, ["sid", "start", "h"], "left")
    rows = rows.unionByName(schedule.docs.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")}))
    sources = F.broadcast(_literal_table(docs.sparkSession, schedule.sources, 1).select("sid", "source_size", "target"))
    return rows.join(sources, "sid").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ordered: bool = False) -> DataFrame:
    """docs as the mix takes them: one row for each pass over a document, with the words taken in that pass.

    A document taken whole keeps its text as it is, otherwise the row has the
    words taken, in order and joined by single spaces. All columns are kept,
    whatever their names; n_chars, where there is one, is that of the new text.
    Documents of which nothing is taken are left out. ordered: deal the rows by
    ranges of their first slot and sort them by it, so that each part is a
    stretch of the schedule, for one more shuffle of the texts.
    """
    schedule = plan(docs, weights)
    key, nth, spans_, taken, slot, words_ = (free_name(docs, f"__mix_{c}") for c in ("key", "n", "spans", "taken", "slot", "words"))
    spans = pieces(schedule).groupBy("sid", "start", "h", "pass").agg(
        F.sort_array(F.collect_list(F.struct("from", "to"))).alias(spans_), F.sum(F.col("to") - F.col("from")).alias(taken), F.min("slot").alias(slot)
    )
    # Rows that share the hash have equal texts, so each takes one of their places.
    places = schedule.docs.where("size > 0").select("sid", "start", "h", F.row_number().over(Window.partitionBy("h").orderBy("start")).alias(nth))
    spans = spans.join(places, ["sid", "start", "h"]).select(F.col("h").alias(key), nth, spans_, taken, slot)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    keyed = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy("doc_id")))
    out = keyed.join(spans, [key, nth])
    chosen = F.flatten(F.transform(spans_, lambda s: F.slice(F.col(words_), (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    out = out.withColumn(words_, words_of(F.col("text")))
    text = F.when(F.col(taken) == F.size(words_), F.col("text")).otherwise(F.array_join(chosen, " "))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    if ordered:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        wide = -(-sum(s["need"] for s in schedule.sources) // (schedule.sources[0]["block"] * parts) or 1) if schedule.sources else 1
        out = out.repartition(parts, F.floor(F.col(slot) / F.lit(wide))).sortWithinPartitions(slot)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_mix_schedule(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
