"""The audit trail: one canonical JSON body for each decision, sealed in a hash chain.

Bodies are built in parallel; only the chain itself, one hash of a fixed-size
text for each record, is a single ordered pass. Verification is parallel again,
as each record stores the hash before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Rules
from ..functions import dates, money
from ..functions.canon import chain_hash, chained, quoted, resorted, to_text
from .history import SNAPSHOT

SCHEMA_VERSION = 1
GENESIS = "0" * 64
#: Positions that verification looks at together.
STRETCH = 1 << 13


def header(rules: Rules = DEFAULT, version: str = "0.1.0") -> str:
    return to_text({"type": "header", "schema_version": SCHEMA_VERSION, "engine_version": version, "config_fingerprint": rules.fingerprint()})


def evidence(items: Column, n_events: Column) -> Column:
    """JSON of a decision's evidence, after a note of the cut where the log is longer than what is shown."""

    def one(e: Column) -> Column:
        plain = [e[c].alias(c) for c in ("event_id", "action", "source", "authority", "seq", "date", "blocked")]
        lists = [F.when(F.size(e[c]) > 0, e[c]).alias(c) for c in ("won", "lost", "lifecycle")]
        return F.to_json(F.struct(*plain, dates.format_ts(e["event_ts"]).alias("event_ts"), F.when(e["amount_minor"].isNotNull(), money.format_amount(e["amount_minor"], e["currency"])).alias("amount"), *lists))

    cut = F.to_json(F.struct(F.lit("evidence_truncated").alias("note"), n_events.alias("total_events"), F.size(items).alias("shown")))
    texts = F.transform(items, one)
    return F.concat(F.lit("["), F.array_join(F.when(n_events > F.size(items), F.concat(F.array(cut), texts)).otherwise(texts), ","), F.lit("]"))


def state_diff() -> Column:
    """JSON of what an event moved: the op, and by field the value before and after."""
    def shown(side: str, c: str) -> Column:
        v = F.col(f"{side}.{c}")
        return F.coalesce(v.cast("string"), F.lit("null")) if c in ("amount_minor", "deleted", "provisional") else quoted(v.cast("string"))

    parts = [F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.concat(F.lit(f'"{c}":{{"from":'), shown("before", c), F.lit(',"to":'), shown("after", c), F.lit("}"))) for c in SNAPSHOT]
    return F.concat(F.lit('{"op":'), quoted(F.col("op")), F.lit(',"fields":{'), F.concat_ws(",", *parts), F.lit("}}"))


def bodies(decisions: DataFrame) -> DataFrame:
    """(seq, body) of labelled history; empty blocks are left out of a body."""
    text = {
        "type": F.lit("decision"), "event_id": F.col("event_id"), "user_id": F.col("user_id"), "transaction_id": F.col("transaction_id"), "action": F.col("action"), "source": F.col("source"),
        "timestamp": dates.format_ts(F.col("event_ts")), "decision": F.col("decision"), "rule": F.col("rule"), "reason": F.col("reason"), "op": F.col("op"),
    }
    parts = [F.concat(F.lit(f'"{k}":'), quoted(v)) for k, v in text.items()]
    parts += [F.concat(F.lit(f'"{k}":'), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in ("seq", "user_version", "txn_version")]
    parts.append(F.concat(F.lit('"state_diff":'), state_diff()))
    if "evidence" in decisions.columns:
        parts.append(F.concat(F.lit('"evidence":'), evidence(F.col("evidence"), F.col("n_events"))))
    for k in ("changed_fields", "new_conflicts", "anomalies", "warnings"):
        if k in decisions.columns:
            parts.append(F.when(F.size(k) > 0, F.concat(F.lit(f'"{k}":'), F.to_json(k, {"ignoreNullFields": "false"}))))
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return decisions.select("seq", resorted(body).alias("body"))


def sealed(records: DataFrame, first: str | None, previous: str = GENESIS, start: int = 0) -> DataFrame:
    """(position, seq, body, prev_hash, record_hash), the header ``first`` at position ``start``; without one, the chain goes on there.

    The one ordered pass: a chain is serial by nature. It streams, a batch at a time.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["position", "seq", "body", "prev_hash", "record_hash"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        place, head = start - 1, previous
        if first is not None:
            place, head = start, chain_hash(previous, first)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((place, None, first, previous, head), types, strict=True)], names)
        for batch in batches:
            rows = []
            for seq, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place += 1
                rows.append((place, seq, body, head, head := chain_hash(head, body)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    # An exchange parts the bodies, built in parallel, from the one task that only sorts and hashes them.
    ordered = records.select("seq", "body").repartition(1).sortWithinPartitions("seq")
    return ordered.mapInArrow(chain, "position long, seq long, body string, prev_hash string, record_hash string")


def breaks(chain: DataFrame) -> DataFrame:
    """(position, kind) of every record whose hash is not its body's, or whose prev_hash is not the one before it.

    Bodies are hashed where they stand. Only hashes are dealt, by stretches of positions, the
    last record of a stretch to the next one too, so the serial chain is made once, not joined to itself.
    """
    at, known = F.col("position"), F.coalesce("record_hash", F.lit("none"))
    hashed = chain.select("position", "prev_hash", known.alias("hash"), (chained(F.col("prev_hash"), F.col("body")) != F.col("record_hash")).alias("wrong"))
    here = F.floor(at / STRETCH)
    places = F.when((at + 1) % STRETCH == 0, F.array(here, here + 1)).otherwise(F.array(here))
    dealt = hashed.withColumn("stretch", F.explode(places))
    before = Window.partitionBy("stretch").orderBy("position").rangeBetween(-1, -1)
    dealt = dealt.withColumns({"least": F.min("hash").over(before), "most": F.max("hash").over(before)}).where(F.col("stretch") == here)
    loose = F.when(at == 0, F.col("prev_hash") != GENESIS).otherwise(F.coalesce((F.col("least") != F.col("prev_hash")) | (F.col("most") != F.col("prev_hash")), F.lit(True)))
    return dealt.select("position", F.when(F.col("wrong"), "record_hash").when(loose, "prev_hash").alias("kind")).where("kind IS NOT NULL")


def first_break(chain: DataFrame) -> tuple[int, str] | None:
    row = breaks(chain).agg(F.min(F.struct("position", "kind")).alias("b")).first()
    return None if row.b is None else (row.b.position, row.b.kind)


def head_hash(chain: DataFrame) -> str:
    row = chain.agg(F.max_by("record_hash", "position")).first()
    return row[0] or GENESIS


def summary(decisions: DataFrame) -> DataFrame:
    """(kind, name, n): decisions by label, rule and reason head; distinct users; sums of conflicts and anomalies."""
    def counted(kind: str, name: Column) -> DataFrame:
        return decisions.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")

    heads = decisions.select(F.explode(F.split("reason", ";")).alias("r")).groupBy(F.substring_index("r", ":", 1).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("reason").alias("kind"), "name", "n")
    totals = {"users": F.count_distinct(F.nullif("user_id", F.lit("")))} | {k: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long") for k, c in (("conflicts", "new_conflicts"), ("anomalies", "anomalies")) if c in decisions.columns}
    one = decisions.agg(*(v.alias(k) for k, v in totals.items()))
    total = one.select(F.explode(F.array(*(F.struct(F.lit("total").alias("kind"), F.lit(k).alias("name"), F.col(k).alias("n")) for k in totals))).alias("t")).select("t.*")
    return counted("decision", F.col("decision")).unionByName(counted("rule", F.col("rule"))).unionByName(heads).unionByName(total)


def _lines(chain: DataFrame) -> DataFrame:
    line = F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"prev_hash":"'), F.col("prev_hash"), F.lit('","record_hash":"'), F.col("record_hash"), F.lit('"}'))
    return chain.coalesce(1).sortWithinPartitions("position").select(line.alias("value"))


def write_jsonl(chain: DataFrame, path: str) -> None:
    """One JSON line for each record, in order, with its hashes."""
    _lines(chain).write.mode("overwrite").text(path)


def append_jsonl(spark: SparkSession, records: DataFrame, path: str, first: str) -> str:
    """Seal records behind what the folder holds, one subfolder a call, and return the new head; a new folder starts with the header ``first``.

    Subfolders are named by the position they start at, so that names sort as the
    chain does. A call that fails midway leaves no ``_SUCCESS`` and is replaced by
    the next one, which starts at the same position.
    """
    runs = finished_runs(spark, path)
    held = read_jsonl(spark, runs) if runs else None
    last = None if held is None else held.agg(F.max("position").alias("p"), F.max_by("record_hash", "position").alias("h")).first()
    start, head = (0, GENESIS) if last is None or last.p is None else (last.p + 1, last.h)
    chain = sealed(records, first if start == 0 else None, head, start)
    folder = f"{path}/at-{start:019d}"
    _lines(chain).write.mode("overwrite").text(folder)
    return head_hash(read_jsonl(spark, folder)) if records.take(1) or start == 0 else head


def finished_runs(spark: SparkSession, path: str) -> list[str]:
    """The finished subfolders of an appended trail, for ``read_jsonl``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.listStatus(at) if fs.exists(at) else []:
        run = status.getPath()
        if run.getName().startswith("at-") and fs.exists(jvm.org.apache.hadoop.fs.Path(run, "_SUCCESS")):
            out.append(run.toString())
    return sorted(out)


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The chain again: by file name, then by place in the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    lines = lines.withColumn("__id", F.monotonically_increasing_id())
    hashes = {k: F.get_json_object("value", f"$.{k}") for k in ("prev_hash", "record_hash")}
    body = F.regexp_replace("value", r',"prev_hash":"[0-9a-f]*","record_hash":"[0-9a-f]*"\}$', "}")
    out = lines.select("__file", "__block", "__id", F.get_json_object("value", "$.seq").cast("long").alias("seq"), body.alias("body"), *(v.alias(k) for k, v in hashes.items()))
    return out.withColumn("position", (F.row_number().over(Window.orderBy("__file", "__block", "__id")) - 1).cast("long")).drop("__file", "__block", "__id")


def replay_diff(recorded: DataFrame, replayed: DataFrame, fields: tuple[str, ...] = ("event_id", "decision", "rule", "reason", "op", "txn_version", "user_version")) -> DataFrame:
    """(seq, field, recorded, replayed) of every difference between two histories; a missing row differs in ``row``."""
    a, b = (df.select("seq", F.struct(*(F.col(c).cast("string").alias(c) for c in fields)).alias(n)) for df, n in ((recorded, "a"), (replayed, "b")))
    both = a.join(b, "seq", "full_outer")
    diffs = F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").alias("recorded"), F.col(f"b.{c}").alias("replayed"))) for c in fields))
    gone = F.struct(F.lit("row").alias("field"), F.when(F.col("a").isNotNull(), "there").alias("recorded"), F.when(F.col("b").isNotNull(), "there").alias("replayed"))
    found = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(gone)).otherwise(F.array_compact(diffs))
    return both.select("seq", F.explode(found).alias("d")).select("seq", "d.field", "d.recorded", "d.replayed")
