"""The engine as one object: batches in, decisions, state and audit out."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import DEFAULT, Rules
from .errors import ReplayMismatch
from .operators import anomalies, audit, history, normalize, rollups
from .sources.readers import read_files, read_memory
from .sources.scratch import written
from .sources.store import Store, open_store


class Batch:
    """What one batch did: accepted events, duplicates, rejects, decisions; raw has each offered row (seq, raw) as it came."""

    def __init__(self, rows: DataFrame, accepted: DataFrame, duplicates: DataFrame, decisions: DataFrame, raw: DataFrame):
        self.rows, self.accepted, self.duplicates, self.decisions, self.raw = rows, accepted, duplicates, decisions, raw
        self.rejected = rows.where(~F.col("accepted"))

    def counts(self) -> dict[str, int]:
        return {"accepted": self.accepted.count(), "duplicates": self.duplicates.count(), "rejected": self.rejected.count()}

    def status(self) -> int:
        """200 if any row went in, 409 if all that could be read were known, 400 if none could be read or none came."""
        c = self.counts()
        if c["accepted"]:
            return 200
        return 409 if c["duplicates"] and not c["rejected"] else 400

    def all_decisions(self) -> DataFrame:
        """One row for each offered row: the decisions, R1 for duplicates and R2 for rejects."""
        cols = ["seq", "event_id", "decision", "rule", "reason", "status"]
        done = self.decisions.withColumn("status", F.lit(200)).select(cols)
        known = self.duplicates.select("seq", "event_id", F.lit("ignored").alias("decision"), F.lit("R1_DUPLICATE_EVENT").alias("rule"), F.lit("duplicate_event_id").alias("reason"), F.lit(409).alias("status"))
        codes = F.array_join(F.array_distinct(F.transform(F.filter("issues", lambda i: i["severity"] == "error"), lambda i: i["code"])), ";")
        bad = self.rejected.join(self.raw, "seq").select("seq", normalize.rejection_id(F.col("raw")).alias("event_id"), F.lit("rejected").alias("decision"), F.lit("R2_SCHEMA_REJECT").alias("rule"), codes.alias("reason"), F.lit(400).alias("status"))
        return done.unionByName(known).unionByName(bad)


class Engine:
    def __init__(self, spark: SparkSession, rules: Rules = DEFAULT, store: Store | None = None):
        self.spark, self.rules = spark, rules
        self.store = store or open_store(spark)

    def ingest(self, rows: DataFrame, full_unicode: bool = True) -> Batch:
        """rows: seq, origin and either a map ``data`` or columns under known headers. seq is moved behind what the store holds.

        full_unicode: texts come to NFKC and ids to their case folding, over Arrow;
        without it the native path lower-cases ids and leaves width variants.
        """
        after = self.store.next_seq()
        low = rows.agg(F.min("seq")).first()[0] or 0
        rows = rows.withColumn("seq", F.col("seq") - low + after)
        names = [c for c in rows.columns if c not in ("seq", "origin")]
        raw = F.col("data") if "data" in names else F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"`{c}`").cast("string") for c in names)))
        offered = rows.select("seq", raw.alias("raw"))
        rows = normalize.remap_maps(rows) if "data" in names else normalize.remap(rows)
        ready = normalize.normalized(rows, self.rules, full_unicode).cache()
        new, duplicates = normalize.first_arrivals(ready.where("accepted"), self.store.seen_ids())
        # Written, so that no later plan holds the parsing.
        new = written(new.drop("issues", "accepted", "extra"), "batch")
        before = self.store.read("events")
        self.store.add_events(new)
        # What an event does depends on its own user's events only.
        touched = new if before is None else before.join(new.select("user_key").distinct(), "user_key", "left_semi").unionByName(new)
        said = self.decide(touched).join(new.select("seq"), "seq", "left_semi").cache()
        return Batch(ready, new, duplicates, said, offered)

    def ingest_files(self, paths: list[str]) -> Batch:
        return self.ingest(read_files(self.spark, paths, self.rules))

    def ingest_rows(self, rows: list[dict]) -> Batch:
        return self.ingest(read_memory(self.spark, rows))

    def decide(self, events: DataFrame, rules: Rules | None = None, evidence: bool = False) -> DataFrame:
        rules = rules or self.rules
        # Read twice: for the flags, and for what was live at each event.
        h = history.history(events, rules, evidence=evidence).cache()
        return anomalies.flagged(h, rules, anomalies.near_duplicates_at(h) if rules.detect_anomalies else None)

    def states(self) -> DataFrame | None:
        events = self.store.read("events")
        return None if events is None else history.final_states(events, self.rules)

    def save_state(self) -> None:
        self.store.save_transactions(self.states())

    def user(self, user_id: str) -> DataFrame:
        return rollups.user_snapshot(self.states(), user_id, self.rules)

    def as_of(self, moment: datetime.datetime) -> DataFrame:
        return rollups.as_of(self.store.read("events"), moment, self.rules)

    def at_version(self, version: int) -> DataFrame:
        events = self.store.read("events")
        return rollups.at_version(events, history.history(events, self.rules), version, self.rules)

    def chain(self) -> DataFrame:
        return audit.sealed(self._bodies(), audit.header(self.rules, __version__))

    def _bodies(self) -> DataFrame:
        return audit.bodies(self.decide(self.store.read("events"), evidence=True))

    def append_audit(self, batch: Batch, path: str) -> str:
        """Add the records of a batch's events to the trail in a folder; returns its new head hash."""
        mine = self._bodies().join(batch.accepted.select("seq"), "seq", "left_semi")
        return audit.append_jsonl(self.spark, mine, path, audit.header(self.rules, __version__))

    def replay(self, rules: Rules | None = None) -> DataFrame:
        """Decisions over the stored events, under other rules if given."""
        return self.decide(self.store.read("events"), rules)

    def verify(self, recorded: DataFrame, most: int = 100, state_hash: str | None = None, head: str | None = None) -> None:
        """Raise with up to ``most`` differences if the stored events do not lead to the recorded decisions, state hash and audit head, as far as given."""
        found = [r.asDict() for r in audit.replay_diff(recorded, self.replay()).limit(most).collect()]
        for name, was, now in (("state_hash", state_hash, self.state_hash), ("audit_head", head, self.audit_head)):
            if was is not None and was != (again := now()):
                found.append({"seq": None, "field": name, "recorded": was, "replayed": again})
        if found:
            raise ReplayMismatch(f"{len(found)} differences", mismatches=found)

    def state_hash(self) -> str:
        return rollups.book_hash(self.states())

    def audit_head(self) -> str:
        return audit.head_hash(self.chain())

    def conflicts(self) -> DataFrame:
        return rollups.conflicts(self.states())

    def anomalies(self) -> DataFrame:
        return anomalies.listed(self.decide(self.store.read("events")))

    def overview(self) -> dict:
        """The summary's counts with the state hash, the audit head and the rules' fingerprint."""
        counts: dict = {}
        for r in self.summary().collect():
            counts.setdefault(r.kind, {})[r.name] = r.n
        return counts | {"state_hash": self.state_hash(), "audit_head": self.audit_head(), "config_fingerprint": self.rules.fingerprint()}

    def summary(self) -> DataFrame:
        return audit.summary(self.decide(self.store.read("events")))

    def save_run(self, batch: Batch, started: datetime.datetime, notes: str = "") -> str:
        done = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        run_id, c = f"run-{uuid.uuid4().hex[:12]}", batch.counts()
        self.store.save_run({
            "run_id": run_id, "started_at": started, "finished_at": done, "engine_version": __version__, "config_fingerprint": self.rules.fingerprint(), "events_accepted": c["accepted"], "events_rejected": c["rejected"],
            "events_duplicate": c["duplicates"], "audit_head_hash": audit.head_hash(self.chain()), "state_hash": rollups.book_hash(self.states()), "notes": notes, "duration_seconds": (done - started).total_seconds(),
        })
        return run_id

    def close(self) -> None:
        self.store.close()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def run(spark: SparkSession, rows: DataFrame, rules: Rules = DEFAULT, store: Store | None = None) -> tuple[Engine, Batch]:
    """One batch in one call."""
    engine = Engine(spark, rules, store)
    return engine, engine.ingest(rows)
