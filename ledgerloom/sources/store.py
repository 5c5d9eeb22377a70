"""Tables of the engine as Parquet folders, or in scratch space for short work.

Events and decisions are appended; the materialized state is replaced as a
whole: it is written to a new version folder, and a pointer row appended last
makes it current, so readers never see half of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..errors import DuplicateEvent, StoreError
from .scratch import shared_path

#: Folders that a user's rows are dealt to, so that reading one user opens a part.
BUCKETS = 64
RUNS = "run_id string, started_at timestamp, finished_at timestamp, engine_version string, config_fingerprint string, events_accepted long, events_rejected long, events_duplicate long, audit_head_hash string, state_hash string, notes string, duration_seconds double"


def open_store(spark: SparkSession, target: str | None = None) -> Store:
    return MemoryStore(spark) if target in (None, ":memory:") else ParquetStore(spark, target)


class Store:
    """What both kinds share; a table that was never written reads as None."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, name: str) -> DataFrame | None:
        raise NotImplementedError

    def append(self, name: str, df: DataFrame) -> None:
        raise NotImplementedError

    def replace(self, name: str, df: DataFrame) -> None:
        raise NotImplementedError

    def add_events(self, events: DataFrame, strict: bool = False) -> DataFrame:
        """Append the events whose ids are new and return them. strict: a known id raises."""
        held = self.read("events")
        # Of rows that share an id the first arrival counts.
        nth = F.row_number().over(Window.partitionBy("event_id").orderBy("seq"))
        new = events.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
        if held is not None:
            if strict and (hit := new.join(held.select("event_id"), "event_id", "left_semi").head(1)):
                raise DuplicateEvent(f"event {hit[0].event_id} is in the store", event_id=hit[0].event_id)
            new = new.join(held.select("event_id"), "event_id", "left_anti")
        if bad := new.where("event_id IS NULL OR user_key IS NULL OR transaction_key IS NULL OR action NOT IN ('create', 'update', 'delete') OR supplied IS NULL").head(1):
            raise StoreError("an event breaks the table's constraints", event_id=bad[0].event_id)
        new = new.select(events.columns)
        self.append("events", new)
        return new

    def events(self) -> DataFrame | None:
        df = self.read("events")
        return None if df is None else df.orderBy("seq")

    def events_for_user(self, user_key: str) -> DataFrame | None:
        df = self.read("events")
        return None if df is None else df.where(F.col("user_key") == user_key).orderBy("seq")

    def has_event(self, event_id: str) -> bool:
        df = self.read("events")
        return df is not None and bool(df.where(F.col("event_id") == event_id).head(1))

    def seen_ids(self) -> DataFrame | None:
        df = self.read("events")
        return None if df is None else df.select("event_id")

    def event_count(self) -> int:
        df = self.read("events")
        return 0 if df is None else df.count()

    def next_seq(self) -> int:
        df = self.read("events")
        return 1 if df is None else (df.agg(F.max("seq")).first()[0] or 0) + 1

    def add_decisions(self, decisions: DataFrame) -> None:
        self.append("decisions", decisions)

    def decisions(self) -> DataFrame | None:
        df = self.read("decisions")
        return None if df is None else df.orderBy("seq")

    def decision_count(self) -> int:
        df = self.read("decisions")
        return 0 if df is None else df.count()

    def save_transactions(self, states: DataFrame) -> None:
        self.replace("transactions", states)

    def transactions(self) -> DataFrame | None:
        return self.read("transactions")

    def save_run(self, run: dict) -> None:
        """Runs are appended; of several with one id the last saved counts."""
        names = [f.split()[0] for f in RUNS.split(", ")]
        n = self.read("runs")
        row = self.spark.createDataFrame([tuple(run.get(c) for c in names)], RUNS).withColumn("saved", F.lit(0 if n is None else n.count()))
        self.append("runs", row)

    def runs(self) -> DataFrame | None:
        df = self.read("runs")
        if df is None:
            return None
        last = df.groupBy("run_id").agg(F.max_by(F.struct(*(c for c in df.columns if c not in ("run_id", "saved"))), "saved").alias("r"))
        return last.select("run_id", "r.*").orderBy("started_at", "run_id")

    def query(self, sql: str, args: dict | None = None) -> DataFrame:
        """A read-only statement over the tables, by their names."""
        if not sql.lstrip().lower().startswith(("select", "with", "show", "describe")):
            raise StoreError("only reading statements")
        for name in ("events", "decisions", "transactions", "runs"):
            if (df := self.read(name)) is not None:
                df.createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args)

    def run_script(self, script: str) -> None:
        for statement in (s.strip() for s in script.split(";")):
            if statement:
                self.spark.sql(statement)

    def close(self) -> None:
        pass

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class MemoryStore(Store):
    """Tables of this session only, in its scratch folder: a plan over them is one scan, however many batches came."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self._tables: dict[str, list[str]] = {}
        self._schemas: dict[str, StructType] = {}

    def read(self, name: str) -> DataFrame | None:
        return self.spark.read.schema(self._schemas[name]).parquet(*self._tables[name]) if name in self._tables else None

    def _write(self, name: str, df: DataFrame) -> str:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        self._schemas[name] = df.schema
        return path

    def append(self, name: str, df: DataFrame) -> None:
        self._tables[name] = [*self._tables.get(name, []), self._write(name, df)]

    def replace(self, name: str, df: DataFrame) -> None:
        self._tables[name] = [self._write(name, df)]

    def close(self) -> None:
        self._tables.clear()


class ParquetStore(Store):
    """Tables under one root; rows with a user are dealt to BUCKETS folders by its hash."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark)
        self.root = root.rstrip("/")

    def _load(self, path: str) -> DataFrame | None:
        try:
            df = self.spark.read.parquet(path)
        except AnalysisException:
            return None
        return df.drop("bucket") if "bucket" in df.columns else df

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        if "user_key" in df.columns:
            df = df.withColumn("bucket", F.pmod(F.xxhash64("user_key"), F.lit(BUCKETS)).cast("int"))
            order = [c for c in ("user_key", "seq") if c in df.columns]
            df.repartition("bucket").sortWithinPartitions("bucket", *order).write.mode(mode).partitionBy("bucket").parquet(path)
        else:
            df.write.mode(mode).parquet(path)

    def read(self, name: str) -> DataFrame | None:
        if name != "transactions":
            return self._load(f"{self.root}/{name}")
        pointers = self._load(f"{self.root}/{name}/pointers")
        if pointers is None:
            return None
        return self._load(f"{self.root}/{name}/{pointers.agg(F.max_by('version', 'nth')).first()[0]}")

    def append(self, name: str, df: DataFrame) -> None:
        self._write(df, f"{self.root}/{name}", "append")

    def events_for_user(self, user_key: str) -> DataFrame | None:
        try:
            df = self.spark.read.parquet(f"{self.root}/events")
        except AnalysisException:
            return None
        bucket = F.pmod(F.xxhash64(F.lit(user_key)), F.lit(BUCKETS)).cast("int")
        return df.where((F.col("bucket") == bucket) & (F.col("user_key") == user_key)).drop("bucket").orderBy("seq")

    def replace(self, name: str, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        self._write(df, f"{self.root}/{name}/{version}", "errorifexists")
        pointers = self._load(f"{self.root}/{name}/pointers")
        nth = 0 if pointers is None else pointers.count()
        self.spark.createDataFrame([(nth, version)], "nth long, version string").coalesce(1).write.mode("append").parquet(f"{self.root}/{name}/pointers")
