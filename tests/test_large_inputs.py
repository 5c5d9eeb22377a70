"""Registered queries on more than one upload holds, and plans that small tables do not get."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT
from ledgerloom.operators import audit, rollups
from ledgerloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Customers of over four times an upload's cap, in one file."""
    place = str(tmp_path_factory.mktemp("wide"))
    rows = spark.range(150_000).select(F.col("id").alias("c_custkey"), F.rpad(F.concat(F.lit("Customer#"), F.col("id")), 300, "x").alias("c_name"), F.lit("FURNITURE").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(f"{place}/customer.parquet")
    return place


@pytest.mark.parametrize("name", ["read_csv", "read_jsonl", "read_json"])
def test_uploads_over_the_cap_are_parted(spark, wide, name):
    digest = lambda df: df.select(F.count(F.lit(1)), F.sum(F.octet_length("merchant")), F.sum(F.xxhash64("user_id", "merchant", "category").cast("decimal(38,0)"))).first()
    want = catalog._customers(spark, wide).toDF("user_id", "merchant", "category")
    assert digest(want)[1] > 4 * DEFAULT.max_upload_bytes
    assert digest(catalog.QUERIES[name](spark, wide)) == digest(want)


def test_live_children_without_broadcasts(spark):
    states = catalog._states(spark, SMALL)
    rows = {(r.user_key, r.transaction_key): r for r in states.collect()}
    want = {}
    for r in rows.values():
        parent = (r.user_key, (r.parent_transaction_id or "").lower())
        if not r.deleted and parent in rows:
            want.setdefault(parent, []).append(r.transaction_id)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.user_key, r.transaction_key): (r.n_children, r.children) for r in catalog.QUERIES["live_children"](spark, SMALL).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {k: (len(v), ",".join(sorted(v)[:20])) for k, v in want.items()} and len(got) > 40


def test_live_children_lists_every_child(spark):
    """Parents of over a hundred children, against the tail of the SQL over the same states."""
    rows = [("u", f"t{i}", f"T{i}", None if i < 3 else ("T0", "t1", "T9999")[i % 3], i % 7 == 3) for i in range(400)] + [("v", "t500", "T500", "T0", False)]
    states = spark.createDataFrame(rows, "user_key string, transaction_key string, transaction_id string, parent_transaction_id string, deleted boolean")
    got = sorted(tuple(r) for r in rollups.live_children(states, catalog.OPEN).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE state (user_key VARCHAR, transaction_key VARCHAR, transaction_id VARCHAR, parent_transaction_id VARCHAR, deleted BOOLEAN)")
    con.executemany("INSERT INTO state VALUES (?, ?, ?, ?, ?)", rows)
    want = sorted(con.execute(catalog.ORACLES["live_children"].removeprefix(catalog._FINAL)).fetchall())
    assert got == want and [r[2] for r in got] == [len(r[3].split(",")) for r in got] and min(r[2] for r in got) > 100


def test_breaks_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(audit, "STRETCH", 4)
    body = lambda i: f'{{"seq":{i}}}'
    rows, head = [], audit.GENESIS
    for i in range(40):
        rows.append([i, i, body(i), head, head := audit.chain_hash(head, body(i))])
    # Altered, sealed anew behind another, gone at and next to the borders of stretches, without a hash, and twice.
    rows[8][2] += " "
    rows[15][3] = "f" * 64
    rows[15][4] = audit.chain_hash(rows[15][3], rows[15][2])
    rows[35][4] = None
    chain = [r for i, r in enumerate(rows) if i not in (11, 20, 26)] + [[30, 30, body(30), "e" * 64, audit.chain_hash("e" * 64, body(30))]]
    df = spark.createDataFrame(chain, "position long, seq long, body string, prev_hash string, record_hash string")
    got = sorted(tuple(r) for r in audit.breaks(df).collect())
    p, h = "prev_hash", "record_hash"
    assert got == [(8, h), (12, p), (15, p), (16, p), (21, p), (27, p), (30, p), (31, p), (36, p)]


def test_breaks_make_the_chain_once(spark):
    plan = catalog.QUERIES["chain_breaks"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
