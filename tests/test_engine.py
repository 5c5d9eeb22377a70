import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT, Period
from ledgerloom.engine import Engine, run
from ledgerloom.errors import DuplicateEvent, InputError, ReplayMismatch, TooLarge
from ledgerloom.operators import audit, fold, history, normalize, rollups, sequential
from ledgerloom.sources import readers
from ledgerloom.sources.store import ParquetStore


def row(n, action, ts, source="bank_sync", txn="T1", user="u", **more):
    base = {"event_id": f"e{n}", "user_id": user, "transaction_id": txn, "action": action, "event_ts": f"2024-01-{ts:02d}T00:00:00Z", "source": source}
    if action == "create":
        base |= {"amount": "10.00", "date": f"2024-01-{ts:02d}"}
    return {k: v for k, v in (base | more).items() if v is not None}


def decided(spark, rows, rules=DEFAULT):
    batch = Engine(spark, rules).ingest_rows(rows)
    return {r.event_id: (r.decision, r.rule[:2], r.reason) for r in batch.all_decisions().collect()}, batch


def test_rules_one_by_one(spark):
    got, _ = decided(spark, [
        row(1, "create", 5), row(1, "create", 5), row(2, "create", 6, amount=None), row(3, "create", 4, source="unknown", amount="99"), row(4, "update", 7, source="user_edit", category="food"),
        row(5, "update", 9, category="rent"), row(6, "delete", 10), row(7, "update", 11, source="unknown", category="x"), row(8, "update", 12, source="user_edit", category="y"),
        row(9, "update", 3, txn="T2", category="z"), row(10, "create", 2, txn="T2"), row(11, "delete", 8, txn="T3"), row(12, "create", 7, txn="T3"),
    ])
    assert got["e1"] in (("ignored", "R1", "duplicate_event_id"), ("created", "R3", "transaction_created"))
    assert [k for k, v in got.items() if v[0] == "rejected"] and [v for v in got.values() if v[0] == "rejected"][0][2] == "E_MISSING_AMOUNT"
    assert got["e3"][:2] == ("ignored", "R4") and "late_event_superseded" in got["e3"][2]
    assert got["e4"] == ("merged", "R5", "fields_merged:category")
    assert got["e5"] == ("ignored", "R5", "outranked_by_existing_values")
    assert got["e6"] == ("deleted", "R7", "transaction_deleted")
    assert got["e7"] == ("ignored", "R7", "update_after_delete_superseded")
    assert got["e8"][:2] == ("merged", "R5") and got["e8"][2].startswith("transaction_restored")
    assert got["e9"] == ("created", "R6", "transaction_created")
    assert got["e11"] == ("created", "R9", "transaction_created")


def test_live_children_and_locked_period(spark):
    rows = [row(1, "create", 1, txn="P"), row(2, "create", 2, txn="C", parent_transaction_id="p"), row(3, "delete", 3, txn="P"), row(4, "delete", 4, txn="C"), row(5, "delete", 5, txn="P")]
    got, batch = decided(spark, rows)
    assert got["e3"] == ("ignored", "R8", "delete_blocked_by_dependencies;live_children") and got["e5"][:2] == ("deleted", "R7")
    locked = DEFAULT.with_(locked_periods={"*": (Period(datetime.date(2024, 1, 1), datetime.date(2024, 1, 31)),)})
    got, _ = decided(spark, [row(1, "create", 1), row(2, "delete", 3)], locked)
    assert got["e2"] == ("ignored", "R8", "delete_blocked_by_dependencies;locked_period")


def test_dates_by_authority(spark):
    for rows, want in [
        ([row(1, "create", 5), row(2, "create", 6, date="2024-01-03")], "2024-01-03"),
        ([row(1, "create", 3), row(2, "create", 9, source="user_edit")], "2024-01-09"),
    ]:
        e = Engine(spark)
        e.ingest_rows(rows)
        assert str(e.states().first().date) == want


def random_rows(seed, parents):
    r = random.Random(seed)
    out = []
    for n in range(120):
        action = r.choice(["create", "update", "update", "delete"])
        more = {"category": r.choice(["a", "b", None]), "merchant": r.choice(["m", None]), "amount": r.choice(["1", "2.5", None]) if action != "create" else r.choice(["1", "3"]), "currency": r.choice(["USD", "JPY"]), "date": f"2024-01-{r.randint(1, 28):02d}"}
        if parents and r.random() < 0.3:
            more["parent_transaction_id"] = f"T{r.randint(0, 6)}"
        out.append(row(n, action, r.randint(1, 9), source=r.choice(["user_edit", "bank_sync", "third_party"]), txn=f"T{r.randint(7, 12) if more.get('parent_transaction_id') else r.randint(0, 6)}", user=f"u{r.randint(0, 2)}", **more))
    return out


def events_of(spark, rows, rules=DEFAULT):
    ready = normalize.normalized(normalize.remap_maps(readers.read_memory(spark, rows)), rules)
    return normalize.first_arrivals(ready.where("accepted"))[0].drop("issues", "accepted", "extra")


def test_native_and_ordered_pass_agree(spark):
    for rules in (DEFAULT, DEFAULT.with_(allow_update_before_create=False, resurrect_deleted_on_higher_authority=False), DEFAULT.with_(prefer_earliest_date_on_equal_authority=False, allow_delete_before_create=False)):
        e = events_of(spark, random_rows(1, False), rules).cache()
        native = history.arrivals(e, rules)
        ordered = sequential.ordered_arrivals(e, rules, native.schema)
        assert native.exceptAll(ordered).count() == 0 == ordered.exceptAll(native).count()


def test_routed_and_whole_ordered_pass_agree(spark):
    for seed in (11, 12):
        e = events_of(spark, random_rows(seed, True)).cache()
        routed = history.history(e)
        whole = sequential.ordered_arrivals(e, DEFAULT, history.arrivals(e).schema)
        keys = history.needs_order(e).count()
        assert 0 < keys < e.select("user_key", "transaction_key").distinct().count()
        names = ["seq", "deleted", "blocked", "lifecycle", "notes", "amount_minor", "date", "category", "is_late", "conflicts"]
        assert routed.select(names).exceptAll(whole.select(names)).count() == 0 and routed.count() == whole.count()


def test_one_move_an_event_equals_a_refold():
    rows = []
    r = random.Random(7)
    for n in range(400):
        t = f"t{r.randint(0, 5)}"
        rows.append({
            "seq": n, "event_id": f"e{n:04d}", "user_id": "u", "user_key": "u", "transaction_key": t, "transaction_id": t, "action": r.choice(["create", "update", "delete"]), "source": "bank_sync", "authority": r.choice([1, 10]),
            "event_ts": datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n if r.random() < 0.8 else r.randint(0, 400)), "amount_minor": r.choice([None, 1, 2]), "currency": r.choice(["USD", "JPY"]),
            "date": r.choice([None, datetime.date(2024, 1, r.randint(1, 9))]), "category": r.choice([None, "a", "b"]), "merchant": None, "account_id": None, "parent_transaction_id": r.choice([None, None, None, f"T{r.randint(0, 5)}"]),
        })
    got = sequential.replay([dict(x) for x in rows], DEFAULT)
    # The same with every log gone through anew at each arrival.
    class Anew(sequential.Pass):
        def arrive(self, txn, e, guarded):
            txn.deletes, txn.guarded = 1, not guarded
            return super().arrive(txn, e, guarded)

    plain, sequential.Pass = sequential.Pass, Anew
    try:
        want = sequential.replay([dict(x) for x in rows], DEFAULT)
    finally:
        sequential.Pass = plain
    assert got == want and any(x["blocked"] for x in got) and any(x["conflicts"] for x in got)


def test_status_and_rejection_ids(spark):
    e = Engine(spark)
    bad = {"user": "u", "op": "new", "amt": "x", "date": "2024-01-01", "ts": "2024-01-01"}
    first = e.ingest_rows([row(1, "create", 1), bad])
    assert first.status() == 200 and e.ingest_rows([row(1, "create", 1)]).status() == 409
    second = e.ingest_rows([bad])
    assert second.status() == 400
    ids = {x.event_id for b in (first, second) for x in b.all_decisions().where("decision = 'rejected'").collect()}
    assert len(ids) == 1 and ids.pop().startswith("bad-")


def test_order_of_files(spark, tmp_path):
    for folder, user in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        for n in range(2):
            (tmp_path / folder / f"x{n}.csv").write_text(f"user\nu{user}{n}a\nu{user}{n}b\n")
    def said(*p):
        return [x.data["user"] for x in readers.read_files(spark, [str(tmp_path / q) for q in p]).orderBy("seq").collect()]
    assert said("b/*.csv", "a/x1.csv") == ["u20a", "u20b", "u21a", "u21b", "u11a", "u11b"]
    rows = readers.read_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert rows.select("seq").distinct().count() == 8 and said("a", "b")[:2] == ["u10a", "u10b"]
    bulk = readers.bulk_csv(spark, [str(tmp_path / "b" / "x0.csv"), str(tmp_path / "a" / "x0.csv")]).orderBy("seq").collect()
    assert [(x.seq, x.user) for x in bulk] == [(1, "u10a"), (2, "u10b"), (3, "u20a"), (4, "u20b")]


def test_state_does_not_depend_on_arrival_order(spark):
    rows = random_rows(2, False)
    books = set()
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        books.add(rollups.book_hash(fold.folded(events_of(spark, rows))))
    assert len(books) == 1


def test_fast_form_equals_full_fold(spark):
    e = events_of(spark, random_rows(3, False)).cache()
    full, mixed = fold.folded(e).drop("conflicts"), fold.folded_mixed(e)
    assert full.exceptAll(mixed.select(full.columns)).count() == 0 and full.count() == mixed.count()


def test_ties_and_currencies(spark):
    s = fold.folded(events_of(spark, [row(1, "create", 1, amount="1"), row(2, "create", 1, amount="2"), row(3, "create", 2, amount="3", currency="JPY")])).first()
    assert [(c.type, c.winner_event_id) for c in s.conflicts] == [("authority_tie", "e2"), ("currency_mismatch", None)] and s.currency == "JPY"


def test_evidence_by_both_passes(spark):
    e = events_of(spark, random_rows(21, True)).cache()
    native = history.arrivals(e, DEFAULT.with_(enforce_delete_dependencies=False), evidence=True)
    ordered = sequential.ordered_arrivals(e, DEFAULT.with_(enforce_delete_dependencies=False), native.schema)
    assert native.exceptAll(ordered).count() == 0 == ordered.exceptAll(native).count()


def test_evidence_and_changes(spark):
    e = events_of(spark, [row(1, "create", 5), row(2, "update", 6, source="user_edit", amount="12.50"), row(3, "update", 3, category="a"), row(4, "delete", 7), row(5, "update", 8, source="unknown", category="b")])
    rows = {r.event_id: r for r in history.history(e, evidence=True).collect()}
    assert [(x.event_id, x.action, x.won, x.lost, x.blocked, x.lifecycle) for x in rows["e5"].evidence] == [
        ("e3", "update", ["category"], [], None, ["provisional_from_update_before_create"]), ("e1", "create", ["date"], ["amount"], None, ["provisional_confirmed"]), ("e2", "update", ["amount"], [], None, []),
        ("e4", "delete", [], [], None, ["deleted"]), ("e5", "update", [], [], "update_after_delete_superseded", []),
    ]
    moved = {(r.event_id, r.field): (r.was, r.now) for r in history.changes(history.history(e)).collect()}
    assert moved["e2", "amount"] == ("10.00", "12.50") and moved["e4", "deleted"] == ("false", "true") and moved["e1", "date"] == (None, "2024-01-05")
    body = {r.seq: json.loads(r.body) for r in audit.bodies(history.history(e, evidence=True)).collect()}
    of = {b["event_id"]: b for b in body.values()}
    assert of["e2"]["state_diff"] == {"op": "updated", "fields": {"amount": {"from": "10.00", "to": "12.50"}, "amount_minor": {"from": 1000, "to": 1250}}}
    assert of["e2"]["evidence"][-1] == {"event_id": "e2", "action": "update", "source": "user_edit", "authority": 100, "seq": of["e2"]["seq"], "amount": "12.50", "event_ts": "2024-01-06T00:00:00Z", "won": ["amount"]}


def test_long_evidence_is_cut(spark):
    e = events_of(spark, [row(0, "create", 1), *(row(n, "update", 2, category=f"c{n}") for n in range(1, 60))])
    for longest in (256, 10):
        last = history.history(e, longest=longest, evidence=True).orderBy(F.desc("seq"))
        r = last.first()
        assert len(r.evidence) == 50 and r.n_events == 60
        items = json.loads(audit.bodies(last.limit(1)).first().body)["evidence"]
        assert items[0] == {"note": "evidence_truncated", "total_events": 60, "shown": 50} and len(items) == 51


def test_appended_trail_goes_on(spark, tmp_path):
    e, path = Engine(spark), str(tmp_path / "trail")
    e.append_audit(e.ingest_rows([row(1, "create", 1), row(2, "update", 2, category="a")]), path)
    head = e.append_audit(e.ingest_rows([row(3, "update", 3, category="b")]), path)
    (tmp_path / "trail" / "at-9999999999999999999").mkdir()
    back = audit.read_jsonl(spark, audit.finished_runs(spark, path)).cache()
    assert back.count() == 4 and audit.first_break(back) is None and audit.head_hash(back) == head


def test_listings_and_overview(spark):
    e = Engine(spark)
    batch = e.ingest_rows([row(1, "create", 1, amount="1"), row(2, "create", 1, amount="2"), row(3, "create", 2, amount="-300000", currency="JPY")])
    assert sorted((r.type, r.event_id) for r in e.conflicts().collect()) == [("authority_tie", "e2"), ("currency_mismatch", "e3")]
    assert {"A_CURRENCY_CHANGE", "A_SIGN_FLIP"} <= {r.code for r in e.anomalies().collect()}
    said = e.overview()
    assert said["state_hash"] == e.state_hash() and said["total"]["conflicts"] == 2
    e.verify(batch.decisions, state_hash=said["state_hash"], head=said["audit_head"])
    with pytest.raises(ReplayMismatch):
        e.verify(batch.decisions, state_hash="0")
    states = e.states()
    one = rollups.transaction_hashes(states).first()
    other = rollups.transaction_hashes(states.withColumn("date_owner", F.lit(None).cast(states.schema["date_owner"].dataType))).first()
    assert one.state_hash == other.state_hash and one.authority_hash != other.authority_hash


def test_audit_chain(spark):
    e = Engine(spark)
    e.ingest_rows(random_rows(4, True))
    chain = e.chain().cache()
    assert audit.first_break(chain) is None and chain.count() > 100
    assert audit.head_hash(e.chain()) == audit.head_hash(chain)
    forged = chain.withColumn("body", F.when(F.col("position") == 7, F.lit("{}")).otherwise(F.col("body")))
    assert audit.first_break(forged) == (7, "record_hash")
    assert audit.first_break(chain.where("position <> 9")) == (10, "prev_hash")


def test_audit_file_round_trip(spark, tmp_path):
    e = Engine(spark)
    e.ingest_rows([row(1, "create", 1), row(2, "update", 2, category="é \"q\"")])
    chain = e.chain()
    audit.write_jsonl(chain, str(tmp_path / "a"))
    back = audit.read_jsonl(spark, str(tmp_path / "a"))
    assert audit.first_break(back) is None and audit.head_hash(back) == audit.head_hash(chain)


def test_replay(spark):
    e = Engine(spark)
    batch = e.ingest_rows(random_rows(5, True))
    e.verify(batch.decisions)
    with pytest.raises(ReplayMismatch):
        e.verify(batch.decisions.withColumn("reason", F.lit("x")))


def test_store_round_trip_and_warm_start(spark, tmp_path):
    rows = random_rows(6, True)
    whole = Engine(spark)
    whole.ingest_rows(rows)
    first = Engine(spark, store=ParquetStore(spark, str(tmp_path / "s")))
    first.ingest_rows(rows[:60])
    second = Engine(spark, store=ParquetStore(spark, str(tmp_path / "s")))
    batch = second.ingest_rows(rows[50:])
    assert batch.counts()["duplicates"] > 0
    assert rollups.book_hash(second.states()) == rollups.book_hash(whole.states())
    second.save_state()
    second.save_state()
    assert second.store.transactions().count() == second.states().count()
    assert second.store.query("SELECT count(*) AS n FROM events WHERE user_key = :u", {"u": "u1"}).first().n == second.store.events_for_user("u1").count()
    second.save_run(batch, datetime.datetime(2024, 1, 1))
    assert second.store.runs().count() == 1 and second.store.next_seq() > 100
    with pytest.raises(DuplicateEvent):
        second.store.add_events(second.store.read("events").limit(1), strict=True)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿user;op;txn_id;amt;date;ts\nu;new;A;1,5;2024-01-01;2024-01-01\n\nu;new;B;2;2024-01-02;;x\n".encode())
    (tmp_path / "b.json").write_text('{"rows": [{"uid": "u", "action": "void", "id": "A", "ts": 1704240000, "flag": true}]}')
    (tmp_path / "c.jsonl").write_text('{"user": "v", "type": "c", "ref": "C", "value": 3, "date": "2024-01-01"}\n')
    paths = [str(tmp_path / n) for n in ("a.csv", "b.json", "c.jsonl")]
    _, batch = run(spark, readers.read_files(spark, paths))
    assert batch.counts() == {"accepted": 4, "duplicates": 0, "rejected": 0}
    assert [r.action for r in batch.accepted.orderBy("seq").collect()] == ["create", "create", "delete", "create"]
    (tmp_path / "d.jsonl").write_text("{}\nnope\n")
    with pytest.raises(InputError):
        readers.read_files(spark, [str(tmp_path / "d.jsonl")])
    with pytest.raises(TooLarge):
        readers.read_files(spark, paths, DEFAULT.with_(max_upload_bytes=10))


def test_stream_equals_batch(spark, tmp_path):
    from ledgerloom.streaming import ingest

    rows = random_rows(8, True)
    src = tmp_path / "in"
    df = readers.read_memory(spark, rows)
    df.where("seq <= 60").coalesce(1).write.mode("append").parquet(str(src))
    df.where("seq > 60").coalesce(1).write.mode("append").parquet(str(src))
    engine = Engine(spark, store=ParquetStore(spark, str(tmp_path / "store")))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = ingest.start(stream, engine, str(tmp_path / "cp"))
    q.awaitTermination(120)
    whole = Engine(spark)
    whole.ingest_rows(rows)
    assert fold.folded(engine.store.read("events")).drop("n_events").count() == fold.folded(whole.store.read("events")).count()


def test_other_moments(spark):
    e = Engine(spark)
    e.ingest_rows([row(1, "create", 1), row(2, "update", 5, category="a"), row(3, "update", 3, merchant="m")])
    assert e.as_of(datetime.datetime(2024, 1, 4)).first().category is None
    assert e.at_version(2).first().category == "a" and e.at_version(2).first().merchant is None
    assert e.at_version(0).count() == 0 and e.at_version(99).first().merchant == "m"
    assert e.user(" U ").count() == 1
