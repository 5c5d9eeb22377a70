"""What each arriving event did: state before and after, versions, labels.

``history`` is native: a window gathers each transaction's log up to the event,
and the fold runs over that prefix. It needs O(k^2) entries for a transaction of
k events, so logs longer than ``longest`` and transactions whose deletes may meet
children (see ``needs_order``) go to the ordered pass of ``sequential`` instead,
which keeps a user's such transactions in memory and needs one move for an event
in timeline order. Both give the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ACTION_RANK, DEFAULT, GROUPS, Rules
from ..functions import money
from ..functions.text import first_reasons
from .fold import KEYS, TYPES, VALUE, fold_log, log_entry, state_columns

#: Fields of a transaction's snapshot, in the order of their names.
SNAPSHOT = ("account_id", "amount", "amount_minor", "category", "currency", "date", "deleted", "merchant", "parent_transaction_id", "provisional")
LONGEST = 256
#: Evidence of a decision: the last so many entries of the log as it was then.
EVIDENCE = 50


def _snapshot() -> Column:
    """The financial view of the state columns; null while the transaction does not exist."""
    return F.when(F.col("exists"), F.struct(*(F.col(c) if c != "amount" else money.format_amount(F.col("amount_minor"), F.col("currency")).alias("amount") for c in SNAPSHOT)))


def needs_order(events: DataFrame, rules: Rules = DEFAULT, longest: int = LONGEST) -> DataFrame:
    """The keys of the transactions that only the ordered pass can do right or cheaply.

    Long ones; those with a delete that another one points at; and those that
    point at one of these, as its deletes depend on whether they are live.
    """
    by_txn = events.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("action") == "delete").alias("deletes"))
    long = by_txn.where(F.col("n") > longest).select(*KEYS)
    if not rules.enforce_delete_dependencies:
        return long
    pointing = events.where(F.col("parent_key").isNotNull()).select(*KEYS, "parent_key").distinct()
    guarded = by_txn.where("deletes").join(pointing.select("user_key", F.col("parent_key").alias("transaction_key")), list(KEYS), "left_semi").select(*KEYS)
    children = pointing.join(guarded.withColumnRenamed("transaction_key", "parent_key"), ["user_key", "parent_key"], "left_semi").select(*KEYS)
    return long.unionByName(guarded).unionByName(children).distinct()


def _evidence() -> Column:
    """The last EVIDENCE entries of the column log, each with what it asserts and what it did."""
    state = F.col("state")

    def item(p: Column) -> Column:
        e, did = p["e"], p["did"]
        open_ = did["blocked"].isNull()
        owns = lambda g: F.coalesce(state[f"{g}_owner"]["event_id"] == e["event_id"], F.lit(False))
        won = F.array_compact(F.array(*(F.when(open_ & owns(g), F.lit(g)) for g in sorted(GROUPS))))
        lost = F.array_compact(F.array(*(F.when(open_ & ~owns(g) & e[VALUE[g]].isNotNull(), F.lit(g)) for g in sorted(GROUPS))))
        action = F.element_at(F.array(*map(F.lit, ACTION_RANK)), e["rank"] + 1)
        return F.struct(
            e["event_id"].alias("event_id"), action.alias("action"), *(e[c].alias(c) for c in ("source", "authority", "event_ts", "seq", "amount_minor", "currency", "date")),
            won.alias("won"), lost.alias("lost"), did["blocked"].alias("blocked"), did["lifecycle"].alias("lifecycle"),
        )

    pairs = F.zip_with("log", state["each"], lambda e, did: F.struct(e.alias("e"), did.alias("did")))
    return F.transform(F.slice(pairs, F.greatest(F.size("log") - (EVIDENCE - 1), F.lit(1)), EVIDENCE), item)


def arrivals(events: DataFrame, rules: Rules = DEFAULT, evidence: bool = False) -> DataFrame:
    """The state after each event and the effects of the event itself, by the native fold of its prefix.

    evidence: also the entries considered, see ``_evidence``.
    """
    by_seq = Window.partitionBy(*KEYS).orderBy("seq")
    upto = by_seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct("event_ts", F.element_at(F.create_map(F.lit("create"), F.lit(0), F.lit("update"), F.lit(1), F.lit("delete"), F.lit(2)), F.col("action")).alias("rank"), "event_id")
    df = events.withColumns({
        "log": F.collect_list(log_entry()).over(upto),
        "is_late": F.coalesce(key < F.max(key).over(by_seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)),
        "display_id": F.first("transaction_id").over(upto),
    })
    df = df.withColumn("log", F.array_sort("log"))
    df = df.withColumns({"state": fold_log(F.col("log"), F.col("user_key"), rules, F.col("event_id"), evidence), "n_events": F.size("log"), "sources": F.array_sort(F.array_distinct(F.transform("log", lambda e: e["source"])))})
    asserted = F.array_compact(F.array(*(F.when(F.col(VALUE[g]).isNotNull(), F.lit(g)) for g in GROUPS))).alias("asserted")
    return df.select(
        "seq", "event_id", "user_id", "user_key", "transaction_key", F.col("display_id").alias("transaction_id"), "action", "source", "authority", "event_ts", "is_late", "n_events", "sources", asserted,
        F.col("state.blocked").alias("blocked"), F.col("state.lifecycle").alias("lifecycle"), F.col("state.notes").alias("notes"), *state_columns(rules=rules),
        *([_evidence().alias("evidence")] if evidence else []),
    )


def _with_diff(df: DataFrame) -> DataFrame:
    by_seq = Window.partitionBy(*KEYS).orderBy("seq")
    df = df.withColumn("after", _snapshot()).withColumns({"before": F.lag("after").over(by_seq), "known_conflicts": F.lag("conflicts").over(by_seq)})
    changed = F.array_compact(F.array(*(F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in SNAPSHOT)))
    was, now = F.col("before.deleted"), F.col("after.deleted")
    op = (
        F.when(F.col("before").isNull() & F.col("after").isNull(), "none").when(F.col("before").isNull(), "created").when(~was & now, "deleted").when(was & ~now, "restored")
        .when(F.size("changed_fields") > 0, "updated").otherwise("none")
    )
    # A first snapshot lists the fields that have a value.
    df = df.withColumn("changed_fields", changed).withColumn("op", op)
    moved = F.col("op") != "none"
    df = df.withColumn("new_conflicts", F.array_except("conflicts", F.coalesce("known_conflicts", F.array().cast(df.schema["conflicts"].dataType))))
    upto = by_seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({
        "changed": moved, "txn_version": F.sum(moved.cast("long")).over(upto),
        "user_version": F.sum(moved.cast("long")).over(Window.partitionBy("user_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }).drop("known_conflicts")


def _with_ownership(df: DataFrame) -> DataFrame:
    """won and lost: the field groups that the event owns, or asserted and does not own, after the fold; none if blocked."""
    held = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"{g}_owner.event_id") == F.col("event_id"), F.lit(g)) for g in GROUPS))))
    none = F.array().cast("array<string>")
    open_ = F.col("blocked").isNull()
    return df.withColumn("won", F.when(open_, held).otherwise(none)).withColumn("lost", F.when(open_, F.array_sort(F.array_except("asserted", "won"))).otherwise(none))


# How a blocked event is labelled.
_BLOCKED = {
    "delete_blocked_by_dependencies": ("R8_DELETE_BLOCKED", "delete_blocked_by_dependencies"),
    "update_after_delete_superseded": ("R7_DELETE_APPLIED", "update_after_delete_superseded"),
    "update_without_create": ("R6_UPDATE_BEFORE_CREATE", "update_without_create_rejected"),
    "delete_without_create": ("R9_DELETE_BEFORE_CREATE", "delete_without_create_rejected"),
}


def labelled(df: DataFrame) -> DataFrame:
    """Adds decision, rule and reason."""
    existed = F.col("before").isNotNull()
    rule = (
        F.when(F.col("action") == "create", F.when(existed, "R4_CREATE_DUPLICATE").otherwise("R3_CREATE_NEW"))
        .when(F.col("action") == "update", F.when(F.array_contains("lifecycle", "provisional_from_update_before_create"), "R6_UPDATE_BEFORE_CREATE").otherwise("R5_UPDATE_MERGE"))
        .when(F.array_contains("lifecycle", "tombstone_before_create"), "R9_DELETE_BEFORE_CREATE").otherwise("R7_DELETE_APPLIED")
    )
    blocked_rule, blocked_reason = F.lit("R5_UPDATE_MERGE"), F.col("blocked")
    for name, (r, why) in _BLOCKED.items():
        blocked_rule, blocked_reason = F.when(F.col("blocked") == name, r).otherwise(blocked_rule), F.when(F.col("blocked") == name, why).otherwise(blocked_reason)
    materialized = F.array_compact(F.array(*(F.when(F.col(VALUE[g]).isNotNull(), F.lit(g)) for g in GROUPS)))
    owns_all = (F.size(materialized) > 0) & (F.size(F.array_except(materialized, "won")) == 0)
    op = F.col("op")
    merged = F.concat(
        F.when(F.size("won") > 0, F.concat(F.lit("fields_merged:"), F.array_join("won", ","))).otherwise("fields_unchanged"),
        F.when(F.size("lost") > 0, F.concat(F.lit(";outranked_on:"), F.array_join("lost", ","))).otherwise(""),
    )
    idle = F.when(F.col("is_late"), "late_event_superseded").when((F.size("lost") > 0) & (F.size("won") == 0), "outranked_by_existing_values").otherwise("no_material_change")
    stopped = F.col("blocked").isNotNull()
    decision = F.when(stopped, "ignored").when(op == "created", "created").when(op == "deleted", "deleted").when(op == "restored", "merged").when(op == "none", "ignored").when(owns_all, "replaced").otherwise("merged")
    primary = (
        F.when(stopped, blocked_reason).when(op == "created", "transaction_created").when(op == "deleted", "transaction_deleted").when(op == "restored", "transaction_restored")
        .when(op == "none", idle).when(owns_all, "all_fields_from_this_event").otherwise(merged)
    )
    rest = F.concat(F.array(F.when(F.col("is_late"), "late_event_reordered")), F.col("notes"))
    return df.withColumns({
        "decision": decision, "rule": F.when(stopped, blocked_rule).when(op == "deleted", "R7_DELETE_APPLIED").otherwise(rule), "reason": first_reasons(F.concat(F.array(primary), rest)),
    })


def history(events: DataFrame, rules: Rules = DEFAULT, longest: int = LONGEST, evidence: bool = False) -> DataFrame:
    """One row for each accepted, first-arrived event, with everything the audit says of it."""
    from .sequential import ordered_arrivals

    ordered = needs_order(events, rules, longest)
    native = arrivals(events.join(ordered, list(KEYS), "left_anti"), rules, evidence)
    passed = ordered_arrivals(events.join(ordered, list(KEYS), "left_semi"), rules, native.schema)
    return labelled(_with_ownership(_with_diff(native.unionByName(passed))))


def native_history(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``history`` by the native fold alone, for events without live-children guards."""
    return labelled(_with_ownership(_with_diff(arrivals(events, rules))))


def changes(decided: DataFrame) -> DataFrame:
    """(seq, event_id, op, field, was, now): each field that an event moved, with both values as text; null where there was none."""
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    moved = F.array(*(F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.struct(F.lit(c).alias("field"), text("before", c).alias("was"), text("after", c).alias("now"))) for c in SNAPSHOT))
    return decided.select("seq", "event_id", "op", F.explode(F.array_compact(moved)).alias("m")).select("seq", "event_id", "op", "m.*")


def final_states(events: DataFrame, rules: Rules = DEFAULT, longest: int = LONGEST) -> DataFrame:
    """State columns of each transaction after all arrivals, guards included: ``folded``, or the last row of the ordered pass."""
    from .fold import folded
    from .sequential import ordered_arrivals

    ordered = needs_order(events, rules, longest)
    plain = folded(events.join(ordered, list(KEYS), "left_anti"), rules)
    names = plain.columns
    schema = arrivals(events, rules).schema
    rows = ordered_arrivals(events.join(ordered, list(KEYS), "left_semi"), rules, schema)
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in KEYS)), "seq").alias("r")).select(*KEYS, "r.*").where("exists")
    return plain.unionByName(last.select(*names))


__all__ = ["SNAPSHOT", "TYPES", "arrivals", "changes", "final_states", "history", "labelled", "native_history", "needs_order"]
