"""The reconciliation fold: one transaction's events, in timeline order, to its state.

Two native forms. ``folded`` sorts each log once and runs the lifecycle and the
field contests in a single ``aggregate``; it covers every rule. ``fast_folded``
is for logs that cannot block anything (no delete, updates allowed before their
create): each field group is then the maximum of a total order, so one grouped
aggregation with partial sums is enough and no log is ever collected.
``folded_mixed`` sends each log to the cheaper one.

Both group by the same keys, so they share one exchange with whatever follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ACTION_RANK, DEFAULT, GROUPS, Rules
from ..functions.text import let
from .normalize import action_rank

KEYS = ("user_key", "transaction_key")
#: Owner of a field, in the order of precedence.
OWNER = "struct<authority:int,event_ts:timestamp,rank:int,event_id:string>"
#: Column of the value that each group contests.
VALUE = {"amount": "amount_minor"} | {g: g for g in GROUPS[1:]}
TYPES = {"amount_minor": "bigint", "currency": "string", "date": "date"} | {g: "string" for g in GROUPS[2:]}
CONFLICT = "struct<type:string,field:string,event_id:string,winner_event_id:string,detail:string>"

#: What one entry of a log did.
EFFECT = "struct<blocked:string,lifecycle:array<string>>"


def log_entry() -> Column:
    """What the fold needs of an event; natural order is timeline order."""
    return F.struct(
        "event_ts", action_rank(F.col("action")).alias("rank"), "event_id", "authority", "transaction_id", "source",
        *(F.col(c) for c in TYPES), *([F.col("seq")]),
    )


def owner(e: Column) -> Column:
    return F.struct(e["authority"].alias("authority"), e["event_ts"].alias("event_ts"), e["rank"].alias("rank"), e["event_id"].alias("event_id"))


def _start(each: bool = False) -> Column:
    values = [F.lit(None).cast(t).alias(c) for c, t in TYPES.items()]
    owners = [F.lit(None).cast(OWNER).alias(f"{g}_owner") for g in GROUPS]
    return F.struct(
        F.lit(False).alias("exists"), F.lit(False).alias("deleted"), F.lit(False).alias("provisional"), F.lit(None).cast(OWNER).alias("tombstone"), *values, *owners,
        F.lit(None).cast("string").alias("blocked"), F.array().cast("array<string>").alias("lifecycle"), F.array().cast("array<string>").alias("notes"),
        F.array().cast(f"array<{CONFLICT}>").alias("conflicts"), *([F.array().cast(f"array<{EFFECT}>").alias("each")] if each else []),
    )


def _locked(user_key: Column, day: Column, rules: Rules) -> Column:
    if not rules.enforce_delete_dependencies:
        return F.lit(False)
    out = F.lit(False)
    for key, periods in rules.locked_periods.items():
        for p in periods:
            hit = day.between(F.lit(p.start), F.lit(p.end))
            out = out | F.coalesce(hit if key == "*" else hit & (user_key == key), F.lit(False))
    return out


def _step(acc: Column, e: Column, user_key: Column, focus: Column | None, rules: Rules, each: bool = False) -> Column:
    """One event onto the state. focus: the event whose effects are kept, or None for none; each: keep those of all, in log order."""
    create, update, delete = (e["rank"] == r for r in ACTION_RANK.values())
    me = owner(e)

    def judged(j: Column) -> Column:
        blocked, beats = j["blocked"], j["beats"]
        ok = blocked.isNull()
        exists = acc["exists"]
        first = ~exists & ok
        restored = acc["deleted"] & beats & ok & (create | update)
        made = exists | ok | (blocked == "delete_blocked_by_dependencies")
        deleted = F.when(delete & ok, True).when(restored, False).otherwise(acc["deleted"])
        # A refused delete may still have made the row that it could not delete.
        opened = ~exists & made & ~create
        provisional = F.when(create, False).when(opened, True).otherwise(acc["provisional"])
        tombstone = F.when(delete & ok, me).when(~restored, acc["tombstone"])
        fields, owners, conflicts, notes = [], [], [], []
        for g in GROUPS:
            c, held = VALUE[g], acc[f"{g}_owner"]
            contests = e[c].isNotNull() & ok
            beats_held = held.isNull() | (me > held)
            wins = beats_held
            if g == "date" and rules.prefer_earliest_date_on_equal_authority:
                equal = F.when(e[c] < acc[c], True).when(e[c] > acc[c], False).otherwise(beats_held)
                wins = held.isNull() | (e["authority"] > held["authority"]) | ((e["authority"] == held["authority"]) & equal)
            elif g == "date":
                wins = held.isNull() | (e["authority"] > held["authority"]) | ((e["authority"] == held["authority"]) & beats_held)
            if g == "date":
                same = held.isNotNull() & (e["authority"] == held["authority"])
                note = F.when(held.isNull(), None).when(e["authority"] > held["authority"], "higher_authority_moved_date:date").when(e["authority"] < held["authority"], "lower_authority_date_rejected:date")
                if rules.prefer_earliest_date_on_equal_authority:
                    note = note.when(same & (e[c] < acc[c]), "earlier_date_preferred:date").when(same & (e[c] > acc[c]), "later_date_rejected_equal_authority:date")
                notes.append(F.when(contests, note))
            takes = F.coalesce(contests & wins, F.lit(False))
            fields.append(F.when(takes, e[c]).otherwise(acc[c]).alias(c))
            if g == "amount":
                fields.append(F.when(takes, e["currency"]).otherwise(acc["currency"]).alias("currency"))
            owners.append(F.when(takes, me).otherwise(held).alias(f"{g}_owner"))
            differs = contests & held.isNotNull() & ~e[c].eqNullSafe(acc[c])
            tie = differs & (e["authority"] == held["authority"]) & (e["event_ts"] == held["event_ts"])
            pair = F.array_join(F.array_sort(F.array(acc[c].cast("string"), e[c].cast("string"))), "|")
            said = lambda kind, field, winner, detail: F.struct(F.lit(kind).alias("type"), F.lit(field).alias("field"), e["event_id"].alias("event_id"), winner.alias("winner_event_id"), detail.alias("detail"))
            conflicts.append(F.when(tie, said("authority_tie", g, F.when(takes, e["event_id"]).otherwise(held["event_id"]), pair)))
            if g == "amount":
                other = differs & (acc["currency"] != e["currency"])
                conflicts.append(F.when(other, said("currency_mismatch", "currency", F.lit(None).cast("string"), F.concat_ws("|", acc["currency"], e["currency"]))))
        refused = F.struct(F.lit("delete_blocked").alias("type"), F.lit("").alias("field"), e["event_id"].alias("event_id"), F.lit(None).cast("string").alias("winner_event_id"), F.lit("locked_period").alias("detail"))
        conflicts.insert(0, F.when(blocked == "delete_blocked_by_dependencies", refused))
        lifecycle = F.array_compact(F.array(
            F.when(restored & create, "recreated_after_delete"), F.when(create & acc["provisional"], "provisional_confirmed"), F.when(create & ~exists, "created"),
            F.when(update & first, "provisional_from_update_before_create"), F.when(restored & update, "restored_by_higher_authority_update"),
            F.when(delete & opened, "tombstone_before_create"), F.when(delete & ok & ~acc["deleted"], "deleted"),
        ))
        if focus is None:
            effects = [acc["blocked"].alias("blocked"), acc["lifecycle"].alias("lifecycle"), acc["notes"].alias("notes")]
        else:
            mine = e["event_id"] == focus
            noted = F.array_compact(F.array(F.when(create & acc["deleted"] & ~beats, "create_outranked_by_delete"), F.when(blocked == "delete_blocked_by_dependencies", "locked_period"), *notes))
            effects = [F.when(mine, blocked).otherwise(acc["blocked"]).alias("blocked"), F.when(mine, lifecycle).otherwise(acc["lifecycle"]).alias("lifecycle"), F.when(mine, noted).otherwise(acc["notes"]).alias("notes")]
        found = F.array_compact(F.array(*conflicts))
        return F.struct(
            made.alias("exists"), deleted.alias("deleted"), provisional.alias("provisional"), tombstone.alias("tombstone"), *fields, *owners, *effects,
            F.when(F.size(found) > 0, F.concat(acc["conflicts"], found)).otherwise(acc["conflicts"]).alias("conflicts"),
            *([F.concat(acc["each"], F.array(F.struct(blocked.alias("blocked"), lifecycle.alias("lifecycle")))).alias("each")] if each else []),
        )

    beats = acc["tombstone"].isNull() | (me > acc["tombstone"])
    superseded = acc["exists"] & acc["deleted"] & (~beats if rules.resurrect_deleted_on_higher_authority else F.lit(True))
    blocked = (
        F.when(update & ~acc["exists"] & F.lit(not rules.allow_update_before_create), "update_without_create")
        .when(update & superseded, "update_after_delete_superseded")
        .when(delete & ~acc["exists"] & F.lit(not rules.allow_delete_before_create), "delete_without_create")
        .when(delete & _locked(user_key, acc["date"], rules), "delete_blocked_by_dependencies")
    )
    return let(F.struct(blocked.alias("blocked"), F.coalesce(beats, F.lit(True)).alias("beats")), judged)


def fold_log(log: Column, user_key: Column, rules: Rules = DEFAULT, focus: Column | None = None, each: bool = False) -> Column:
    """The state struct after all entries of a sorted log."""
    return F.aggregate(log, _start(each), lambda acc, e: _step(acc, e, user_key, focus, rules, each))


def state_columns(state: str = "state", rules: Rules = DEFAULT) -> list[Column]:
    s = F.col(state)
    return [
        *(s[c].alias(c) for c in ("exists", "deleted", "provisional", "amount_minor")), F.coalesce(s["currency"], F.lit(rules.default_currency)).alias("currency"), *(s[c].alias(c) for c in list(TYPES)[2:]),
        *(s[f"{g}_owner"].alias(f"{g}_owner") for g in GROUPS), s["conflicts"].alias("conflicts"),
    ]


def folded(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """One row for each transaction that exists: keys, display id, state, owners, conflicts, n_events."""
    logs = events.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(log_entry())).alias("log"), F.min_by("transaction_id", "seq").alias("transaction_id"), F.min_by("user_id", "seq").alias("user_id"), F.count(F.lit(1)).alias("n_events")
    )
    states = logs.withColumn("state", fold_log(F.col("log"), F.col("user_key"), rules)).drop("log")
    return states.select(*KEYS, "user_id", "transaction_id", "n_events", *state_columns(rules=rules)).where("exists")


def fast_folded(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The columns of ``folded`` but conflicts, for events of which no log has a delete."""
    if not rules.allow_update_before_create:
        raise ValueError("without updates before creates, logs can block: use folded")
    me = F.struct("authority", "event_ts", action_rank(F.col("action")).alias("rank"), "event_id")
    early = F.struct("authority", (-F.datediff("date", F.lit("1970-01-01"))).alias("early"), "event_ts", action_rank(F.col("action")).alias("rank"), "event_id")
    winners = []
    for g in GROUPS:
        asserted = F.col(VALUE[g]).isNotNull()
        order = early if g == "date" and rules.prefer_earliest_date_on_equal_authority else me
        best = F.max(F.when(asserted, F.struct(order.alias("o"), F.col(VALUE[g]).alias("v"), *([F.col("currency").alias("c")] if g == "amount" else []))))
        winners.append(best.alias(f"_{g}"))
    out = events.groupBy(*KEYS).agg(
        *winners, F.min_by("transaction_id", "seq").alias("transaction_id"), F.min_by("user_id", "seq").alias("user_id"), F.count(F.lit(1)).alias("n_events"),
        (F.count_if(F.col("action") == "create") == 0).alias("provisional"),
    )
    won = lambda g: F.when(F.col(f"_{g}").isNotNull(), F.struct(*(F.col(f"_{g}.o.{c}").alias(c) for c in ("authority", "event_ts", "rank", "event_id"))))
    return out.select(
        *KEYS, "user_id", "transaction_id", "n_events", F.lit(True).alias("exists"), F.lit(False).alias("deleted"), "provisional", F.col("_amount.v").alias("amount_minor"),
        F.coalesce("_amount.c", F.lit(rules.default_currency)).alias("currency"), *(F.col(f"_{g}.v").alias(VALUE[g]) for g in GROUPS[1:]), *(won(g).alias(f"{g}_owner") for g in GROUPS),
    )


def folded_mixed(events: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``folded`` without conflicts; logs without a delete take the fast form."""
    if not rules.allow_update_before_create:
        return folded(events, rules).drop("conflicts")
    with_delete = events.where(F.col("action") == "delete").select(*KEYS).distinct()
    slow = folded(events.join(with_delete, list(KEYS), "left_semi"), rules).drop("conflicts")
    return slow.unionByName(fast_folded(events.join(with_delete, list(KEYS), "left_anti"), rules))
