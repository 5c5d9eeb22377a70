"""Rollups of the reconciled state, and the state at other moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Rules
from ..functions import canon, dates, money
from ..functions.text import identity
from .fold import KEYS, folded_mixed
from .history import final_states


def live(states: DataFrame) -> DataFrame:
    return states.where(~F.col("deleted"))


def _priced(states: DataFrame) -> DataFrame:
    return live(states).where(F.col("amount_minor").isNotNull())


def _sums() -> list:
    a = F.col("amount_minor")
    return [
        F.sum(a).alias("net_minor"), F.coalesce(F.sum(F.when(a >= 0, a)), F.lit(0)).cast("long").alias("inflow_minor"),
        F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0)).cast("long").alias("outflow_minor"), F.count(F.lit(1)).alias("n_transactions"),
    ]


def by_currency(states: DataFrame) -> DataFrame:
    return _priced(states).groupBy("user_key", "currency").agg(*_sums())


def by_month(states: DataFrame) -> DataFrame:
    return _priced(states).groupBy("user_key", dates.month_of(F.col("date")).alias("month"), "currency").agg(F.sum("amount_minor").alias("net_minor"))


def by_category(states: DataFrame) -> DataFrame:
    return _priced(states).groupBy("user_key", F.coalesce("category", F.lit("uncategorized")).alias("category"), "currency").agg(F.sum("amount_minor").alias("net_minor"))


def all_sets(states: DataFrame) -> DataFrame:
    """The three rollups in one pass over grouping sets; ``level`` says which one a row is of."""
    rows = _priced(states).select("user_key", "currency", dates.month_of(F.col("date")).alias("month"), F.coalesce("category", F.lit("uncategorized")).alias("category"), "amount_minor")
    key = [F.col(c) for c in ("user_key", "currency", "month", "category")]
    sets = [[key[0], key[1]], [key[0], key[1], key[2]], [key[0], key[1], key[3]]]
    out = rows.groupingSets(sets, *key).agg(F.grouping_id().alias("gid"), F.sum("amount_minor").alias("net_minor"), F.count(F.lit(1)).alias("n_transactions"))
    level = F.when(F.col("gid") == 3, "currency").when(F.col("gid") == 1, "month").otherwise("category")
    return out.select(level.alias("level"), "user_key", "currency", "month", "category", "net_minor", "n_transactions")


def shown(rollup: DataFrame) -> DataFrame:
    """The minor-unit sums of a rollup as exact texts beside them."""
    sums = [c for c in rollup.columns if c.endswith("_minor")]
    return rollup.withColumns({c.removesuffix("_minor"): money.format_amount(F.col(c), F.col("currency")) for c in sums})


def lifecycle_counts(states: DataFrame) -> DataFrame:
    up = ~F.col("deleted")
    return states.groupBy("user_key").agg(
        F.count_if(up).alias("n_live"), F.count_if(F.col("deleted")).alias("n_deleted"), F.count_if(up & F.col("provisional")).alias("n_provisional"), F.count_if(up & F.col("amount_minor").isNull()).alias("n_unpriced"),
    )


def book_totals(states: DataFrame) -> DataFrame:
    conflicts = F.sum(F.size("conflicts")) if "conflicts" in states.columns else F.lit(0)
    return states.agg(
        F.count_distinct("user_key").alias("n_users"), F.count(F.lit(1)).alias("n_transactions"), F.count_if(~F.col("deleted")).alias("n_live"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"),
        F.coalesce(conflicts, F.lit(0)).cast("long").alias("n_conflicts"),
    )


def user_snapshot(states: DataFrame, user_id: str, rules: Rules = DEFAULT) -> DataFrame:
    """The transactions of one user, found by display id or key."""
    return states.where(F.col("user_key") == identity(F.lit(user_id), rules.case_insensitive_ids))


def financial_view(states: DataFrame) -> DataFrame:
    return live(states).select(*KEYS, "transaction_id", money.format_amount(F.col("amount_minor"), F.col("currency")).alias("amount"), "amount_minor", "currency", "date", "category", "merchant", "account_id", "parent_transaction_id", "provisional")


def authority_view(states: DataFrame) -> DataFrame:
    """Who owns what: one row for each transaction and field group."""
    groups = [c for c in states.columns if c.endswith("_owner")]
    pairs = F.array(*(F.struct(F.lit(g.removesuffix("_owner")).alias("field"), F.col(g).alias("owner")) for g in groups))
    return states.select(*KEYS, F.explode(F.filter(pairs, lambda p: p["owner"].isNotNull())).alias("p")).select(*KEYS, "p.field", "p.owner.authority", "p.owner.event_ts", "p.owner.event_id")


def _row_json() -> F.Column:
    q, n = canon.quoted, canon.number
    amount = q(money.format_amount(F.col("amount_minor"), F.col("currency")))
    parts = [
        ("account_id", q(F.col("account_id"))), ("amount", amount), ("amount_minor", n(F.col("amount_minor"))), ("category", q(F.col("category"))), ("currency", q(F.col("currency"))), ("date", q(F.col("date").cast("string"))),
        ("deleted", F.col("deleted").cast("string")), ("merchant", q(F.col("merchant"))), ("parent_transaction_id", q(F.col("parent_transaction_id"))), ("provisional", F.col("provisional").cast("string")), ("transaction_id", q(F.col("transaction_id"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts)), F.lit("}"))


def transaction_hashes(states: DataFrame) -> DataFrame:
    """(keys, state_hash, authority_hash): SHA-256 of a transaction's values, and of its values with the owners of its fields."""
    n, q = canon.number, canon.quoted
    owners = []
    for g in sorted(c for c in states.columns if c.endswith("_owner")):
        o = F.col(g)
        text = F.concat_ws(",", q(o["event_id"]), n(o["authority"]), q(dates.format_ts(o["event_ts"])))
        owners.append(F.when(o.isNotNull(), F.concat(F.lit(f'"{g.removesuffix("_owner")}":['), text, F.lit("]"))))
    whole = F.concat(_row_json(), F.lit("{"), F.concat_ws(",", *owners), F.lit("}"))
    return states.select(*KEYS, F.sha2(_row_json(), 256).alias("state_hash"), F.sha2(whole, 256).alias("authority_hash"))


def conflicts(states: DataFrame) -> DataFrame:
    """One row for each conflict of every user, with its transaction."""
    return states.select(*KEYS, "transaction_id", F.explode("conflicts").alias("c")).select(*KEYS, "transaction_id", "c.*")


def state_hashes(states: DataFrame) -> DataFrame:
    """(user_key, n, state_hash): SHA-256 over a user's transactions by display id.

    Each transaction is hashed by itself and only the hashes are gathered, 64
    characters each, so that a row stays small for users of many transactions.
    """
    rows = states.select("user_key", F.struct("transaction_id", F.sha2(_row_json(), 256).alias("h")).alias("t"))
    return rows.groupBy("user_key").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("user_key", F.size("ts").cast("long").alias("n"), F.sha2(F.array_join(F.transform("ts", lambda t: F.concat_ws(":", t["transaction_id"], t["h"])), ","), 256).alias("state_hash"))


def book_hash(states: DataFrame) -> str:
    """One hash over all users, by key: hashes are combined in 4096 buckets of the key's hash, then over the buckets."""
    users = state_hashes(states).withColumn("b", F.pmod(F.xxhash64("user_key"), F.lit(4096)))
    buckets = users.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("user_key", "state_hash"))), lambda u: F.concat_ws("=", u["user_key"], u["state_hash"])), ","), 256).alias("h"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ","), 256)).first()[0]


def as_of(events: DataFrame, moment, rules: Rules = DEFAULT) -> DataFrame:
    """State by business time: only what was asserted up to the moment, rebuilt."""
    return final_states(events.where(F.col("event_ts") <= F.lit(moment)), rules) if rules.enforce_delete_dependencies else folded_mixed(events.where(F.col("event_ts") <= F.lit(moment)), rules)


def at_version(events: DataFrame, history: DataFrame, version: int, rules: Rules = DEFAULT) -> DataFrame:
    """State by processing time: each user's arrivals up to the one that made this user version; later versions give the last state."""
    if version < 0:
        raise ValueError("versions start at 0")
    reached = history.where(F.col("user_version") >= version).groupBy("user_key").agg(F.min("seq").alias("__stop"))
    upto = events.join(reached, "user_key", "left").where(F.col("__stop").isNull() | (F.col("seq") <= F.col("__stop"))).drop("__stop")
    if version == 0:
        upto = upto.limit(0)
    return final_states(upto, rules) if rules.enforce_delete_dependencies else folded_mixed(upto, rules)


def near_duplicates(states: DataFrame) -> DataFrame:
    """Live transactions of a user that share amount, date and currency with others: match_count, and the first ten ids.

    Counted by group, not by pairs: the others of a row are its group without itself.
    """
    rows = _priced(states).where(F.col("date").isNotNull())
    group = ["user_key", "amount_minor", "date", "currency"]
    by_key = Window.partitionBy(*group).orderBy("transaction_key")
    # The ten others of a row are among the first eleven of its group.
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy(*group)), "nth": F.row_number().over(by_key)})
    first = rows.where("nth <= 11").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("transaction_key", "transaction_id"))).alias("first"))
    out = rows.where("n > 1").join(first, group)
    others = F.slice(F.filter("first", lambda t: t["transaction_key"] != F.col("transaction_key")), 1, 10)
    return out.select("user_key", "transaction_key", "amount_minor", "date", "currency", (F.col("n") - 1).alias("match_count"), F.array_join(F.transform(others, lambda t: t["transaction_id"]), ",").alias("matches"))


def live_children(states: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """(user_key, transaction_key, n_children, children): live transactions that name this one as their parent; all their ids, in order.

    Each transaction stands once under its own key and, if live, once under its parent's,
    so that one grouping finds both and the states are folded once, not joined to themselves.
    """
    parent = identity(F.col("parent_transaction_id"), rules.case_insensitive_ids)
    own = F.struct(F.col("transaction_key"), F.lit(False).alias("is_kid"), F.lit(None).cast("string").alias("child"))
    kid = F.when(~F.col("deleted") & parent.isNotNull(), F.struct(parent.alias("transaction_key"), F.lit(True).alias("is_kid"), F.col("transaction_id").alias("child")))
    rows = states.select("user_key", F.explode(F.array_compact(F.array(own, kid))).alias("r")).select("user_key", "r.*")
    # A row that stands under its own key has no child, and nulls are not collected.
    grouped = rows.groupBy("user_key", "transaction_key").agg(
        F.count_if("is_kid").alias("n_children"), F.array_join(F.sort_array(F.collect_list("child")), ",").alias("children"), F.min("is_kid").alias("__orphans")
    )
    return grouped.where(~F.col("__orphans") & (F.col("n_children") > 0)).drop("__orphans")
