"""Registered queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, GROUPS, Period
from ..functions import canon, dates, money
from ..operators import anomalies, audit, fold, history, normalize, rollups
from ..sources import readers, store
from ..sources.scratch import shared_path, written
from . import feeds

#: Without guards, so that SQL can follow the rules; guarded queries are checked by their row counts and tests.
OPEN = DEFAULT.with_(enforce_delete_dependencies=False)
LOCKED = DEFAULT.with_(locked_periods={"*": (Period(datetime.date(2024, 1, 5), datetime.date(2024, 1, 12), "closed"),)})
MOMENT = datetime.datetime(2024, 1, 8)
VERSION = 5
QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalized(feeds.events_feed(spark, d), OPEN)


#: Normalized events by session and folder: parsed and written once, as a store's event table is.
_TABLES: dict[tuple[str, str], DataFrame] = {}


def _first(spark: SparkSession, d: str) -> DataFrame:
    return normalize.first_arrivals(_rows(spark, d).where("accepted"))[0]


def _events(spark: SparkSession, d: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, d)
    if key not in _TABLES:
        _TABLES[key] = written(_first(spark, d).drop("issues", "accepted", "extra"), "events")
    return _TABLES[key]


def _states(spark: SparkSession, d: str) -> DataFrame:
    return fold.folded_mixed(_events(spark, d), OPEN)


def _history(spark: SparkSession, d: str) -> DataFrame:
    return history.native_history(_events(spark, d), OPEN)


# ---- the same in SQL ----

_FEED = """
feed AS (
  SELECT (i * 7919) % 10007 * 1000000000 + i * 2 + c AS seq, 'e' || i AS event_id, user_id::VARCHAR AS user_key, 'T' || (k % 20) AS transaction_id, 't' || (k % 20) AS transaction_key,
    action, CASE action WHEN 'create' THEN 0 WHEN 'update' THEN 1 ELSE 2 END AS rank, source, role, CASE WHEN i % 5 = 0 THEN date_trunc('month', ts) ELSE ts END AS event_ts,
    CASE source WHEN 'user_edit' THEN 100 + CASE WHEN role = 'premium' THEN 10 ELSE 0 END WHEN 'third_party' THEN 50 WHEN 'bank_sync' THEN 10 ELSE 1 END AS authority,
    currency, CASE WHEN action = 'create' OR (action = 'update' AND i % 3 <> 0) THEN round(said * CASE currency WHEN 'JPY' THEN 1 WHEN 'KWD' THEN 1000 ELSE 100 END, 0)::BIGINT END AS amount_minor,
    currency = 'JPY' AND (action = 'create' OR (action = 'update' AND i % 3 <> 0)) AND said <> round(said, 0) AS rounded,
    CASE WHEN NOT (action = 'update' AND i % 5 = 0) THEN CASE WHEN i % 19 = 0 THEN DATE '2024-01-02' + (i % 2)::INTEGER WHEN i % 58 = 0 THEN ts::DATE - 400 WHEN i % 29 = 0 THEN ts::DATE - 200 ELSE ts::DATE + (k % 7)::INTEGER END END::DATE AS date,
    CASE WHEN i % 4 <> 0 THEN 'C' || (i % 3) END AS category, CASE WHEN i % 4 <> 0 THEN 'M' || (i % 5) END AS merchant,
    CASE WHEN i % 13 = 0 THEN 'T' || ((k + 1) % 20) END AS parent_transaction_id
  FROM (
    SELECT event_id AS i, ts, user_id, regexp_extract(props, '[0-9]+')::BIGINT AS k,
      CASE WHEN event_id % 19 = 0 THEN 10000 + event_id % 3 * 1000 WHEN event_id % 11 = 0 THEN -value ELSE value END::DECIMAL(18,2) AS said,
      CASE WHEN event_type IN ('signup', 'purchase') THEN 'create' WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS action,
      CASE event_id % 4 WHEN 0 THEN 'user_edit' WHEN 1 THEN 'third_party' WHEN 2 THEN 'bank_sync' ELSE 'unknown' END AS source,
      CASE WHEN event_id % 17 = 0 THEN 'premium' ELSE 'standard' END AS role,
      CASE event_id % 10 WHEN 0 THEN 'JPY' WHEN 1 THEN 'KWD' ELSE 'USD' END AS currency
    FROM events
  ), (VALUES (0), (1)) AS copies(c) WHERE c = 0 OR i % 23 = 0
), good AS (
  SELECT * FROM feed WHERE NOT (action = 'update' AND amount_minor IS NULL AND date IS NULL AND category IS NULL AND merchant IS NULL AND parent_transaction_id IS NULL)
), ev AS (
  SELECT *, printf('%05d|%s|%d|%s', authority, strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f'), rank, event_id) AS prec,
    user_key || '/' || transaction_key AS txn
  FROM good QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1
)"""

_DATE_PREC = "printf('%05d|%06d|%s', authority, 100000 - (date - DATE '1970-01-01'), prec)"
_WINNERS = f"""
    arg_max(amount_minor, prec) FILTER (WHERE amount_minor IS NOT NULL) AS amount_minor,
    coalesce(arg_max(currency, prec) FILTER (WHERE amount_minor IS NOT NULL), 'USD') AS currency,
    arg_max(date, {_DATE_PREC}) FILTER (WHERE date IS NOT NULL) AS date,
    arg_max(category, prec) FILTER (WHERE category IS NOT NULL) AS category,
    arg_max(merchant, prec) FILTER (WHERE merchant IS NOT NULL) AS merchant,
    arg_max(parent_transaction_id, prec) FILTER (WHERE parent_transaction_id IS NOT NULL) AS parent_transaction_id,
    arg_max(event_id, prec) FILTER (WHERE amount_minor IS NOT NULL) AS amount_event,
    arg_max(event_id, {_DATE_PREC}) FILTER (WHERE date IS NOT NULL) AS date_event,
    arg_max(event_id, prec) FILTER (WHERE category IS NOT NULL) AS category_event,
    arg_max(event_id, prec) FILTER (WHERE merchant IS NOT NULL) AS merchant_event,
    arg_max(event_id, prec) FILTER (WHERE parent_transaction_id IS NOT NULL) AS parent_event"""


def _fold_sql(log: str) -> str:
    """CTEs from a table of events with a group g to ``state``, one row for each g."""
    return f"""
t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_ts, rank, event_id) AS n FROM {log}),
life AS (
  SELECT g, 0::BIGINT AS n, false AS ex, false AS del, false AS prov, NULL::VARCHAR AS tomb, false AS blocked FROM (SELECT DISTINCT g FROM t)
  UNION ALL
  SELECT t.g, t.n, true, CASE WHEN action = 'delete' THEN true ELSE del AND NOT (tomb IS NULL OR prec > tomb) END,
    CASE WHEN action = 'create' THEN false WHEN NOT ex THEN true ELSE prov END,
    CASE WHEN action = 'delete' THEN prec WHEN del AND (tomb IS NULL OR prec > tomb) THEN NULL ELSE tomb END,
    action = 'update' AND del AND NOT (tomb IS NULL OR prec > tomb)
  FROM life JOIN t ON t.g = life.g AND t.n = life.n + 1
), ends AS (
  SELECT g, arg_max(del, n) AS deleted, arg_max(prov, n) AS provisional, max(n) AS n_events FROM life GROUP BY g
), won AS (
  SELECT t.g, any_value(user_key) AS user_key, any_value(transaction_key) AS transaction_key,{_WINNERS}
  FROM t JOIN life ON t.g = life.g AND t.n = life.n AND NOT blocked GROUP BY t.g
), state AS (SELECT * FROM won JOIN ends USING (g))"""


_FINAL = f"WITH RECURSIVE {_FEED}, log AS (SELECT *, txn AS g FROM ev), {_fold_sql('log')}"
_PREFIXES = f"""WITH RECURSIVE {_FEED}, log AS (
  SELECT e.*, e.txn || '@' || a.seq AS g, a.seq AS at_seq FROM ev AS a JOIN ev AS e ON a.txn = e.txn AND e.seq <= a.seq
), {_fold_sql('log')}, hist AS (
  SELECT a.seq, a.txn, a.event_id, a.action, a.source, a.event_ts, s.*, 
    lag(struct_pack(a := s.amount_minor, c := s.currency, d := s.date, g := s.category, m := s.merchant, p := s.parent_transaction_id, x := s.deleted, v := s.provisional)) OVER w AS b
  FROM ev AS a JOIN state AS s ON s.g = a.txn || '@' || a.seq WINDOW w AS (PARTITION BY a.txn ORDER BY a.seq)
), h AS (
  SELECT *, b IS NULL OR struct_pack(a := amount_minor, c := currency, d := date, g := category, m := merchant, p := parent_transaction_id, x := deleted, v := provisional) IS DISTINCT FROM b AS changed FROM hist
)"""

# ---- normalization ----


@_query("feed_normalized", f"WITH {_FEED} SELECT seq, event_id, user_key, transaction_key, action, source, authority, event_ts, currency, amount_minor, date, category, merchant, parent_transaction_id, role FROM good")
def feed_normalized(spark, d):
    return _rows(spark, d).where("accepted").select("seq", "event_id", "user_key", "transaction_key", "action", "source", "authority", "event_ts", "currency", "amount_minor", "date", "category", "merchant", "parent_transaction_id", "role")


@_query("rejects_by_code", f"WITH {_FEED} SELECT 'E_EMPTY_UPDATE' AS code, 'error' AS severity, count(*) AS n FROM feed WHERE seq NOT IN (SELECT seq FROM good) HAVING count(*) > 0 UNION ALL SELECT 'W_SOURCE_MISSING', 'warning', count(*) FROM feed WHERE source = 'unknown' HAVING count(*) > 0 UNION ALL SELECT 'W_ROUNDED', 'warning', count(*) FROM feed WHERE rounded HAVING count(*) > 0")
def rejects_by_code(spark, d):
    return _rows(spark, d).select(F.explode("issues").alias("i")).groupBy("i.code", "i.severity").agg(F.count(F.lit(1)).alias("n"))


@_query("dedupe_first_arrival", f"WITH {_FEED} SELECT seq, event_id FROM ev")
def dedupe_first_arrival(spark, d):
    return _first(spark, d).select("seq", "event_id")


@_query("duplicate_events", f"WITH {_FEED} SELECT seq, event_id, 'ignored' AS decision, 'R1_DUPLICATE_EVENT' AS rule FROM good WHERE seq NOT IN (SELECT seq FROM ev)")
def duplicate_events(spark, d):
    dup = normalize.first_arrivals(_rows(spark, d).where("accepted"))[1]
    return dup.select("seq", "event_id", F.lit("ignored").alias("decision"), F.lit("R1_DUPLICATE_EVENT").alias("rule"))


@_query("authority_scores", f"WITH {_FEED} SELECT source, role, authority, count(*) AS n FROM good GROUP BY ALL")
def authority_scores(spark, d):
    return _rows(spark, d).where("accepted").groupBy("source", "role", "authority").agg(F.count(F.lit(1)).alias("n"))


# ---- the fold ----

_STATE = "user_key, transaction_key, amount_minor, currency, date, category, merchant, parent_transaction_id, deleted, provisional, n_events"
_OWNERS = {"amount": "amount_event", "date": "date_event", "category": "category_event", "merchant": "merchant_event", "parent_transaction_id": "parent_event"}


def _state_rows(states: DataFrame) -> DataFrame:
    return states.select(*(c.strip() for c in _STATE.split(",")))


@_query("field_winners", f"{_FINAL} SELECT user_key, transaction_key, {', '.join(_OWNERS.values())} FROM state")
def field_winners(spark, d):
    return _states(spark, d).select("user_key", "transaction_key", *(F.col(f"{g}_owner.event_id").alias(n) for g, n in _OWNERS.items()))


@_query("date_winner", f"WITH {_FEED} SELECT user_key, transaction_key, arg_max(date, {_DATE_PREC}) AS date, arg_max(authority, {_DATE_PREC}) AS authority FROM ev WHERE date IS NOT NULL AND action <> 'delete' GROUP BY ALL")
def date_winner(spark, d):
    return fold.fast_folded(_events(spark, d).where("action <> 'delete' AND date IS NOT NULL"), OPEN).select("user_key", "transaction_key", "date", F.col("date_owner.authority").alias("authority"))


@_query("fold_fast_path", f"WITH RECURSIVE {_FEED}, log AS (SELECT *, txn AS g FROM ev WHERE txn NOT IN (SELECT txn FROM ev WHERE action = 'delete')), {_fold_sql('log')} SELECT {_STATE} FROM state")
def fold_fast_path(spark, d):
    e = _events(spark, d)
    deleted = e.where("action = 'delete'").select(*fold.KEYS).distinct()
    return _state_rows(fold.fast_folded(e.join(deleted, list(fold.KEYS), "left_anti"), OPEN))


@_query("fold_with_deletes", f"{_FINAL} SELECT {_STATE} FROM state")
def fold_with_deletes(spark, d):
    return _state_rows(fold.folded(_events(spark, d), OPEN))


@_query("fold_mixed", f"{_FINAL} SELECT {_STATE} FROM state")
def fold_mixed(spark, d):
    return _state_rows(_states(spark, d))


@_query("orders_states", "SELECT o_custkey::VARCHAR AS user_key, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, sum(round(o_totalprice::DECIMAL(18,2) * 100, 0)::BIGINT)::BIGINT AS net_minor FROM orders GROUP BY ALL")
def orders_states(spark, d):
    states = fold.fast_folded(normalize.first_arrivals(normalize.normalized(feeds.orders_feed(spark, d), OPEN).where("accepted"))[0], OPEN)
    return states.groupBy("user_key", F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("net_minor"))


@_query("guarded_states")
def guarded_states(spark, d):
    return _state_rows(history.final_states(_events(spark, d), DEFAULT))


@_query("locked_period_blocks", f"""WITH RECURSIVE {_FEED}, t AS (SELECT *, {_DATE_PREC} AS dprec, row_number() OVER (PARTITION BY txn ORDER BY event_ts, rank, event_id) AS n FROM ev), life AS (
  SELECT txn, 0::BIGINT AS n, false AS del, NULL::VARCHAR AS tomb, NULL::VARCHAR AS best, NULL::DATE AS held, NULL::VARCHAR AS refused, NULL::BIGINT AS seq FROM (SELECT DISTINCT txn FROM t)
  UNION ALL
  SELECT txn, n, CASE WHEN action = 'delete' THEN NOT stop OR del ELSE del AND NOT beats END, CASE WHEN action = 'delete' AND NOT stop THEN prec WHEN action <> 'delete' AND del AND beats THEN NULL ELSE tomb END,
    CASE WHEN takes THEN dprec ELSE best END, CASE WHEN takes THEN date ELSE held END, CASE WHEN stop THEN event_id END, seq
  FROM (SELECT *, NOT stop AND NOT (action = 'update' AND del AND NOT beats) AND date IS NOT NULL AND (best IS NULL OR dprec > best) AS takes FROM (
    SELECT t.txn, t.n, t.seq, t.action, t.prec, t.dprec, t.date, t.event_id, del, tomb, best, held, tomb IS NULL OR t.prec > tomb AS beats, t.action = 'delete' AND coalesce(held BETWEEN DATE '2024-01-05' AND DATE '2024-01-12', false) AS stop
    FROM life JOIN t ON t.txn = life.txn AND t.n = life.n + 1))
) SELECT refused AS event_id FROM life WHERE refused IS NOT NULL""")
def locked_period_blocks(spark, d):
    """Deletes that a locked period refuses, in the final timeline of every log."""
    return fold.folded(_events(spark, d), LOCKED).select(F.explode("conflicts").alias("c")).where("c.type = 'delete_blocked'").select("c.event_id")


def _held(c: str, prec: str = "prec") -> str:
    return f"arg_max(struct_pack(v := {c}, a := authority, s := event_ts, c := currency), {prec}) FILTER (WHERE {c} IS NOT NULL) OVER w"


#: Every conflict of the final fold of every log: what an event meets is the winner among the unblocked ones before it.
_CONFLICTS = f"""{_FINAL}, met AS (
  SELECT t.*, {_held('amount_minor')} AS amount_h, {_held('date', _DATE_PREC)} AS date_h, {_held('category')} AS category_h, {_held('merchant')} AS merchant_h, {_held('parent_transaction_id')} AS parent_h
  FROM t JOIN life ON t.g = life.g AND t.n = life.n AND NOT blocked WINDOW w AS (PARTITION BY t.g ORDER BY t.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), conflicts AS (
  SELECT 'authority_tie' AS type, 'amount' AS field, event_id, '' AS detail FROM met WHERE amount_minor <> amount_h.v AND authority = amount_h.a AND event_ts = amount_h.s
  UNION ALL SELECT 'authority_tie', 'date', event_id, '' FROM met WHERE date <> date_h.v AND authority = date_h.a AND event_ts = date_h.s
  UNION ALL SELECT 'authority_tie', 'category', event_id, '' FROM met WHERE category <> category_h.v AND authority = category_h.a AND event_ts = category_h.s
  UNION ALL SELECT 'authority_tie', 'merchant', event_id, '' FROM met WHERE merchant <> merchant_h.v AND authority = merchant_h.a AND event_ts = merchant_h.s
  UNION ALL SELECT 'authority_tie', 'parent_transaction_id', event_id, '' FROM met WHERE parent_transaction_id <> parent_h.v AND authority = parent_h.a AND event_ts = parent_h.s
  UNION ALL SELECT 'currency_mismatch', 'currency', event_id, amount_h.c || '|' || currency FROM met WHERE amount_minor <> amount_h.v AND currency <> amount_h.c
)"""


def _conflicts(spark, d) -> DataFrame:
    return fold.folded(_events(spark, d), OPEN).select(F.explode("conflicts").alias("c")).select("c.*")


@_query("tie_conflicts", f"{_CONFLICTS} SELECT field, event_id FROM conflicts WHERE type = 'authority_tie'")
def tie_conflicts(spark, d):
    return _conflicts(spark, d).where("type = 'authority_tie'").select("field", "event_id")


@_query("currency_mismatch", f"{_CONFLICTS} SELECT event_id, detail FROM conflicts WHERE type = 'currency_mismatch'")
def currency_mismatch(spark, d):
    return _conflicts(spark, d).where("type = 'currency_mismatch'").select("event_id", "detail")


@_query("conflict_list", f"{_CONFLICTS} SELECT ev.user_key, ev.transaction_key, c.type, c.field, c.event_id FROM conflicts c JOIN ev ON ev.event_id = c.event_id")
def conflict_list(spark, d):
    return rollups.conflicts(fold.folded(_events(spark, d), OPEN)).select("user_key", "transaction_key", "type", "field", "event_id")


# ---- arrivals ----


@_query("late_events", f"WITH {_FEED} SELECT seq, event_id FROM (SELECT *, max(struct_pack(t := event_ts, r := rank, i := event_id)) OVER (PARTITION BY txn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev) WHERE struct_pack(t := event_ts, r := rank, i := event_id) < top")
def late_events(spark, d):
    return _history(spark, d).where("is_late").select("seq", "event_id")


@_query("txn_versions", f"{_PREFIXES} SELECT seq, event_id, sum(changed::BIGINT) OVER (PARTITION BY txn ORDER BY seq)::BIGINT AS txn_version, sum(changed::BIGINT) OVER (PARTITION BY user_key ORDER BY seq)::BIGINT AS user_version FROM h")
def txn_versions(spark, d):
    return _history(spark, d).select("seq", "event_id", "txn_version", "user_version")


_OP = "CASE WHEN b IS NULL THEN 'created' WHEN NOT b.x AND deleted THEN 'deleted' WHEN b.x AND NOT deleted THEN 'restored' WHEN changed THEN 'updated' ELSE 'none' END"


@_query("change_ops", f"{_PREFIXES} SELECT action, {_OP} AS op, count(*) AS n FROM h GROUP BY ALL")
def change_ops(spark, d):
    return _history(spark, d).groupBy("action", "op").agg(F.count(F.lit(1)).alias("n"))


def _money_sql(minor: str, currency: str) -> str:
    return f"CASE {currency} WHEN 'JPY' THEN {minor}::VARCHAR WHEN 'KWD' THEN ({minor} * 0.001::DECIMAL(4,3))::VARCHAR ELSE ({minor} * 0.01::DECIMAL(3,2))::VARCHAR END"


_MOVED = ", ".join(f"struct_pack(field := '{f}', was := ({was})::VARCHAR, now := ({now})::VARCHAR)" for f, was, now in (
    ("amount", _money_sql("b.a", "b.c"), _money_sql("amount_minor", "currency")), ("amount_minor", "b.a", "amount_minor"), ("category", "b.g", "category"), ("currency", "b.c", "currency"), ("date", "b.d", "date"),
    ("deleted", "b.x", "deleted"), ("merchant", "b.m", "merchant"), ("parent_transaction_id", "b.p", "parent_transaction_id"), ("provisional", "b.v", "provisional"),
))


@_query("state_changes", f"{_PREFIXES}, x AS (SELECT seq, event_id, {_OP} AS op, unnest([{_MOVED}]) AS m FROM h) SELECT seq, event_id, op, m.field AS field, m.was AS was, m.now AS now FROM x WHERE m.was IS DISTINCT FROM m.now")
def state_changes(spark, d):
    return history.changes(_history(spark, d))


#: What each event did at its arrival: its place in the timeline then, what it owned and what it did not.
_DECIDED = f"""{_PREFIXES}, mine AS (SELECT t.g, t.n, blocked, t.seq, len(list_filter([t.amount_minor IS NOT NULL, t.date IS NOT NULL, t.category IS NOT NULL, t.merchant IS NOT NULL, t.parent_transaction_id IS NOT NULL], lambda x: x)) AS asserted
  FROM t JOIN life ON t.g = life.g AND t.n = life.n WHERE t.seq = t.at_seq
), said AS (
  SELECT h.*, mine.n, mine.blocked, mine.asserted, len(list_filter([amount_event, date_event, category_event, merchant_event, parent_event], lambda x: x = h.event_id)) AS owns,
    len(list_filter([amount_event, date_event, category_event, merchant_event, parent_event], lambda x: x IS NOT NULL)) AS fields
  FROM h JOIN mine ON h.seq = mine.seq
), told AS (
  SELECT *, {_OP} AS op, CASE WHEN blocked THEN 0 ELSE owns END AS won, CASE WHEN blocked THEN 0 ELSE asserted - owns END AS lost FROM said
)"""


@_query("decision_counts", f"""{_DECIDED} SELECT decision, rule, count(*) AS n FROM (SELECT
  CASE WHEN blocked OR op = 'none' THEN 'ignored' WHEN op IN ('created', 'deleted') THEN op WHEN op = 'restored' THEN 'merged' WHEN fields > 0 AND owns = fields THEN 'replaced' ELSE 'merged' END AS decision,
  CASE WHEN blocked OR op = 'deleted' THEN 'R7_DELETE_APPLIED' WHEN action = 'create' THEN CASE WHEN b IS NULL THEN 'R3_CREATE_NEW' ELSE 'R4_CREATE_DUPLICATE' END
    WHEN action = 'update' THEN CASE WHEN n = 1 THEN 'R6_UPDATE_BEFORE_CREATE' ELSE 'R5_UPDATE_MERGE' END WHEN n = 1 THEN 'R9_DELETE_BEFORE_CREATE' ELSE 'R7_DELETE_APPLIED' END AS rule FROM told) GROUP BY ALL""")
def decision_counts(spark, d):
    return _history(spark, d).groupBy("decision", "rule").agg(F.count(F.lit(1)).alias("n"))


@_query("guarded_decisions")
def guarded_decisions(spark, d):
    return history.history(_events(spark, d), DEFAULT).groupBy("decision", "rule").agg(F.count(F.lit(1)).alias("n"))


@_query("reason_counts")
def reason_counts(spark, d):
    return _history(spark, d).select(F.explode(F.split("reason", ";")).alias("r")).groupBy(F.substring_index("r", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ---- rollups ----

_PRICED = "FROM state WHERE NOT deleted AND amount_minor IS NOT NULL"


@_query("rollup_currency", f"{_FINAL} SELECT user_key, currency, sum(amount_minor)::BIGINT AS net_minor, coalesce(sum(amount_minor) FILTER (WHERE amount_minor >= 0), 0)::BIGINT AS inflow_minor, coalesce(sum(amount_minor) FILTER (WHERE amount_minor < 0), 0)::BIGINT AS outflow_minor, count(*) AS n_transactions {_PRICED} GROUP BY ALL")
def rollup_currency(spark, d):
    return rollups.by_currency(_states(spark, d))


@_query("rollup_month", f"{_FINAL} SELECT user_key, coalesce(strftime(date, '%Y-%m'), 'undated') AS month, currency, sum(amount_minor)::BIGINT AS net_minor {_PRICED} GROUP BY ALL")
def rollup_month(spark, d):
    return rollups.by_month(_states(spark, d))


@_query("rollup_category", f"{_FINAL} SELECT user_key, coalesce(category, 'uncategorized') AS category, currency, sum(amount_minor)::BIGINT AS net_minor {_PRICED} GROUP BY ALL")
def rollup_category(spark, d):
    return rollups.by_category(_states(spark, d))


@_query("rollup_sets", f"{_FINAL}, x AS (SELECT user_key, currency, coalesce(strftime(date, '%Y-%m'), 'undated') AS month, coalesce(category, 'uncategorized') AS category, amount_minor {_PRICED}) SELECT CASE grouping(month, category) WHEN 3 THEN 'currency' WHEN 1 THEN 'month' ELSE 'category' END AS level, user_key, currency, month, category, sum(amount_minor)::BIGINT AS net_minor, count(*) AS n_transactions FROM x GROUP BY GROUPING SETS ((user_key, currency), (user_key, currency, month), (user_key, currency, category))")
def rollup_sets(spark, d):
    return rollups.all_sets(_states(spark, d))


@_query("lifecycle_counts", f"{_FINAL} SELECT user_key, count(*) FILTER (WHERE NOT deleted) AS n_live, count(*) FILTER (WHERE deleted) AS n_deleted, count(*) FILTER (WHERE NOT deleted AND provisional) AS n_provisional, count(*) FILTER (WHERE NOT deleted AND amount_minor IS NULL) AS n_unpriced FROM state GROUP BY user_key")
def lifecycle_counts(spark, d):
    return rollups.lifecycle_counts(_states(spark, d))


@_query("book_totals", f"{_CONFLICTS} SELECT count(DISTINCT user_key) AS n_users, count(*) AS n_transactions, count(*) FILTER (WHERE NOT deleted) AS n_live, sum(n_events)::BIGINT AS n_events, (SELECT count(*) FROM conflicts) AS n_conflicts FROM state")
def book_totals(spark, d):
    return rollups.book_totals(fold.folded(_events(spark, d), OPEN))


@_query("near_duplicates", f"{_FINAL} SELECT a.user_key, a.transaction_key, a.amount_minor, a.date, a.currency, count(*) AS match_count FROM state a JOIN state b ON a.user_key = b.user_key AND a.amount_minor = b.amount_minor AND a.date = b.date AND a.currency = b.currency AND a.transaction_key <> b.transaction_key WHERE NOT a.deleted AND NOT b.deleted GROUP BY ALL")
def near_duplicates(spark, d):
    return rollups.near_duplicates(_states(spark, d)).drop("matches")


@_query("live_children", f"{_FINAL} SELECT s.user_key, s.transaction_key, count(*) AS n_children, string_agg('T' || substr(c.transaction_key, 2), ',' ORDER BY 'T' || substr(c.transaction_key, 2)) AS children FROM state s JOIN state c ON s.user_key = c.user_key AND lower(c.parent_transaction_id) = s.transaction_key AND NOT c.deleted GROUP BY ALL")
def live_children(spark, d):
    return rollups.live_children(_states(spark, d), OPEN)


# ---- other moments ----


@_query("state_as_of", f"WITH RECURSIVE {_FEED}, log AS (SELECT *, txn AS g FROM ev WHERE event_ts <= TIMESTAMP '2024-01-08 00:00:00'), {_fold_sql('log')} SELECT {_STATE} FROM state")
def state_as_of(spark, d):
    return _state_rows(rollups.as_of(_events(spark, d), MOMENT, OPEN))


@_query("state_at_version", f"""{_PREFIXES}, v AS (SELECT user_key, seq, sum(changed::BIGINT) OVER (PARTITION BY user_key ORDER BY seq) AS version FROM h), stop AS (SELECT user_key, min(seq) AS seq FROM v WHERE version >= {VERSION} GROUP BY user_key),
last AS (SELECT h.txn, max(h.seq) AS seq FROM h LEFT JOIN stop ON h.user_key = stop.user_key WHERE stop.seq IS NULL OR h.seq <= stop.seq GROUP BY h.txn)
SELECT {_STATE} FROM h SEMI JOIN last ON h.txn = last.txn AND h.seq = last.seq""")
def state_at_version(spark, d):
    events = _events(spark, d)
    return _state_rows(rollups.at_version(events, history.native_history(events, OPEN), VERSION, OPEN))


# ---- anomalies ----


def _flag_rows(spark, d, code: str) -> DataFrame:
    h = _history(spark, d)
    near = anomalies.near_duplicates_at(h) if code == "A_NEAR_DUPLICATE" else None
    return anomalies.flagged(h, OPEN, near).select("seq", "event_id", F.explode("anomalies").alias("a")).where(F.col("a.code") == code).select("seq", "event_id", "a.severity")


_ANOMALIES = {
    "amount_jump": ("A_AMOUNT_JUMP", "CASE WHEN abs(amount_minor - b.a) >= 100000 AND b.a <> 0 AND abs(amount_minor - b.a) * 100 >= abs(b.a) * 300 THEN 'high' ELSE 'medium' END", "b.a <> amount_minor AND (abs(amount_minor - b.a) >= 100000 OR (b.a <> 0 AND abs(amount_minor - b.a) * 100 >= abs(b.a) * 300))"),
    "sign_flip": ("A_SIGN_FLIP", "'high'", "b.a <> amount_minor AND (b.a < 0) <> (amount_minor < 0)"),
    "date_shift": ("A_RETRO_DATE_SHIFT", "CASE WHEN abs(date - b.d) > 360 THEN 'high' ELSE 'medium' END", "abs(date - b.d) > 90"),
    "currency_change": ("A_CURRENCY_CHANGE", "'high'", "b.c <> currency"),
    "stale_delete": ("A_STALE_DELETE", "'medium'", "action = 'delete' AND NOT b.x AND deleted AND event_ts::DATE - b.d > 365"),
    "edit_churn": ("A_EDIT_CHURN", "CASE WHEN n_events <= 10 THEN 'low' ELSE 'medium' END", "n_events > 5"),
    "round_amount": ("A_ROUND_LARGE_AMOUNT", "'low'", "action <> 'delete' AND abs(amount_minor) >= 1000000 AND abs(amount_minor) % 100000 = 0"),
    "near_duplicate": ("A_NEAR_DUPLICATE", "'medium'", "NOT deleted AND EXISTS (SELECT 1 FROM h AS o WHERE o.user_key = h.user_key AND o.txn <> h.txn AND o.seq < h.seq AND NOT o.deleted AND o.amount_minor = h.amount_minor AND o.date = h.date AND o.currency = h.currency AND NOT EXISTS (SELECT 1 FROM h AS n WHERE n.txn = o.txn AND n.seq > o.seq AND n.seq < h.seq))"),
}
for _name, (_code, _severity, _where) in _ANOMALIES.items():
    _query(f"anomaly_{_name}", f"{_PREFIXES} SELECT seq, event_id, {_severity} AS severity FROM h WHERE {_where}")(lambda spark, d, code=_code: _flag_rows(spark, d, code))


@_query("anomaly_contradiction", f"{_DECIDED} SELECT seq, event_id, 'low' AS severity FROM told WHERE lost > 0 AND won = 0 AND source <> 'user_edit'")
def anomaly_contradiction(spark, d):
    return _flag_rows(spark, d, "A_LOW_AUTHORITY_CONTRADICTION")


_FLAGS = " UNION ALL ".join(f"SELECT seq, event_id, '{code}' AS code, {severity} AS severity FROM h WHERE {where}" for code, severity, where in _ANOMALIES.values())


@_query("anomaly_list", f"{_DECIDED} {_FLAGS} UNION ALL SELECT seq, event_id, 'A_LOW_AUTHORITY_CONTRADICTION', 'low' FROM told WHERE lost > 0 AND won = 0 AND source <> 'user_edit'")
def anomaly_list(spark, d):
    h = _history(spark, d)
    return anomalies.listed(anomalies.flagged(h, OPEN, anomalies.near_duplicates_at(h))).select("seq", "event_id", "code", "severity")


# ---- audit ----


def _chain(spark, d) -> DataFrame:
    return audit.sealed(audit.bodies(_history(spark, d)), audit.header(OPEN))


@_query("audit_chain")
def audit_chain(spark, d):
    return _chain(spark, d).select("position", "seq", "prev_hash", "record_hash")


@_query("chain_breaks", f"""WITH {_FEED}, p AS (SELECT unnest(range(1, (SELECT count(*) FROM ev) + 1)) AS position)
SELECT position, CASE WHEN position % 97 = 0 THEN 'record_hash' ELSE 'prev_hash' END AS kind FROM p WHERE position % 97 = 0 OR position % 101 = 0 OR (position > 101 AND position % 101 = 1 AND (position - 1) % 97 <> 0)""")
def chain_breaks(spark, d):
    """What verification finds in a forged chain: some bodies altered, some records sealed anew behind another one."""
    chain, at = _chain(spark, d), F.col("position")
    altered, moved = (at > 0) & (at % 97 == 0), (at > 0) & (at % 101 == 0) & (at % 97 != 0)
    other = F.lit("f" * 64)
    forged = chain.withColumns({
        "body": F.when(altered, F.concat("body", F.lit(" "))).otherwise(F.col("body")), "prev_hash": F.when(moved, other).otherwise(F.col("prev_hash")),
        "record_hash": F.when(moved, canon.chained(other, F.col("body"))).otherwise(F.col("record_hash")),
    })
    return audit.breaks(forged)


@_query("replay_diff")
def replay_diff(spark, d):
    """What another date rule would have decided differently."""
    other = OPEN.with_(prefer_earliest_date_on_equal_authority=False)
    return audit.replay_diff(_history(spark, d), history.native_history(_events(spark, d), other))


@_query("audit_summary")
def audit_summary(spark, d):
    h = _history(spark, d)
    return audit.summary(anomalies.flagged(h, OPEN, anomalies.near_duplicates_at(h)))


@_query("authority_view", f"{_FINAL}, x AS (SELECT user_key, transaction_key, unnest([struct_pack(f := 'amount', e := amount_event), struct_pack(f := 'date', e := date_event), struct_pack(f := 'category', e := category_event), struct_pack(f := 'merchant', e := merchant_event), struct_pack(f := 'parent_transaction_id', e := parent_event)]) AS o FROM state) SELECT x.user_key, x.transaction_key, o.f AS field, ev.authority, o.e AS event_id FROM x JOIN ev ON ev.event_id = o.e")
def authority_view(spark, d):
    return rollups.authority_view(_states(spark, d)).select("user_key", "transaction_key", "field", "authority", "event_id")


# ---- scalars ----


@_query("amount_roundtrip", "SELECT o_orderkey, round(o_totalprice::DECIMAL(18,2) * 100, 0)::BIGINT AS minor, o_totalprice::DECIMAL(18,2)::VARCHAR AS shown FROM orders")
def amount_roundtrip(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("t"))
    minor = money.parse_amount(F.concat(F.lit("$"), F.col("t")), F.lit("USD"))["minor"]
    return o.withColumn("minor", minor).select("o_orderkey", "minor", money.format_amount(F.col("minor"), F.lit("USD")).alias("shown"))


@_query("date_formats", "SELECT o_orderkey, o_orderdate::DATE AS parsed, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'W_DATE_ALT_FORMAT' END AS warning FROM orders")
def date_formats(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    formats = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd-MMM-yyyy", "MMMM d, yyyy"]
    text = F.lit(None).cast("string")
    for i, f in enumerate(formats):
        text = F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", f)).otherwise(text)
    return o.withColumn("p", dates.parse_date(text)).select("o_orderkey", F.col("p.value").alias("parsed"), F.col("p.warning").alias("warning"))


@_query("ts_formats", "SELECT o_orderkey, date_trunc('second', o_orderdate) AS parsed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS shown FROM orders")
def ts_formats(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.date_trunc("second", "o_orderdate").alias("at"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.unix_timestamp("at").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
    return o.withColumn("parsed", dates.parse_timestamp(text)["value"]).select("o_orderkey", "parsed", dates.format_ts(F.col("parsed")).alias("shown"))


@_query("stable_ids", "SELECT o_orderkey, 'syn-' || substr(sha256('[\"' || o_custkey || '\",\"' || strftime(o_orderdate, '%Y-%m-%d') || '\",' || round(o_totalprice::DECIMAL(18,2) * 100, 0)::BIGINT || ',\"\"]'), 1, 16) AS surrogate FROM orders")
def stable_ids(spark, d):
    rows = feeds.orders_feed(spark, d)
    made = normalize.normalized(rows.withColumn("transaction_id", F.lit(None).cast("string")), OPEN)
    return made.select(F.col("seq").alias("o_orderkey"), F.col("transaction_id").alias("surrogate"))


#: Rows with one fault each, by the order's number.
_FAULTS = (
    ("user_id", " ", "E_MISSING_USER"), ("action", "frobnicate", "E_BAD_ACTION"), ("currency", "dollars", "E_BAD_CURRENCY"), ("amount", "12,34x", "E_BAD_AMOUNT"), ("amount", None, "E_MISSING_AMOUNT"),
    ("amount", "9999999999999", "E_AMOUNT_RANGE"), ("date", "2024-02-30", "E_BAD_DATE"), ("date", "03/04/2024", "E_AMBIGUOUS_DATE"), ("date", "1890-01-01", "E_DATE_RANGE"), ("date", None, "E_MISSING_DATE"),
    ("event_ts", "yesterday", "E_BAD_EVENT_TS"), ("action", None, "E_MISSING_ACTION"),
)


@_query("row_faults", f"SELECT code, 'error' AS severity, count(*) AS n FROM (SELECT CASE o_orderkey % {len(_FAULTS)} {' '.join(f"WHEN {i} THEN '{c}'" for i, (_, _, c) in enumerate(_FAULTS))} END AS code FROM orders) GROUP BY ALL")
def row_faults(spark, d):
    rows = feeds.orders_feed(spark, d).withColumn("source", F.lit("bank"))
    for i, (field, text, _) in enumerate(_FAULTS):
        rows = rows.withColumn(field, F.when(F.col("seq") % len(_FAULTS) == i, F.lit(text)).otherwise(F.col(field)))
    issues = normalize.normalized(rows, OPEN).select(F.explode("issues").alias("i")).where("i.severity = 'error'")
    return issues.groupBy("i.code", "i.severity").agg(F.count(F.lit(1)).alias("n"))


def _customers(spark, d) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").cast("string").alias("uid"), F.concat(F.lit('x,"'), "c_name", F.lit('"\u00e9')).alias("payee"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("cat"))


_CUSTOMERS = """SELECT c_custkey::VARCHAR AS user_id, 'x,"' || c_name || '"\u00e9' AS merchant, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS category FROM customer"""


#: Bytes that an upload is meant to have, well under the cap, as rows differ in size.
_UPLOAD = DEFAULT.max_upload_bytes // 4


def _n_uploads(rows: DataFrame) -> int:
    """How many uploads rows make, by their size as JSON, which no other form exceeds by much; four at least."""
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))) + 1)).first()[0] or 0
    return max(4, -(-size // _UPLOAD))


def _uploads(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to as many partitions, so files, as keep each of them under the cap of an upload."""
    return rows.repartition(_n_uploads(rows))


def _read_back(spark, path: str) -> DataFrame:
    rows = normalize.remap_maps(readers.read_files(spark, [path]))
    return rows.select("user_id", "merchant", F.nullif("category", F.lit("")).alias("category"))


@_query("read_csv", _CUSTOMERS)
def read_csv(spark, d):
    path = shared_path(spark, "csv")
    _uploads(_customers(spark, d)).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return _read_back(spark, path + "/*.csv")


@_query("read_jsonl", _CUSTOMERS)
def read_jsonl(spark, d):
    path = shared_path(spark, "jsonl")
    rows = _uploads(_customers(spark, d))
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return normalize.remap_maps(readers.read_files(spark, [path + "/*.txt"], kind="jsonl")).select("user_id", "merchant", "category")


@_query("read_json", _CUSTOMERS)
def read_json(spark, d):
    """One wrapped array for each file."""
    path = shared_path(spark, "json")
    rows = _customers(spark, d)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("uid", "payee", "cat"), F.lit(_n_uploads(rows))))
    arrays = rows.groupBy("part").agg(F.to_json(F.struct(F.collect_list(F.struct("uid", "payee", "cat")).alias("rows"))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return normalize.remap_maps(readers.read_files(spark, [path + "/*/*.txt"], kind="json")).select("user_id", "merchant", "category")


@_query("store_scan", f"WITH {_FEED} SELECT user_key, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM ev GROUP BY user_key")
def store_scan(spark, d):
    """Two batches appended to a store, the second one with all of the first again; then a scan."""
    events = _events(spark, d)
    held = store.ParquetStore(spark, shared_path(spark, "store"))
    held.add_events(events.where("seq % 2 = 0"))
    held.add_events(events)
    return held.read("events").groupBy("user_key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@_query("record_hashes", "SELECT o_orderkey, sha256(repeat('0', 64) || chr(31) || '{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}') AS record_hash FROM orders")
def record_hashes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")
    body = canon.resorted(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"))))
    return o.select("o_orderkey", canon.chained(F.lit(audit.GENESIS), body).alias("record_hash"))


@_query("state_hash")
def state_hash(spark, d):
    return rollups.state_hashes(_states(spark, d).where(F.col("account_id").isNull()))


__all__ = ["GROUPS", "ORACLES", "QUERIES", "canon"]
