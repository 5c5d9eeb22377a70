"""Raw rows to typed events, or to the list of what is wrong with them.

Input: seq, origin and text columns, under any known header; all issues of a row
are collected, in a fixed order, as they are part of the audit trail. One
``select`` chain, so a scan, the parsing and the split stay in one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ACTION_RANK, ACTION_WORDS, DEFAULT, GROUPS, SOURCE_WORDS, Rules, spelled
from ..functions import dates, money
from ..functions.canon import json_array, number, quoted, stable_id
from ..functions.text import compatible, folded, identity, literal_map, said, slug, squeezed, staged

# Headers under which a field may come.
HEADERS = {
    "user_id": "user_id user uid userid customer_id customer account_holder",
    "transaction_id": "transaction_id txn_id tx_id transactionid txnid transaction id reference ref",
    "amount": "amount amt value transaction_amount sum total debit_credit",
    "date": "date txn_date transaction_date posted_date post_date value_date booking_date occurred_on",
    "event_ts": "event_ts event_timestamp timestamp ts event_time updated_at modified_at asserted_at recorded_at",
    "source": "source src origin_system channel provider feed",
    "action": "action op operation event_type change_type verb type",
    "event_id": "event_id eventid evt_id idempotency_key message_id",
    "category": "category cat spend_category",
    "merchant": "merchant merchant_name payee description narrative vendor",
    "account_id": "account_id account acct acct_id account_number",
    "parent_transaction_id": "parent_transaction_id parent_id parent merged_into split_of",
    "currency": "currency ccy currency_code",
    "role": "role user_role tier plan",
}
FIELDS = tuple(HEADERS)
_CANONICAL = spelled(HEADERS)
ISSUE = "struct<code:string,field:string,severity:string>"


def canonical_header(name: str) -> str | None:
    import unicodedata

    s = "_".join(unicodedata.normalize("NFKC", name).strip().casefold().split()).replace("-", "_").strip("_")
    return _CANONICAL.get(s)


def remap(df: DataFrame) -> DataFrame:
    """Columns under their canonical names, unknown ones kept in ``extra``; of several headers of one field the first wins."""
    chosen: dict[str, str] = {}
    extra = []
    for c in df.columns:
        if c in ("seq", "origin"):
            continue
        if (name := canonical_header(c)) and name not in chosen:
            chosen[name] = c
        elif not name:
            extra.append(c)
    values = [F.col(f"`{chosen[f]}`").cast("string").alias(f) if f in chosen else F.lit(None).cast("string").alias(f) for f in FIELDS]
    kept = F.map_from_arrays(F.array(*map(F.lit, extra)), F.array(*(F.col(f"`{c}`").cast("string") for c in extra))) if extra else F.lit(None).cast("map<string,string>")
    return df.select("seq", "origin", *values, kept.alias("extra"))


def remap_maps(df: DataFrame, data: str = "data") -> DataFrame:
    """The same for rows whose columns differ: ``data`` is a map of text, in the order of the row."""
    slugged = lambda k: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(squeezed(k)), r"\s", "_"), "-", "_"), "^_+|_+$", "")
    names = literal_map(_CANONICAL)
    pairs = F.transform(F.map_entries(data), lambda e: F.struct(F.element_at(names, slugged(e["key"])).alias("name"), e["key"].alias("key"), e["value"].alias("value")))
    df = df.withColumn("__pairs", pairs)
    value_of = lambda f: F.get(F.filter("__pairs", lambda e: e["name"] == F.lit(f)), F.lit(0))["value"].alias(f)
    values = [value_of(f) for f in FIELDS]
    extra = F.map_from_entries(F.transform(F.filter("__pairs", lambda e: e["name"].isNull()), lambda e: F.struct(e["key"], e["value"])))
    return df.select("seq", "origin", *values, extra.alias("extra"))


def authority(source: Column, role: Column, rules: Rules = DEFAULT) -> Column:
    base = F.coalesce(F.element_at(literal_map(dict(rules.source_authority)), source), F.lit(rules.source_authority.get("unknown", 1)))
    bonus = F.when(source.isin(*rules.bonus_sources), F.coalesce(F.element_at(literal_map(dict(rules.role_bonus)), role), F.lit(0))).otherwise(0)
    return (base + bonus).cast("int")


def action_rank(action: Column) -> Column:
    return F.element_at(literal_map(ACTION_RANK), action)


def _issue(condition: Column, code: Column | str, field: str, severity: str = "error") -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.when(condition, F.struct(code.alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))


def normalized(rows: DataFrame, rules: Rules = DEFAULT, full_unicode: bool = False) -> DataFrame:
    """Every row of a remapped frame with its event columns, ``issues`` and ``accepted``.

    full_unicode: bring texts to NFKC and ids to their case folding first, in
    Python over Arrow. Without it, ids are lower-cased and width variants stay.
    """
    ids = ("user_id", "transaction_id", "parent_transaction_id", "merchant", "category", "account_id", "event_id", "role", "source", "action")
    df = rows
    if full_unicode:
        df = df.withColumns({c: compatible(F.col(c)) for c in ids})
    key = (lambda c: folded(squeezed(c)) if rules.case_insensitive_ids else squeezed(c)) if full_unicode else (lambda c: identity(c, rules.case_insensitive_ids))

    texts = ("user_id", "transaction_id", "category", "merchant", "account_id", "parent_transaction_id", "role", "event_id", "source", "action")
    df = staged(df, ("_", {}, [lambda v: {f"sq_{c}": squeezed(F.col(c)) for c in (*texts, "amount", "date", "event_ts")}, lambda v: {c: said(v(f"sq_{c}")) for c in (*texts, "amount", "date", "event_ts")}]))
    df = df.withColumns({
        "_act": F.element_at(literal_map(spelled(ACTION_WORDS)), slug(F.col("_action"))),
        "_src": F.element_at(literal_map(spelled(SOURCE_WORDS)), slug(F.col("_source"))),
        "_ccy": money.currency_code(F.col("currency"), rules.default_currency),
        "_has_amount": F.col("_amount").isNotNull(), "_has_date": F.col("_date").isNotNull(), "_has_ts": F.col("_event_ts").isNotNull(),
    })
    df = df.withColumn("_currency", F.coalesce("_ccy.value", F.lit(rules.default_currency)))
    df = staged(
        df, ("_money_", {"raw": F.col("amount"), "currency": F.col("_currency")}, money.AMOUNT_STEPS), ("_day_", {"text": F.col("_date")}, dates.date_steps(rules.strict_ambiguous_dates)),
        ("_when_", {"moment": F.col("_event_ts")}, dates.timestamp_steps()),
    )
    in_range = F.col("_day_value").between(F.lit(rules.min_date), F.lit(rules.max_date))
    df = df.withColumns({"amount_minor": F.when(F.col("_has_amount"), F.col("_money_minor")), "_date": F.when(F.col("_has_date") & in_range, F.col("_day_value"))})
    inferred = ~F.col("_has_ts") & F.col("_date").isNotNull() & F.lit(rules.infer_missing_event_ts)
    df = df.withColumns({"_inferred": inferred, "_ts": F.when(F.col("_has_ts"), F.col("_when_at")).when(inferred, F.col("_date").cast("timestamp"))})

    given = F.col("_transaction_id").isNotNull()
    can = F.lit(rules.synthesize_missing_transaction_id) & (F.col("_act") == "create") & F.col("amount_minor").isNotNull() & F.col("_date").isNotNull()
    surrogate = stable_id("syn-", 16, quoted(F.col("_user_id")), quoted(F.col("_date").cast("string")), number(F.col("amount_minor")), quoted(F.lower(F.coalesce("_merchant", F.lit("")))))
    made = F.coalesce(~given & can, F.lit(False))
    df = df.withColumns({"_made": made, "_txn": F.when(given, F.col("_transaction_id")).when(made, surrogate)})
    df = df.withColumns({"user_key": key(F.col("_user_id")), "transaction_key": key(F.col("_txn")), "_parent_key": key(F.col("_parent_transaction_id"))})

    asserts = {"amount": F.col("amount_minor").isNotNull(), "date": F.col("_date").isNotNull()} | {g: F.col("_" + g).isNotNull() for g in GROUPS[2:]}
    nothing = ~F.greatest(*asserts.values())
    create, update = F.col("_act") == "create", F.col("_act") == "update"
    issues = F.array(
        _issue(F.col("_user_id").isNull(), "E_MISSING_USER", "user_id"),
        _issue(F.col("_act").isNull(), F.when(F.col("_action").isNull(), "E_MISSING_ACTION").otherwise("E_BAD_ACTION"), "action"),
        _issue(F.col("_src").isNull(), F.when(F.col("_source").isNull(), "W_SOURCE_MISSING").otherwise("W_SOURCE_UNKNOWN"), "source", "warning"),
        _issue(F.col("_ccy.error").isNotNull(), F.col("_ccy.error"), "currency"),
        _issue(F.col("_has_amount") & F.col("_money_error").isNotNull(), F.col("_money_error"), "amount"),
        _issue(F.col("_has_amount") & F.col("_money_warning").isNotNull(), F.col("_money_warning"), "amount", "warning"),
        _issue(~F.col("_has_amount") & create, "E_MISSING_AMOUNT", "amount"),
        _issue(F.col("_has_date") & F.col("_day_error").isNotNull(), F.col("_day_error"), "date"),
        _issue(F.col("_has_date") & F.col("_day_cut").isNotNull(), F.col("_day_cut"), "date", "warning"),
        _issue(F.col("_has_date") & F.col("_day_warning").isNotNull(), F.col("_day_warning"), "date", "warning"),
        _issue(F.col("_has_date") & ~in_range, "E_DATE_RANGE", "date"),
        _issue(~F.col("_has_date") & create, "E_MISSING_DATE", "date"),
        _issue(update & nothing, "E_EMPTY_UPDATE", ""),
        _issue(F.col("_has_ts") & F.col("_when_ts_error").isNotNull(), F.col("_when_ts_error"), "event_ts"),
        _issue(F.col("_inferred"), "W_TS_INFERRED", "event_ts", "warning"),
        _issue(~F.col("_has_ts") & ~F.col("_inferred"), "E_MISSING_EVENT_TS", "event_ts"),
        _issue(~given & ~F.col("_made"), "E_MISSING_TXN_ID", "transaction_id"),
        _issue(F.col("_made"), "W_ID_SYNTHESIZED", "transaction_id", "warning"),
        _issue(F.col("transaction_key") == F.col("_parent_key"), "E_SELF_PARENT", "parent_transaction_id"),
    )
    df = df.withColumn("issues", F.array_compact(issues))
    role = F.coalesce(F.lower("_role"), F.element_at(literal_map(dict(rules.user_roles)), F.col("_user_id")) if rules.user_roles else F.lit(None).cast("string"), F.lit(rules.default_role))
    supplied = F.array_sort(F.array_compact(F.array(
        F.when(asserts["amount"], F.lit("amount_minor")), F.when(asserts["amount"], F.lit("currency")), *(F.when(asserts[g], F.lit(g)) for g in GROUPS[1:]),
    )))
    df = df.withColumns({"_source_name": F.coalesce("_src", F.lit("unknown")), "_role_name": role, "supplied": supplied})
    derived = stable_id(
        "evt-", 24, *(quoted(F.col(c)) for c in ("user_key", "transaction_key", "_act", "_source_name")), quoted(dates.format_ts(F.col("_ts"))), number(F.col("amount_minor")),
        quoted(F.col("_currency")), quoted(F.col("_date").cast("string")), *(quoted(F.col("_" + g)) for g in GROUPS[2:]), json_array(F.transform("supplied", quoted)),
    )
    errors = F.exists("issues", lambda i: i["severity"] == "error")
    flags = F.array_compact(F.array(F.when(F.col("_inferred"), F.lit("ts_inferred")), F.when(F.col("_made"), F.lit("id_synthesized")), F.when(F.col("_event_id").isNull(), F.lit("event_id_derived"))))
    out = [
                F.col("seq").alias("seq"), F.col("origin").alias("origin"), F.coalesce("_event_id", derived).alias("event_id"), F.col("_user_id").alias("user_id"), F.col("user_key").alias("user_key"), F.col("_txn").alias("transaction_id"), F.col("transaction_key").alias("transaction_key"),
        F.col("_act").alias("action"), F.col("_source_name").alias("source"), F.coalesce("_source", F.lit("")).alias("source_raw"), F.col("_ts").alias("event_ts"), F.col("_currency").alias("currency"),
        F.col("amount_minor").alias("amount_minor"), F.col("_date").alias("date"), *(F.col("_" + g).alias(g) for g in GROUPS[2:]), F.col("_parent_key").alias("parent_key"), F.col("supplied").alias("supplied"),
        F.col("_role_name").alias("role"), authority(F.col("_source_name"), F.col("_role_name"), rules).alias("authority"),
        F.transform(F.filter("issues", lambda i: i["severity"] == "warning"), lambda i: i["code"]).alias("warnings"), flags.alias("flags"), F.col("issues").alias("issues"), (~errors).alias("accepted"),
        *([F.col("extra").alias("extra")] if "extra" in rows.columns else []),
    ]
    # A generator of one row: filters on ``accepted`` stay above it, where the optimizer would
    # otherwise write the whole of the parsing into them, once for each place that uses it.
    names = ["seq", "origin", "event_id", "user_id", "user_key", "transaction_id", "transaction_key", "action", "source", "source_raw", "event_ts", "currency", "amount_minor", "date", *GROUPS[2:], "parent_key", "supplied", "role", "authority", "warnings", "flags", "issues", "accepted"]
    return df.select(F.stack(F.lit(1), *out).alias(*names, *(["extra"] if "extra" in rows.columns else [])))


def rejection_id(raw: Column) -> Column:
    """Content id of a raw row (a map of text) that is no event."""
    entries = F.array_sort(F.map_entries(raw))
    body = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ","), F.lit("}"))
    return F.concat(F.lit("bad-"), F.substring(F.sha2(body, 256), 1, 24))


def first_arrivals(events: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new, duplicates): the first arrival of each event_id, unless ``known`` (event_id) has it, and all others."""
    by_id = Window.partitionBy("event_id").orderBy("seq")
    ranked = events.withColumn("__nth", F.row_number().over(by_id))
    if known is not None:
        ranked = ranked.join(known.select("event_id", F.lit(True).alias("__known")).distinct(), "event_id", "left")
    else:
        ranked = ranked.withColumn("__known", F.lit(None).cast("boolean"))
    first = (F.col("__nth") == 1) & F.col("__known").isNull()
    return tuple(ranked.where(c).drop("__nth", "__known").select(*events.columns) for c in (first, ~first))
