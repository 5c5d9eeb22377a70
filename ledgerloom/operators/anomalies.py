"""Advisory rules over the history: each row's flags, sorted by code. Time is the event's, never a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Rules

SEVERITIES = ("low", "medium", "high")


def at_least(severity: Column, least: str) -> Column:
    return severity.isin(*SEVERITIES[SEVERITIES.index(least) :])


def _flag(condition: Column, code: str, severity: Column | str, field: str) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), severity.alias("severity")))


def flagged(history: DataFrame, rules: Rules = DEFAULT, near: DataFrame | None = None) -> DataFrame:
    """history with ``anomalies``. near: (seq, match_count) from ``near_duplicates_at`` for A_NEAR_DUPLICATE."""
    t = rules.thresholds
    if not rules.detect_anomalies:
        return history.withColumn("anomalies", F.array().cast("array<struct<code:string,field:string,severity:string>>"))
    if near is not None:
        history = history.join(near.select("seq", F.col("match_count").alias("__near")), "seq", "left")
    else:
        history = history.withColumn("__near", F.lit(None).cast("long"))
    old, new = F.col("before.amount_minor"), F.col("after.amount_minor")
    delta = F.abs(new - old)
    far = delta >= t.amount_jump_minor
    steep = (old != 0) & (delta * 100 >= F.abs(old) * t.amount_jump_pct)
    shift = F.abs(F.datediff("after.date", "before.date"))
    age = F.datediff(F.to_date("event_ts"), F.col("before.date"))
    n = F.col("n_events")
    size = F.abs(new)
    flags = F.array(
        _flag((old != new) & (far | steep), "A_AMOUNT_JUMP", F.when(far & steep, "high").otherwise("medium"), "amount"),
        _flag((F.col("before.currency") != F.col("after.currency")), "A_CURRENCY_CHANGE", "high", "currency"),
        _flag(n > t.edit_churn_count, "A_EDIT_CHURN", F.when(n <= 2 * t.edit_churn_count, "low").otherwise("medium"), ""),
        _flag((F.size("lost") > 0) & (F.size("won") == 0) & (F.col("source") != "user_edit"), "A_LOW_AUTHORITY_CONTRADICTION", "low", ""),
        _flag(F.col("__near") > 0, "A_NEAR_DUPLICATE", "medium", ""),
        _flag(shift > t.date_shift_days, "A_RETRO_DATE_SHIFT", F.when(shift > 4 * t.date_shift_days, "high").otherwise("medium"), "date"),
        _flag((F.col("action") != "delete") & (size >= t.round_amount_floor_minor) & (F.lit(t.round_amount_modulus_minor) > 0) & (F.pmod(size, F.lit(max(t.round_amount_modulus_minor, 1))) == 0), "A_ROUND_LARGE_AMOUNT", "low", "amount"),
        _flag(F.lit(t.flag_sign_flip) & (old != new) & ((old < 0) != (new < 0)), "A_SIGN_FLIP", "high", "amount"),
        _flag((F.col("action") == "delete") & (F.col("op") == "deleted") & (age > t.delete_age_days), "A_STALE_DELETE", "medium", "deleted"),
    )
    return history.withColumn("anomalies", F.array_compact(flags)).drop("__near")


def listed(flags: DataFrame) -> DataFrame:
    """One row for each flag, with its event and transaction."""
    return flags.select("seq", "event_id", "user_id", "transaction_id", F.explode("anomalies").alias("a")).select("seq", "event_id", "user_id", "transaction_id", "a.*")


def near_duplicates_at(history: DataFrame) -> DataFrame:
    """(seq, match_count): other live transactions of the user with the same amount, date and currency, as of each event.

    A state of a transaction holds from its event to the next one of the same
    transaction. Along (user, amount, date, currency) and seq, entering states
    count +1 and leaving ones -1, so a running sum gives the live ones without
    any pairs.
    """
    from pyspark.sql import Window

    by_txn = Window.partitionBy("user_key", "transaction_key").orderBy("seq")
    rows = history.select("seq", "user_key", "transaction_key", "after.amount_minor", "after.date", "after.currency", F.lead("seq").over(by_txn).alias("until"), (~F.coalesce("after.deleted", F.lit(True))).alias("up"))
    rows = rows.where(F.col("up") & F.col("amount_minor").isNotNull() & F.col("date").isNotNull())
    key = ["user_key", "amount_minor", "date", "currency"]
    steps = rows.select(*key, "seq", F.lit(1).alias("d"), F.lit(True).alias("own")).unionByName(rows.where("until IS NOT NULL").select(*key, F.col("until").alias("seq"), F.lit(-1).alias("d"), F.lit(False).alias("own")))
    # At one seq only one transaction changes: its old state leaves as its new one enters.
    running = F.sum("d").over(Window.partitionBy(*key).orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.withColumn("n", running).where("own").select("seq", (F.col("n") - 1).alias("match_count")).where("match_count > 0")
