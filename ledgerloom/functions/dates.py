"""Business dates and event timestamps from text, as native expressions. The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, expressed, literal_map

# Month names.
MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
MONTHS |= {m[:3]: i for m, i in MONTHS.items()} | {"sept": 9}

_ISO_TS = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([zZ]|[+-]\d{2}:?\d{2}(:\d{2})?)?)?$"
_EPOCH = r"^-?\d{9,14}$"


def _tokens(v) -> dict[str, Column]:
    """The shape of a date (9 for digits, a for letters, separators as they are) and its parts."""
    day = v("day")
    parts = F.split(F.regexp_replace(day, "[^0-9A-Za-z]+", " "), " ")
    return {"shape": F.regexp_replace(F.regexp_replace(day, "[0-9]+", "9"), "[A-Za-z]+", "a"), **{n: F.get(parts, F.lit(i)) for i, n in enumerate("abc")}}


def _kind(v) -> dict[str, Column]:
    """Which order the parts stand in, by the shape and how long they are."""
    a, b, c = (F.length(v(n)) for n in "abc")
    short_ends, name = (b <= 2) & (c <= 2), lambda n: n.between(3, 9)
    year_first = (a == 4) & short_ends
    kind = (
        F.when((v("shape") == "9-9-9") & year_first, "iso").when(v("shape").isin("9/9/9", "9.9.9") & year_first, "year").when((v("shape") == "9") & (a == 8), "packed")
        .when(v("shape").isin("9 a 9", "9-a-9", "9 a-9", "9-a 9") & (a <= 2) & name(b) & (c == 4), "day name").when(v("shape").isin("a 9, 9", "a 9 9") & name(a) & (b <= 2) & (c == 4), "name day")
        .when(v("shape").rlike("^9[-./]9[-./]9$") & (a <= 2) & (b <= 2) & (c == 4), "numbers")
    )
    return {"kind": kind}


def _order(v) -> dict[str, Column]:
    """Of two numbers before a year the one above twelve is the day."""
    a, b = v("a").try_cast("int"), v("b").try_cast("int")
    told = F.when((a > 12) & (b <= 12), "day first").when((b > 12) & (a <= 12), "month first").otherwise("either")
    return {"kind": F.when(v("kind") == "numbers", told).otherwise(v("kind"))}


def _made(strict: bool):
    def step(v) -> dict[str, Column]:
        a, b, c, is_ = v("a"), v("b"), v("c"), lambda *kinds: v("kind").isin(*kinds)
        named = lambda x: F.element_at(literal_map(MONTHS), F.lower(x)).cast("string")
        ahead = ["month first"] if strict else ["month first", "either"]
        year = F.when(is_("iso", "year"), a).when(is_("packed"), F.substring(a, 1, 4)).otherwise(c)
        month = F.when(is_("iso", "year", "day first"), b).when(is_("packed"), F.substring(a, 5, 2)).when(is_("day name"), named(b)).when(is_("name day"), named(a)).when(is_(*ahead), a)
        day = F.when(is_("iso", "year"), c).when(is_("packed"), F.substring(a, 7, 2)).when(is_("day name", "day first"), a).when(is_("name day", *ahead), b)
        return {"value": F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")}

    return step


def _told(strict: bool):
    def step(v) -> dict[str, Column]:
        either = F.coalesce(v("kind") == "either", F.lit(False))
        error = F.when(v("text").isNull(), "E_MISSING_DATE").when(either & F.lit(strict), "E_AMBIGUOUS_DATE").when(v("value").isNull(), "E_BAD_DATE")
        alike = F.when(either, "W_DATE_ASSUMED_MDY").when(v("kind") != "iso", "W_DATE_ALT_FORMAT")
        return {"error": error, "warning": F.when(v("value").isNotNull(), alike), "cut": F.when(v("truncated") & v("value").isNotNull() & error.isNull(), F.lit("W_DATE_TRUNCATED"))}

    return step


def date_steps(strict_ambiguous: bool = True) -> list:
    """From text (clean) to value, error, warning and cut (the warning of a cut-off time of day)."""
    head = lambda v: F.substring_index(F.substring_index(v("text"), "T", 1), " ", 1)
    timed = lambda v: v("text").contains("T") | (v("text").contains(" ") & v("text").contains(":"))
    return [
        lambda v: {"head": F.when(timed(v), head(v))},
        lambda v: {"truncated": F.coalesce(v("head").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & (v("head") != v("text")), F.lit(False))},
        lambda v: {"day": F.when(v("truncated"), v("head")).otherwise(v("text"))},
        _tokens, _kind, _order, _made(strict_ambiguous), _told(strict_ambiguous),
    ]


def parse_date(raw: Column, strict_ambiguous: bool = True) -> Column:
    """struct(value, error, truncated, warning): the last two are warning codes."""
    return expressed({"text": clean(raw)}, date_steps(strict_ambiguous), lambda v: F.struct(v("value").alias("value"), v("error").alias("error"), v("cut").alias("truncated"), v("warning").alias("warning")))


def _moment(v) -> dict[str, Column]:
    """Epoch seconds or milliseconds, or ISO 8601; without an offset the time is UTC."""
    number = F.when(v("moment").rlike(_EPOCH), v("moment").try_cast("long"))
    iso = F.when(v("moment").rlike(_ISO_TS), F.regexp_replace(F.translate(v("moment"), ",", "."), "z$", "Z").try_cast("timestamp"))
    return {"number": number, "iso": iso}


def _exact_moment(v) -> dict[str, Column]:
    seconds = F.when(F.abs(v("number")) >= 100_000_000_000, F.floor(v("number") / F.lit(1000).cast("decimal(4,0)")).cast("long")).otherwise(v("number"))
    exact = F.coalesce(F.timestamp_seconds(seconds), v("iso"))
    # What is neither may still be a date.
    return {"exact": exact, "text": F.when(exact.isNull(), v("moment"))}


def timestamp_steps() -> list:
    """From moment (clean) to at and ts_error."""
    end = lambda v: {"at": F.coalesce(v("exact"), v("value").cast("timestamp"))}
    return [_moment, _exact_moment, *date_steps(), end, lambda v: {"ts_error": F.when(v("moment").isNull(), "E_MISSING_EVENT_TS").when(v("at").isNull(), "E_BAD_EVENT_TS")}]


def parse_timestamp(raw: Column) -> Column:
    """struct(value, error): ISO 8601 (no offset: UTC), epoch seconds or milliseconds, or a date."""
    return expressed({"moment": clean(raw)}, timestamp_steps(), lambda v: F.struct(v("at").alias("value"), v("ts_error").alias("error")))


def format_ts(ts: Column) -> Column:
    """UTC text with Z; microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def parse_ts(text: Column) -> Column:
    """The strict inverse of format_ts; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?Z$"), text.try_cast("timestamp"))


def month_of(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("undated"))
