"""Exact money: integer minor units, parsed and rendered by native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import expressed, literal_map

# Currencies whose minor unit is not a hundredth.
MINOR_DIGITS = {"JPY": 0, "KRW": 0, "VND": 0, "CLP": 0, "BHD": 3, "KWD": 3, "JOD": 3, "TND": 3}
#: Largest amount in major units, either sign.
MOST_MAJOR = 1_000_000_000_000
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def minor_digits(currency: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(MINOR_DIGITS), F.upper(currency)), F.lit(2))


def _power(currency: Column) -> Column:
    digits = minor_digits(currency)
    return F.when(digits == 0, 1).when(digits == 3, 1000).otherwise(100)


def currency_code(raw: Column, default: str = "USD") -> Column:
    """struct(value, error): three letters in upper case, the default for a blank."""
    text = F.upper(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    blank = text.isNull() | (text == "")
    ok = text.rlike("^[A-Z]{3}$")
    return F.struct(F.when(blank, F.lit(default)).when(ok, text).alias("value"), F.when(~blank & ~ok, F.lit("E_BAD_CURRENCY")).alias("error"))


_PLAIN = r"^[0-9]{1,13}(\.[0-9]{1,9})?$"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _unmarked(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^[$£€¥₹]|[$£€¥₹]$", ""), "(?U)[\\s,_\u00a0\u2009\u202f]", "")


def _negated(x: Column) -> Column:
    return F.when(x.startswith("-"), F.substring(x, 2, 1 << 30)).otherwise(F.concat(F.lit("-"), F.regexp_replace(x, r"^\+", "")))


def _judged(v) -> dict[str, Column]:
    blank = v("raw").isNull() | ~v("raw").rlike(r"(?U)\S")
    big = v("number").isNotNull() & (v("exact").isNull() | (F.abs(v("exact")) > MOST_MAJOR))
    return {
        "scaled": v("exact") * _power(v("currency")).cast("decimal(4,0)"),
        "error": F.when(blank, "E_MISSING_AMOUNT").when(v("number").isNull(), "E_BAD_AMOUNT").when(big, "E_AMOUNT_RANGE"),
    }


#: From raw and currency to minor, error and warning. Parentheses or a trailing minus negate; one currency sign
#: at either end, separators and white space go; half a unit rounds away from zero.
AMOUNT_STEPS = [
    lambda v: {"plain": v("raw").rlike(_PLAIN)},
    lambda v: {"trimmed": F.when(~v("plain"), _trimmed(v("raw")))},
    lambda v: {"bracketed": v("trimmed").rlike(r"(?s)^\(.*\)$")},
    lambda v: {"bare": _unmarked(F.when(v("bracketed"), _trimmed(F.substring(v("trimmed"), F.lit(2), F.length(v("trimmed")) - 2))).otherwise(v("trimmed")))},
    lambda v: {"negative": v("bracketed") | v("bare").rlike("-$"), "unsigned": F.regexp_replace(F.regexp_replace(v("bare"), "-$", ""), r"^\+", "")},
    lambda v: {"number": F.when(v("plain"), v("raw")).when(v("unsigned").rlike(_NUMBER), F.when(v("negative"), _negated(v("unsigned"))).otherwise(v("unsigned")))},
    lambda v: {"exact": v("number").try_cast("decimal(32,18)")},
    _judged,
    lambda v: {"whole": F.when(v("error").isNull(), F.round(v("scaled"), 0))},
    lambda v: {"minor": v("whole").cast("long"), "warning": F.when(v("scaled") != v("whole"), F.lit("W_ROUNDED"))},
]


def parse_amount(raw: Column, currency: Column) -> Column:
    """struct(minor, error, warning)."""
    return expressed({"raw": raw, "currency": currency}, AMOUNT_STEPS, lambda v: F.struct(*(v(n).alias(n) for n in ("minor", "error", "warning"))))


def format_amount(minor: Column, currency: Column) -> Column:
    """Minor units as an exact decimal text."""
    digits, power = minor_digits(currency), _power(currency)
    size = F.abs(minor)
    part = F.pmod(size, power)
    whole = ((size - part).cast("decimal(20,0)") / power.cast("decimal(4,0)"))
    sign = F.when(minor < 0, "-").otherwise("")
    body = F.when(digits == 0, size.cast("string")).otherwise(F.concat(whole.cast("decimal(20,0)").cast("string"), F.lit("."), F.lpad(part.cast("string"), 3, "0").substr(4 - digits, digits)))
    return F.when(minor.isNotNull(), F.concat(sign, body))


def to_decimal(minor: Column, currency: Column) -> Column:
    return (minor.cast("decimal(20,0)") / _power(currency).cast("decimal(4,0)")).cast("decimal(23,3)")
