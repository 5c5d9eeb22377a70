"""Canonical JSON, content hashes and the hash chain."""

from __future__ import annotations

import hashlib
import json
from datetime import date, datetime, timezone
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A JSON string, or null as text; non-ASCII stays as it is."""
    one = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(one, F.lit(2), F.length(one) - 2))


def number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def json_array(*parts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix and the first hex digits of the SHA-256 of a JSON array of the parts (already JSON)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(json_array(*parts), 256), 1, length))


def to_text(value) -> str:
    """Canonical JSON of plain values: sorted keys, no spaces, times in UTC; floats are refused."""

    def plain(v):
        if isinstance(v, float):
            raise TypeError("floats have no canonical form")
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, (set, frozenset)):
            return sorted(plain(x) for x in v)
        if isinstance(v, datetime):
            v = v.replace(tzinfo=timezone.utc) if v.tzinfo is None else v.astimezone(timezone.utc)
            return v.strftime("%Y-%m-%dT%H:%M:%S") + (f".{v.microsecond:06d}" if v.microsecond else "") + "Z"
        if isinstance(v, date):
            return v.isoformat()
        return str(v) if isinstance(v, Decimal) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def resorted(c: Column) -> Column:
    """JSON text in canonical form, through Arrow: only where the bytes are hashed."""

    @F.pandas_udf("string")
    def canonical(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else to_text(json.loads(x)))

    return canonical(c)


def chain_hash(previous: str, body: str) -> str:
    return hashlib.sha256(previous.encode() + b"\x1f" + body.encode()).hexdigest()


def chained(previous: Column, body: Column) -> Column:
    """chain_hash as an expression."""
    return F.sha2(F.concat(previous.cast("binary"), F.unhex(F.lit("1F")), body.cast("binary")), 256)
