import pytest
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT, Rules
from ledgerloom.errors import RulesError
from ledgerloom.functions import canon, dates, money
from ledgerloom.functions.text import clean

AMOUNTS = [
    ("(12.50)", "USD", -1250, None, None), ("1,234.5", "USD", 123450, None, None), ("12.345", "USD", 1235, None, "W_ROUNDED"), ("5-", "USD", -500, None, None),
    ("-$5.00", "USD", None, "E_BAD_AMOUNT", None), ("$-5.00", "USD", -500, None, None), ("(-5)", "USD", 500, None, None), ("1.234,56", "USD", 123, None, "W_ROUNDED"), ("1500", "JPY", 1500, None, None),
    ("1.2345", "KWD", 1235, None, "W_ROUNDED"), ("NaN", "USD", None, "E_BAD_AMOUNT", None), (" ", "USD", None, "E_MISSING_AMOUNT", None), ("1000000000001", "USD", None, "E_AMOUNT_RANGE", None), ("1 000", "USD", 100000, None, None),
]


def test_amounts(spark):
    df = spark.createDataFrame([(i, a, c) for i, (a, c, *_) in enumerate(AMOUNTS)], "i int, a string, c string")
    got = [tuple(r.p) for r in df.select("i", money.parse_amount(F.col("a"), F.col("c")).alias("p")).orderBy("i").collect()]
    assert got == [x[2:] for x in AMOUNTS]


def test_amounts_render(spark):
    df = spark.createDataFrame([(-5, "USD"), (1235, "KWD"), (-1500, "JPY"), (None, "USD"), (10**15, "KWD")], "m long, c string")
    assert [r[0] for r in df.select(money.format_amount(F.col("m"), F.col("c"))).collect()] == ["-0.05", "1.235", "-1500", None, "1000000000000.000"]


@pytest.mark.parametrize("text,want,error", [
    ("2024-3-5", "2024-03-05", None), ("25/03/2024", "2024-03-25", None), ("03/25/2024", "2024-03-25", None), ("03/04/2024", None, "E_AMBIGUOUS_DATE"), ("2024-02-30", None, "E_BAD_DATE"),
    ("05-Mar-2024", "2024-03-05", None), ("March 5, 2024", "2024-03-05", None), ("20240305", "2024-03-05", None), ("5 Foo 2024", None, "E_BAD_DATE"), ("n/a", None, "E_MISSING_DATE"),
])
def test_dates(spark, text, want, error):
    r = spark.createDataFrame([(text,)], "t string").select(dates.parse_date(F.col("t")).alias("d")).first().d
    assert (str(r.value) if r.value else None, r.error) == (want, error)


def test_timestamps(spark):
    texts = ["1709632800", "1709632800123", "2024-03-05T12:00:00+02:00", "2024-03-05 10:00:00", "2024-03-05T10:00:00.5Z", "nope"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.format_ts(dates.parse_timestamp(F.col("t"))["value"]).alias("f"))
    assert [r.f for r in df.collect()] == ["2024-03-05T10:00:00Z"] * 4 + ["2024-03-05T10:00:00.500000Z", None]


def test_clean(spark):
    df = spark.createDataFrame([(" a   b ",), ("N/A",), ("--",), (None,), ("#n/a",)], "t string")
    assert [r[0] for r in df.select(clean(F.col("t"))).collect()] == ["a b", None, None, None, None]


def test_canonical_json():
    assert canon.to_text({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'
    with pytest.raises(TypeError):
        canon.to_text({"a": 1.5})


def test_rules():
    assert DEFAULT.authority("user_edit", "premium") == 110 and DEFAULT.authority("bank_sync", "premium") == 10
    assert Rules.from_dict(DEFAULT.to_dict()).fingerprint() == DEFAULT.fingerprint() != DEFAULT.with_(default_currency="EUR").fingerprint()
    with pytest.raises(RulesError):
        DEFAULT.with_(nonsense=1)
    with pytest.raises(RulesError):
        Rules(default_role="nobody")
