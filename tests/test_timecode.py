"""Clock strings: the vectors that parsers and formatters are known by, and the cases around them."""

import pytest
from pyspark.sql import functions as F

from reelspan.functions import timecode as tc


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


STRICT = {
    "00:00:10": 10000, "01:00:00": 3600000, "00:01:30": 90000, "00:00:10.5": 10500, "00:00:10.500": 10500, "00:00:10.05": 10050, "00:00:60": 60000, "00:00:90": 90000,
    "00:60:00": 3600000, ".500": 500, "00:00:01500": 1500, "": None, "abc": None, "-10:00": None, "1:2:3:4": None, " 0 1 : 02 ": 62000, "5": 5000, "10,5": None, "1:500": 1500,
    "01:02.1234": 62123, "01:02.x": 62000, "-1:70": 10000, "+1:00": 60000, "1:02:99999": None, "1:.5": None,
}


def test_strict(spark):
    rows = spark.createDataFrame([(k,) for k in STRICT], "ts string").select("ts", tc.strict_ms(F.col("ts")).alias("ms")).collect()
    want = STRICT | {"1:02:99999": 3720000 + 99000 + 999}
    assert {r["ts"]: r["ms"] for r in rows} == want


@pytest.mark.parametrize("ts, ms", [("01:02:03", 3723000), ("02:03.5", 123500), ("4.25", 4250), ("1e1x", 10000), ("x", None), ("1:2:3:4", 1000), (" 7", 7000)])
def test_lenient(spark, ts, ms):
    assert one(spark, tc.lenient_ms(F.lit(ts))) == ms


@pytest.mark.parametrize("ms, clock, minutes", [(0, "00:00.000", "00:00.000"), (61500, "01:01.500", "01:01.500"), (3600000, "01:00:00.000", "60:00.000"), (12346, "00:12.346", "00:12.346"), (360000000, "100:00:00.000", "6000:00.000"), (-1, None, None)])
def test_formats(spark, ms, clock, minutes):
    assert one(spark, tc.clock(F.lit(ms).cast("long"))) == clock
    assert one(spark, tc.minutes_clock(F.lit(ms).cast("long"))) == minutes


@pytest.mark.parametrize("ts, out", [("1:2.5", "00:01:02,500"), ("7", "00:00:07,000"), ("1:02:03,4567", "01:02:03,456"), ("9:1:02:03", "01:02:03,000"), ("100:00:01", "100:00:01,000"), ("1:90.", "00:01:90,000")])
def test_subtitle_clock(spark, ts, out):
    assert one(spark, tc.subtitle_clock(F.lit(ts), ",")) == out
