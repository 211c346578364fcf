"""Scalar rules T1-T23 and date ranges."""

import datetime as dt

from pyspark.sql import functions as F

from wrenchflow.functions import dates as D
from wrenchflow.functions.exprs import (falsy_default, hhmm, initials, parse_hhmm, round_half_up, weekday0)
from wrenchflow.operators.quality import validate, vehicle_rules


def test_round_half_up_is_math_round(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (1.0,)], "x double")
    got = [r[0] for r in df.select(round_half_up("x", 0).alias("r")).collect()]
    assert got == [3, -2, 0, 1]


def test_weekday_sunday_zero(spark):
    df = spark.createDataFrame([(dt.date(2001, 7, 15),), (dt.date(2001, 7, 16),)], "d date")
    assert [r[0] for r in df.select(weekday0("d")).collect()] == [0, 1]


def test_time_text_round_trip(spark):
    df = spark.createDataFrame([("08:05",), ("23:59:00",), ("24:00",), ("7:5",)], "t string")
    got = [r[0] for r in df.select(parse_hhmm("t")).collect()]
    assert got == [485, 1439, None, None]
    assert spark.range(1).select(hhmm(F.lit(485))).first()[0] == "08:05"


def test_initials_and_falsy_default(spark):
    df = spark.createDataFrame([("ada  lovelace",), ("x",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(initials("n")).collect()] == ["AL", "X", "", None]
    assert [r[0] for r in df.select(falsy_default("n", "-")).collect()] == ["ada  lovelace", "x", "-", "-"]


def test_report_range_week_across_month_start():
    # T16 fix: the week of 2024-05-01 (a Wednesday) runs Monday 04-29 .. Sunday 05-05
    assert D.report_range("weekly", "2024-05-01") == (dt.date(2024, 4, 29), dt.date(2024, 5, 5))
    assert D.report_range("monthly", "2024-02-10") == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert D.report_range("yearly", "2001-07-15") == (dt.date(2001, 1, 1), dt.date(2001, 12, 31))


def test_insight_range_clamps_month_end():
    s, e, ps, pe = D.insight_range("month", "2001-03-31")
    assert (s, e, ps, pe) == (dt.date(2001, 2, 28), dt.date(2001, 3, 31), dt.date(2001, 1, 28), dt.date(2001, 2, 28))


def test_week_bounds_sunday():
    assert D.week_bounds_sunday("2001-07-18") == (dt.date(2001, 7, 15), dt.date(2001, 7, 21))


def test_vehicle_rules(spark):
    df = spark.createDataFrame(
        [(1, "Make", "M", 2000, "AB 12", "1HGCM82633A004352", 5),
         (2, "", "M", 1800, "ab-1", "VIN123", 0)],
        "id long, make string, model string, year int, license_plate string, vin string, customer_id long")
    got = {r.id: [e.message for e in r.errors] for r in validate(df, vehicle_rules(2002)).collect()}
    assert got[1] == []
    assert got[2] == ["Merk kendaraan tidak boleh kosong", "Tahun kendaraan tidak valid",
                      "Format plat nomor tidak valid", "VIN harus 17 karakter", "Format VIN tidak valid",
                      "ID pelanggan harus valid"]
