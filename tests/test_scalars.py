import datetime as dt

import pytest
from pyspark.sql import functions as F

from contrail.functions import scalars as S


def one(spark, expr, value, typ):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("num,den,digits,want", [
    (1, 8, 2, 0.13), (-1, 8, 2, -0.13), (201, 200, 2, 1.01), (5, 2, 0, 3.0), (-5, 2, 0, -3.0),
    (1, 3, 2, 0.33), (0, 7, 1, 0.0), (10, 0, 2, None)])
def test_ratio_half_up_ties_go_away_from_zero(spark, num, den, digits, want):
    df = spark.createDataFrame([(num, den)], "n long, d long")
    assert df.select(S.ratio_half_up("n", "d", digits).alias("o")).first()["o"] == want


@pytest.mark.parametrize("raw,want", [("5", 5), ("905", 545), ("905.0", 545), ("2400", None),
                                      ("2359", 1439), ("0", 0), ("12345", None), ("1260", None),
                                      (None, None), ("abc", None)])
def test_hhmm_to_minutes(spark, raw, want):
    assert one(spark, S.hhmm_to_minutes, raw, "string") == want


@pytest.mark.parametrize("raw,want", [("12", 12), ("12.0", 12), ("12.5", None), ("", None),
                                      (None, None), ("-3.0", -3)])
def test_to_nullable_int(spark, raw, want):
    assert one(spark, S.to_nullable_int, raw, "string") == want


@pytest.mark.parametrize("raw,default,want", [("1.00", False, True), ("0.00", True, False),
                                              (None, False, False), (None, True, True),
                                              ("true", False, True)])
def test_to_bool_default(spark, raw, default, want):
    assert one(spark, lambda c: S.to_bool(c, default), raw, "string") == want


def test_pg_day_of_week_sunday_is_zero(spark):
    assert one(spark, S.pg_day_of_week, dt.date(2024, 1, 7), "date") == 0
    assert one(spark, S.pg_day_of_week, dt.date(2024, 1, 8), "date") == 1


def test_risk_tier_and_month_and_route(spark):
    df = spark.createDataFrame([(0.29, 3, "A", "B"), (0.3, 12, None, "B"), (0.6, 1, "C", "D")],
                               "p double, m int, o string, d string")
    out = df.select(S.risk_tier("p").alias("t"), S.month_abbr("m").alias("mn"),
                    S.route_label("o", "d").alias("r")).collect()
    assert [r.t for r in out] == ["LOW RISK", "MEDIUM RISK", "HIGH RISK"]
    assert [r.mn for r in out] == ["Mar", "Dec", "Jan"]
    assert [r.r for r in out] == ["A → B", None, "C → D"]


def test_clip_and_oktas(spark):
    df = spark.createDataFrame([(-50.0, 50.0), (300.0, 100.0)], "d double, c double")
    out = df.select(S.clip("d", -30, 180).alias("x"), S.oktas("c").alias("k")).collect()
    assert [r.x for r in out] == [-30.0, 180.0]
    assert [r.k for r in out] == [4.0, 8.0]
