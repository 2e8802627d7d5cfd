"""Formulas against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from netloom.functions import scalar, vdf


def one(spark, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))


def value(spark, expression, **columns):
    return one(spark, x=0, **columns).select(expression.alias("v")).first().v


BASE = dict(fftt=20.0, vf=100.0, vc=85.0, capacity=4000.0, lanes=1.0, hours=1.0, start_hour=7.0, end_hour=8.0, **vdf.DEFAULTS)


def test_bpr(spark):
    r = vdf.bpr(one(spark, volume=5000.0, **BASE)).first()
    assert r.bpr_min == pytest.approx(27.32421875) and r.bpr_speed == pytest.approx(73.19514, abs=1e-5)


@pytest.mark.parametrize(
    "volume, want",
    [
        (2000.0, dict(q_speed=94.456403, q_min=20.441176, p=0.0625, vt2=82.058648, co2=6.988171)),
        (5000.0, dict(q_speed=60.063199, q_min=32.14614, p=1.25, vt2=48.652191, mu=4000.0, gamma=877.4175, co2=8.023765)),
    ],
)
def test_qvdf(spark, volume, want):
    df = vdf.qvdf(one(spark, volume=volume, **{**BASE, "vf": 96.54, "vc": 82.059}))
    rate = F.array(*map(F.lit, (20785.99541, 0.0002, 0.0042, 0.3412)))
    r = df.withColumn("co2", vdf.emission_kg(F.col("q_min"), F.col("fftt"), F.col("vf"), rate)).first()
    for k, v in want.items():
        assert r[k] == pytest.approx(v, rel=2e-6)


def test_qvdf_profile(spark):
    df = vdf.qvdf(one(spark, volume=5000.0, link_id=1, **{**BASE, "vf": 96.54, "vc": 82.059}))
    got = [r.speed for r in vdf.qvdf_profile(df, ["link_id"]).orderBy("minute").collect()]
    half = [75.3534, 67.7095, 60.7136, 55.2773, 51.5297, 49.3603, 48.6522]
    assert got == pytest.approx(half + half[-2::-1], abs=1e-3)


def test_few_lanes_count_with_the_capacity(spark):
    df = one(spark, volume=500.0, **{**BASE, "lanes": 0.5})
    assert vdf.bpr(df).first().doc == pytest.approx(500 / 2000)


def test_time_codes(spark):
    start, end = scalar.period_to_min(F.lit("0700_0800"))
    assert (value(spark, start), value(spark, end)) == (420, 480)
    assert value(spark, scalar.time_to_min(F.lit("010615"))) == 1440 + 375
    assert value(spark, scalar.time_to_min(F.lit("0730:30"))) == 450.5
    assert value(spark, scalar.min_to_time(F.lit(420.0))) == "0700:00.000"
    assert value(spark, scalar.min_to_time(F.lit(61.5))) == "0101:30.000"


def test_geometry(spark):
    lit = F.lit
    got = value(spark, scalar.haversine_m(lit(-90.0), lit(40.0), lit(-89.0), lit(40.0)))
    a = math.cos(math.radians(40)) ** 2 * math.sin(math.radians(0.5)) ** 2
    assert got == pytest.approx(2 * math.asin(math.sqrt(a)) * scalar.EARTH_RADIUS_M)
    assert value(spark, scalar.bearing_deg(lit(0.0), lit(0.0), lit(0.0), lit(2.0))) == 90
    assert value(spark, scalar.turn_deg(lit(350.0), lit(10.0))) == 20
    assert value(spark, scalar.point_line_distance(lit(0.0), lit(3.0), lit(-1.0), lit(0.0), lit(1.0), lit(0.0))) == 3
    assert value(spark, scalar.segments_cross(*map(lit, (0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 2.0, 0.0))))
    assert not value(spark, scalar.segments_cross(*map(lit, (0.0, 0.0, 1.0, 1.0, 3.0, 0.0, 3.0, 1.0))))


def test_text(spark):
    assert value(spark, scalar.split_numbers(F.lit("1;2; 3;"), "long")) == [1, 2, 3]
    for uses, want in (("", True), (None, True), ("null", True), ("all", True), ("auto;hov", True), ("hov", False)):
        assert value(spark, scalar.allow_mode(F.lit(uses).cast("string"), F.lit("auto"))) is want
    wkt = F.lit("POLYGON((0 0, 1 0, 1 2, 0 0))")
    assert [(p.x, p.y) for p in value(spark, scalar.wkt_points(wkt))] == [(0, 0), (1, 0), (1, 2), (0, 0)]
    assert value(spark, scalar.wkt_kind(wkt)) == "POLYGON"
    assert value(spark, scalar.cell_code(F.lit(0.55), F.lit(0.5), 0.1, F.lit(0.0), F.lit(1.0))) == "F5"


def test_s3_inverts(spark):
    lit = F.lit
    flow = value(spark, vdf.s3_volume(lit(70.0), lit(100.0), lit(45.0), lit(4.0)))
    assert flow > 0
    assert value(spark, vdf.s3_speed(lit(flow), lit(100.0), lit(45.0), lit(4.0), lit(70.0))) == pytest.approx(70, rel=1e-6)
