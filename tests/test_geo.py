"""Column geodesy against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shuttleplan.functions import geo as G
from shuttleplan.operators import clean


def metres(a, b, radius=6371000.0):
    (p, q), (r, s) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(h))


def crossings(p, poly):
    """Sequential ray test with the nudge that stays."""
    lat, lon = p
    n = 0
    for a, b in zip(poly, poly[1:]):
        if a[1] > b[1]:
            a, b = b, a
        if lon in (a[1], b[1]):
            lon += 0.00001
        if lon > b[1] or lon < a[1] or lat > max(a[0], b[0]):
            continue
        if lat < min(a[0], b[0]):
            n += 1
            continue
        red = (b[1] - a[1]) / (b[0] - a[0]) if abs(a[0] - b[0]) > G.TINY else G.HUGE
        blue = (lon - a[1]) / (lat - a[0]) if abs(a[0] - lat) > G.TINY else G.HUGE
        n += blue >= red
    return n % 2 == 1


POLY = [(0.0, 0.0), (4.0, 1.0), (3.0, 5.0), (-2.0, 4.0), (0.0, 0.0)]


@pytest.mark.parametrize("edges", [None, 4])
def test_polygon_matches_sequential_scan(spark, edges):
    rng = random.Random(5)
    points = [(rng.uniform(-3, 5), rng.uniform(-1, 6)) for _ in range(300)] + [(1.0, 0.0), (1.0, 1.0), (2.0, 5.0), (0.0, 4.0), (9.0, 1.0)]
    df = spark.createDataFrame(points, "lat double, lon double")
    got = [r[0] for r in df.select(G.in_polygon("lat", "lon", G.polygon_literal(POLY), edges)).collect()]
    assert got == [crossings(p, POLY) for p in points]


def test_null_coordinates_are_outside_and_kept_when_negated(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 2.0), (3, 9.0, 2.0)], "id int, lat double, lon double")
    assert [r.in_bounds for r in clean.flag_bounds(df, POLY).orderBy("id").collect()] == [False, True, False]
    assert {r.id for r in clean.box_filter(df, (0, 0), (5, 5)).collect()} == {2}
    assert {r.id for r in clean.box_filter(df, (0, 0), (5, 5), negated=True).collect()} == {1, 3}


def test_destination_and_distance_agree(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-80, 80), rng.uniform(-180, 180), rng.uniform(0, 1e6), rng.uniform(0, 360)) for _ in range(50)]
    df = spark.createDataFrame(rows, "lat double, lon double, m double, h double").withColumn("p", G.destination("lat", "lon", F.col("m"), "h"))
    df = df.withColumn("d", G.distance("lat", "lon", "p.lat", "p.lon")).withColumn("b", G.bearing("lat", "lon", "p.lat", "p.lon"))
    for x in df.collect():
        assert x.d == pytest.approx(x.m, abs=0.01)
        assert x.d == pytest.approx(metres((x.lat, x.lon), (x.p.lat, x.p.lon)), rel=1e-9, abs=1e-3)
        if x.m > 1:
            assert min(abs(x.b - x.h), 360 - abs(x.b - x.h)) < 1e-4


def test_corridor_of_equal_ends(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 2.0)], "lat1 double, lon1 double, lat2 double, lon2 double")
    assert [tuple(p) for p in G.with_corridor(df, 10.0).first().area] == [(1.0, 2.0)] * 4
