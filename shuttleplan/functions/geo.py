"""Geodesy and angles as Column expressions. Points are (lat, lon) in degrees; arrays hold struct<lat,lon>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: metres for distances and destinations, and for radius predicates
EARTH, EARTH_RADIUS_SEARCH = 6371000.0, 6371008.8
#: fixed values of the ray test
NUDGE, HUGE, TINY = 0.00001, 1.7976931348623157e308, 2.2250738585072014e-308

Col = Column | str


def c(x: Col | float) -> Column:
    """A column by name, a literal from a number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def point(lat: Col | float, lon: Col | float) -> Column:
    return F.struct(c(lat).alias("lat"), c(lon).alias("lon"))


def distance(lat1: Col, lon1: Col, lat2: Col, lon2: Col, radius: float = EARTH) -> Column:
    """Great-circle metres."""
    lat1, lon1, lat2, lon2 = c(lat1), c(lon1), c(lat2), c(lon2)
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def to_radians(metres: Col | float) -> Column:
    """Metres on the sphere of radius predicates as an angle."""
    return c(metres) / F.lit(EARTH_RADIUS_SEARCH)


def to_metres(angle: Col | float) -> Column:
    return c(angle) * F.lit(EARTH_RADIUS_SEARCH)


def squared_degrees(lat1: Col, lon1: Col, lat2: Col, lon2: Col) -> Column:
    a, b = c(lat1) - c(lat2), c(lon1) - c(lon2)
    return a * a + b * b


def euclidean(x1: Col, y1: Col, x2: Col, y2: Col) -> Column:
    return F.sqrt(squared_degrees(x1, y1, x2, y2))


def wrap360(degrees: Col) -> Column:
    return F.pmod(c(degrees), F.lit(360.0))


def same_point(lat1: Col, lon1: Col, lat2: Col, lon2: Col) -> Column:
    return (c(lat1) == c(lat2)) & (c(lon1) == c(lon2))


def bearing(lat1: Col, lon1: Col, lat2: Col, lon2: Col) -> Column:
    """Initial bearing in [0, 360); null for equal points."""
    p1, p2, dl = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2) - c(lon1))
    b = F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)))
    return F.when(~same_point(lat1, lon1, lat2, lon2), wrap360(b))


def angle_between(x1: Col, y1: Col, x2: Col, y2: Col) -> Column:
    """Degrees between two vectors, the cosine rounded to 5 places; 90 where x1 equals y1."""
    x1, y1, x2, y2 = c(x1), c(y1), c(x2), c(y2)
    cosine = F.try_divide(x1 * x2 + y1 * y2, F.sqrt(x1 * x1 + y1 * y1) * F.sqrt(x2 * x2 + y2 * y2))
    return F.when(x1 == y1, F.lit(90.0)).otherwise(F.acos(F.bround(cosine, 5)) * F.lit(180.0) / F.pi())


def headings_differ(a1: Col, a2: Col, limit: Col | float) -> Column:
    """Is the circular difference of two headings larger than the limit."""
    return 180 - F.abs(F.abs(c(a1) - c(a2)) - 180) > c(limit)


def n_vector(lat: Col, lon: Col) -> Column:
    p, l = F.radians(c(lat)), F.radians(c(lon))
    return F.struct((F.cos(p) * F.cos(l)).alias("x"), (F.cos(p) * F.sin(l)).alias("y"), F.sin(p).alias("z"))


def from_n_vector(v: Col) -> Column:
    x, y, z = (c(v)[k] for k in "xyz")
    return point(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x)))


def pole_of_bearing(lat: Col, lon: Col, heading: Col) -> Column:
    """Pole of the great circle through a point on a heading."""
    p, l, a = F.radians(c(lat)), F.radians(c(lon)), F.radians(c(heading))
    return F.struct(
        (F.sin(l) * F.cos(a) - F.sin(p) * F.cos(l) * F.sin(a)).alias("x"),
        (-F.cos(l) * F.cos(a) - F.sin(p) * F.sin(l) * F.sin(a)).alias("y"),
        (F.cos(p) * F.sin(a)).alias("z"),
    )


def unit(v: Col) -> Column:
    x, y, z = (c(v)[k] for k in "xyz")
    n = F.sqrt(x * x + y * y + z * z)
    return F.struct(F.try_divide(x, n).alias("x"), F.try_divide(y, n).alias("y"), F.try_divide(z, n).alias("z"))


def pole_of_points(lat1: Col, lon1: Col, lat2: Col, lon2: Col) -> Column:
    a, b = n_vector(lat1, lon1), n_vector(lat2, lon2)
    cross = F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))
    return unit(cross)


def destination(lat: Col, lon: Col, metres: Col | float, heading: Col | float, radius: float = EARTH) -> Column:
    """Point reached from (lat, lon) after ``metres`` (negative: backwards) on the heading."""
    p, l, d, t = F.radians(c(lat)), F.radians(c(lon)), c(metres) / F.lit(radius), F.radians(c(heading))
    x = F.cos(p) * F.cos(l) * F.cos(d) + (-F.sin(l) * F.sin(t) - F.sin(p) * F.cos(l) * F.cos(t)) * F.sin(d)
    y = F.cos(p) * F.sin(l) * F.cos(d) + (F.cos(l) * F.sin(t) - F.sin(p) * F.sin(l) * F.cos(t)) * F.sin(d)
    z = F.sin(p) * F.cos(d) + F.cos(p) * F.cos(t) * F.sin(d)
    return point(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x)))


def linear_map(x: Col, in_min: float, in_max: float, out_min: float, out_max: float) -> Column:
    return (c(x) - in_min) * (out_max - out_min) / (in_max - in_min) + out_min


def _corners(df: DataFrame, ends: tuple[float, float], half_width: Column, order: str, out: str) -> DataFrame:
    """Polygon round the segment (lat1, lon1) - (lat2, lon2), built column by column so that no expression repeats another."""
    df = df.withColumn("_b", bearing("lat1", "lon1", "lat2", "lon2")).withColumn("_w", half_width)
    df = df.withColumns({"_side": wrap360(F.col("_b") - 90), "p1": destination("lat1", "lon1", ends[0], "_b"), "p2": destination("lat2", "lon2", ends[1], "_b")})
    df = df.withColumns({f"_{k}{x}": F.col(f"{k}.{x}") for k in ("p1", "p2") for x in ("lat", "lon")})
    turns = {"c1": ("p1", 1), "c2": ("p1", -1), "c3": ("p2", -1), "c4": ("p2", 1)}
    df = df.withColumns({k: destination(f"_{p}lat", f"_{p}lon", F.col("_w") * F.lit(float(s)), "_side") for k, (p, s) in turns.items()})
    a = point("lat1", "lon1")
    df = df.withColumn(out, F.when(F.col("_b").isNull(), F.array(a, a, a, a)).otherwise(F.array(*[F.col(k) for k in order.split()])))
    return df.drop("_b", "_w", "_side", "p1", "p2", *turns, *[f"_{k}{x}" for k in ("p1", "p2") for x in ("lat", "lon")])


def with_corridor(df: DataFrame, delta: float, share: float = 1.0, out: str = "area") -> DataFrame:
    """Adds a closed polygon round the segment: ``delta`` metres beyond both ends, a ``share``-th of its length to both sides.

    Four copies of the start where both ends agree.
    """
    return _corners(df, (-delta, delta), distance("lat1", "lon1", "lat2", "lon2") / share, "p1 c1 c4 p2 c3 c2 p1", out)


def with_rectangle(df: DataFrame, out: str = "area") -> DataFrame:
    """Adds a closed rectangle round the segment; both ends shift 10 m on the bearing."""
    d = distance("lat1", "lon1", "lat2", "lon2")
    return _corners(df, (10.0, 10.0), F.try_divide(d, linear_map(d, 5000, 50000, 3, 15)), "c1 c2 c3 c4 c1", out)


def section(a: Col, b: Col, m: Col, n: Col) -> Column:
    """Internal division of a scalar segment in the ratio m : n."""
    return (c(n) * c(a) + c(m) * c(b)) / (c(m) + c(n))


def travel_time(metres: Col, factor: float = 0.2) -> Column:
    return F.lit(factor) * c(metres)


def in_box(lat: Col, lon: Col, south_west: tuple[float, float], north_east: tuple[float, float]) -> Column:
    """Strictly inside; false for null."""
    lat, lon = c(lat), c(lon)
    inside = (lat > south_west[0]) & (lat < north_east[0]) & (lon > south_west[1]) & (lon < north_east[1])
    return F.coalesce(inside, F.lit(False))


def polygon_literal(points: list[tuple[float, float]]) -> Column:
    return F.array(*[point(float(a), float(b)) for a, b in points])


def crossing(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """Struct (lon, hit) of the ray test of one edge: lon carries the nudge that later edges see."""
    left, right = F.when(a["lon"] > b["lon"], b).otherwise(a), F.when(a["lon"] > b["lon"], a).otherwise(b)
    x = F.when((lon == left["lon"]) | (lon == right["lon"]), lon + NUDGE).otherwise(lon)

    def slope(d_lon: Column, d_lat: Column, off: Column) -> Column:
        return F.when(F.abs(off) > TINY, F.try_divide(d_lon, d_lat)).otherwise(F.lit(HUGE))

    red = slope(right["lon"] - left["lon"], right["lat"] - left["lat"], left["lat"] - right["lat"])
    blue = slope(x - left["lon"], lat - left["lat"], left["lat"] - lat)
    outside = (x > right["lon"]) | (x < left["lon"]) | (lat > F.greatest(left["lat"], right["lat"]))
    hit = F.when(outside, F.lit(False)).when(lat < F.least(left["lat"], right["lat"]), F.lit(True)).otherwise(blue >= red)
    return F.struct(x.alias("lon"), hit.alias("hit"))


def _above(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """The ray test of one edge for a longitude that no vertex has, as 0 or 1."""
    low, high = F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])
    # at such a longitude the edge is crossed where it passes above the point
    slope = F.try_divide(b["lat"] - a["lat"], b["lon"] - a["lon"])
    hit = (lon > low) & (lon < high) & (lat <= a["lat"] + (lon - a["lon"]) * slope)
    return F.when(hit, 1).otherwise(0)


def in_polygon(lat: Col, lon: Col, polygon: Col, edges: int | None = None) -> Column:
    """Odd number of crossings; false for null coordinates. The polygon is closed.

    With the number of ``edges`` known, points whose longitude no vertex has (nearly all) are tested
    by plain expressions that compile; the others, and polygons of any size, edge after edge, as a
    nudge to the longitude carries over from edge to edge.
    """
    lat, lon, poly = c(lat), c(lon), c(polygon)
    start = F.struct(lon.alias("lon"), F.lit(0).alias("n"))

    def step(acc: Column, i: Column) -> Column:
        got = crossing(lat, acc["lon"], F.element_at(poly, i), F.element_at(poly, i + 1))
        return F.struct(got["lon"].alias("lon"), (acc["n"] + got["hit"].cast("int")).alias("n"))

    odd = F.aggregate(F.when(F.size(poly) > 1, F.sequence(F.lit(1), F.size(poly) - 1)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["n"] % 2 == 1)
    if edges:
        points = [F.get(poly, F.lit(i)) for i in range(edges + 1)]
        off = lon != points[0]["lon"]
        for p in points[1:]:
            off = off & (lon != p["lon"])
        hits = sum((_above(lat, lon, a, b) for a, b in zip(points[1:-1], points[2:], strict=True)), _above(lat, lon, points[0], points[1]))
        odd = F.when(off & (F.size(poly) == edges + 1), hits % 2 == 1).otherwise(odd)
    return F.coalesce(F.when(lat.isNotNull() & lon.isNotNull(), odd), F.lit(False))
