"""Lines and layers: densified routes, polylines, GeoJSON, tables behind map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shuttleplan.functions.geo import distance, section
from shuttleplan.functions.text import distance_text, duration_text

POINTS = "array<struct<lat:double,lon:double>>"


def leg_lengths(points: DataFrame, keys: list[str]) -> DataFrame:
    """Adds leg_m: great-circle metres to the next point of the route, null at its end."""
    order = Window.partitionBy(*keys).orderBy("pos")
    out = points.withColumns({"_lat": F.lead("lat").over(order), "_lon": F.lead("lon").over(order)})
    return out.withColumn("leg_m", distance("lat", "lon", "_lat", "_lon")).drop("_lat", "_lon")


def densify(points: DataFrame, eps: float, keys: list[str]) -> DataFrame:
    """(keys, pos, k, lat, lon): legs longer than ``eps`` get round(d / eps) points between their ends, evenly by degrees."""
    order = Window.partitionBy(*keys).orderBy("pos")
    out = points.withColumns({"_lat": F.lead("lat").over(order), "_lon": F.lead("lon").over(order)})
    d = distance("lat", "lon", "_lat", "_lon")
    out = out.withColumn("_n", F.when(d > eps, F.rint(d / eps) + 1).otherwise(F.lit(1.0)).cast("int"))
    out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)))
    m, n = F.col("k").cast("double"), (F.col("_n") - F.col("k")).cast("double")

    def at(a: str, b: str) -> Column:
        return F.when(F.col("k") == 0, F.col(a)).otherwise(section(a, b, m, n))

    return out.select(*keys, "pos", "k", at("lat", "_lat").alias("lat"), at("lon", "_lon").alias("lon"))


#: characters of a number at most (five bits each), and points summed at once
LETTERS, CHUNK = 13, 64


def _pick(x: Column, i: Column) -> Column:
    return F.get(x, i)


def decode_polyline(text: str | Column) -> Column:
    """Ordered points of an encoded polyline; null for null, for text that ends inside a number or a point, and for longer numbers than 64 bits.

    Characters become groups of five bits; a group below 32 ends a number. Numbers are differences, summed in chunks.
    """
    text = F.col(text) if isinstance(text, str) else text
    codes = F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch) - 63)
    steps = lambda codes, ends: F.transform(
        ends,
        lambda end, k: F.aggregate(
            F.transform(F.slice(codes, F.coalesce(_pick(ends, k - 1), F.lit(-1)) + 2, end - F.coalesce(_pick(ends, k - 1), F.lit(-1))), lambda x, j: F.call_function("shiftleft", x.bitwiseAND(31).cast("bigint"), j * 5)),
            F.lit(0).cast("bigint"),
            lambda a, b: a + b,
        ),
    )
    signed = lambda v: F.when(v % 2 != 0, -F.shiftright(v, 1) - 1).otherwise(F.shiftright(v, 1))

    def sums(d: Column) -> Column:
        total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, b: a + b)
        return _with(
            F.transform(F.sequence(F.lit(0), F.floor(F.size(d) / CHUNK).cast("int")), lambda c: total(F.slice(d, c * CHUNK + 1, CHUNK))),
            lambda chunks: F.transform(d, lambda _, i: total(F.slice(chunks, F.lit(1), F.floor(i / CHUNK).cast("int"))) + total(F.slice(d, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK + 1))),
        )

    def points(codes: Column, ends: Column) -> Column:
        whole = (F.coalesce(_pick(ends, F.size(ends) - 1), F.lit(-1)) == F.size(codes) - 1) & (F.size(ends) % 2 == 0)
        short = ~F.exists(F.transform(ends, lambda e, k: e - F.coalesce(_pick(ends, k - 1), F.lit(-1))), lambda n: n > LETTERS)
        split = lambda v, side: F.filter(v, lambda _, i: i % 2 == side)
        pair = lambda v: F.transform(F.arrays_zip(sums(split(v, 0)).alias("a"), sums(split(v, 1)).alias("b")), lambda p: F.struct((p["a"] / 1e5).alias("lat"), (p["b"] / 1e5).alias("lon")))
        return F.when(whole & short, _with(F.transform(steps(codes, ends), signed), pair))

    ends = lambda codes: F.filter(F.transform(codes, lambda x, i: F.when(x < 32, i)), lambda i: i.isNotNull())
    return _with(codes, lambda c: _with(ends(c), lambda e: points(c, e)))


def _with(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def encode_polyline(points: str | Column) -> Column:
    """Encoded polyline of ordered points; coordinates are cut (not rounded) to five places. Null for null.

    Differences with the sign in the lowest bit, five bits a character from the low end.
    """
    whole = lambda x: (x * F.lit(1e5)).cast("bigint")

    def letters(v: Column) -> Column:
        groups = F.filter(F.sequence(F.lit(0), F.lit(LETTERS - 1)), lambda j: (j == 0) | (F.call_function("shiftright", v, j * 5) > 0))
        more = lambda j: F.when((j < LETTERS - 1) & (F.call_function("shiftright", v, (j + 1) * 5) > 0), 32).otherwise(0)
        return F.array_join(F.transform(groups, lambda j: F.char(F.call_function("shiftright", v, j * 5).bitwiseAND(31) + more(j) + 63)), "")

    def number(now: Column, before: Column) -> Column:
        d = now - F.coalesce(before, F.lit(0))
        return F.when(d < 0, -2 * d - 1).otherwise(2 * d)

    def text(p: Column) -> Column:
        both = lambda x, i: F.concat(*[_with(number(x[c], _pick(p, i - 1)[c]), letters) for c in ("a", "b")])
        return F.array_join(F.transform(p, both), "")

    points = F.col(points) if isinstance(points, str) else points
    return _with(F.transform(points, lambda p: F.struct(whole(p["lat"]).alias("a"), whole(p["lon"]).alias("b"))), text)


def ordered_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, points): a route's points in order of ``pos``."""
    own = F.array_sort(F.collect_list(F.struct("pos", "lat", "lon")))
    return df.groupBy(*keys).agg(F.transform(own, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))


def encode_routes(df: DataFrame, keys: list[str]) -> DataFrame:
    return ordered_points(df, keys).select(*keys, encode_polyline("points").alias("polyline"))


def decode_routes(df: DataFrame, keys: list[str], polyline: str = "polyline") -> DataFrame:
    """(keys, pos, lat, lon)."""
    out = df.select(*keys, F.posexplode(decode_polyline(polyline)).alias("pos", "p"))
    return out.select(*keys, "pos", "p.lat", "p.lon")


def _pairs(points: str) -> Column:
    return F.transform(points, lambda p: F.array(p["lon"], p["lat"]))


def feature(points: str, kind: str = "LineString") -> Column:
    """GeoJSON feature as a struct; coordinates are [lon, lat]."""
    coords = _pairs(points) if kind == "LineString" else F.array(_pairs(points))
    return F.struct(F.lit("Feature").alias("type"), F.create_map().cast("map<string,string>").alias("properties"), F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")).alias("geometry"))


def geojson(routes: DataFrame, keys: list[str], kind: str = "LineString") -> DataFrame:
    """(keys, geojson): one FeatureCollection a route."""
    body = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature("points", kind)).alias("features")))
    return routes.select(*keys, body.alias("geojson"))


def geojson_collection(routes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, geojson): all routes of a key in one FeatureCollection. For large keys write features line by line instead."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(feature("points")).alias("f"))))
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.lit("]}"))
    return routes.groupBy(*keys).agg(own.alias("fs")).select(*keys, body.alias("geojson"))


def geojson_lines(routes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, geojson): one feature a line."""
    return routes.select(*keys, F.to_json(feature("points")).alias("geojson"))


def postal_markers(groups: DataFrame) -> DataFrame:
    return groups.select("lat", "lon", F.concat(F.lit("CP: "), F.col("cp")).alias("title"), F.col("count").alias("people"))


def person_markers(people: DataFrame) -> DataFrame:
    return people.where("has_coords").select("person_id", "lat", "lon", F.concat_ws(" / ", "postal_code", "name", F.col("person_id").cast("string")).alias("title"))


def heat_points(groups: DataFrame) -> DataFrame:
    return groups.select("lat", "lon", F.col("count").cast("double").alias("weight"))


def edge_popups(edges: DataFrame) -> DataFrame:
    """Estimated and road distance and duration as texts."""
    return edges.select(
        "scenario_id", "src", "dst", distance_text(F.rint("dist_est").cast("bigint")).alias("distance_est"), duration_text("dur_est").alias("duration_est"),
        distance_text("dist_road").alias("distance_road"), duration_text("dur_road").alias("duration_road"),
    )


def node_popups(nodes: DataFrame) -> DataFrame:
    return nodes.select("scenario_id", "node_id", F.concat(F.lit("Users: "), F.col("weight").cast("bigint").cast("string")).alias("title"))


def tour_segments(tours: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Start and end of each consecutive pair of a tour, with the edge's estimates and road values."""
    order = Window.partitionBy(*keys, "tour_id").orderBy("pos")
    steps = tours.withColumn("dst", F.lead("node_id").over(order)).where("dst is not null").select(*keys, "tour_id", "pos", F.col("node_id").alias("src"), "dst")
    a = nodes.select(*keys, F.col("node_id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(*keys, F.col("node_id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    out = steps.join(a, [*keys, "src"]).join(b, [*keys, "dst"])
    return out.join(edges.select(*keys, "src", "dst", "dist_est", "dur_est", "dist_road", "dur_road"), [*keys, "src", "dst"], "left")
