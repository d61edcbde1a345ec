"""Responses of map services as tables: matrices, directions, geocodes, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shuttleplan.functions.text import scale_to_total

_value = "struct<value:bigint>"
MATRIX = f"struct<rows:array<struct<elements:array<struct<status:string,distance:{_value},duration:{_value},duration_in_traffic:{_value}>>>>>"
DIRECTIONS = f"array<struct<overview_polyline:struct<points:string>,legs:array<struct<distance:{_value},duration:{_value},duration_in_traffic:{_value}>>>>"
GEOCODE = "array<struct<geometry:struct<location:struct<lat:double,lng:double>>>>"
PLACES = "struct<status:string,results:array<struct<name:string,geometry:struct<location:struct<lat:double,lng:double>>,place_id:string,vicinity:string>>>"
#: fixed value: stands for "not reachable" where a number is wanted
SENTINEL = 9223372036854775807


def _traffic_first(x: Column) -> Column:
    return F.coalesce(x["duration_in_traffic"]["value"], x["duration"]["value"])


def matrix_cells(responses: DataFrame, body: str = "body", sentinel: bool = False) -> DataFrame:
    """(other columns, i, j, duration, distance) of every cell; null (or the sentinel) where not OK.

    Absent or empty rows give no cells. Durations take traffic first.
    """
    rest = [c for c in responses.columns if c != body]
    rows = responses.select(*rest, F.posexplode(F.from_json(body, MATRIX)["rows"]).alias("i", "row"))
    cells = rows.select(*rest, "i", F.posexplode("row.elements").alias("j", "cell"))
    x, ok = F.col("cell"), F.coalesce(F.col("cell.status") == "OK", F.lit(False))
    other = F.lit(SENTINEL if sentinel else None).cast("bigint")
    return cells.select(*rest, "i", "j", F.when(ok, _traffic_first(x)).otherwise(other).alias("duration"), F.when(ok, x["distance"]["value"]).otherwise(other).alias("distance"))


def plan_cells(responses: DataFrame, plan: DataFrame, keys: list[str], sentinel: bool = True) -> DataFrame:
    """(keys, src, dst, distance, duration): each source's slice of its batch's matrix.

    ``responses`` has keys, batch, body; ``plan`` is what request_plan gives. Row i of a batch is its
    i-th source, columns down to up are that source's targets.
    """
    order = Window.partitionBy(*keys, "batch").orderBy("src")
    own = plan.withColumn("i", F.row_number().over(order) - 1)
    cells = matrix_cells(responses, sentinel=sentinel)
    joined = cells.join(own, [*keys, "batch", "i"]).where("j >= down and j < up")
    return joined.select(*keys, "src", F.element_at("targets", (F.col("j") - F.col("down") + 1).cast("int")).alias("dst"), "distance", "duration")


def geocode_points(responses: DataFrame, body: str = "body", first: bool = False) -> DataFrame:
    """(other columns, n, lat, lon) of all results, or of the first one only."""
    rest = [c for c in responses.columns if c != body]
    out = responses.select(*rest, F.posexplode(F.from_json(body, GEOCODE)).alias("n", "r"))
    out = out.select(*rest, "n", F.col("r.geometry.location.lat").alias("lat"), F.col("r.geometry.location.lng").alias("lon"))
    return out.where("n = 0") if first else out


def directions(responses: DataFrame, body: str = "body") -> DataFrame:
    """(other columns, alternative, polyline, durations, distances, duration, distance).

    Legs as arrays, traffic first; totals over the legs; the polyline is null where absent.
    """
    rest = [c for c in responses.columns if c != body]
    out = responses.select(*rest, F.posexplode(F.from_json(body, DIRECTIONS)).alias("alternative", "r"))

    def total(x: str) -> Column:
        return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0).cast("bigint")))

    out = out.select(
        *rest, "alternative", F.col("r.overview_polyline.points").alias("polyline"),
        F.transform("r.legs", _traffic_first).alias("durations"), F.transform("r.legs", lambda x: x["distance"]["value"]).alias("distances"),
    )
    return out.withColumns({"duration": total("durations"), "distance": total("distances")})


def traffic_routes(stopovers: DataFrame, via: DataFrame, key: str) -> DataFrame:
    """(key, durations, distances, polyline): legs of the stop-over response scaled to the totals of the via response."""
    a = directions(stopovers).where("alternative = 0").select(key, "durations", "distances")
    b = directions(via).where("alternative = 0").select(key, "polyline", "duration", "distance")
    return a.join(b, key).select(key, scale_to_total("durations", "duration").alias("durations"), scale_to_total("distances", "distance").alias("distances"), "polyline")


def places(responses: DataFrame, body: str = "body") -> DataFrame:
    """(other columns, name, lat, lon, place_id, address) of responses whose status is OK."""
    rest = [c for c in responses.columns if c != body]
    out = responses.withColumn("_b", F.from_json(body, PLACES)).where("_b.status = 'OK'").select(*rest, F.explode("_b.results").alias("r"))
    return out.select(*rest, "r.name", F.col("r.geometry.location.lat").alias("lat"), F.col("r.geometry.location.lng").alias("lon"), "r.place_id", F.col("r.vicinity").alias("address"))


def first_seen(found: DataFrame, batch: str = "batch", address: str = "address") -> DataFrame:
    """Places of the first batch that has their address; duplicates inside one batch stay."""
    return found.withColumn("_first", F.min(batch).over(Window.partitionBy(address))).where(F.col(batch) == F.col("_first")).drop("_first")
