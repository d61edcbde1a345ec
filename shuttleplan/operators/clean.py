"""Headcount cleaning: postal codes, geocoding, bounds, counts per code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shuttleplan.functions.geo import in_box, in_polygon, polygon_literal


def flag_postal_code(df: DataFrame, code: str = "postal_code") -> DataFrame:
    """Adds good_zip_code: exactly five digits; false for null."""
    return df.withColumn("good_zip_code", F.coalesce(F.col(code).rlike("^[0-9]{5}$"), F.lit(False)))


def padded_code(code: str = "cp") -> Column:
    """Four characters get a leading zero; other lengths stay."""
    return F.when(F.length(code) == 4, F.concat(F.lit("0"), F.col(code))).otherwise(F.col(code))


def first_per_code(directory: DataFrame) -> DataFrame:
    """First directory row (least idx) of each padded code; combines before its shuffle."""
    padded = directory.withColumn("cp", padded_code()).where("cp is not null")
    row = F.struct("idx", "lat", "lon", "address")
    return padded.groupBy("cp").agg(F.min_by(row, "idx").alias("r")).select("cp", "r.idx", "r.lat", "r.lon", "r.address")


def geocode(people: DataFrame, directory: DataFrame, code: str = "postal_code") -> DataFrame:
    """Left join of people to the first directory row of their code; adds has_coords.

    The directory is small by nature (one row a code), but no hint forces a broadcast: Spark decides
    from its measured size. Null codes match nothing and are kept apart from the join's keys.
    """
    first = first_per_code(directory).drop("idx")
    joined = people.where(F.col(code).isNotNull()).join(first, F.col(code) == F.col("cp"), "left")
    rest = people.where(F.col(code).isNull())
    for f in first.schema:
        rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
    return joined.unionByName(rest).withColumn("has_coords", F.col("lat").isNotNull())


def flag_bounds(df: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Adds in_bounds; a bounding box goes before the polygon test, null coordinates are outside."""
    lats, lons = [p[0] for p in polygon], [p[1] for p in polygon]
    near = in_box("lat", "lon", (min(lats) - 1e-4, min(lons) - 1e-4), (max(lats) + 1e-4, max(lons) + 1e-4))
    return df.withColumn("in_bounds", F.when(near, in_polygon("lat", "lon", polygon_literal(polygon), edges=len(polygon) - 1)).otherwise(F.lit(False)))


def flag_bounds_by_key(df: DataFrame, boundaries: DataFrame, key: str = "scenario_id") -> DataFrame:
    """As flag_bounds with a polygon per key (columns key, polygon); keys without one are outside."""
    joined = df.join(boundaries.select(key, F.col("polygon").alias("_polygon")), key, "left")
    return joined.withColumn("in_bounds", F.coalesce(in_polygon("lat", "lon", "_polygon"), F.lit(False))).drop("_polygon")


def box_filter(df: DataFrame, south_west: tuple[float, float], north_east: tuple[float, float], negated: bool = False) -> DataFrame:
    """Rows strictly inside the box; negated keeps the others, null coordinates among them."""
    m = in_box("lat", "lon", south_west, north_east)
    return df.where(~m if negated else m)


def group_postal_codes(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """People per (cp, lat, lon, address); rows with any null key are left out."""
    keys = [*(by or []), "cp", "lat", "lon", "address"]
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("count"))
