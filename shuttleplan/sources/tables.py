"""Readers of the input files and stores of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuttleplan.functions.scratch import materialize
from shuttleplan.functions.text import clock_minutes

DIRECTORY = "idx bigint, cp string, lat string, lon string, address string"
ROUTES = "route_id bigint, stops array<struct<coords:array<double>>>"
TIMETABLE = "idx int, departure string, duration string, arrival string"


def read_headcount(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def as_text(df: DataFrame) -> DataFrame:
    """A headcount table whatever its types: every column as text."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def type_directory(df: DataFrame) -> DataFrame:
    """Coordinates as doubles; malformed ones and NaN become null."""
    def number(c: str):
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x), x).alias(c)

    return df.select(F.col("idx").cast("bigint").alias("idx"), F.col("cp").cast("string").alias("cp"), number("lat"), number("lon"), "address")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return type_directory(spark.read.csv(path, header=True, schema=DIRECTORY))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True, schema=ROUTES)


def parse_routes(texts: DataFrame, column: str = "body") -> DataFrame:
    """Routes from JSON texts, for routes that stand in a table."""
    return texts.select(F.from_json(column, f"struct<{ROUTES.replace(' bigint', ':bigint', 1).replace(', stops ', ',stops:')}>").alias("r")).select("r.*")


def read_timetable(spark: SparkSession, path: str) -> DataFrame:
    """Timetables of either header spelling, by position; adds the file's name and minutes."""
    return with_minutes(spark.read.csv(path, header=True, schema=TIMETABLE, enforceSchema=True).withColumn("file", F.col("_metadata.file_name")))


def with_minutes(df: DataFrame) -> DataFrame:
    """Adds departure_min, duration_min, and the arrival a day's clock would show."""
    out = df.withColumns({"departure_min": clock_minutes("departure"), "duration_min": clock_minutes("duration")})
    return out.withColumn("arrival_min", (F.col("departure_min") + F.col("duration_min")) % 1440)


def append_groups(groups: DataFrame, path: str, upload: str | None = None) -> None:
    """One row a postal group, by scenario and upload; a second upload adds its rows again.

    ``upload`` names the upload: repeated under the same name (a retried job, a replayed batch) it replaces what it wrote
    before, so nothing is added twice. Without a name every call is an upload of its own.
    """
    own = groups.withColumn("upload", F.lit(upload or uuid.uuid4().hex))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scenario_id", "upload").parquet(path)


def replace_groups(groups: DataFrame, path: str, upload: str | None = None) -> None:
    """As append_groups, but the scenarios at hand replace what they had."""
    spark, upload = groups.sparkSession, upload or uuid.uuid4().hex
    mine = materialize(groups)
    append_groups(mine, path, upload)
    # earlier uploads of these scenarios go once the new one is stored
    old = read_groups(spark, path).where(F.col("upload") != upload).join(mine.select("scenario_id").distinct(), "scenario_id", "left_semi")
    _drop_partitions(spark, path, materialize(old.select("scenario_id", "upload").distinct()))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """All groups of a store, with scenario_id and upload as written."""
    kinds = spark.read.parquet(path)
    return kinds.withColumns({"scenario_id": F.col("scenario_id").cast("int"), "upload": F.col("upload").cast("string")})


def _drop_partitions(spark: SparkSession, path: str, parts: DataFrame) -> None:
    """Delete the folders of the (scenario_id, upload) partitions of a written table; they come one after another."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in parts.toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/scenario_id={r['scenario_id']}/upload={r['upload']}")
        folder.getFileSystem(conf).delete(folder, True)


def remove_groups(spark: SparkSession, path: str, ids: DataFrame, key: str) -> int:
    """Remove the rows of a store whose ``key`` is listed; returns how many partitions changed.

    Only partitions that hold a listed id are read whole and written anew, the others keep their files; a partition of
    which nothing is left goes. Removing the same ids again changes nothing.
    """
    store, listed = read_groups(spark, path), materialize(ids.select(key).distinct())
    where = ["scenario_id", "upload"]
    hit = materialize(store.join(listed, key, "left_semi").select(*where).distinct())
    if hit.isEmpty():
        return 0
    # written aside first, as a partition can't be read while it is overwritten
    rest = materialize(store.join(hit, where, "left_semi").join(listed, key, "left_anti").select(*store.columns))
    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*where).parquet(path)
    _drop_partitions(spark, path, materialize(hit.join(rest.select(*where).distinct(), where, "left_anti")))
    return hit.count()


def register_map(row: DataFrame, path: str) -> None:
    """Append a map (country, city, url, user) with its times; cities are partitions."""
    row.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}).write.mode("append").partitionBy("city").parquet(path)


def maps_of_city(maps: DataFrame, city: str) -> DataFrame:
    return maps.where(F.col("city") == city)


def map_by_id(maps: DataFrame, map_id: int) -> DataFrame:
    return maps.where(F.col("map_id") == map_id)


def remove_by_id(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The table without the listed ids; rows with a null id stay."""
    return table.join(ids.select(key).distinct(), key, "left_anti")
