"""Headcount rows as a stream: stateless per row, with a static directory, and a sink into the store of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shuttleplan.functions.geo import in_polygon, polygon_literal
from shuttleplan.operators.clean import first_per_code, flag_postal_code, group_postal_codes
from shuttleplan.sources.tables import append_groups


def enrich(people: DataFrame, directory: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Format flag, geocode and bounds flag for a streaming (or static) headcount."""
    first = first_per_code(directory).drop("idx")
    out = flag_postal_code(people).join(first, F.col("postal_code") == F.col("cp"), "left").withColumn("has_coords", F.col("lat").isNotNull())
    return out.withColumn("in_bounds", in_polygon("lat", "lon", polygon_literal(polygon)))


def store_batch(rows: DataFrame, batch_id: int, path: str, name: str) -> None:
    """Groups of the in-bounds rows of a batch, stored under the batch's number: a replayed batch replaces itself."""
    append_groups(group_postal_codes(rows.where("in_bounds"), ["scenario_id"]), path, f"{name}-{batch_id}")


def store_groups(people: DataFrame, directory: DataFrame, polygon: list[tuple[float, float]], path: str, checkpoint: str, name: str = "headcount") -> StreamingQuery:
    """Start a query that cleans a streaming headcount and adds its groups to the store at ``path``.

    Every batch is an upload of its own, so a stream that is started again after a failure adds no group twice. A code's
    count is the sum over its uploads. ``name`` keeps the streams of one store apart.
    """
    found = enrich(people, directory, polygon)
    return found.writeStream.foreachBatch(lambda rows, k: store_batch(rows, k, path, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
