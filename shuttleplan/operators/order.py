"""Row numbers and percentiles without sending a whole key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shuttleplan.functions.scratch import materialize


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: 1, 2, ... in ``order`` inside every key; the order must tell the rows of a key apart.

    The rows are range partitioned by key and order and written with their partition; a key's rows are numbered inside
    each partition and shifted by the rows of it in earlier ones, of which there is one count for each key and partition.
    """
    parts = materialize(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    own = [*keys, "_part"]
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = parts.groupBy(*own).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy(*own).orderBy(*order))
    return parts.join(shift, own).withColumn(out, (number + F.col("_before")).cast("bigint")).drop("_part", "_before")


def percentiles(df: DataFrame, column: str, shares: list[float], keys: list[str]) -> DataFrame:
    """(keys, q): exact percentiles of every key, between two values by their distance, as an array in the order of ``shares``.

    Equal values are counted first; the counts are range partitioned by key and value, so a value's places follow from the
    sums of the partitions before and of the values before it in its own. No task holds the values of a key.
    Nulls count for nothing; a key without a value has no row.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    parts = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    own = [*keys, "_part"]
    before = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = parts.groupBy(*own).agg(F.sum("_n").alias("_m")).withColumns({"_before": F.coalesce(before, F.lit(0)), "_total": F.sum("_m").over(Window.partitionBy(*keys))}).drop("_m")
    run = F.sum("_n").over(Window.partitionBy(*own).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.join(sums, own).withColumn("_end", run + F.col("_before"))

    def at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("_end") - F.col("_n")) & (place < F.col("_end")), F.col("_v")))

    places = [F.lit(p) * (F.col("_total") - 1) for p in shares]
    found = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *[at(f(x)).alias(f"_{side}{i}") for i, x in enumerate(places) for side, f in (("l", F.floor), ("h", F.ceil))])

    def between(i: int) -> Column:
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        return F.when(low == high, low.cast("double")).otherwise((F.ceil(places[i]) - places[i]) * low + (places[i] - F.floor(places[i])) * high)

    return found.select(*keys, F.array(*[between(i) for i in range(len(shares))]).alias("q"))
