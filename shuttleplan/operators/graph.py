"""Sparse stop graphs that point to a plant (node 0 of every scenario)."""

from __future__ import annotations

from math import floor, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shuttleplan.functions.geo import distance, in_polygon, same_point, travel_time, with_corridor
from shuttleplan.functions.scratch import materialize
from shuttleplan.operators.order import numbered, percentiles
from shuttleplan.operators.spatial import nearest_n

PLANT = 0


def _pairs(nodes: DataFrame, keys: list[str]) -> DataFrame:
    a = nodes.select(*keys, F.col("node_id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(*keys, F.col("node_id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, keys)


def _nearest(sources: DataFrame, nodes: DataFrame, n: int, keys: list[str], accept=None) -> DataFrame:
    """Ranks 2 to n + 1: the nearest one is taken for the source itself."""
    found = nearest_n(sources, nodes.select(*keys, F.col("node_id").alias("dst"), "lat", "lon"), n + 1, keys, "src", "dst", accept)
    return found.where("rank > 1")


def _with_plant(edges: DataFrame, nodes: DataFrame, n: int, keys: list[str], plants: DataFrame) -> DataFrame:
    """Where a source's list lacks the plant, its last entry gives way to the plant."""
    own = Window.partitionBy(*keys, "src")
    marked = edges.withColumn("_has", F.max((F.col("dst") == PLANT).cast("int")).over(own)).withColumn("_last", F.max("rank").over(own))
    kept = marked.where("_has = 1 or rank < _last").drop("_has", "_last")
    lacking = marked.where("_has = 0").select(*keys, "src", F.col("_last").alias("rank")).distinct()
    a = nodes.select(*keys, F.col("node_id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    added = lacking.join(a, [*keys, "src"]).join(plants, keys)
    added = added.select(*keys, "src", F.lit(PLANT).cast("bigint").alias("dst"), distance("lat1", "lon1", "plant_lat", "plant_lon").alias("dist_est"), "rank")
    return kept.select(*keys, "src", "dst", "dist_est", "rank").unionByName(added)


def candidate_edges(nodes: DataFrame, n: int | None = 8, strategy: str = "full", include_dest: bool = False, factor: float = 0.2, keys: list[str] | None = None) -> DataFrame:
    """(keys, src, dst, dist_est, dur_est).

    full: the nearest nodes; wide and narrow: of those inside a corridor from the source to the plant
    (10 m beyond the ends and as wide as the distance to the plant; 100 m and a sixth of it), and the
    plant has one edge of length 0 to itself. Equal distances go by node id. With ``n`` only near cells are
    searched, of a corridor those that it meets; with None all pairs are the result. Nodes without coordinates have no edges.
    """
    keys = keys or ["scenario_id"]
    plants = nodes.where(F.col("node_id") == PLANT).select(*keys, F.col("lat").alias("plant_lat"), F.col("lon").alias("plant_lon"))
    d = distance("lat1", "lon1", "lat2", "lon2")
    if strategy == "full" and n is None:
        edges = _pairs(nodes, keys).withColumn("dist_est", d)
    elif strategy == "full":
        edges = _nearest(nodes.select(*keys, F.col("node_id").alias("src"), "lat", "lon"), nodes, n, keys)
    else:
        delta, share = {"wide": (10.0, 1.0), "narrow": (100.0, 6.0)}[strategy]
        to_plant = nodes.select(*keys, F.col("node_id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).join(plants, keys)
        ends = to_plant.withColumn("at_plant", same_point("lat1", "lon1", "plant_lat", "plant_lon")).withColumnsRenamed({"plant_lat": "lat2", "plant_lon": "lon2"})
        # one small row a node: written once, so that the pair join does not compute polygons again
        area = materialize(with_corridor(ends, delta, share).drop("lat2", "lon2"))
        own = area.where("at_plant").select(*keys, "src", F.lit(PLANT).cast("bigint").alias("dst"), F.lit(0.0).alias("dist_est"))
        # the corridor's box goes before the polygon test
        lat, lon = F.transform("area", lambda p: p["lat"]), F.transform("area", lambda p: p["lon"])
        area = area.where("not at_plant").select(*keys, "src", "lat1", "lon1", "area", F.array_min(lat).alias("s"), F.array_max(lat).alias("n"), F.array_min(lon).alias("w"), F.array_max(lon).alias("e"))
        box = "{0} between s - 1e-4 and n + 1e-4 and {1} between w - 1e-4 and e + 1e-4"
        if n is None:
            b = nodes.select(*keys, F.col("node_id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
            edges = area.join(b, keys).where(box.format("lat2", "lon2")).where(in_polygon("lat2", "lon2", "area", edges=6)).withColumn("dist_est", d)
        else:
            reach = F.array_max(F.transform("area", lambda p: distance("lat1", "lon1", p["lat"], p["lon"]))) * 1.05 + 100
            sources = area.withColumn("reach", reach).withColumnsRenamed({"lat1": "lat", "lon1": "lon"})
            edges = _nearest(sources, nodes, n, keys, lambda: F.expr(box.format("_lat", "_lon")) & in_polygon("_lat", "_lon", "area", edges=6))
    if include_dest and n is not None:
        edges = _with_plant(edges, nodes, n, keys, plants)
    edges = edges.select(*keys, "src", "dst", "dist_est")
    if strategy != "full":
        edges = edges.unionByName(own)
    return edges.withColumn("dur_est", travel_time("dist_est", factor))


def attach_roads(edges: DataFrame, roads: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds dist_road, dur_road where known; ``edge`` is the road distance, else the estimate."""
    keys = keys or ["scenario_id"]
    out = edges.join(roads.select(*keys, "src", "dst", "dist_road", "dur_road"), [*keys, "src", "dst"], "left")
    return out.withColumn("edge", F.coalesce("dist_road", "dist_est"))


def robust(df: DataFrame, column: str, out: str, keys: list[str], negated: bool = False, weight: float = 1.0, approximate: bool = False) -> DataFrame:
    """Adds (x - median) / (q85 - q25), shifted to a least value of 0, times ``weight``; a zero range divides by 1.

    Percentiles are exact (``order.percentiles``); ``approximate`` takes approximate ones, in one pass.
    """
    if approximate:
        quarters = df.groupBy(*keys).agg(F.percentile_approx(column, [0.25, 0.85], 100_000).alias("_q"))
    else:
        quarters = percentiles(df, column, [0.25, 0.85], keys).withColumnRenamed("q", "_q")
    joined = df.join(df.groupBy(*keys).agg(F.min(column).alias("_min"), F.max(column).alias("_max")), keys).join(quarters, keys, "left")
    spread = F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))
    scale = F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    value = ((F.col("_max") - F.col(column)) if negated else (F.col(column) - F.col("_min"))) / scale
    return joined.withColumn(out, value * F.lit(weight)).drop("_q", "_min", "_max")


def node_scores(nodes: DataFrame, w_weights: float = 1.0, w_end: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Nodes plus end_distance, scaled_weight (heavy is low) and scaled_end_distance."""
    keys = keys or ["scenario_id"]
    plants = nodes.where(F.col("node_id") == PLANT).select(*keys, F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    out = nodes.join(plants, keys).withColumn("end_distance", distance("_plat", "_plon", "lat", "lon")).drop("_plat", "_plon")
    out = robust(out, "weight", "scaled_weight", keys, negated=True, weight=w_weights)
    return robust(out, "end_distance", "scaled_end_distance", keys, weight=w_end)


def edge_scores(edges: DataFrame, nodes: DataFrame, w_edge: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Score = scaled edge length + the target's scaled weight and end distance (nodes from node_scores)."""
    keys = keys or ["scenario_id"]
    scaled = robust(edges, "edge", "scaled_edge", keys, weight=w_edge)
    at = nodes.select(*keys, F.col("node_id").alias("dst"), (F.col("scaled_weight") + F.col("scaled_end_distance")).alias("_at"))
    return scaled.join(at, [*keys, "dst"]).withColumn("score", F.col("scaled_edge") + F.col("_at")).drop("_at")


def road_scores(edges: DataFrame, keys: list[str] | None = None, w_distance: float = 1.0, w_duration: float = 1.0) -> DataFrame:
    """Score = scaled road distance + scaled road duration."""
    keys = keys or ["scenario_id"]
    out = robust(edges, "dist_road", "scaled_distance", keys, weight=w_distance)
    out = robust(out, "dur_road", "scaled_duration", keys, weight=w_duration)
    return out.withColumn("score", F.col("scaled_distance") + F.col("scaled_duration"))


def prune(edges: DataFrame, keys: list[str] | None = None, duration: str = "dur_road") -> DataFrame:
    """Edges kept per source: none at mean duration 0, all at a deviation under 0.2 percent of the mean, else the faster ones.

    Faster: the gap to the slowest reaches the mean gap. The kept value is the duration.
    """
    own = Window.partitionBy(*(keys or ["scenario_id"]), "src")
    t = F.col(duration)
    out = edges.withColumns({"_mean": F.avg(t).over(own), "_std": F.stddev_pop(t).over(own), "_max": F.max(t).over(own)})
    flat = F.col("_std") * 100 < F.col("_mean") * 0.2
    faster = F.col("_max") - t >= F.col("_max") - F.col("_mean") - 1e-9
    return out.where((F.col("_mean") != 0) & (flat | faster)).withColumn("edge", t).drop("_mean", "_std", "_max")


def in_degrees(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node_id, connections), 0 for none."""
    keys = keys or ["scenario_id"]
    n = edges.groupBy(*keys, F.col("dst").alias("node_id")).agg(F.count("*").alias("connections"))
    return nodes.select(*keys, "node_id").join(n, [*keys, "node_id"], "left").select(*keys, "node_id", F.coalesce("connections", F.lit(0).cast("bigint")).alias("connections"))


def request_plan(edges: DataFrame, n: int, limit: int = 100, keys: list[str] | None = None) -> DataFrame:
    """Matrix requests: (keys, batch, src, down, up, targets): each source's slice of its batch's target list.

    Sources are numbered in id order; a batch has floor(sqrt(limit / n)) of them.
    """
    keys = keys or ["scenario_id"]
    size = max(1, floor(sqrt(limit / n)))
    per = edges.groupBy(*keys, "src").agg(F.array_sort(F.collect_list(F.struct("dist_est", "dst"))).alias("t"))
    per = per.select(*keys, "src", F.transform("t", lambda x: x["dst"]).alias("targets"))
    per = numbered(per, keys, ["src"], "_no").withColumn("batch", F.floor((F.col("_no") - 1) / size)).drop("_no")
    run = Window.partitionBy(*keys, "batch").orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    up = F.sum(F.size("targets")).over(run).cast("bigint")
    return per.withColumn("up", up).withColumn("down", F.col("up") - F.size("targets")).select(*keys, "batch", "src", "down", "up", "targets")


def build_graph(nodes: DataFrame, roads: DataFrame | None = None, n: int = 8, strategy: str = "full", include_dest: bool = False, factor: float = 0.2, w: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """(nodes with scores, edges with scores)."""
    scored = node_scores(nodes, w[0], w[1])
    edges = candidate_edges(nodes, n, strategy, include_dest, factor)
    if roads is not None:
        edges = attach_roads(edges, roads)
    else:
        edges = edges.withColumn("edge", F.col("dist_est"))
    return scored, edge_scores(edges, scored, w[2])


def missing(value: str = "edge") -> Column:
    """No edge: rows that are absent read as infinite."""
    return F.coalesce(F.col(value), F.lit(float("inf")))
