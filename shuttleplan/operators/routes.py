"""Route search and scoring on stop graphs."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shuttleplan.functions.geo import destination, distance
from shuttleplan.operators.spatial import nearest_probe

#: fixed value: pheromone bounds are this over the largest and smallest duration
STRENGTH = 10.0


def segments(tours: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tour_id, pos, src, dst, columns of the edge) of consecutive nodes."""
    order = Window.partitionBy(*keys, "tour_id").orderBy("pos")
    steps = tours.withColumn("dst", F.lead("node_id").over(order)).where("dst is not null").withColumnRenamed("node_id", "src")
    return steps.join(edges, [*keys, "src", "dst"], "left")


def fitness(tours: DataFrame, edges: DataFrame, nodes: DataFrame, max_nodes: int, keys: list[str], end_node: int = 0, duration: str = "dur_road", require_complete: bool = False) -> DataFrame:
    """(keys, tour_id, fitness, people, stops, complete), lower is better.

    Sum of durations, times 1000 without the plant at the end, times (|max_nodes - length| + 1) over
    the tour's people; null where nobody is on it. A tour of one node has fitness 0 unless
    ``require_complete`` turns tours that miss the plant to null.
    """
    time = segments(tours, edges, keys).groupBy(*keys, "tour_id").agg(F.sum(duration).alias("time"))
    own = tours.join(nodes.select(*keys, "node_id", "weight"), [*keys, "node_id"])
    own = own.groupBy(*keys, "tour_id").agg(F.sum("weight").alias("people"), F.count("*").alias("stops"), F.max_by("node_id", "pos").alias("last"))
    out = own.join(time, [*keys, "tour_id"], "left").withColumn("complete", F.col("last") == end_node)
    value = F.coalesce("time", F.lit(0.0)) * F.when(F.col("complete"), 1).otherwise(1000)
    value = F.try_divide(value * (F.abs(F.lit(max_nodes) - F.col("stops")) + 1), F.col("people"))
    if require_complete:
        value = F.when(F.col("complete"), value)
    return out.select(*keys, "tour_id", value.alias("fitness"), "people", "stops", "complete")


def best_of_colony(ants: DataFrame, by: list[str]) -> DataFrame:
    """Least fitness, the first ant on ties."""
    return ants.groupBy(*by).agg(F.min(F.struct("fitness", "ant_id")).alias("m")).select(*by, "m.ant_id", "m.fitness")


def running_best(queens: DataFrame, by: list[str]) -> DataFrame:
    """Over iterations: an old queen stays only while strictly better, so the latest of equals wins."""
    return queens.groupBy(*by).agg(F.min(F.struct(F.col("fitness"), (-F.col("iteration")).alias("i"))).alias("m")).select(*by, (-F.col("m.i")).alias("iteration"), "m.fitness")


def weighted_pick(options: DataFrame, by: list[str]) -> DataFrame:
    """First option (by ``pos``) whose running share reaches ``r``; none if all weights are 0.

    The share is the running sum over the whole, so it is rounded once; a sum of rounded shares may miss a bound that it equals.
    """
    own = Window.partitionBy(*by)
    run = F.try_divide(F.sum("p").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), F.sum("p").over(own))
    return options.withColumn("run", run).where("r <= run").groupBy(*by).agg(F.min("pos").alias("pos"))


def neighbourhood(ants: DataFrame, edges: DataFrame, visited: DataFrame, avoided: DataFrame | None, keys: list[str]) -> DataFrame:
    """Out-edges of each ant's current node, without those it visited and those to avoid."""
    out = ants.join(edges.withColumnRenamed("src", "current"), [*keys, "current"])
    out = out.join(visited.select(*keys, "ant_id", F.col("node_id").alias("dst")), [*keys, "ant_id", "dst"], "left_anti")
    return out if avoided is None else out.join(avoided.select(*keys, F.col("node_id").alias("dst")), [*keys, "dst"], "left_anti")


def transition(options: DataFrame, by: list[str], alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """Adds prob: tau^alpha * (1 / edge)^beta * recurrency, normalised over each neighbourhood."""
    raw = F.pow("tau", F.lit(alpha)) * F.pow(F.try_divide(F.lit(1.0), F.col("edge")), F.lit(beta)) * F.coalesce(F.col("recurrency"), F.lit(1.0))
    return options.withColumn("_p", raw).withColumn("prob", F.try_divide(F.col("_p"), F.sum("_p").over(Window.partitionBy(*by)))).drop("_p")


def pheromone_bounds(edges: DataFrame, keys: list[str], duration: str = "dur_road") -> DataFrame:
    return edges.where(F.col(duration) > 0).groupBy(*keys).agg((F.lit(STRENGTH) / F.max(duration)).alias("tau_min"), (F.lit(STRENGTH) / F.min(duration)).alias("tau_max"))


def evaporate(edges: DataFrame, bounds: DataFrame, keys: list[str], rho: float = 0.4) -> DataFrame:
    """tau * (1 - rho), clamped to the bounds."""
    out = edges.join(bounds, keys)
    return out.withColumn("tau", F.least(F.greatest(F.col("tau") * (1 - rho), F.col("tau_min")), F.col("tau_max"))).drop("tau_min", "tau_max")


def deposit(edges: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """Adds 1 / fitness to the edges of the best tour; ``best`` has keys, pos, node_id, fitness."""
    order = Window.partitionBy(*keys).orderBy("pos")
    steps = best.withColumn("dst", F.lead("node_id").over(order)).where("dst is not null")
    steps = steps.select(*keys, F.col("node_id").alias("src"), "dst", F.try_divide(F.lit(1.0), F.col("fitness")).alias("_add"))
    out = edges.join(steps, [*keys, "src", "dst"], "left")
    return out.withColumn("tau", F.col("tau") + F.coalesce("_add", F.lit(0.0))).drop("_add")


def start_nodes(stops: DataFrame, keys: list[str], step: int = 5, offset: int = 1) -> DataFrame:
    """Distinct nearest stops to points on a circle round the centre through the farthest stop.

    ``stops`` has keys, stop_id, lat, lon; node_id = stop_id + offset.
    """
    mid = stops.groupBy(*keys).agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    far = stops.join(mid, keys).groupBy(*keys, "clat", "clon").agg(F.max(distance("clat", "clon", "lat", "lon")).alias("radius"))
    probes = far.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(360), F.lit(step))))
    probes = probes.withColumn("p", destination("clat", "clon", F.col("radius"), F.col("probe").cast("double"))).select(*keys, "probe", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    return nearest_probe(stops, probes, keys, "stop_id", "probe").select(*keys, (F.col("stop_id") + offset).alias("node_id")).distinct()


def farthest_stop(stops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, radius, stop_id): greatest distance from the centre, and the first stop that has it."""
    mid = stops.groupBy(*keys).agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    d = stops.join(mid, keys).withColumn("d", distance("clat", "clon", "lat", "lon"))
    return d.groupBy(*keys).agg(F.max(F.struct("d", (-F.col("stop_id")).alias("s"))).alias("m")).select(*keys, F.col("m.d").alias("radius"), (-F.col("m.s")).alias("stop_id"))


def unserved_stops(stops: DataFrame, tours: DataFrame, keys: list[str], offset: int = 1) -> DataFrame:
    """Stops in no tour, for a second planning round."""
    used = tours.select(*keys, (F.col("node_id") - offset).alias("stop_id")).distinct()
    return stops.join(used, [*keys, "stop_id"], "left_anti")


def people_on_tours(tours: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tour_id, people)."""
    return tours.join(nodes.select(*keys, "node_id", "weight"), [*keys, "node_id"]).groupBy(*keys, "tour_id").agg(F.sum("weight").alias("people"))


def people_served(tours: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, served, total): people over the distinct nodes of all tours, and over the graph."""
    served = tours.select(*keys, "node_id").distinct().join(nodes, [*keys, "node_id"]).groupBy(*keys).agg(F.sum("weight").alias("served"))
    total = nodes.groupBy(*keys).agg(F.sum("weight").alias("total"))
    return total.join(served, keys, "left").select(*keys, F.coalesce("served", F.lit(0.0)).alias("served"), "total")


def _search(edges: dict, weight: dict, start: int, end: int, rec: dict, rng, max_nodes: int, iterations: int, ants: int, rho: float, alpha: float, beta: float) -> tuple[list[int], float]:
    """Ant colony from one start: (best tour, fitness).

    Only edges that got a deposit are kept, with the iteration of it: the decay since then is applied
    when an ant looks at the edge, so an iteration costs what its ants walk, not the number of edges.
    """
    times = [t for out in edges.values() for _, t in out if t > 0]
    if not times:
        return [start], 0.0
    low, high = STRENGTH / max(times), STRENGTH / min(times)
    marked: dict[tuple[int, int], tuple[float, int]] = {}
    draws = iter(())

    def draw() -> float:
        nonlocal draws
        x = next(draws, None)
        if x is None:
            draws = iter(rng.random(2048).tolist())
            x = next(draws)
        return x

    def strength(step: tuple[int, int], now: int) -> float:
        value, since = marked.get(step, (high, 0))
        if now > since:
            value = min(max(value * (1 - rho), low), high)
            value = max(value * (1 - rho) ** (now - since - 1), low)
        return value

    def walk(now: int) -> tuple[list[int], float]:
        tour, total = [start], 0.0
        while tour[-1] != end and len(tour) <= 3 * max_nodes:
            here = tour[-1]
            options = [(b, t) for b, t in edges.get(here, ()) if b not in tour]
            p = [strength((here, b), now) ** alpha * (1 / max(t, 1e-9)) ** beta * max(rec.get(b, 1.0), 0.0) for b, t in options]
            left = draw() * sum(p)
            if not sum(p) > 0:
                break
            for (b, t), x in zip(options, p, strict=True):
                left -= x
                if left < 0:
                    break
            tour.append(b)
            total += t
        return tour, total

    def cost(tour: list[int], total: float) -> float:
        people = sum(weight.get(x, 0.0) for x in tour)
        return total * (1 if tour[-1] == end else 1000) * (abs(max_nodes - len(tour)) + 1) / people if people else float("inf")

    best, least = [start], float("inf")
    for now in range(iterations):
        found = [walk(now) for _ in range(ants)]
        costs = [cost(*f) for f in found]
        k = min(range(ants), key=costs.__getitem__)
        if not least < costs[k]:
            best, least = found[k][0], costs[k]
        if 0 < costs[k] < float("inf"):
            for s in zip(found[k][0], found[k][0][1:]):
                marked[s] = (strength(s, now + 1) + 1 / costs[k], now + 1)
    return best, least


def plan_routes(edges: DataFrame, nodes: DataFrame, starts: DataFrame, key: str = "scenario_id", max_nodes: int = 5, iterations: int = 150, ants: int = 15, rho: float = 0.4, alpha: float = 1.0, beta: float = 0.0, seed: int = 1, duration: str = "dur_road", end_node: int = 0, avoid: DataFrame | None = None) -> DataFrame:
    """(key, tour_id, pos, node_id, fitness): a tour from every start, starts in id order.

    ``avoid`` (key, node_id) holds nodes that no tour may step on; a start among them still starts.

    A node's recurrency starts at the number of starts and drops by one for each tour that used it, so
    later tours avoid it: the starts of one scenario follow each other, scenarios run side by side.
    The random numbers of a start depend on (seed, scenario, start) alone.
    """
    if avoid is not None:
        edges = edges.join(avoid.select(key, F.col("node_id").alias("dst")), [key, "dst"], "left_anti")
    flat = (
        edges.select(key, F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col(duration).cast("double").alias("v"))
        .unionByName(nodes.select(key, F.lit(1).alias("kind"), F.col("node_id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("weight").cast("double").alias("v")))
        .unionByName(starts.select(key, F.lit(2).alias("kind"), F.col("node_id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0.0).alias("v")))
    )

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        scenario = rows[key].iloc[0]
        rows = rows.sort_values(["kind", "a", "b"])
        out: dict[int, list] = {}
        for a, b, v in rows.loc[rows.kind == 0, ["a", "b", "v"]].itertuples(index=False):
            out.setdefault(a, []).append((b, v))
        weight = dict(zip(rows.loc[rows.kind == 1, "a"], rows.loc[rows.kind == 1, "v"]))
        first = rows.loc[rows.kind == 2, "a"].drop_duplicates().tolist()
        rec = dict.fromkeys(weight, float(len(first)))
        tours = []
        for t, s in enumerate(first):
            rng = np.random.default_rng(zlib.crc32(f"{seed}:{scenario}:{s}".encode()))
            tour, value = _search(out, weight, s, end_node, rec, rng, max_nodes, iterations, ants, rho, alpha, beta)
            tours += [(scenario, t, p, n, value) for p, n in enumerate(tour)]
            for n in tour:
                rec[n] = rec.get(n, 0.0) - 1
        return pd.DataFrame(tours, columns=[key, "tour_id", "pos", "node_id", "fitness"])

    kind = edges.schema[key].dataType.simpleString()
    return flat.groupBy(key).applyInPandas(solve, f"{key} {kind}, tour_id bigint, pos int, node_id bigint, fitness double")


def search_routes(edges: DataFrame, nodes: DataFrame, starts: DataFrame, key: str = "scenario_id", avoid: DataFrame | None = None, **how) -> DataFrame:
    """Independent searches: as plan_routes, but no start sees the others; every start is its own group."""
    if avoid is not None:
        edges = edges.join(avoid.select(key, F.col("node_id").alias("dst")), [key, "dst"], "left_anti")
    own = starts.select(key, F.col("node_id").alias("start"))
    label = F.concat_ws(":", F.col(key).cast("string"), F.col("start").cast("string"))
    every = [df.join(own, key).withColumn("_search", label).drop(key) for df in (edges, nodes)]
    first = own.select(label.alias("_search"), F.col("start").alias("node_id"))
    out = plan_routes(every[0], every[1], first, key="_search", **how)
    return out.withColumn(key, F.split("_search", ":")[0].cast(edges.schema[key].dataType)).withColumn("start", F.split("_search", ":")[1].cast("bigint")).select(key, "start", "pos", "node_id", "fitness")
