"""Stops: from routes, thinned, matched with people, proposed."""

from __future__ import annotations

from math import sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shuttleplan.functions.geo import EARTH_RADIUS_SEARCH, destination, distance
from shuttleplan.functions.scratch import materialize
from shuttleplan.operators.components import connected_components
from shuttleplan.operators.order import numbered
from shuttleplan.operators.spatial import with_cell, with_near_cells


def all_but_last(stops: DataFrame) -> DataFrame:
    """Stops of all routes without each route's last one."""
    last = Window.partitionBy("route_id")
    return stops.withColumn("_last", F.max("pos").over(last)).where("pos < _last").drop("_last")


def stops_of_routes(routes: DataFrame) -> DataFrame:
    """(route_id, pos, lat, lon) from nested routes; the last stop of each is left out."""
    inner = F.slice("stops", 1, F.greatest(F.size("stops") - 1, F.lit(0)))
    return routes.select("route_id", F.posexplode(inner).alias("pos", "stop")).select("route_id", "pos", F.element_at("stop.coords", 1).alias("lat"), F.element_at("stop.coords", 2).alias("lon"))


def scatter(groups: DataFrame, keys: list[str], max_radius: float = 750.0, seed: int = 1, chunk: int = 10_000) -> DataFrame:
    """A point for each person of a postal group, on a bearing and at a radius hashed from (seed, cp, i).

    Exploded in two levels, so that one big code is spread over tasks before its rows are made.
    """
    parts = groups.where("count > 0").withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / chunk))))
    first, last = F.col("_part") * chunk, F.least((F.col("_part") + 1) * chunk, F.col("count")) - 1
    rows = parts.repartition(F.col("cp"), F.col("_part")).withColumn("i", F.explode(F.sequence(first, last)))
    h = F.pmod(F.col("cp").cast("bigint") * 7919 + F.col("i") * 104_729 + seed * 15_485_863, F.lit(360_360))
    heading = F.pmod(h, F.lit(360)).cast("double")
    metres = F.floor(h / 360).cast("double") / 1001 * max_radius
    return rows.withColumn("p", destination("lat", "lon", metres, heading)).select(*keys, "cp", "i", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


#: people of a component that one task scans at once
BLOCK = 50_000


class Around:
    """Points in cubes as wide as the radius, so those within it of a place are in the 27 cubes round it; no pole or date line matters."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, radius: float):
        self.radius, self.chord = radius, 2 * sin(min(radius / EARTH_RADIUS_SEARCH, 3.14) / 2)
        self.side = max(self.chord * 1.000001, 2.0**-18)
        xyz = self.vectors(lat, lon)
        code = self.codes(np.floor(xyz / self.side).astype(np.int64))
        self.order = np.argsort(code, kind="stable")
        self.code, self.xyz, self.lat, self.lon = code[self.order], xyz[self.order], lat[self.order], lon[self.order]
        self.known: dict[tuple, np.ndarray] = {}

    @staticmethod
    def vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        p, q = np.radians(lat), np.radians(lon)
        return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=-1)

    @staticmethod
    def codes(cube: np.ndarray) -> np.ndarray:
        return ((cube[..., 0] + 2**19) << 42) + ((cube[..., 1] + 2**19) << 21) + cube[..., 2] + 2**19

    def within(self, lat: float, lon: float) -> np.ndarray:
        """Places, in the order of ``order``, within the radius, ends included."""
        at = self.vectors(np.float64(lat), np.float64(lon))
        cube = np.floor(at / self.side).astype(np.int64)
        near = self.known.get(key := tuple(cube.tolist()))
        if near is None:
            near = self.known[key] = self.beside(cube)
        away = self.xyz[near] - at
        square = np.einsum("ij,ij->i", away, away)
        sure = square <= self.chord**2 * (1 - 1e-6)
        edge = np.flatnonzero(~sure & (square <= self.chord**2 * (1 + 1e-6)))
        if len(edge):
            sure[edge] = self.exact(near[edge], lat, lon)
        return near[sure]

    def beside(self, cube: np.ndarray) -> np.ndarray:
        """Places of the 27 cubes round a cube."""
        rows = self.codes(cube + [(x, y, -1) for x in (-1, 0, 1) for y in (-1, 0, 1)])
        ends = zip(np.searchsorted(self.code, rows), np.searchsorted(self.code, rows + 3))
        return np.concatenate([np.arange(a, b) for a, b in ends])

    def exact(self, places: np.ndarray, lat: np.ndarray | float, lon: np.ndarray | float) -> np.ndarray:
        """The radius test by the formula of ``distance``."""
        p, q = self.lat[places], self.lon[places]
        s, t = np.sin(np.radians(p - lat) / 2), np.sin(np.radians(q - lon) / 2)
        a = s * s + np.cos(np.radians(lat)) * np.cos(np.radians(p)) * t * t
        return 2 * EARTH_RADIUS_SEARCH * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a))) <= self.radius

    def counts(self, lat: np.ndarray, lon: np.ndarray, most: int = 2_000_000) -> np.ndarray:
        """How many places are within the radius of each of the given ones, by products of blocks of at most ``most`` pairs."""
        xyz = self.vectors(lat, lon)
        code = self.codes(np.floor(xyz / self.side).astype(np.int64))
        order, out = np.argsort(code, kind="stable"), np.zeros(len(lat), np.int64)
        low, high = self.chord**2 * (1 - 1e-6), self.chord**2 * (1 + 1e-6)
        for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []:
            near = self.beside(np.floor(xyz[own[0]] / self.side).astype(np.int64))
            mid = xyz[own[0]]
            for k in range(0, len(near), 100_000):
                part = near[k : k + 100_000]
                b = self.xyz[part] - mid
                step = max(1, most // len(part))
                for j in range(0, len(own), step):
                    rows = own[j : j + step]
                    a = xyz[rows] - mid
                    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
                    sure = square <= low
                    out[rows] += sure.sum(axis=1)
                    i, c = np.nonzero(~sure & (square <= high))
                    if len(i):
                        out[rows] += np.bincount(i[self.exact(part[c], lat[rows[i]], lon[rows[i]])], minlength=len(rows))
        return out


#: places of a component that one task thins at once
PLACES = 500_000


def _thin_scan(rows: pd.DataFrame, kept: pd.DataFrame, radius: float) -> pd.DataFrame:
    """A block of a component's places in id order, after what earlier blocks ``kept``: each that is kept drops all within the radius."""
    rows = rows.sort_values("a", kind="stable")
    ids, lat, lon = (rows[c].to_numpy() for c in ("a", "lat", "lon"))
    around = Around(lat, lon, radius)
    gone, place = np.zeros(len(ids), bool), np.argsort(around.order)
    for y, x in zip(kept["lat"].tolist(), kept["lon"].tolist()):
        gone[around.within(y, x)] = True
    stay = []
    for k, i in enumerate(place.tolist()):
        if not gone[i]:
            stay.append(k)
            gone[around.within(lat[k], lon[k])] = True
    return pd.DataFrame({"component": rows["component"].to_numpy()[stay], "a": ids[stay], "lat": lat[stay], "lon": lon[stay]})


def thin(stops: DataFrame, radius: float = 200.0, keys: list[str] | None = None, stop_id: str = "stop_id", block: int = PLACES) -> DataFrame:
    """Stops that a scan in id order keeps: those without a kept one within the radius.

    The scan depends on its order inside a component of the radius graph only, so components (of the graph of cells, which joins some) are scanned
    side by side, in blocks of ``block`` places: a block sees what earlier ones kept, of which an area holds few. Rounds are as many as
    the largest component has blocks. Ids are unique over all keys. Of stops at one place only the least can stay.
    Stops without coordinates stay.
    """
    keys = keys or []
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    node = F.xxhash64(F.lit(0), *keys, "_row", "_col")
    spots = stops.where(placed).groupBy(*keys, "lat", "lon").agg(F.min(stop_id).cast("bigint").alias("a"))
    spots = materialize(with_cell(spots, radius).withColumn("u", node).drop("_row", "_col"))
    # a cell that is no place's own ends nowhere
    edges = with_near_cells(spots, radius).select("u", node.alias("v")).distinct().join(spots.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    comp = connected_components(edges, "u", "v").withColumnRenamed("node", "u")
    comp = numbered(spots.join(comp, "u").select("component", "a", "lat", "lon"), ["component"], ["a"], "_no")
    dealt = materialize(comp.withColumn("_block", F.floor((F.col("_no") - 1) / block)).drop("_no"))
    most, kind = dealt.agg(F.max("_block")).first()[0], "component bigint, a bigint, lat double, lon double"
    done = stops.sparkSession.createDataFrame([], kind)
    for k in range(0 if most is None else most + 1):
        now = dealt.where(F.col("_block") == k).drop("_block")
        before = done.join(now.select("component").distinct(), "component", "left_semi")
        scan = now.groupBy("component").cogroup(before.groupBy("component")).applyInPandas(lambda a, b: _thin_scan(a, b, radius), kind)
        part = materialize(scan)
        done = part if k == 0 else done.union(part)
    kept = stops.where(~placed).select(F.col(stop_id).cast("bigint").alias("a")).union(done.select("a"))
    return stops.join(kept, stops[stop_id] == kept["a"], "left_semi")


def assign_nearest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each person to the nearest candidate stop, the lower id on ties."""
    best = F.min_by(F.struct("stop_id", "distance_m"), F.struct("distance_m", "stop_id")).alias("m")
    return pairs.groupBy(*keys, "person_id").agg(best).select(*keys, "person_id", "m.stop_id", "m.distance_m")


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    """Sequential scan of a block of one component: people in order, each to its emptiest candidate; ``load`` has the earlier blocks' people."""
    load: dict[int, int] = dict(zip(rows["stop_id"].tolist(), rows["load"].tolist()))
    people, chosen, far = [], [], []
    rows = rows.sort_values(["person_id", "stop_id"], kind="stable")
    starts = rows["person_id"].ne(rows["person_id"].shift()).to_numpy().nonzero()[0].tolist() + [len(rows)]
    person, stop, dist = rows["person_id"].tolist(), rows["stop_id"].tolist(), rows["distance_m"].tolist()
    for a, b in zip(starts, starts[1:]):
        k = min(range(a, b), key=lambda i: load[stop[i]])
        load[stop[k]] += 1
        people.append(person[a])
        chosen.append(stop[k])
        far.append(dist[k])
    return pd.DataFrame({"person_id": people, "stop_id": chosen, "distance_m": far})


def assign_balanced(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(person_id, stop_id, distance_m): people in id order, each to the candidate stop with fewest people so far, the lower id on ties.

    The scan depends on its order inside a component of the candidate graph only. Components are scanned side by
    side, in blocks of ``block`` people: a block starts with the loads that the earlier ones left, which are kept as a
    table. So a task holds one block's pairs, however large a town is, and rounds are as many as the largest
    component has blocks. Person and stop ids are unique over all keys.
    """
    both = materialize(pairs.select("person_id", "stop_id", "distance_m"))
    graph = both.select((F.col("person_id") * 2).alias("a"), (F.col("stop_id") * 2 + 1).alias("b"))
    comp = connected_components(graph).where("node % 2 = 0").select((F.col("node") / 2).cast("bigint").alias("person_id"), "component")
    comp = numbered(comp, ["component"], ["person_id"], "_no").withColumn("_block", F.floor((F.col("_no") - 1) / block)).drop("_no")
    dealt = materialize(both.join(comp, "person_id"))
    most, done, loads = dealt.agg(F.max("_block")).first()[0] or 0, None, None
    for k in range(most + 1):
        now = dealt.where(F.col("_block") == k)
        now = now.withColumn("load", F.lit(0).cast("bigint")) if loads is None else now.join(loads, "stop_id", "left").withColumn("load", F.coalesce("load", F.lit(0)))
        part = now.groupBy("component").applyInPandas(lambda df: _scan(df), "person_id bigint, stop_id bigint, distance_m double")
        if most == 0:
            return part
        part = materialize(part)
        done = part if done is None else done.union(part)
        loads = materialize(done.groupBy("stop_id").agg(F.count("*").alias("load")))
    return done


def _scan_near(people: pd.DataFrame, stops: pd.DataFrame, radius: float) -> pd.DataFrame:
    """As ``_scan``, with the candidates found on the way. Stops of one place are candidates of the same people, so they fill in turn: a place is known by its least load and the next stop."""
    stops = stops.sort_values(["lat", "lon", "stop_id"], kind="stable")
    lat, lon, ids = (stops[c].to_numpy() for c in ("lat", "lon", "stop_id"))
    first = np.flatnonzero(np.r_[True, (lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1])][: len(ids)])
    many = np.diff(np.r_[first, len(ids)])
    around = Around(lat[first], lon[first], radius)
    first, many = first[around.order], many[around.order]
    total = np.r_[0, np.cumsum(stops["load"].to_numpy())]
    taken = total[first + many] - total[first]
    load, turn = taken // many, ids[first + taken % many]
    out = []
    people = people.sort_values("person_id", kind="stable")
    for person, y, x in zip(people["person_id"].tolist(), people["lat"].tolist(), people["lon"].tolist()):
        near = around.within(y, x)
        if len(near):
            loads = load[near]
            near = near[loads == loads.min()]
            k = near[turn[near].argmin()]
            out.append((person, int(turn[k]), y, x, around.lat[k], around.lon[k]))
            taken[k] += 1
            load[k], turn[k] = taken[k] // many[k], ids[first[k] + taken[k] % many[k]]
    return pd.DataFrame(out, columns=["person_id", "stop_id", "lat", "lon", "_lat", "_lon"])


def assign_balanced_within(people: DataFrame, stops: DataFrame, radius: float, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``assign_balanced`` of the pairs of ``radius_join``, without a table of pairs: a task gets people and stops and finds the pairs as it scans.

    The components are those of the graph of cells, an upper bound of the candidate graph's, which the scan does not depend on. A block
    holds its people and the stops of its component.
    """
    at = lambda df, id_: df.select(*keys, id_, "lat", "lon").where("lat is not null and lon is not null")
    node = lambda side, row, col: F.xxhash64(F.lit(side), *keys, row, col)
    spots = materialize(with_cell(at(stops, "stop_id"), radius).withColumn("b", node("stop", "_row", "_col")).drop("_row", "_col"))
    own = with_cell(at(people, "person_id"), radius).withColumn("a", node("person", "_row", "_col")).drop("_row", "_col")
    own = materialize(own)
    edges = with_near_cells(own, radius).select("a", node("stop", "_row", "_col").alias("b")).distinct()
    comp = materialize(connected_components(edges.join(spots.select("b").distinct(), "b", "left_semi")))
    placed = comp.join(own.withColumnRenamed("a", "node"), "node").select("component", "person_id", "lat", "lon")
    numbers = numbered(placed, ["component"], ["person_id"], "_no").withColumn("_block", F.floor((F.col("_no") - 1) / block)).drop("_no")
    dealt = materialize(numbers)
    spots = materialize(comp.join(spots.withColumnRenamed("b", "node"), "node").select("component", "stop_id", "lat", "lon"))
    most, done = dealt.agg(F.max("_block")).first()[0] or 0, None
    for k in range(most + 1):
        now = dealt.where(F.col("_block") == k).drop("_block")
        if done is None:
            beside = spots.withColumn("load", F.lit(0).cast("bigint"))
        else:
            loads = done.groupBy("stop_id").agg(F.count("*").alias("load"))
            beside = spots.join(now.select("component").distinct(), "component", "left_semi").join(loads, "stop_id", "left").withColumn("load", F.coalesce("load", F.lit(0)))
        scan = now.groupBy("component").cogroup(beside.groupBy("component")).applyInPandas(lambda a, b: _scan_near(a, b, radius), "person_id bigint, stop_id bigint, lat double, lon double, _lat double, _lon double")
        part = scan.select("person_id", "stop_id", distance("lat", "lon", "_lat", "_lon", EARTH_RADIUS_SEARCH).alias("distance_m"))
        if most == 0:
            return part
        part = materialize(part)
        done = part if done is None else done.union(part)
    return done


def people_within(places: DataFrame, people: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """(keys, lat, lon, people): how many people are within ``radius`` metres of each place; places without any go.

    Cells of four radii, each with the people of the cells round it, are counted in one call by products of small blocks, so pairs
    are never rows. Both have ``keys``, lat, lon.
    """
    at = lambda df: df.select(*keys, "lat", "lon").where("lat is not null and lon is not null")
    cell, kinds = [*keys, "_row", "_col"], ", ".join(f"{k} {places.schema[k].dataType.simpleString()}" for k in keys)
    a, b = with_cell(at(places).distinct(), 4 * radius), with_near_cells(at(people), 4 * radius)
    b = b.join(a.select(*cell).distinct(), cell, "left_semi")

    def count(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = own[[*keys, "lat", "lon"]].copy()
        spots = Around(near["lat"].to_numpy(), near["lon"].to_numpy(), radius)
        out["people"] = spots.counts(own["lat"].to_numpy(), own["lon"].to_numpy()) if len(near) else 0
        return out[out["people"] > 0]

    return a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInPandas(count, f"{kinds}, lat double, lon double, people bigint")


def people_per_stop(stops: DataFrame, assignments: DataFrame) -> DataFrame:
    """(stop_id, people), 0 where nobody is assigned."""
    counts = assignments.groupBy("stop_id").agg(F.count("*").alias("people"))
    return stops.select("stop_id").join(counts, "stop_id", "left").select("stop_id", F.coalesce("people", F.lit(0).cast("bigint")).alias("people"))


def busy_stops(assignments: DataFrame, min_samples: int) -> DataFrame:
    """Stops with at least ``min_samples`` people."""
    return assignments.groupBy("stop_id").agg(F.count("*").alias("people")).where(F.col("people") >= min_samples)


def stops_and_centres(selected: DataFrame, centres: DataFrame) -> DataFrame:
    """Selected stops, then cluster centres, numbered in that order: (scenario_id, source, source_id, lat, lon, stop_no)."""
    both = selected.select("scenario_id", F.lit(0).alias("source"), F.col("stop_id").alias("source_id"), "lat", "lon").unionByName(
        centres.select("scenario_id", F.lit(1).alias("source"), F.col("cluster_id").alias("source_id"), "lat", "lon")
    )
    return numbered(both, ["scenario_id"], ["source", "source_id"], "stop_no")
