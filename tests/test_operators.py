"""Iterative and order-dependent operators against brute force, on random inputs."""

import random

import pytest
from pyspark.sql import functions as F
from test_geo import crossings, metres

from shuttleplan.functions.geo import EARTH_RADIUS_SEARCH, with_corridor
from shuttleplan.operators import clean, cluster, components, graph, responses, routes, shapes, spatial, stops
from shuttleplan.operators.components import connected_components
from shuttleplan.operators.order import numbered, percentiles
from shuttleplan.sources import tables


def near(a, b):
    return metres(a, b, EARTH_RADIUS_SEARCH)


def cloud(n, seed, side=0.02, base=(21.9, -102.3)):
    rng = random.Random(seed)
    return [(i, base[0] + rng.uniform(0, side), base[1] + rng.uniform(0, side)) for i in range(n)]


def points(spark, rows, name="point_id"):
    return spark.createDataFrame([(0, *r) for r in rows], f"scenario_id int, {name} bigint, lat double, lon double")


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5} | dict.fromkeys(range(100, 161), 100)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("base", [(21.9, -102.3), (60.0, 179.99), (-0.01, -179.995), (88.9, 10.0)])
def test_radius_join_is_cross_join(spark, base):
    rng = random.Random(3)
    wrap = lambda x: (x + 180) % 360 - 180
    a = [(i, base[0] + rng.uniform(0, 0.03), wrap(base[1] + rng.uniform(0, 0.03))) for i in range(80)]
    b = [(i, base[0] + rng.uniform(0, 0.03), wrap(base[1] + rng.uniform(0, 0.03))) for i in range(40)]
    want = {(x[0], y[0]) for x in a for y in b if near(x[1:], y[1:]) <= 700}
    for salts, hot in ((1, None), (3, None), (1, 5)):
        got = spatial.radius_join(points(spark, a, "person_id"), points(spark, b, "stop_id"), 700, ["scenario_id"], "person_id", "stop_id", salts, hot)
        assert sorted((r.person_id, r.stop_id) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_thinning_is_the_scan(spark, seed):
    rows, kept = cloud(60, seed), []
    for r in rows:
        if all(near(r[1:], k[1:]) > 300 for k in kept):
            kept.append(r)
    for block in (stops.BLOCK, 7):
        got = stops.thin(points(spark, rows, "stop_id"), 300, ["scenario_id"], block=block)
        assert sorted(r.stop_id for r in got.collect()) == [k[0] for k in kept]


def written(monkeypatch, modules):
    """Number of tables that the modules write from now on, as a list with one entry each."""
    out = []
    for m in modules:
        monkeypatch.setattr(m, "materialize", lambda df, f=m.materialize: (out.append(m), f(df))[1])
    return out


def test_thinning_a_street(spark, monkeypatch):
    street = [(i, 21.9, -102.3 + i * 0.001) for i in range(1000)]
    count = written(monkeypatch, [stops, components])
    got = stops.thin(points(spark, street, "stop_id"), 150, ["scenario_id"])
    assert sorted(r.stop_id for r in got.collect()) == list(range(0, 1000, 2))
    assert len(count) <= 30  # twelve rounds of two tables, six more


def test_nearest_of_mixed_density(spark, monkeypatch):
    rows = cloud(150, 11, side=2.0) + [(i + 500, a, b) for i, a, b in cloud(150, 12, side=0.0005, base=(22.5, -101.7))] + [(900, 21.9, 179.99), (901, 21.9, -179.99), (902, 89.9, 0.0), (903, None, 1.0)]
    count = written(monkeypatch, [spatial])
    got = spatial.nearest_n(points(spark, rows, "src"), points(spark, rows, "dst"), 4, ["scenario_id"], "src", "dst")
    found = {}
    for r in got.collect():
        found.setdefault(r.src, []).append((r.rank, r.dst))
    assert len(count) <= 5
    for i, *a in (r for r in rows if r[1] is not None):
        far = sorted((metres(a, b), j) for j, *b in rows if b[0] is not None)
        mine = [j for _, j in sorted(found[i])]
        assert [round(metres(a, dict((j, b) for j, *b in rows)[x]), 3) for x in mine] == [round(d, 3) for d, _ in far[:4]]


def test_exact_percentiles(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, float(rng.randint(0, 9)), rng.random()])) for k in (0, 1, 2) for _ in range(200)] + [(3, None), (4, 7.0)] + [(5, 1.0)] * 300
    df = spark.createDataFrame(rows, "k int, x double").repartition(5)
    got = {r.k: r.q for r in percentiles(df, "x", [0.0, 0.25, 0.5, 0.85, 1.0], ["k"]).collect()}
    want = df.groupBy("k").agg(F.percentile("x", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.85, 1.0)])).alias("q"))
    assert got == {r.k: r.q for r in want.collect() if r.q is not None}


def test_balanced_assignment_is_the_scan(spark):
    people, at = cloud(70, 4), cloud(9, 5)
    load, want = {}, {}
    for p in people:
        options = [s[0] for s in at if near(p[1:], s[1:]) <= 900]
        if options:
            best = min(options, key=lambda s: (load.get(s, 0), s))
            load[best] = load.get(best, 0) + 1
            want[p[0]] = best
    pairs = spatial.radius_join(points(spark, people, "person_id"), points(spark, at, "stop_id"), 900, ["scenario_id"], "person_id", "stop_id")
    for block in (stops.BLOCK, 8):
        assert {r.person_id: r.stop_id for r in stops.assign_balanced(pairs, block).collect()} == want


def dbscan(rows, eps, m):
    """Sequential clustering; labels are least core ids."""
    hood = {a[0]: [b[0] for b in rows if near(a[1:], b[1:]) <= eps] for a in rows}
    core = {a for a in hood if len(hood[a]) >= m}
    label = {}
    for a in sorted(core):
        if a in label:
            continue
        todo = [a]
        while todo:
            x = todo.pop()
            for y in hood[x]:
                if y not in label:
                    label[y] = a
                    if y in core:
                        todo.append(y)
    return {r[0]: label.get(r[0]) for r in rows}


@pytest.mark.parametrize("seed", [1, 7])
def test_dbscan(spark, seed):
    rows = cloud(90, seed)
    got = cluster.dbscan(points(spark, rows), 250, 4, ["scenario_id"])
    assert {r.point_id: r.cluster_id for r in got.collect()} == dbscan(rows, 250, 4)


@pytest.mark.parametrize(("seed", "gap"), [(1, 180), (2, 246), (3, 254), (4, 330)])
def test_dbscan_of_crowded_cells(spark, seed, gap):
    """Two dense streets about a radius apart, many points at one place, some strays."""
    rng = random.Random(seed)
    lat = 21.9 + gap / 111_195
    rows = [(rng.choice((21.9, lat)), -102.3 + rng.uniform(0, 0.01)) for _ in range(260)]
    rows += [(21.9, -102.3)] * 30 + [(21.9 + rng.uniform(-0.01, 0.02), -102.3 + rng.uniform(-0.01, 0.02)) for _ in range(60)]
    rng.shuffle(rows)
    rows = [(i, *r) for i, r in enumerate(rows)]
    got = cluster.dbscan(points(spark, rows), 250, 4, ["scenario_id"])
    assert {r.point_id: r.cluster_id for r in got.collect()} == dbscan(rows, 250, 4)


@pytest.mark.parametrize("gap", [243, 249.9, 251])
def test_margins_of_crowded_cells(spark, gap):
    """Two crowded places whose nearest points are ``gap`` metres apart, on a slope."""
    rng, rows = random.Random(5), []
    for k in range(800):
        a, b = rng.uniform(0, 1), rng.uniform(0, 1)
        up = (k % 2) * (gap + 30 * a) + (1 - k % 2) * -30 * a
        rows.append((k, 21.9 + (up + 10 * b) / 111_195, -102.3 + b * 30 / 103_000))
    got = cluster.dbscan(points(spark, rows), 250, 4, ["scenario_id"])
    assert {r.point_id: r.cluster_id for r in got.collect()} == dbscan(rows, 250, 4)


def test_numbers_and_places(spark):
    rows = [(k % 3, k * 7919 % 101) for k in range(300)]
    want = {(a, b): n for a in range(3) for n, b in enumerate(sorted({b for x, b in rows if x == a}), 1)}
    df = spark.createDataFrame(sorted(set(rows)), "k int, v int").repartition(5)
    assert {(r.k, r.v): r.n for r in numbered(df, ["k"], ["v"], "n").collect()} == want
    same = points(spark, [(3, 21.9, -102.3), (1, 21.9, -102.3), (2, 21.9, -102.3), (9, None, 1.0)], "stop_id")
    assert sorted(r.stop_id for r in stops.thin(same, 200).collect()) == [1, 9]


def test_dbscan_groups_are_apart(spark):
    rows = cloud(40, 2)
    both = points(spark, rows).union(points(spark, [(i + 1000, a, b) for i, a, b in rows]).withColumn("scenario_id", F.lit(1)))
    got = {r.point_id: r.cluster_id for r in cluster.dbscan(both, 300, 3, ["scenario_id"]).collect()}
    alone = dbscan(rows, 300, 3)
    assert got == alone | {k + 1000: None if v is None else v + 1000 for k, v in alone.items()}


def split(rows, eps, m):
    label, out = dbscan(rows, eps, m), {}
    for c in {v for v in label.values() if v is not None}:
        own = [r for r in rows if label[r[0]] == c]
        mid = (sum(r[1] for r in own) / len(own), sum(r[2] for r in own) / len(own))
        d = [metres(mid, r[1:]) for r in own]
        mean = sum(d) / len(d)
        wide = (sum((x - mean) ** 2 for x in d) / len(d)) ** 0.5 > 0.4 * eps
        if wide and eps in cluster.LADDER and cluster.LADDER.index(eps) > 0:
            out |= split(own, cluster.LADDER[cluster.LADDER.index(eps) - 1], m)
        else:
            out |= dict.fromkeys([r[0] for r in own], c)
    return out | {r[0]: None for r in rows if label[r[0]] is None}


def test_split_and_sweep(spark):
    rows = cloud(120, 3, side=0.05) + [(i + 500, a, b) for i, a, b in cloud(25, 8, side=0.004)]
    assert {r.point_id: r.cluster_id for r in cluster.split_dbscan(points(spark, rows), 1000, 4, ["scenario_id"]).collect()} == split(rows, 1000, 4)
    rest, want = rows, {}
    for k in (500, 1000):
        got = split(rest, k, 4) if rest else {}
        want |= {a: b for a, b in got.items() if b is not None}
        rest = [r for r in rest if got[r[0]] is None]
    got = cluster.sweep(points(spark, rows), 1000, 4, ["scenario_id"], iterations=2)
    assert {r.point_id: r.cluster_id for r in got.collect()} == want | {r[0]: None for r in rest}


@pytest.mark.parametrize("strategy", ["wide", "narrow"])
def test_corridor_edges(spark, strategy):
    rows = [(0, 21.9, -102.3)] + [(i + 1, a, b) for i, a, b in cloud(30, 6, side=0.1, base=(21.85, -102.35))]
    df = points(spark, rows, "node_id")
    delta, share = {"wide": (10.0, 1.0), "narrow": (100.0, 6.0)}[strategy]
    ends = spark.createDataFrame([(i, a, b, 21.9, -102.3) for i, a, b in rows], "src int, lat1 double, lon1 double, lat2 double, lon2 double")
    area = {r.src: [tuple(p) for p in r.area] for r in with_corridor(ends, delta, share).collect()}
    want = {(0, 0)}
    for i, a, b in rows[1:]:
        inside = [r for r in rows if crossings(r[1:], area[i])]
        inside.sort(key=lambda r: (metres((a, b), r[1:]), r[0]))
        want |= {(i, r[0]) for r in inside[1:5]}
    got = graph.candidate_edges(df, 4, strategy)
    assert {(r.src, r.dst) for r in got.collect()} == want


def test_polyline_round_trip(spark):
    rows = [(1, k, a, b) for k, (_, a, b) in enumerate(cloud(20, 9))] + [(2, 0, -0.00001, 179.99999), (2, 1, 0.0, -179.5)]
    df = spark.createDataFrame(rows, "r int, pos int, lat double, lon double")
    lines = shapes.encode_routes(df, ["r"])
    got = {(x.r, x.pos): (x.lat, x.lon) for x in shapes.decode_routes(lines, ["r"]).collect()}
    assert got == {(r, k): (int(a * 1e5) / 1e5, int(b * 1e5) / 1e5) for r, k, a, b in rows}
    known = spark.createDataFrame([("_p~iF~ps|U_ulLnnqC_mqNvxq`@",), (None,), ("_p~",), ("_p~iF",), ("",)], "t string")
    out = [r[0] for r in known.select(shapes.decode_polyline("t")).collect()]
    assert [tuple(p) for p in out[0]] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)] and out[1:] == [None, None, None, []]
    rng, at = random.Random(2), []
    for k in range(700):
        at.append((3, k, rng.uniform(-90, 90), rng.uniform(-180, 180)))
    long = shapes.encode_routes(spark.createDataFrame(at, df.schema), ["r"])
    assert {(x.pos): (x.lat, x.lon) for x in shapes.decode_routes(long, ["r"]).collect()} == {k: (int(a * 1e5) / 1e5, int(b * 1e5) / 1e5) for _, k, a, b in at}


def test_lazy_decay_equals_decay_of_every_edge():
    """The search against one that evaporates all edges in every iteration."""
    import numpy as np

    edges = {a: [(b, float(10 + (a * 7 + b) % 50)) for b in range(12) if b != a] for a in range(1, 12)}
    weight = {a: float(a % 5) for a in range(12)}

    def plain(start, rng, max_nodes=5, iterations=30, ants=6, rho=0.4):
        times = [t for out in edges.values() for _, t in out]
        low, high = routes.STRENGTH / max(times), routes.STRENGTH / min(times)
        tau, numbers = {(a, b): high for a, out in edges.items() for b, _ in out}, iter(rng.random(100_000).tolist())
        best, least = [start], float("inf")
        for _ in range(iterations):
            found = []
            for _ in range(ants):
                tour, total = [start], 0.0
                while tour[-1] != 0 and len(tour) <= 3 * max_nodes:
                    options = [(b, t) for b, t in edges[tour[-1]] if b not in tour]
                    p = [tau[tour[-1], b] for b, _ in options]
                    left = next(numbers) * sum(p)
                    for (b, t), x in zip(options, p):
                        left -= x
                        if left < 0:
                            break
                    tour.append(b)
                    total += t
                people = sum(weight[x] for x in tour)
                found.append((total * (1 if tour[-1] == 0 else 1000) * (abs(max_nodes - len(tour)) + 1) / people if people else float("inf"), tour))
            cost, tour = min(found, key=lambda f: f[0])
            if not least < cost:
                best, least = tour, cost
            tau = {s: min(max(t * (1 - rho), low), high) for s, t in tau.items()}
            for s in zip(tour, tour[1:]):
                tau[s] += 1 / cost
        return best, least

    for start in range(1, 12):
        got = routes._search(edges, weight, start, 0, dict.fromkeys(weight, 1.0), np.random.default_rng(start), 5, 30, 6, 0.4, 1.0, 0.0)
        want = plain(start, np.random.default_rng(start))
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9


def test_routes_are_valid_and_scored(spark):
    nodes = [(0, i, float(i % 5)) for i in range(12)]
    edges = [(0, a, b, float(10 + (a * 7 + b) % 50)) for a in range(1, 12) for b in range(0, a)]
    n = spark.createDataFrame(nodes, "scenario_id int, node_id bigint, weight double")
    e = spark.createDataFrame(edges, "scenario_id int, src bigint, dst bigint, dur_road double")
    s = n.where("node_id in (11, 9)")
    got = routes.plan_routes(e, n, s, iterations=15, ants=6)
    again = routes.plan_routes(e.repartition(3), n.repartition(2), s, iterations=15, ants=6)
    shy = routes.plan_routes(e, n, s, iterations=15, ants=6, avoid=n.where("node_id % 2 = 1"))
    assert not {r.node_id for r in shy.where("pos > 0").collect()} & set(range(1, 12, 2)) and shy.where("node_id = 0").count() == 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    known = {(a, b) for _, a, b, _ in edges}
    for t in (0, 1):
        path = [r.node_id for r in got.where(F.col("tour_id") == t).orderBy("pos").collect()]
        assert path[0] == (9, 11)[t] and path[-1] == 0 and all(p in known for p in zip(path, path[1:]))
    scored = {r.tour_id: r.fitness for r in routes.fitness(got, e, n, 5, ["scenario_id"]).collect()}
    for r in got.collect():
        assert scored[r.tour_id] == pytest.approx(r.fitness)


def test_one_node_tour_and_plant_only_tour(spark):
    n = spark.createDataFrame([(0, 0, 0.0), (0, 1, 3.0)], "scenario_id int, node_id bigint, weight double")
    e = spark.createDataFrame([], "scenario_id int, src bigint, dst bigint, dur_road double")
    t = spark.createDataFrame([(0, 1, 0, 1), (0, 2, 0, 0)], "scenario_id int, tour_id bigint, pos int, node_id bigint")
    assert {r.tour_id: r.fitness for r in routes.fitness(t, e, n, 5, ["scenario_id"]).collect()} == {1: 0.0, 2: None}
    assert {r.tour_id: r.fitness for r in routes.fitness(t, e, n, 5, ["scenario_id"], require_complete=True).collect()} == {1: None, 2: None}


def test_stop_plan_covers_and_does_not_mix_scenarios(spark):
    people = points(spark, cloud(80, 11), "person_id")
    at = points(spark, cloud(3, 12), "stop_id")
    one, given = cluster.propose_stops(people, at, 500, 4)
    other = people.withColumns({"scenario_id": F.lit(1), "person_id": F.col("person_id") + 1000})
    two, both = cluster.propose_stops(people.union(other), at, 500, 4)
    keys = ["source", F.round("lat", 9), F.round("lon", 9), "people"]
    assert sorted(map(tuple, one.select(*keys).collect())) == sorted(map(tuple, two.where("scenario_id = 0").select(*keys).collect()))
    assert min(r.people for r in one.collect()) >= 4
    assert given.count() <= both.count()


def test_postal_codes(spark):
    df = spark.createDataFrame([(1, "20000"), (2, None), (3, "2000"), (4, "ABCDE"), (5, "99999")], "person_id int, postal_code string")
    directory = spark.createDataFrame([(3, "20000", 1.0, 2.0, "b"), (1, "20000", 5.0, 6.0, "a"), (2, "2000", 7.0, 8.0, "c"), (4, None, 1.0, 1.0, "d")], "idx bigint, cp string, lat double, lon double, address string")
    got = {r.person_id: (r.good_zip_code, r.lat, r.has_coords) for r in clean.geocode(clean.flag_postal_code(df), directory).collect()}
    assert got == {1: (True, 5.0, True), 2: (False, None, False), 3: (False, None, False), 4: (False, None, False), 5: (True, None, False)}


def test_responses_with_nothing(spark):
    df = spark.createDataFrame([(1, '{"rows":[]}'), (2, "{}"), (3, None), (4, '{"rows":[{"elements":[{"status":"X"}]}]}')], "req int, body string")
    assert [tuple(r) for r in responses.matrix_cells(df).collect()] == [(4, 0, 0, None, None)]
    assert [r.duration for r in responses.matrix_cells(df, sentinel=True).collect()] == [2**63 - 1]


def test_files(spark, tmp_path):
    (tmp_path / "way1.csv").write_text(",departure,duration,arrival\n0,06:30,0:58,07:28\n1,x,1:03,\n")
    (tmp_path / "way2.csv").write_text(",departures,durations,arrivals\n0,23:30,1:00,00:30\n")
    got = sorted((r.file, r.idx, r.departure_min, r.duration_min, r.arrival_min) for r in tables.read_timetable(spark, str(tmp_path / "*.csv")).collect())
    assert got == [("way1.csv", 0, 390, 58, 448), ("way1.csv", 1, None, 63, None), ("way2.csv", 0, 1410, 60, 30)]
    (tmp_path / "r.json").write_text('[{"route_id":1,"stops":[{"coords":[1.0,2.0]},{"coords":[3.0,4.0]}]},{"route_id":2,"stops":[]}]')
    assert [tuple(r) for r in stops.stops_of_routes(tables.read_routes(spark, str(tmp_path / "r.json"))).collect()] == [(1, 0, 1.0, 2.0)]


def test_store_rewrites_what_it_must(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(s, f"{c:05d}", 1.0, 2.0, "x", c) for s in (1, 2, 3) for c in range(4)]
    groups = spark.createDataFrame(rows, "scenario_id int, cp string, lat double, lon double, address string, count bigint")
    tables.append_groups(groups, path, "one")
    tables.append_groups(groups, path, "one")
    tables.append_groups(groups.where("scenario_id = 2 and cp = '00003'"), path, "two")
    read = lambda: sorted((r.scenario_id, r.upload, r.cp) for r in tables.read_groups(spark, path).collect())
    assert read() == sorted([(s, "one", c) for s, c, *_ in rows] + [(2, "two", "00003")])
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    before = files()
    listed = spark.createDataFrame([("00003",), ("99999",)], "cp string").where("cp is not null")
    assert tables.remove_groups(spark, path, spark.createDataFrame([("no such",)], "cp string"), "cp") == 0 and files() == before
    assert tables.remove_groups(spark, path, listed, "cp") == 4
    assert read() == sorted((s, "one", c) for s, c, *_ in rows if c != "00003")
    before = files()
    assert tables.remove_groups(spark, path, spark.createDataFrame([(2,)], "scenario_id int"), "scenario_id") == 1
    assert files() == {f: t for f, t in before.items() if "scenario_id=2" not in str(f)}
    tables.replace_groups(groups.where("scenario_id = 1 and cp = '00001'"), path)
    assert [(s, c) for s, _, c in read()] == [(1, "00001"), *[(3, f"{c:05d}") for c in range(3)]]


def test_replayed_batch_adds_nothing(spark, tmp_path):
    from shuttleplan.streaming import headcount

    people = spark.createDataFrame([(1, k, f"2000{k % 3}") for k in range(12)], "scenario_id int, person_id bigint, postal_code string")
    people.repartition(3).write.parquet(str(tmp_path / "in"))
    directory = spark.createDataFrame([(k, f"2000{k}", 21.9, -102.3, "x") for k in range(3)], "idx bigint, cp string, lat double, lon double, address string")
    box, path = [(21.0, -103.0), (21.0, -102.0), (22.5, -102.0), (22.5, -103.0), (21.0, -103.0)], str(tmp_path / "store")
    stream = lambda: spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    headcount.store_groups(stream(), directory, box, path, str(tmp_path / "check")).awaitTermination()
    once = sorted(tuple(r) for r in tables.read_groups(spark, path).groupBy("cp").agg(F.sum("count")).collect())
    assert once == [(f"2000{k}", 4) for k in range(3)]
    # the last batch was stored, but its end was not noted: it runs again after the restart
    max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda f: int(f.name)).unlink()
    for crc in (tmp_path / "check" / "commits").glob(".*.crc"):
        crc.unlink()
    headcount.store_groups(stream(), directory, box, path, str(tmp_path / "check")).awaitTermination()
    assert sorted(tuple(r) for r in tables.read_groups(spark, path).groupBy("cp").agg(F.sum("count")).collect()) == once


def test_stream_equals_batch(spark, tmp_path):
    from shuttleplan.streaming.headcount import enrich

    rows = spark.createDataFrame([(1, "20000"), (2, None), (3, "77")], "person_id int, postal_code string")
    rows.write.parquet(str(tmp_path / "in"))
    directory = spark.createDataFrame([(1, "20000", 1.0, 2.0, "a")], "idx bigint, cp string, lat double, lon double, address string")
    poly = [(0.0, 0.0), (4.0, 1.0), (3.0, 5.0), (-2.0, 4.0), (0.0, 0.0)]
    flow = enrich(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), directory, poly)
    q = flow.writeStream.format("memory").queryName("enriched").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("enriched").collect())) == sorted(map(tuple, enrich(rows, directory, poly).collect()))


def test_scratch_tables_can_be_released(spark):
    from shuttleplan.functions.scratch import materialize, release

    release(spark)
    df = materialize(spark.range(5))
    assert df.count() == 5
    assert release(spark) == 1 and release(spark) == 0


def test_temporary_tables_go_and_kept_ones_stay(spark):
    from shuttleplan.functions.scratch import materialize, release, temporary

    release(spark)
    before = materialize(spark.range(3))
    with temporary(spark) as keep:
        inner = materialize(spark.range(5))
        kept = keep(inner.where("id > 1"))
    assert before.count() == 3 and kept.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        inner.count()
    assert release(spark) == 2


def test_weighted_pick_rounds_once(spark):
    # 0.1 + 0.7 is less than 0.8 in doubles, 8 / 10 is not
    rows = [(1, pos, p, 0.8) for pos, p in enumerate([1.0, 7.0, 2.0], 1)] + [(2, 1, 1.0, 0.6), (2, 2, 1.0, 0.6), (3, 1, 0.0, 0.5), (3, 2, 0.0, 0.5)]
    got = routes.weighted_pick(spark.createDataFrame(rows, "o int, pos int, p double, r double"), ["o"])
    assert {r.o: r.pos for r in got.collect()} == {1: 2, 2: 2}


@pytest.mark.parametrize("base", [(21.9, -102.3), (60.0, 179.99), (-0.01, -179.995), (88.9, 10.0)])
def test_nearest_within_is_the_least_pair(spark, base):
    rng = random.Random(8)
    wrap = lambda x: (x + 180) % 360 - 180
    spot = lambda: (base[0] + rng.uniform(0, 0.05), wrap(base[1] + rng.uniform(0, 0.05)))
    b = [(i, *spot()) for i in range(40)]
    b += [(100 - i, *b[i][1:]) for i in range(5)] + [(200, None, 1.0)]
    a = [(i, *spot()) for i in range(60)] + [(90 + i, *b[i][1:]) for i in range(4)] + [(99, None, None), (98, -base[0], 0.0)]
    want = {}
    for x in a:
        if x[1] is not None:
            found = [(near(x[1:], y[1:]), y[0]) for y in b if y[1] is not None and near(x[1:], y[1:]) <= 700]
            want |= {x[0]: min(found)[1]} if found else {}
    got = spatial.nearest_within(points(spark, a, "person_id"), points(spark, b, "stop_id"), 700, ["scenario_id"], "person_id", "stop_id").collect()
    assert {r.person_id: r.stop_id for r in got} == want and len(got) == len(want)


def test_a_crowd_forms_few_pairs(spark):
    """Of 150 points among 150 probes within the radius, each looks only around itself."""
    a, b = cloud(150, 3, side=0.005), cloud(150, 4, side=0.005)
    spots = points(spark, b, "_b").withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    pairs = spatial._near_pairs(points(spark, a, "_a"), spots, 1, 2000, ["scenario_id"])
    assert 150 <= pairs.count() < 150 * 150 / 3


@pytest.mark.parametrize("base", [(21.9, -102.3), (60.0, 179.99), (-0.01, -179.995), (88.9, 10.0)])
@pytest.mark.parametrize("n", [1, 3])
def test_enough_probes_near(spark, base, n):
    rng = random.Random(9)
    wrap = lambda x: (x + 180) % 360 - 180
    spot = lambda side: (base[0] + rng.uniform(0, side), wrap(base[1] + rng.uniform(0, side)))
    b = [(i, *spot(0.05)) for i in range(25)] + [(30 + i, *spot(0.006)) for i in range(15)]
    b += [(60 + i, *b[3][1:]) for i in range(3)] + [(200, None, 1.0)]
    a = [(i, *spot(0.05)) for i in range(60)] + [(60 + i, *spot(0.006)) for i in range(10)] + [(99, None, None)]
    want = {x[0] for x in a if x[1] is not None and sum(near(x[1:], y[1:]) <= 700 for y in b if y[1] is not None) >= n}
    people, probes = points(spark, a, "person_id"), points(spark, b, "stop_id")
    got = spatial.with_enough(people, probes, n, 700, ["scenario_id"], "person_id").collect()
    rest = spatial.with_enough(people, probes, n, 700, ["scenario_id"], "person_id", negated=True).collect()
    assert sorted(r.person_id for r in got) == sorted(want) and sorted(r.person_id for r in rest) == sorted({x[0] for x in a} - want)


def test_points_of_a_crowd_need_no_pairs(spark, monkeypatch):
    seen = []
    whole = spatial._near_pairs
    monkeypatch.setattr(spatial, "_near_pairs", lambda a, *more: seen.append(a.count()) or whole(a, *more))
    people, probes = points(spark, cloud(300, 5, side=0.005), "person_id"), points(spark, cloud(300, 6, side=0.005), "stop_id")
    assert spatial.near_any(people, probes, 2000, ["scenario_id"], "person_id", "stop_id").count() == 300 and seen == [0]


@pytest.mark.parametrize("base", [(21.9, -102.3), (-0.01, -179.995)])
def test_balanced_within_is_the_scan_of_pairs(spark, base):
    """Blocks, stops at one place and the date line, against the scan over the table of pairs."""
    rng = random.Random(10)
    wrap = lambda x: (x + 180) % 360 - 180
    spot = lambda: (base[0] + rng.uniform(0, 0.03), wrap(base[1] + rng.uniform(0, 0.03)))
    b = [(i, *spot()) for i in range(20)] + [(99, None, 1.0)]
    b += [(40 - i, *b[i][1:]) for i in range(9)]
    a = [(i, *spot()) for i in range(70)] + [(80, None, None), (81, 0.0, 50.0)]
    people, at = points(spark, a, "person_id"), points(spark, b, "stop_id")
    want = stops.assign_balanced(spatial.radius_join(people, at, 700, ["scenario_id"], "person_id", "stop_id")).collect()
    for block in (stops.BLOCK, 9):
        got = stops.assign_balanced_within(people, at, 700, ["scenario_id"], block=block).collect()
        assert sorted((r.person_id, r.stop_id, r.distance_m) for r in got) == sorted((r.person_id, r.stop_id, r.distance_m) for r in want)


@pytest.mark.parametrize("base", [(21.9, -102.3), (-0.01, -179.995)])
def test_people_within_are_the_pairs(spark, base):
    rng = random.Random(11)
    wrap = lambda x: (x + 180) % 360 - 180
    spot = lambda: (base[0] + rng.uniform(0, 0.05), wrap(base[1] + rng.uniform(0, 0.05)))
    a, b = [(i, *spot()) for i in range(50)] + [(50, 0.0, 60.0), (51, None, 1.0)], [(i, *spot()) for i in range(90)]
    want = {x[1:]: n for x in a if x[1] is not None and (n := sum(near(x[1:], y[1:]) <= 700 for y in b))}
    got = stops.people_within(points(spark, a, "stop_id"), points(spark, b, "person_id"), 700, ["scenario_id"]).collect()
    assert {(r.lat, r.lon): r.people for r in got} == want and len(got) == len(want)


def test_hot_cells_get_no_more_parts_than_pairs_ask_for(spark, monkeypatch):
    """The probes of a cell go to every part of it, so a cell is dealt into fewer parts if these would hold few pairs."""
    on, rows = ["_row", "_col"], [(i, 0, 0) for i in range(60)]
    a, b = (spark.createDataFrame(rows, f"{name} bigint, _row bigint, _col bigint") for name in ("_a", "_b"))
    for pairs, parts in ((2**24, 1), (1200, 3), (1, 12)):
        monkeypatch.setattr(spatial, "PART_PAIRS", pairs)
        assert spatial._split_hot(a, b, on, 5)[1].count() == 60 * parts
    near_ones = points(spark, cloud(60, 3), "person_id"), points(spark, cloud(60, 4), "stop_id")
    both = [spatial.radius_join(*near_ones, 700, ["scenario_id"], "person_id", "stop_id", hot=hot).drop("distance_m") for hot in (None, 5)]
    assert sorted(both[0].collect()) == sorted(both[1].collect())
