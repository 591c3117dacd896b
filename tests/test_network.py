import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.plain_lines import hop_m
from lanewright.functions.geo import polyline_m
from lanewright.operators import features, many, network, paths, routes, snapping, tracks
from lanewright.operators.paths import Network, search

LANE = "uid string, lane_ord long, points array<struct<lon:double,lat:double,z:double,timestamp:string>>, successor_uid array<string>, predecessor_uid array<string>"


def lanes_of(spark, rows):
    """rows: uid -> (points, successors, predecessors)."""
    df = spark.createDataFrame([(u, i, [(float(x), float(y), None, None) for x, y in pts], s, q) for i, (u, (pts, s, q)) in enumerate(rows.items())], LANE)
    return df.withColumns({"length_m": polyline_m(F.col("points")), "start_point": F.element_at("points", 1), "end_point": F.element_at("points", -1)})


def d(a, b):
    return hop_m({"lon": a[0], "lat": a[1]}, {"lon": b[0], "lat": b[1]})


def test_topology(spark):
    rows = {"1": ([(0, 0), (0.001, 0)], ["2", "9", "2"], []), "2": ([(0.001, 0), (0.002, 0)], ["2"], ["1", "3"]), "3": ([(0.5, 0.5)], [], ["8"])}
    own = lanes_of(spark, rows)
    got = {(r["src"], r["dst"]): r["weight"] for r in network.topology_edges(network.declared_links(own), own).collect()}
    assert set(got) == {("1", "2"), ("2", "2"), ("3", "2")} and got["1", "2"] == pytest.approx(d((0.001, 0), (0.002, 0)))


@pytest.mark.parametrize("lon,lat", [(110, 40), (-60, -20), (0, 0), (25, 68)])
def test_grid_join_equals_all_pairs(spark, lon, lat):
    rng = random.Random(int(lon))
    at = lambda: (lon + rng.uniform(-0.01, 0.01), lat + rng.uniform(-0.005, 0.005))
    rows = {str(i): ([at(), at()], [], []) for i in range(150)}
    got = {(r["src"], r["dst"]) for r in network.proximity_pairs(lanes_of(spark, rows), 100.0).collect()}
    assert got == {(a, b) for a in rows for b in rows if a != b and d(rows[a][0][-1], rows[b][0][0]) <= 100.0} and got


def textbook(edges, source):
    """Repeated relaxation, no heap; predecessors by cost, then text."""
    cost = {source: 0.0}
    for _ in range(len(edges)):
        for (u, v), w in edges.items():
            if u in cost and cost[u] + w < cost.get(v, float("inf")):
                cost[v] = cost[u] + w
    before = {v: min((cost[u], u) for (u, x), w in edges.items() if x == v and u in cost and cost[u] + w == c)[1] for v, c in cost.items() if v != source}
    return cost, before


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("1 10 2 9 30 a".split()), st.sampled_from("1 10 2 9 30 a".split())), st.integers(1, 4), max_size=20))
def test_search_against_textbook(edges):
    net = Network.of(pa.table({"src": [u for u, _ in edges] + ["1"], "dst": [v for _, v in edges] + ["1"], "weight": [float(w) for w in edges.values()] + [9.0]}))
    cost, before = search(net, net.number("1"))
    name = net.names.__getitem__
    assert ({name(v): c for v, c in cost.items()}, {name(v): name(u) for v, u in before.items()}) == textbook(edges, "1") and net.number("zz") is None


def test_both_ways_agree(spark):
    rng = random.Random(4)
    edges = {(str(rng.randint(0, 40)), str(rng.randint(0, 40))): float(rng.randint(1, 5)) for _ in range(140)}
    df = spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "src string, dst string, weight double")
    sources = spark.createDataFrame([("0",), ("7",)], "src string")
    sent = {(r["src"], r["dst"]): (r["cost"], r["pred"]) for r in paths.from_sources(df, sources).collect()}
    costs = paths.distances(df, sources)
    joined = {(r["src"], r["dst"]): (r["cost"], r["pred"]) for r in paths.predecessors(df, costs).collect()}
    assert sent == joined and len(sent) > 20
    with pytest.raises(ValueError):
        paths.predecessors(df.withColumn("weight", F.lit(0.0)), costs)
    pairs = spark.createDataFrame([("0", "0"), ("0", "none"), ("0", "5")], "src string, dst string")
    found = {r["dst"]: r for r in paths.paths(df, pairs).collect()}
    assert found["0"]["path"] == ["0"] and found["0"]["cost"] == 0.0 and "none" not in found


@pytest.mark.parametrize("least", [1, 0])
def test_large_networks_give_the_same_rows(spark, monkeypatch, least):
    rng = random.Random(9 + least)
    edges = {(str(rng.randint(0, 30)), str(rng.randint(0, 30))): float(rng.randint(least, 3)) for _ in range(90)}
    df = spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "src string, dst string, weight double")
    sources = spark.createDataFrame([("0",), ("7",), ("none",)], "src string")
    pairs = spark.createDataFrame([(s, str(t)) for s in ("0", "7", "none") for t in range(30)] + [("none", "none"), ("0", "5")], "src string, dst string")
    small = sorted(paths.from_sources(df, sources).collect(), key=str), sorted(paths.paths(df, pairs).collect(), key=str)
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    assert (sorted(paths.from_sources(df, sources).collect(), key=str), sorted(paths.paths(df, pairs).collect(), key=str)) == small
    assert len(small[0]) > 30 and max(len(r["path"]) for r in small[1]) > 2


def test_searches_are_dealt_to_tasks(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1), 1.0) for i in range(50)], "src string, dst string, weight double")
    pairs = spark.createDataFrame([(str(i), "50") for i in range(40)], "src string, dst string")
    assert len(paths.paths(edges, pairs).groupBy(F.spark_partition_id()).count().collect()) > 1
    assert len(paths.from_sources(edges, pairs.select("src")).groupBy(F.spark_partition_id()).count().collect()) > 1


def test_proximity_over_the_antimeridian_and_the_poles(spark):
    rng = random.Random(5)
    places = [(179.9995, 0.0), (-179.9995, 0.0), (180.0, 10.0), (-180.0, 10.0), (10.0, 89.9999), (-170.0, 89.9999), (100.0, 89.9995), (3.0, 89.99), (3.004, 89.99), (50.0, -89.9999), (-130.0, -89.9999), (0.0, 90.0), (77.0, 90.0), (20.0, 60.0), (20.001, 60.0005)]
    for lat in (0.0, 45.0, 70.0, 85.0, 89.0, 89.9, 89.99, -89.99, 89.999):
        for lon in (0.0, 179.9995, -179.9995):
            wide = 0.0012 / max(math.cos(math.radians(lat)), 1e-5)
            places += [((lon + rng.uniform(-wide, wide) + 180) % 360 - 180, max(-90.0, min(90.0, lat + rng.uniform(-0.0012, 0.0012)))) for _ in range(8)]
    own = lanes_of(spark, {str(i): ([p, rng.choice(places)], [], []) for i, p in enumerate(places)})
    rows = {r["uid"]: r for r in own.collect()}
    point = lambda x: (x["lon"], x["lat"])
    want = {(a, b) for a in rows for b in rows if a != b and d(point(rows[a]["end_point"]), point(rows[b]["start_point"])) <= 100}
    assert {(r["src"], r["dst"]) for r in network.proximity_pairs(own, 100.0).collect()} == want and len(want) > 100


def test_parts_and_reach():
    import pyarrow as pa

    rng = random.Random(11)
    for n, m in ((1, 1), (12, 14), (40, 60), (40, 200), (300, 320)):
        edges = sorted({(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)})
        net = paths.Network.of(pa.table({"src": [a for a, _ in edges], "dst": [b for _, b in edges], "weight": [1.0] * len(edges)}))
        names, after = net.names, {}
        for a, b in edges:
            after.setdefault(a, []).append(b)
        reach = {}
        for a in names:
            seen, todo = {a}, [a]
            while todo:
                for b in after.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            reach[a] = seen
        part, _ = net.parts
        assert all((part[i] == part[j]) == (b in reach[a] and a in reach[b]) for i, a in enumerate(names) for j, b in enumerate(names))
        masks = net.reaching(list(range(len(names))))
        assert all(bool(masks[part[i]] >> j & 1) == (b in reach[a]) for i, a in enumerate(names) for j, b in enumerate(names))
    chain = pa.table({"src": [str(i) for i in range(50_000)], "dst": [str(i + 1) for i in range(50_000)], "weight": [1.0] * 50_000})
    assert len(paths.Network.of(chain).parts[1]) == 50_001


def test_large_boxes_and_long_lanes_take_few_cells(spark):
    box = spark.createDataFrame([("stray", 0.0, 0.0, 40.0, 110.0), ("small", 40.0, 110.0, 40.001, 110.001)], "k string, south double, west double, north double, east double")
    vertices = spark.createDataFrame([(1, 20.0, 20.0), (2, 110.0005, 40.0005), (3, -1.0, 5.0)], "f int, lon double, lat double")
    assert sorted(map(tuple, features.met_by_boxes(vertices, ["f"], box, ["k"]).collect())) == [("small", 2), ("stray", 1)]
    own = lanes_of(spark, {"long": ([(100, 30), (110, 40)], [], []), "near": ([(105, 35.0001), (105.0001, 35.0001)], [], [])})
    assert snapping.posted(snapping.segments(own)).count() <= 8
    points = spark.createDataFrame([(1, 105.0, 35.0), (2, 100.0, 30.0)], "q int, lon double, lat double")
    got = {(r["q"], r["rank"]): r["uid"] for r in snapping.nearest_lanes(points, own, ["q"], 2).collect()}
    assert got[1, 1] == "long" and got[2, 1] == "long" and len(got) == 4


def test_projection_cases(spark):
    rows = {"a": ([(0, 0), (0.001, 0), (0.001, 0), (0.001, 0.001)], [], []), "p": ([(0.0005, 0.0005)], [], []), "far": ([(50, 50), (51, 51)], [], [])}
    own = lanes_of(spark, rows)
    points = spark.createDataFrame([(1, 0.0005, 0.0001), (2, -0.001, 0.0), (3, 0.0011, 0.0011), (4, -120.0, -40.0)], "q int, lon double, lat double")
    got = {(r["q"], r["uid"]): r for r in snapping.nearest_lanes(points, own, ["q"], 3).collect()}
    assert len(got) == 12 and all(r["offset_m"] + r["remain_m"] == pytest.approx(r["lane_length_m"], abs=1e-6) for r in got.values())
    assert got[1, "a"]["rank"] == 1 and got[1, "a"]["segment_index"] == 0 and got[1, "a"]["offset_m"] == pytest.approx(d((0, 0), (0.0005, 0)), rel=1e-6)
    assert got[2, "a"]["offset_m"] == 0 and got[3, "a"]["remain_m"] == pytest.approx(0)
    assert got[1, "p"]["snap_dist_m"] == pytest.approx(d((0.0005, 0.0001), (0.0005, 0.0005))) and got[1, "p"]["offset_m"] == 0


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(6)
    at = lambda: (10 + rng.uniform(0, 0.05), 50 + rng.uniform(0, 0.05))
    own = lanes_of(spark, {str(i): ([at(), at()], [], []) for i in range(60)})
    points = spark.createDataFrame([(i, *at()) for i in range(25)], "q int, lon double, lat double")
    near = snapping.nearest_lanes(points, own, ["q"], 4).select("q", "rank", "uid").collect()
    every = snapping.project(points.crossJoin(snapping.segments(own)), ["q", "lon", "lat"]).select("q", "snap_dist_m", "lane_ord", "uid").collect()
    want = {}
    for r in sorted(every, key=lambda r: (r["snap_dist_m"], r["lane_ord"])):
        want.setdefault(r["q"], []).append(r["uid"])
    assert sorted((r["q"], r["rank"], r["uid"]) for r in near) == sorted((q, i + 1, u) for q, us in want.items() for i, u in enumerate(us[:4]))


def test_stray_points_equal_all_pairs_and_meet_few_segments(spark, monkeypatch):
    rng = random.Random(8)
    lines = {f"{i}-{j}": ([(110 + i / 1000, 40 + j * 8e-4), (110 + (i + 0.9) / 1000, 40 + j * 8e-4)], [], []) for i in range(20) for j in range(60)}
    lines |= {"long": ([(109, 39), (112, 43)], [], []), "one": ([(110.01, 40.01)], [], []), "over": ([(-179.9, 10), (-179.8, 10)], [], []), "pole": ([(20, 89.9)], [], [])}
    own = lanes_of(spark, lines)
    stray = [(0.001 * i, 0.0) for i in range(40)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(60)] + [(179.99, 10.0), (110.01, 40.0101), (110.5, 40.02), (0.0, 90.0), (-180.0, -90.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(stray)], "q int, lon double, lat double")
    met = []
    whole = snapping.descended
    monkeypatch.setattr(snapping, "descended", lambda *a: met.append((whole(*a), a[1])) or met[-1][0])
    near = snapping.nearest_lanes(points, own, ["q"], 4).select("q", "rank", "uid").collect()
    every = snapping.project(points.crossJoin(snapping.segments(own)), ["q", "lon", "lat"]).select("q", "snap_dist_m", "lane_ord", "uid").collect()
    want = {}
    for r in sorted(every, key=lambda r: (r["snap_dist_m"], r["lane_ord"])):
        want.setdefault(r["q"], []).append(r["uid"])
    assert sorted((r["q"], r["rank"], r["uid"]) for r in near) == sorted((q, i + 1, u) for q, us in want.items() for i, u in enumerate(us[:4]))
    cells, parts = met[0]
    assert cells.join(parts, snapping.CELL).count() < 100 * len(stray)


def test_objective_wins_over_graph_cost_and_backward_is_dropped(spark):
    rows = {
        "1": ([(0, 0), (0.002, 0)], ["2"], []), "2": ([(0.002, 0), (0.004, 0)], [], []),
        "3": ([(0, 0.0003), (0.004, 0.0003)], [], []),
    }
    own = lanes_of(spark, rows)
    links = network.declared_links(own)
    net = network.edges(links, own)
    ends = spark.createDataFrame([("x", 0.0005, 0.0, 0.0035, 0.0), ("back", 0.0035, 0.0, 0.0005, 0.0)], "k string, origin_lon double, origin_lat double, destination_lon double, destination_lat double")
    found = routes.candidates(ends, own, ["k"])
    ways = paths.paths(net, found.select(F.col("o_uid").alias("src"), F.col("d_uid").alias("dst")).distinct())
    rows_ = routes.metrics(found, ways, own, routes.jumps(net, links, own)).collect()
    for r in rows_:
        assert r["total_m"] == pytest.approx(r["lane_m"] + r["jump_m"] + r["snap_m"]) and r["objective_m"] == pytest.approx(r["lane_m"] + 10 * r["jump_m"] + 5 * r["snap_m"])
        assert not (r["k"] == "back" and len(r["path"]) == 1)
    best = {r["k"]: r for r in routes.plan(ends, own, links, net, ["k"]).collect()}
    assert best["x"]["path"] == ["1", "2"] and best["x"]["jump_m"] == 0 and best["x"]["tried_count"] >= 2
    parts = routes.visible(routes.plan(ends.filter("k = 'x'"), own, links, net, ["k"]), own, ["k"])
    line = routes.visible_line(parts, ["k"]).first()["points"]
    assert [x["lon"] for x in line] == pytest.approx([0.0005, 0.002, 0.002, 0.0035]) and parts.count() == 2


def test_features_and_tracks(spark):
    vertices = spark.createDataFrame([(1, 0.0, 0.0), (1, 5.0, 5.0), (2, 3.0, 3.0), (3, -9.0, 2.0), (3, 9.0, 2.0)], "f int, lon double, lat double")
    boxes = spark.createDataFrame([("a", 1.0, 1.0, 3.0, 3.0), ("b", -0.1, -0.1, 0.0, 0.0)], "k string, south double, west double, north double, east double")
    assert sorted(map(tuple, features.met_by_boxes(vertices, ["f"], boxes, ["k"]).collect())) == [("a", 2), ("b", 1)]  # 3 only crosses
    points = spark.createDataFrame([(1, 0, 1.0, 1.0, None), (1, 1, None, 1.0, 9.0), (2, 0, 1.0, 1.0, 3.0)], "t int, i int, lon double, lat double, speed double")
    assert {r["t"]: r["max_speed"] for r in tracks.top_speeds(points, ["t"]).collect()} == {1: None, 2: 3.0}
    assert {r["t"]: r["length_m"] for r in tracks.lengths(points.filter("lon is not null"), ["t"], "i").collect()} == {1: 0.0, 2: 0.0}


def test_of_a_large_network_only_what_sources_reach_is_searched(spark, monkeypatch):
    far = [(f"x{i}", f"x{i + 1}", 1.0) for i in range(40)]
    near = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("a", "c", 3.0), ("x7", "a", 1.0)]
    df, pairs = spark.createDataFrame(far + near, "src string, dst string, weight double"), spark.createDataFrame([("a", "c"), ("a", "x7"), ("b", "a"), ("gone", "gone")], "src string, dst string")
    ways, costs = sorted(map(tuple, paths.paths(df, pairs).collect())), sorted(paths.from_sources(df, pairs.select("src")).collect(), key=str)
    monkeypatch.setattr(paths, "MOST_EDGES", 4)
    monkeypatch.setattr(paths, "joined", lambda *_: pytest.fail("the whole network was relaxed"))
    assert sorted(map(tuple, paths.paths(df, pairs).collect())) == ways and [w[:3] for w in ways] == [("a", "c", 3.0), ("b", "a", 3.0), ("gone", "gone", 0.0)]
    assert sorted(paths.from_sources(df, pairs.select("src")).collect(), key=str) == costs
    assert paths.reached(df, spark.createDataFrame([("x7",)], "src string")) is None


def test_tasks_of_one_trip_are_planned_once(spark, monkeypatch):
    own = lanes_of(spark, {"1": ([(110, 40), (110.001, 40)], ["2"], []), "2": ([(110.001, 40), (110.002, 40)], [], [])})
    links, trip = network.declared_links(own), (110.0001, 40.0, 110.0019, 40.0)
    ends = spark.createDataFrame([("a", *trip), ("b", *trip), ("c", *trip[:3], 40.0001)], "k string, origin_lon double, origin_lat double, destination_lon double, destination_lat double")
    asked, candidates = [], routes.candidates

    def counted(trips, *rest):
        asked.append(trips.count())
        return candidates(trips, *rest)

    monkeypatch.setattr(routes, "candidates", counted)
    rows = {r["k"]: r for r in routes.plan(ends, own, links, network.edges(links, own), ["k"]).collect()}
    assert asked == [2] and sorted(rows) == ["a", "b", "c"]
    assert rows["a"].asDict() | {"k": "b"} == rows["b"].asDict() and rows["a"]["path"] == ["1", "2"] and rows["c"]["total_m"] > rows["a"]["total_m"]


def test_counted_by_boxes_keeps_no_pairs(spark, monkeypatch):
    rng, size = random.Random(5), [0.0005, 0.004, 0.03, 2.0]
    vertices = [(f, None if rng.random() < 0.05 else rng.randrange(40) / 1000, rng.randrange(40) / 1000) for f in range(60) for _ in range(rng.randint(1, 5))]
    vertices += [(f + 100, lon, lat) for f, lon, lat in vertices]  # the same shapes again
    boxes = []
    for k in range(80):
        south, west = rng.randrange(-10, 40) / 1000, rng.randrange(-10, 40) / 1000
        boxes.append((k, south, west, south + rng.choice(size), west + rng.choice(size)))
    boxes += [(k + 100, *sides) for k, *sides in boxes]
    v, b = spark.createDataFrame(vertices, "f long, lon double, lat double"), spark.createDataFrame(boxes, "k long, south double, west double, north double, east double")
    want = {}
    for k, south, west, north, east in boxes:
        met = {f for f, lon, lat in vertices if lon is not None and south <= lat <= north and west <= lon <= east}
        if met:
            want[k] = (len(met), min(met))
    rows = features.counted_by_boxes(v, "f", b, ["k"])
    assert {r["k"]: (r["features"], r["first"]) for r in rows.collect()} == want and 0 < len(want) < len(boxes)
    pairs = {(r["k"], r["f"]) for r in features.met_by_boxes(v, ["f"], b, ["k"]).collect()}
    assert len(pairs) == sum(n for n, _ in want.values())


def test_many_sources_together(spark, monkeypatch):
    """Costs and predecessors among many ties, from groups and parts of groups, are those of a search from each source."""
    rng = random.Random(5)
    rows = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}"): float(rng.randrange(1, 4)) for _ in range(170)} | {(f"m{i}", f"m{i + 1}"): 2.0 for i in range(30)}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "src string, dst string, weight double")
    sources = spark.createDataFrame([(f"{c}{i}",) for i in range(60) for c in "nm"] + [("n1",)], "src string")
    seen = lambda how: sorted(map(tuple, how.collect()), key=str)
    want = seen(paths.from_sources(df, sources))
    assert len(want) > 1000
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    for together, dealt in ((96, 88), (7, 20)):
        monkeypatch.setattr(many, "TOGETHER", together)
        monkeypatch.setattr(many, "DEALT", dealt)
        assert seen(paths.from_sources(df, sources)) == want
        assert seen(paths.from_sources(df, sources, preds=False).drop("pred")) == sorted((r[:3] for r in want), key=str)
    network, name = many.Incoming.of(df), lambda x: None if x is None else network.names[x].as_py()
    for costs, looked in ((8 * 3 * 90, 4), (1, 1)):  # three sources at a time, or one
        monkeypatch.setattr(many, "COSTS", costs)
        monkeypatch.setattr(many, "LOOKED", looked)
        found = many.ways(network, list(range(len(network.names))), True)
        rows = [(name(s), name(v), c, name(u)) for s, nodes, cost, before in found for v, c, u in zip(nodes.tolist(), cost.tolist(), before.to_pylist(), strict=True)]
        assert sorted(rows, key=str) == [r for r in want if r[0] in set(network.names.to_pylist())]
    monkeypatch.setattr(paths, "MOST_SENT", 0)
    assert seen(paths.from_sources(df, sources)) == want


def test_long_ways_of_a_large_network_take_no_rounds(spark, monkeypatch):
    """over a network of more than MOST_EDGES edges each lane of the longest way took a round of joins."""

    def never(*_):
        raise AssertionError("a round per lane of a way")

    monkeypatch.setattr(paths, "MOST_EDGES", 100)
    monkeypatch.setattr(paths, "distances", never)
    monkeypatch.setattr(paths, "reached", never)
    both = [(f"{i}", f"{j}", 1.0) for i in range(3000) for j in (i - 1, i + 1) if 0 <= j < 3000]
    got = paths.from_sources(spark.createDataFrame(both, "src string, dst string, weight double"), spark.createDataFrame([("0",), ("2999",)], "src string"))
    rows = {(r["src"], r["dst"]): (r["cost"], r["pred"]) for r in got.collect()}
    assert len(rows) == 6000 and rows["0", "2999"] == (2999.0, "2998") and rows["2999", "0"] == (2999.0, "1") and rows["0", "0"] == (0.0, None)
