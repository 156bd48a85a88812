"""The engine against worked examples: graphs, spaces, forces, steps, metrics, hierarchies, files, runs."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import spaces, vectors
from graphloom.functions.random import geometric_skip, sample, uniform, unit_vector
from graphloom.operators import algorithms, coarsen, metrics, pairs, step, trace
from graphloom.operators.graph import Graph, consecutive, dense
from graphloom.operators.run import DisplacementMonitor, Embedder, LayeredEmbedder, LossMonitor, Options, Schedule, Timer, embed
from graphloom.sources import files, generators, sinks

SMALL = [(0, 1), (1, 2), (2, 3), (3, 4), (1, 3), (2, 4)]


def graph(spark, edges):
    return Graph.from_edges(spark.createDataFrame(edges, "src int, dst int"))


def points(spark, rows, weights=None):
    d = len(rows[0])
    w = weights or [1.0] * len(rows)
    return spark.createDataFrame([(i, *map(float, r), float(w[i])) for i, r in enumerate(rows)], "id int, " + ", ".join(f"p{k} double" for k in range(d)) + ", w double")


def values(df, *cols):
    return {r[0]: tuple(r[1:]) if len(r) > 2 else r[1] for r in df.select(*cols).collect()}


def test_graph_construction(spark):
    empty = graph(spark, [])
    assert (empty.n, empty.m) == (0, 0)
    loop = Graph.from_adjacency(spark.createDataFrame([(0, [0])], "id int, nbrs array<int>"))
    assert (loop.n, loop.m) == (1, 0)
    lone = Graph.from_adjacency(spark.createDataFrame([(0, [])], "id int, nbrs array<int>"))
    assert (lone.n, lone.m) == (1, 0)
    path = Graph.from_adjacency(spark.createDataFrame([(0, [1]), (1, [0, 2]), (2, [1])], "id int, nbrs array<int>"))
    assert (path.n, path.m) == (3, 2)
    assert values(path.degrees(), "id", "deg") == {0: 1, 1: 2, 2: 1}
    assert values(path.neighbours(), "id", "nbrs")[1] == [0, 2]
    g = graph(spark, [(0, 1), (1, 2), (0, 3), (0, 3), (3, 0), (0, 4), (7, 7)])
    assert (g.n, g.m) == (8, 4) and g.no_gaps()
    assert {tuple(r) for r in g.canonical().collect()} == {(0, 1), (1, 2), (0, 3), (0, 4)}
    assert [tuple(r) for r in g.edge_ids().orderBy("eid").collect()] == [(k, *e) for k, e in enumerate(sorted([(0, 1), (0, 3), (0, 4), (1, 0), (1, 2), (2, 1), (3, 0), (4, 0)]))]


def test_components_and_paths(spark):
    g = graph(spark, [(0, 1), (1, 2), (3, 4)])
    assert values(g.components(), "id", "comp") == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}
    assert not g.is_connected()
    big, mapping = graph(spark, [(4, 5), (0, 1), (1, 2), (5, 6)]).largest_component()
    assert (big.n, big.m) == (3, 2) and values(mapping, "old", "new") == {0: 0, 1: 1, 2: 2}
    h = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (4, 5), (4, 6), (5, 6)])
    assert [values(algorithms.shortest_paths(h, 0), "id", "dist")[i] for i in range(7)] == [0, 1, 1, 2, 2, 3, 3]
    assert [values(algorithms.shortest_paths(h, 2), "id", "dist")[i] for i in range(7)] == [1, 1, 0, 1, 1, 2, 2]
    assert values(algorithms.shortest_paths(g, 0), "id", "dist")[4] == -1
    assert algorithms.all_pairs(g).count() == 25


def test_long_chain_components(spark):
    chain = graph(spark, [(i, i + 1) for i in range(60)] + [(70, 71)])
    comp = values(chain.components(), "id", "comp")
    assert {comp[i] for i in range(61)} == {0} and comp[70] == comp[71] == 10


@pytest.mark.parametrize(("most", "rounds"), [(1 << 22, False), (0, True)])
def test_components_of_a_held_graph_take_no_rounds(spark, monkeypatch, most, rounds):
    from graphloom.plans import components

    taken, stars = [], components._stars
    monkeypatch.setattr(components, "HELD", most, raising=False)
    monkeypatch.setattr(components, "_stars", lambda *a, **b: taken.append(1) or stars(*a, **b))
    ids = scattered(90)
    edges = [(ids[i], ids[i + 1]) for i in range(40)] + [(ids[50], x) for x in ids[51:70]] + [(ids[80], ids[80]), (ids[3], None), (None, ids[85]), (ids[71], ids[70]), (ids[70], ids[71])]
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3))
    want = {x: min(part) for part in (ids[:41], ids[50:70], ids[70:72]) for x in part}
    assert [(r.id, r.component) for r in got.orderBy("id").collect()] == sorted(want.items())
    assert bool(taken) == rounds
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def scattered(n):
    """Distinct signed 64-bit ids in no order."""
    return [(k * 0x9E3779B97F4A7C15 + 12345) % 2**64 - 2**63 for k in range(n)]


def test_least_reachable_by_hand():
    import numpy as np

    from graphloom.plans.components import least_reachable

    draw = np.random.default_rng(3)
    for n, m in ((1, 0), (30, 12), (200, 150), (200, 600), (500, 499)):
        u, v = draw.integers(-n, n, m), draw.integers(-n, n, m)
        if m == n - 1:  # a chain of shuffled names
            name = draw.permutation(n)
            u, v = name[:-1], name[1:]
        least = {int(x): int(x) for x in np.r_[u, v]}
        for _ in least:
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                least[a] = least[b] = min(least[a], least[b])
        ids, found = least_reachable(u, v)
        assert dict(zip(ids.tolist(), found.tolist(), strict=True)) == least and len(ids) == len(least)


def test_coarsening(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (4, 5), (4, 6), (5, 6)])
    cl = spark.createDataFrame(list(enumerate([0, 0, 1, 2, 3, 3, 3])), "id int, cluster int")
    coarse, edge_map = coarsen.coarsen(g, cl)
    assert (coarse.n, coarse.m) == (4, 3) and values(coarse.degrees(), "id", "deg") == {0: 1, 1: 3, 2: 1, 3: 1}
    inside = values(g.edge_ids().join(edge_map, "eid"), F.struct("src", "dst"), "coarse_eid")
    of = [0, 0, 1, 2, 3, 3, 3]
    assert all((c == -1) == (of[k.src] == of[k.dst]) for k, c in inside.items())
    weights = {(r.src, r.dst): r.w for r in coarsen.coarse_weights(g.edges.withColumn("w", F.lit(1.0)), cl).collect()}
    assert weights[0, 1] == 2 and weights[1, 3] == 1


def test_hierarchy_and_labels(spark):
    layers = coarsen.hierarchy(graph(spark, SMALL))
    assert len(layers) == 2
    assert set(values(layers[0].parents, "id", "cluster").values()) == {0} and values(layers[1].parents, "id", "cluster") == {0: -1}
    ring = graph(spark, [(i, (i + 1) % 40) for i in range(40)])
    deep = coarsen.hierarchy(ring, propagate=coarsen.sequential_labels)
    sizes = list(coarsen.sizes(deep))
    assert sizes[0] == 40 and sizes[-1] == 1 and all(a > b for a, b in zip(sizes, sizes[1:], strict=False))
    nodes, children = coarsen.layer_tables(deep)
    assert nodes.where("layer = 0").count() == 40 and children.where("layer = 1").agg(F.sum(F.size("children"))).first()[0] == 40
    with pytest.raises(RuntimeError, match="layers"):
        coarsen.hierarchy(ring, most=0, propagate=coarsen.sequential_labels)


def test_label_propagation(spark):
    # two cliques of five, joined by an edge, and a chain of three
    edges = [(a, b) for k in (0, 5) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(10, 11), (11, 12)]
    g = graph(spark, [*edges, (4, 5)])
    weighted = g.edges.withColumn("w", F.lit(1.0))
    out = [values(coarsen.label_propagation(Graph(g.nodes.repartition(n), g.edges), weighted.repartition(n), sweeps=2, capacity=3), "id", "cluster") for n in (2, 5)]
    assert out[0] == out[1] and 1 < max(list(out[0].values()).count(c) for c in out[0].values()) <= 3
    seq = values(coarsen.sequential_labels(g, weighted), "id", "cluster")
    assert len(seq) == 13 and max(list(seq.values()).count(c) for c in seq.values()) <= 7
    assert len(values(coarsen.sequential_labels(g, weighted, order="random", seed=3), "id", "cluster")) == 13


def test_aggressive_merge_pairs_lone_vertices(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1)], "src int, dst int"), spark.createDataFrame([(5,)], "id int"))
    got = values(coarsen.aggressive_merge(g, g.edges.withColumn("w", F.lit(1.0)), None), "id", "cluster")
    assert got[2] == got[3] and got[4] == got[5] and got[2] != got[4]


def test_weights_and_buckets(spark):
    g = graph(spark, SMALL)
    w = step.rescaled(step.degree_weights(g), 2)
    assert [round(values(w, "id", "w")[i], 6) for i in range(5)] == [0.416667, 1.25, 1.25, 1.25, 0.833333]
    assert [round(x, 6) for x in pairs.weight_buckets(w)] == [0.833333]
    cls = values(w.select("id", pairs.weight_class(F.col("w"), pairs.weight_buckets(w)).alias("c")), "id", "c")
    assert cls == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}
    assert [round(x, 6) for x in pairs.class_maxima(w, pairs.weight_buckets(w))] == [0.833333, 1.25]


LINE = [(i, 0) for i in range(5)]
SQUARE = [(0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5), (0.25, 0.9)]


def laid_out(spark, rows):
    g = graph(spark, SMALL)
    return g, points(spark, rows).drop("w").join(step.rescaled(step.degree_weights(g), 2), "id")


def test_forces_on_a_line(spark):
    g, p = laid_out(spark, LINE)
    row = step.losses(g, p).first()
    assert (round(row.attractive, 6), row.repulsive) == (4.015383, 0)
    f = values(step.forces(g, p), "id", "f0", "f1")
    assert [round(f[i][0], 6) for i in range(5)] == [1.385641, -0.585641, 0.979796, -0.8, -0.979796]


def test_forces_and_one_adam_step_on_a_square(spark):
    g, p = laid_out(spark, SQUARE)
    assert round(step.losses(g, p).first().repulsive, 6) == 0.645625
    acting = step.forces(g, p)
    f = values(acting, "id", "f0", "f1")
    assert [tuple(round(x, 6) + 0 for x in f[i]) for i in range(5)] == [(-0.979796, -2.365437), (0.262236, -0.944051), (0.979796, 0.979796), (0, 1.385641), (-0.262236, 0.944051)]
    e = Embedder(g, Options(dimension=2), positions=p.select("id", "p0", "p1"))
    e.step()
    got = values(e.state, "id", "p0", "p1")
    want = [(-0.7475, -0.977), (0.7475, -0.977), (0.7475, 0.518), (-0.25, 0.518), (-0.4975, 0.918)]
    assert all(abs(a - b) < 1e-6 for i in range(5) for a, b in zip(got[i], want[i], strict=True))
    assert round(e.trace[0][7], 6) == 0.678517 and round(e.trace[0][6], 4) == 0.4975


def test_coincident_vertices_part(spark):
    g = graph(spark, [(0, 1)])
    f = values(step.forces(g, points(spark, [(0, 0), (0, 0)])), "id", "f0", "f1")
    assert all(abs(math.hypot(*f[i]) - 1) < 1e-9 for i in (0, 1)) and f[0] != f[1]


def test_spaces(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3], [0.3, -0.1, 0.2])], "id int, a array<double>, b array<double>")
    a, b = spaces.spread(F.col("a"), 3), spaces.spread(F.col("b"), 3)
    want = {"euclidean": 0.374166, "infnorm": 0.3, "dot": -0.07, "cosine": -0.5, "poincare": 0.844806, "weighted": 0.296976, "weighted_inf": 0.23811, "weighted_nodim": 0.187083, "additive": 0.15714}
    row = df.select(*[spaces.similarity(s, a, b, F.lit(4.0), F.lit(0.5)).alias(s) for s in want]).first()
    assert {s: round(row[s], 6) for s in want} == want
    r = df.select(spaces.mercator_s1(F.lit(0.5), F.lit(6.0), F.lit(2.0), F.lit(3.0)), spaces.mercator_sd(a, b, F.lit(2.0), F.lit(3.0)), spaces.mercator_sd(a, a, F.lit(2.0), F.lit(2.0)), spaces.similarity("cosine", [F.lit(0.0)], [F.lit(1.0)])).first()
    assert (round(r[0], 6), round(r[1], 6), r[2]) == (3.186969, 3.673619, 0) and math.isnan(r[3])
    with pytest.raises(ValueError):
        spaces.similarity("none", a, b)


def test_vector_helpers(spark):
    one = spark.range(1)
    a, b = [F.lit(1.0), F.lit(1.0)], [F.lit(-1.0), F.lit(1.5)]
    r = one.select(*vectors.plus(a, vectors.scaled(b, 3)), *vectors.inf_normed([F.lit(0.5), F.lit(-2.0)]), *vectors.norm_gradient(a, a), vectors.max_index(b)).first()
    assert tuple(r) == (-2, 5.5, 0, -1, 0, 0, 1)
    t = spark.createDataFrame([("",), ("a,,b,",)], "s string").select(vectors.tokens(F.col("s"))).collect()
    assert [x[0] for x in t] == [[], ["a", "", "b", ""]]
    assert one.select(vectors.map_text(F.create_map(F.lit("k"), F.lit(1), F.lit("a"), F.lit(2)))).first()[0] == "a: 2, k: 1"
    assert tuple(one.select(*vectors.hsv_to_rgb(F.lit(120.0), F.lit(1.0), F.lit(1.0))).first()) == (0, 255, 0)


def test_radius_queries(spark):
    p = spark.createDataFrame([(0, 0.5, 2.0, 3.0), (2, 0.0, 1.0, 3.0), (1, 0.0, 1.0, 0.0)], "id int, p0 double, p1 double, p2 double")
    q = spark.createDataFrame([(0, 0.0, 1.5, 3.1, 1.0), (1, 0.0, 1.5, 3.1, 0.5), (2, 0.5, 0.0, 4.0, 1.7)], "qid int, p0 double, p1 double, p2 double, radius double")
    for theta in (100, 0):
        assert {tuple(r) for r in pairs.within(p, q, theta=theta).collect()} == {(0, 0), (0, 2), (2, 2)}


@pytest.mark.parametrize("d", [1, 2, 4])
def test_grid_join_equals_theta_join(spark, d):
    rows = spark.range(400).select(F.col("id").cast("int").alias("id"), *[(uniform(1, F.col("id"), k) * 6 - 3).alias(f"p{k}") for k in range(d)], F.pow(2.0, uniform(2, F.col("id")) * 5 - 2).alias("w"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = [{tuple(r) for r in pairs.weighted_within(rows, 0.4, theta=t).select("a_id", "b_id").collect()} for t in (1000, 0)]
    assert got[0] == got[1] and len(got[0]) > 50


def test_metrics(spark):
    g = graph(spark, [(0, 1), (1, 2)])
    good, bad = points(spark, [(0, 0), (1, 0), (2, 0)]), points(spark, [(0, 0), (3, 0), (1, 0)])
    none = 1
    for p, deg, m, pr, f1 in ((good, 1, 1, 1, 1), (bad, 1 / 3, 2 / 3, 2 / 3, 0.8)):
        r = metrics.reconstruction(metrics.node_scores(metrics.ranked(g, p))).first()
        assert abs(r.construct_deg - deg) < 1e-9 and abs(r.map - m) < 1e-9
        s = metrics.f1_sweep(metrics.pair_sample(g, p, scale=1), g.m, none).first()
        assert abs(s.precision - pr) < 1e-9 and s.recall == 1 and abs(s.f1 - f1) < 1e-9
    assert tuple(graph(spark, [(i, i + 1) for i in range(4)]).info().first()) == (5, 4)
    assert metrics.evaluate(g, good, nodes=3).first().edge_f1 == 1


def test_sampled_pairs_are_non_edges(spark):
    g = graph(spark, [(i, (i + 1) % 80) for i in range(80)])
    p = points(spark, [(i, 0) for i in range(80)])
    for chance in (0.1, 0.5, 0.9):
        got = [tuple(r) for r in pairs.non_edges(g, p, p=chance, seed=3).select("a_id", "b_id").collect()]
        assert len(set(got)) == len(got) and all(a < b and (b - a) % 80 not in (1, 79) for a, b in got)
        assert abs(len(got) - chance * 3080) < 4.5 * math.sqrt(3080 * chance * (1 - chance))
        again = pairs.non_edges(Graph(g.nodes.repartition(7), g.edges), p, p=chance, seed=3).select("a_id", "b_id").collect()
        assert sorted(map(tuple, again)) == sorted(got)
    assert pairs.jumps(g.nodes, 80, 0.0, 1).count() == 0
    assert pairs.negative_candidates(g, 3, 1, 1).count() > 100


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    p = points(spark, [(uniform_point(i, 0), uniform_point(i, 1)) for i in range(90)])
    g = graph(spark, [(i, (i + k) % 90) for i in range(90) for k in (1, 3)])
    got = [[sorted(map(tuple, x.collect())) for x in (pairs.nearest(p, p, 3, theta=t), pairs.non_edges(g, p, theta=t).select("a_id", "b_id"))] for t in (1000, 20)]
    assert got[0] == got[1] and len(got[0][0]) == 270
    whole = metrics.reconstruction(metrics.node_scores(metrics.ranked(g, p, digits=9))).first()
    monkeypatch.setattr(pairs.against, "__defaults__", (20,))
    assert all(abs(a - b) < 1e-12 for a, b in zip(whole, metrics.reconstruction(metrics.node_scores(metrics.ranked(g, p, digits=9))).first(), strict=True))
    a = [{tuple(r) for r in pairs.weighted_within(p, 0.05, theta=t, additive=True).select("a_id", "b_id").collect()} for t in (1000, 0)]
    assert a[0] == a[1] and len(a[0]) > 20


def uniform_point(i, k):
    return (i * (37 + 22 * k) % 91) / 91


def test_ranges_are_drawn_once(spark):
    """Partition numbers of a range partitioning that two branches use, where nothing reuses an exchange."""
    n = 30_000
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = spark.range(n).select(F.col("id").alias("t"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("v")).repartition(5)
        v = [r.v for r in rows.orderBy("t").collect()]
        want = sorted((a, b) for a, b in zip(v, v[1:], strict=False) if a != b)
        assert sorted(map(tuple, consecutive(rows, "v", ["t"]).collect())) == want
        pair = spark.range(n).select(F.round(uniform(1, F.col("id")), 3).alias("similarity"), F.col("id").cast("int").alias("v"), F.lit(0).alias("w"), (uniform(2, F.col("id")) < 0.3 / (1 + 4 * uniform(1, F.col("id")))).alias("is_edge"))
        got = metrics.f1_sweep(pair, 4000, 20_000).first()
        seen = sorted(pair.collect())
        seen.sort(key=lambda r: (r.similarity, r.is_edge, r.v, r.w))
        m, f = sum(r.is_edge for r in seen), sum(not r.is_edge for r in seen)
        best, e = (0.0,), 0
        for k, r in enumerate(seen, 1):
            e += r.is_edge
            if e:
                tp, fp = e / m * 4000, (k - e) / f * 20_000
                precision, recall = tp / (tp + fp), e / m
                best = max(best, (2 / (1 / precision + 1 / recall), precision, recall), key=lambda x: x[0])
        assert abs(got.f1 - best[0]) < 1e-12 and abs(got.precision - best[1]) < 1e-9 and abs(got.recall - best[2]) < 1e-9
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_monitors_and_schedules(spark):
    m = LossMonitor(1e-2, 2, 0.3, 2)
    seen = []
    for x in (100, 90, 85, 84, 83.9, 83.9):
        m.observe(x)
        seen.append((round(m.smoothed, 4), m.rate if math.isinf(m.rate) else round(m.rate, 6)))
    assert [s for s, _ in seen] == [100, 97, 93.4, 90.58, 88.576, 87.1732]
    assert [r for _, r in seen] == [math.inf, math.inf, 0.066, 0.066186, 0.051649, 0.037611]
    t = trace.smoothed(spark.createDataFrame(list(enumerate([100.0, 90.0, 85.0, 84.0, 83.9, 83.9])), "t int, loss double"))
    assert [round(r.rate, 6) for r in trace.rates(t, 2).orderBy("t").collect()][2:] == [0.066, 0.066186, 0.051649, 0.037611]
    assert [r.patience for r in trace.patience(trace.rates(t, 2), 0.06).orderBy("t").collect()] == [0, 0, 0, 0, 1, 2]
    d = DisplacementMonitor(0.1, 2)
    for x in (0.2, 0.05, 0.01):
        d.observe(x)
    assert d.converged
    o = Options(lr_schedule="adaptive", lr_adapt_patience=2, warmup_steps=0, learning_rate=8)
    s = Schedule(o, m := LossMonitor(0, 1, 1, 1))
    rates = []
    for x in (10, 10, 10, 10, 10, 10):
        rates.append(s.at(len(rates) + 1))
        m.observe(x)
    assert rates == [8, 8, 8, 4, 4, 2]


def test_a_part_of_the_vertices_pushes(spark):
    g = graph(spark, [(i, (i + 1) % 60) for i in range(60)])
    p = points(spark, [(uniform_point(i, 0), uniform_point(i, 1)) for i in range(60)])
    whole = step.repulsion(g, p)
    part = step.repulsion(g, p, step.Forces(index_size=0.1, seed=5, iteration=1)).cache()
    assert part.select("other").distinct().count() == 6 < whole.select("other").distinct().count() and part.select("id").distinct().count() > 50
    assert part.join(whole, ["id", "other"], "left_anti").isEmpty()
    other = step.repulsion(g, p, step.Forces(index_size=0.1, seed=5, iteration=2))
    assert {r.other for r in part.select("other").distinct().collect()} != {r.other for r in other.select("other").distinct().collect()}


def test_bands_run_along_the_main_axis(spark):
    p = points(spark, [(0.001 * uniform_point(i, 0), 5 * i + uniform_point(i, 1)) for i in range(90)])
    mean, axis = pairs.main_axis(p.repartition(4))
    assert abs(abs(axis[1]) - 1) < 1e-3 and abs(mean[1] - 223) < 2
    q = p.select(F.col("id").alias("qid"), "p0", "p1", (F.col("id") % 7 * 3.0).alias("radius"))
    assert {tuple(r) for r in pairs.within(p, q, theta=0).collect()} == {tuple(r) for r in pairs.within(p, q).collect()}


def test_timer_is_a_tree():
    t = Timer()
    with t.phase("a"):
        with t.phase("a1"):
            pass
        with t.phase("a2"), t.phase("a2I"):
            pass
    with t.phase("b"):
        pass
    with t.phase("c"), t.phase("c1"):
        pass
    assert [(d, n) for d, n, _ in t.rows()] == [(0, "a"), (1, "a1"), (1, "a2"), (2, "a2I"), (0, "b"), (0, "c"), (1, "c1")]
    assert t.text().splitlines()[1].startswith("   +- ")


def ring(spark):
    return graph(spark, [(v, (v + k) % 64) for v in range(64) for k in (1, 7)])


def test_runs_are_the_same_on_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(step, "BLOCK", 16)  # several blocks even here
    out, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            g = graph(spark, [(v, (v + k) % 150) for v in range(150) for k in (1, 7, 31)] + [(v, 0) for v in range(2, 40)])
            e = Embedder(Graph(g.nodes.repartition(n), g.edges.repartition(n)), Options(dimension=2, seed=1234, max_iterations=2))
            e.run()
            out.append((values(e.state, "id", "p0", "p1", "w"), e.loss, e.trace[-1][2:]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] == out[2]


def test_optimizers_modes_and_stops(spark):
    g = ring(spark)
    e = Embedder(g, Options(dimension=2, optimizer="simple", centre=0.1, additive_weights=True, max_iterations=1))
    assert e.run().count() == 64 and e.finished and e.trace_table().count() == 1
    e.reset()
    n = Embedder(g, Options(dimension=2, negative_samples=4, stop="displacement", stop_displacement_tol=1e9, stop_displacement_patience=1))
    n.run()
    assert n.iteration == 1
    assert embed(graph(spark, [(0, 0)]), Options(dimension=2)).count() == 1


def test_layered_run(spark):
    e = LayeredEmbedder(graph(spark, [(i, (i + 1) % 14) for i in range(14)]), Options(dimension=2, max_iterations=1))
    assert len(e.layers) >= 3 and e.run().count() == 14 and e.finished


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "g.edg").write_text("# a comment\n# m=7\n0 1\n1 2\n2 3 extra\n3 4\n1 3\n2 4\n")
    g = files.read_edge_list(spark, f"{tmp_path}/g.edg")
    assert (g.n, g.m) == (5, 6)
    sinks.write_edge_list(g, f"{tmp_path}/out")
    assert files.read_edge_list(spark, f"{tmp_path}/out").m == 6
    (tmp_path / "bad.edg").write_text("0 1\n\n")
    with pytest.raises(Exception, match="two ids"):
        files.read_edge_list(spark, f"{tmp_path}/bad.edg").edges.collect()
    assert files.read_edge_list(spark, f"{tmp_path}/bad.edg", skip_invalid=True).m == 1
    (tmp_path / "b.txt").write_text("#psizes 2 3\n0 2\n1 4\n")
    assert values(files.read_bipartite(spark, f"{tmp_path}/b.txt").nodes, "id", "color") == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
    (tmp_path / "c.csv").write_text("% note\n1,0.5,2\n0,1,3\n1,0.25,7\n")
    pos = files.read_coordinates(spark, f"{tmp_path}/c.csv")
    assert values(files.split_last(pos), "id", "pos", "w") == {0: ([1.0], 3.0), 1: ([0.25], 7.0)}
    sinks.write_coordinates(files.split_last(pos), f"{tmp_path}/coords")
    assert values(files.read_coordinates(spark, f"{tmp_path}/coords"), "id", "pos") == {0: [1.0, 3.0], 1: [0.25, 7.0]}
    assert values(files.parse_embedding("mercator", spark.createDataFrame([(1, [9.0, 1.5, 2.5])], "id int, pos array<double>")), "id", "pos", "radius") == {1: ([1.5], 2.5)}
    (tmp_path / "run.log").write_text("start\n> seed=3\n> dim(default)=4\nother > x=1\n")
    assert values(files.read_config(spark, f"{tmp_path}/run.log"), "name", "value") == {"seed": "3", "dim": "4"}
    (tmp_path / "run.csv").write_text("seed,dim\n3,4\n")
    assert values(files.read_config(spark, f"{tmp_path}/run.csv", "csv"), "name", "value") == {"seed": "3", "dim": "4"}
    (tmp_path / "time").write_text("1.5\n")
    assert files.read_time(spark, f"{tmp_path}/time").first().value == "1.5" and files.read_time(spark, "") is None
    xy = pos.select("id", F.get("pos", 0).alias("x"), F.get("pos", 1).alias("y"))
    sinks.write_drawing(sinks.svg(spark, graph(spark, [(0, 1)]), xy), f"{tmp_path}/svg")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/svg").collect()]
    assert lines[0].startswith("<svg") and lines[-1] == "</svg>" and len(lines) == 5
    assert sinks.metrics_text(graph(spark, [(0, 1)]).info()) == "num_nodes,num_edges\n2,1"


def test_random_graphs(spark):
    g, p = generators.random_disc_graph(spark, 1500, seed=2)
    assert abs(2 * g.m / g.n - 20) < 3 and g.n > 1400 and p.count() == g.n
    h, _ = generators.girg(spark, 300, degree=10, seed=4)
    assert h.n == 300 and abs(2 * h.m / h.n - 10) < 1
    cold, half = generators.girg(spark, 100, degree=6, temperature=0, torus=False, seed=4)
    assert cold.m > 100 and half.agg(F.max("p0")).first()[0] <= 0.5
    part, kept = generators.girg(spark, 100, degree=3, temperature=0, seed=4, largest=True)
    assert part.is_connected() and part.n == kept.count() < 100 and kept.agg(F.max("id")).first()[0] == part.n - 1


def test_hash_randomness(spark):
    df = spark.range(4000)
    r = df.select(F.avg(uniform(1, F.col("id"))), F.min(uniform(1, F.col("id"))), F.max(uniform(1, F.col("id"))), F.avg(geometric_skip(0.25, 1, F.col("id")))).first()
    assert abs(r[0] - 0.5) < 0.03 and r[1] >= 0 and r[2] < 1 and abs(r[3] - 3) < 0.4
    u = df.select(spaces.sq_norm(unit_vector(3, 1, F.col("id")))).agg(F.min("*")) if False else df.select(spaces.sq_norm(unit_vector(3, 1, F.col("id"))).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert abs(u[0] - 1) < 1e-9 and abs(u[1] - 1) < 1e-9
    assert sorted(x.id for x in sample(df, 5, 7).collect()) == sorted(x.id for x in sample(df.repartition(9), 5, 7).collect())


def test_numbering_and_neighbours_in_order(spark):
    got = values(dense(spark.createDataFrame([(9,), (3,), (9,), (200000,)], "k long"), "k", "n"), "k", "n")
    assert got == {3: 0, 9: 1, 200000: 2}
    rows = spark.createDataFrame([(t, (t * 7) % 5) for t in range(200)], "t int, v int").repartition(6)
    want = sorted((a * 7 % 5, b * 7 % 5) for a, b in zip(range(199), range(1, 200), strict=True))
    assert sorted(tuple(r) for r in consecutive(rows, "v", ["t"]).collect()) == want


def test_every_query_has_a_schema_and_the_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70
    row = e.entry(spark).collect()
    assert len(row) == 1 and row[0].attractive > 0


def by_search(n, edges):
    """Distances of every vertex from every origin, -1 if unreachable, by a queue."""
    near = {v: set() for v in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for origin in range(n):
        dist, queue = {origin: 0}, [origin]
        for v in queue:
            for u in near[v] - set(dist):
                dist[u] = dist[v] + 1
                queue.append(u)
        out |= {(origin, v): dist.get(v, -1) for v in range(n)}
    return out


def test_component_queries_take_all_orders(spark, tmp_path):
    import __spark_entry__ as e

    orders = {1: [1, 2], 2: [2, 3, 3], 39: [5, 6], 40: [6, 7], 41: [9], 83: [10, 12, 14]}
    spark.createDataFrame([(o, p) for o, ps in orders.items() for p in ps], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 16)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    pairs = {(a, b) for ps in orders.values() for a in ps for b in ps if a < b}
    dist = by_search(16, pairs)
    least = [min(u for u in range(16) if dist[v, u] >= 0) for v in range(16)]
    comp = [sorted(set(least)).index(x) for x in least]
    run = lambda name: e.queries()[name](spark, str(tmp_path))
    assert values(run("components"), "id", "comp") == dict(enumerate(comp))
    assert values(run("component_sizes"), "comp", "size") == {c: comp.count(c) for c in comp}
    assert tuple(run("component_count").first()) == (len(set(comp)), False)
    assert {tuple(r) for r in run("largest_component").collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_all_pairs_query_starts_from_every_vertex(spark, tmp_path):
    import __spark_entry__ as e

    walks = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [13, 12, 13]]
    users = [u for walk in walks for u in walk]
    spark.createDataFrame([(t, u, t, "purchase") for t, u in enumerate(users)] + [(99, 14, 99, "view")], "event_id long, user_id long, ts long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = by_search(14, list(zip(users, users[1:], strict=False)))
    got = {(r.origin, r.id): r.dist for r in e.queries()["all_pairs_bfs"](spark, str(tmp_path)).collect()}
    assert got == want and max(want.values()) > 6 and len(got) == 14 * 14


def test_sphere_query_takes_three_components_and_a_radius(spark):
    import __spark_entry__ as e

    x = {r.vec_id: list(map(float, r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    want = {}
    for i in x.keys() & {k - 1 for k in x}:
        a, b = x[i], x[i + 1]
        cosine = sum(p * q for p, q in zip(a[:3], b[:3], strict=True)) / (math.hypot(*a[:3]) * math.hypot(*b[:3]))
        c, r, s = max(-1.0, min(1.0, cosine)), 1 + a[3], 1 + b[3]
        want[i] = math.acosh(max(1.0, 0.5 * ((1 - c) * math.cosh(r + s) + (1 + c) * math.cosh(r - s))))
    got = values(e.queries()["sim_mercator_sd"](spark, "/root/testdata/sf0.001"), "id", "similarity")
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def tied(spark, n=40):
    """Points with many equal distances, some of the vertices without a point."""
    edges = [(i, (i * k + 1) % n) for i in range(n) for k in (2, 5)] + [(i, n) for i in range(0, n, 3)]
    return graph(spark, edges), points(spark, [(i % 7, i % 3) for i in range(n)]).repartition(5)


def shuffled(df):
    """What exchanges of a plan deal out by hash or range, of those whose rows are pairs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange" in x and "similarity" in x]


def test_ranks_need_no_shuffle_of_pairs(spark, monkeypatch):
    g, p = tied(spark)
    got = metrics.ranked(g, p, digits=9)
    scores = metrics.vertex_scores(g, p, digits=9)
    assert not shuffled(got) and "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")[0]
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")[0]
    got, scores = sorted(map(tuple, got.collect())), values(scores, "v", "deg", "deg_precision", "average_precision")
    near = {}
    for a, b in map(tuple, g.edges.collect()):
        near.setdefault(a, set()).add(b)
    at = {r.id: (r.p0, r.p1) for r in p.collect()}
    want = []
    for v in near.keys() & at:
        hits = 0
        for rk, (s, x) in enumerate(sorted((round(math.dist(at[v], at[x]), 9), x) for x in at if x != v), 1):
            hits += x in near[v]
            want.append((v, x, s, int(x in near[v]), len(near[v]), rk, hits, hits / rk, hits / len(near[v])))
    assert got == sorted(want)
    again = values(metrics.node_scores(metrics.ranked(g, p, digits=9)), "v", "deg", "deg_precision", "average_precision")
    assert again.keys() == scores.keys() and all(abs(x - y) < 1e-12 for v in again for x, y in zip(again[v], scores[v], strict=True))
    monkeypatch.setattr(metrics, "HELD", 0)
    assert sorted(map(tuple, metrics.ranked(g, p, digits=9).collect())) == got
    assert values(metrics.vertex_scores(g, p, digits=9), "v", "deg") == {v: s[0] for v, s in scores.items()}


def test_scores_meet_points_held_as_arrays(spark, monkeypatch):
    """No pair is a row of Spark's; equal to the join of pairs, with whole numbers and without."""
    g, p = tied(spark)
    for digits in (9, None):
        got = metrics.vertex_scores(g, p, digits=digits)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as few:
            few.setattr(metrics, "near_points", lambda *_: None)
            want = metrics.vertex_scores(g, p, digits=digits)
            assert "NestedLoop" in want._jdf.queryExecution().executedPlan().toString()
            want = sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, got.collect())) == want and len(want) == 40
    wide, lost = points(spark, [(i * 1e12, 0) for i in range(40)]), p.withColumn("p0", F.when(F.col("id") != 3, F.col("p0")))
    assert metrics.near_points(wide, "euclidean", 9) is None and metrics.near_points(lost, "euclidean", 9) is None and metrics.near_points(p, "dot", 9) is None


def test_f1_counts_non_edges_where_they_are_made(spark, monkeypatch):
    g, p = tied(spark)
    pairs_ = metrics.pair_sample(g, p, scale=1e9, digits=9)
    none = pairs_.where("not is_edge")
    assert not shuffled(none) and "Exchange" not in none._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")[0]
    got = tuple(metrics.f1_sweep(pairs_, g.m, 500).first())
    monkeypatch.setattr(metrics, "STEPS", 0)
    assert got == pytest.approx(tuple(metrics.f1_sweep(pairs_, g.m, 500).first()), abs=1e-12) and got[2] > 0
    monkeypatch.undo()
    empty = spark.createDataFrame([], pairs_.schema)
    assert tuple(metrics.f1_sweep(empty, 0, 0).first()) == (None, None, None)
    assert tuple(metrics.f1_sweep(pairs_.where("not is_edge"), 0, 5).first()) == (0, 0, 0)


def test_f1_of_all_pairs_makes_no_rows_of_them(spark, monkeypatch):
    """As the query's SQL: sums aren't scaled where edges lack a point, and the first of equal rounded F1 wins, also among equal gaps."""
    g, p = tied(spark)
    monkeypatch.setattr(metrics, "pair_sample", None)
    monkeypatch.setattr(metrics, "STRIDE", 2)
    monkeypatch.setattr(metrics, "CELLS", 50)
    near = {tuple(r) for r in g.canonical().select("src", "dst").collect()}
    at = {r.id: (r.p0, r.p1) for r in p.collect()}
    seen = sorted((round(math.dist(at[v], at[w]), 9), (v, w) in near, v, w) for v in at for w in at if v < w)
    for places in (10, 1):
        tp, all_ = 0, []
        for k, r in enumerate(seen, 1):
            tp += r[1]
            precision, recall = tp / k, tp / len(near)
            all_.append((round(2 / (1 / precision + 1 / recall), places) if tp else 0, -k, precision, recall))
        got = metrics.edge_f1(g, p, digits=9, places=places).first()
        assert (got.precision, got.recall) == pytest.approx(max(all_)[2:]), places
    assert sum(r[1] for r in seen) < len(near)


def test_queries_of_ranks_join_no_pairs(spark, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(metrics, "_in_order", None)
    assert e.queries()["reconstruction"](spark, "/root/testdata/sf0.001").count() == 1
    assert e.queries()["precision_at_k"](spark, "/root/testdata/sf0.001").count() > 0


def test_rows_of_ranks_alternate_and_pack(spark, tmp_path):
    """Equal to the join of pairs, and written in few bytes: ranks come together, not all others of one vertex."""
    import pyarrow.parquet as pq

    g, p = tied(spark)
    for columns in (["v", "x", "rk", "recall"], ["v", "x", "rk", "precision"], ["v", "x", "similarity", "is_nb", "hits", "deg"]):
        for digits in (9, None):
            got = metrics.ranked(g, p, digits=digits, columns=columns, places=6)
            assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
            want = metrics._shuffled(g, p, "euclidean", None, 0, digits)
            want = want.select(*(F.round(c, 6).alias(c) if c in ("precision", "recall") else F.col(c) for c in columns))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    n = 1500
    far = points(spark, [(math.sin(i * i), math.cos(3 * i * i)) for i in range(n)])
    metrics.ranked(graph(spark, [(i, (i * 7 + 1) % n) for i in range(n)]), far, digits=9, columns=["v", "x", "rk", "recall"], places=6).write.parquet(f"{tmp_path}/out")
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("out/*.parquet")]
    rows, size = sum(m.num_rows for m in files), [sum(m.row_group(k).column(c).total_compressed_size for m in files for k in range(m.num_row_groups)) for c in range(4)]
    assert rows == n * (n - 1) and size[2] < rows / 4  # of ranks; 11 bits a row where they run through for each vertex


def test_all_pairs_are_found_where_the_origins_are(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(90)] + [(3, 60), (100, 101), (101, 100)]
    g = graph(spark, edges)
    plan = algorithms.all_pairs(g)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "dist" not in plan.split("Exchange")[1]
    want = {(o, i, d) for (o, i), d in by_search(102, edges).items()}
    assert {tuple(r) for r in algorithms.all_pairs(g).collect()} == want
    monkeypatch.setattr(algorithms, "CELLS", 300)
    assert {tuple(r) for r in algorithms.all_pairs(g).collect()} == want
    assert algorithms.all_pairs(Graph(g.nodes.limit(0), g.edges.limit(0))).count() == 0


def test_all_pairs_take_few_bytes(spark, tmp_path):
    """The rows of 512 origins take less than a byte each in a written table."""
    import pyarrow.parquet as pq

    g = graph(spark, [(i, (i * k + 1) % 4000) for i in range(4000) for k in (2, 3, 7)])
    algorithms.all_pairs(g).where("origin < 512").write.parquet(f"{tmp_path}/out")
    files = [pq.ParquetFile(p).metadata for p in tmp_path.glob("out/*.parquet")]
    rows, size = sum(m.num_rows for m in files), sum(m.row_group(k).column(c).total_compressed_size for m in files for k in range(m.num_row_groups) for c in range(3))
    assert rows == 512 * 4000 and size < rows


def test_label_propagation_in_one_task_equals_the_rounds(spark, monkeypatch):
    rows = [(i, (i * 7 + k * k) % 60) for i in range(60) for k in range(1, 4)] + [(70, 71), (75, 75)]
    g = graph(spark, rows)
    weighted = g.edges.withColumn("w", (1 + (F.col("src") + F.col("dst")) % 3).cast("double"))
    shared = []
    monkeypatch.setattr(coarsen, "cut", lambda df, cut=coarsen.cut: shared.append(df) or cut(df))
    got = values(coarsen.label_propagation(g, weighted, sweeps=2), "id", "cluster")
    assert len(shared) == 1  # however many rounds there are
    monkeypatch.setattr(coarsen, "HELD", 0)
    assert got == values(coarsen.label_propagation(g, weighted, sweeps=2), "id", "cluster")
    assert len(got) == g.n and 1 < len(set(got.values())) < g.n and len(shared) > 4
    none = Graph(g.nodes.limit(0), g.edges.limit(0))
    assert coarsen.label_propagation(none, weighted.limit(0)).count() == 0
