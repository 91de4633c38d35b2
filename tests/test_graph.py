"""Literal expectations on small graphs, invariants, and the shipped matrices."""

import inspect
import math
import os
import time

import numpy as np
import pytest

from ordograph.functions import kernels
from ordograph.operators import bandwidth as B, centrality as C, graph as G, learn as L, ordering as O, traverse as T
from ordograph.plans import catalogue
from ordograph.sources import matrix_market as M

G5 = [(1, 2), (1, 4), (2, 3), (2, 4), (2, 5), (3, 5), (4, 5)]
G10 = [(0, 3), (0, 5), (1, 2), (1, 4), (1, 6), (1, 9), (2, 3), (2, 4), (3, 5), (3, 8), (4, 6), (5, 6), (5, 7), (6, 7)]


def frame(spark, edges, name="g"):
    return spark.createDataFrame([(name, u, v) for u, v in edges], "instance string, u int, v int")


def values(df):
    return {r["v"]: r["value"] for r in df.collect()}


def test_bandwidth_of_g5(spark):
    e = frame(spark, G5)
    ids = B.identity_labels(e)
    assert B.bandwidth(e, ids).first()["bandwidth"] == 3
    assert B.full_bandwidth(e, ids).first()["full_bandwidth"] == 7
    assert B.critical(e, ids).first()["critical"] == 4
    assert {r["v"]: r["degree"] for r in G.degrees(e).collect()} == {1: 2, 2: 4, 3: 2, 4: 3, 5: 3}
    t = T.topology(e, with_connectivity=True).first()
    assert (t["density"], t["diameter"], t["aspl"], t["num_comp"], t["node_conn"], t["edge_conn"]) == (0.7, 2, 1.3, 1, 2, 2)


def test_centralities_of_g5(spark):
    e = frame(spark, G5)
    near = lambda got, want: all(math.isclose(got[v], want[v], abs_tol=2e-5) for v in want)
    assert near(values(C.closeness(e)), {1: 0.666667, 2: 1, 3: 0.666667, 4: 0.8, 5: 0.8})
    assert near(values(C.harmonic(e)), {1: 3, 2: 4, 3: 3, 4: 3.5, 5: 3.5})
    assert near(values(C.betweenness(e)), {1: 0, 2: 0.333333, 3: 0, 4: 0.083333, 5: 0.083333})
    assert near(values(C.pagerank(e, tol=1e-9)), {1: 0.149059, 2: 0.277065, 3: 0.149059, 4: 0.212409, 5: 0.212409})
    a = np.zeros((5, 5))
    for u, v in G5:
        a[u - 1, v - 1] = a[v - 1, u - 1] = 1
    top = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert near(values(C.eigenvector(e, tol=1e-9)), {i + 1: top[i] for i in range(5)})
    k = np.linalg.solve(np.eye(5) - 0.005 * a, np.ones(5))
    assert near(values(C.katz(e)), {i + 1: (k / np.linalg.norm(k))[i] for i in range(5)})


def test_levels_and_components(spark):
    e = frame(spark, G5 + [(7, 8)])
    levels = T.bfs(e, spark.createDataFrame([("g", 1)], "instance string, root int"))
    assert {r["v"]: r["level"] for r in levels.collect()} == {1: 0, 2: 1, 4: 1, 3: 2, 5: 2}
    assert {r["v"]: r["component"] for r in T.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7}
    assert T.topology(e).first()["aspl"] is None


def test_golden_orders():
    g = kernels.Graph(10, *zip(*G10, strict=True))
    assert g.bandwidth(np.arange(10)) == 8
    assert kernels.cuthill_mckee(g, 6)[::-1].tolist() == [8, 3, 0, 9, 2, 5, 1, 4, 7, 6]
    assert kernels.cuthill_mckee(g, 0)[::-1].tolist() == [9, 1, 4, 6, 7, 2, 8, 5, 3, 0]
    assert g.bandwidth(kernels.labels_of(kernels.cuthill_mckee(g)[::-1])) == 4
    assert kernels.Graph(5, [u - 1 for u, _ in G5], [v - 1 for _, v in G5]) and [x + 1 for x in kernels.cuthill_mckee(kernels.Graph(5, [u - 1 for u, _ in G5], [v - 1 for _, v in G5]), 0)] == [1, 4, 2, 5, 3]


def test_labellings_are_permutations(spark):
    e = frame(spark, [(u + 1, v + 1) for u, v in G10] + [(12, 13), (13, 14)])
    g = kernels.Graph(13, [0], [1])
    for made in (O.cuthill_mckee(e), O.cuthill_mckee(e, reverse=True), O.hill_climb(e), O.vns(e)):
        assert sorted(r["label"] for r in made.collect()) == list(range(1, 14))
    bound = L.lower_bound(13, 16)
    assert B.bandwidth(e, O.vns(e)).first()["bandwidth"] >= bound and g.n == 13


def test_agents_learn(spark):
    e = frame(spark, [(u + 1, v + 1) for u, v in G10])
    for network in (False, True):
        log = L.attempt_log(e, episodes=4, tries=2, network=network).collect()
        assert len(log) == 4 and log[0]["reward"] == 10
    top = L.grid_search(e, L.parameter_grid(spark).filter("episodes = 10 and lr = 0.1 and gamma = 0.9")).collect()
    assert len(top) == 4 and all(r["bandwidth"] >= r["lower_bound"] for r in top)
    assert L.parameter_grid(spark).count() == 48


def test_top3_searches_the_whole_grid(spark, monkeypatch):
    grids = []

    def search(edges, grid):
        grids.append([tuple(r)[1:] for r in grid.collect()])
        return grid.withColumn("bandwidth", -grid.param_id)

    monkeypatch.setattr(L, "grid_search", search)
    assert [r["param_id"] for r in catalogue.queries()["top3_params"](spark, "/root/testdata/sf0.001").collect()] == [47, 46, 45]
    assert len(set(grids[0])) == 48 and {p[0] for p in grids[0]} == {20, 30, 40} and (40, 0.005, 0.9, 0.5, 0.995) in grids[0]


def test_agents_choose_among_all_centralities(spark):
    e = frame(spark, [(u + 1, v + 1) for u, v in G10])
    g, tables = kernels.Graph(10, *zip(*G10, strict=True)), {}
    for name, row in zip(L.NAMES, L.tables_of(g), strict=True):
        tables[name] = row
    assert set(tables) == set(C.REGISTRY) and len(tables) == 7
    for name in ("Eigenvector", "Katz Centrality", "PageRank"):
        want = values(C.REGISTRY[name][0](e))
        assert all(math.isclose(tables[name][v - 1], want[v], abs_tol=1e-4) for v in want), name
    assert np.isfinite(kernels.katz(kernels.Graph(400, *np.triu_indices(400, 1)))).all()
    assert len(L.attempt_log(e).collect()) == 30
    assert inspect.signature(L.attempt_log).parameters["tries"].default == 15


def test_local_search_ends_at_a_local_optimum():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = 60
        g = kernels.Graph(n, rng.integers(0, n, 90), rng.integers(0, n, 90))
        label = kernels.hill_climb(g, rng.permutation(n) + 1)
        score, d = (g.bandwidth(label), g.critical(label)), np.abs(label[g.u] - label[g.v])
        for x in np.unique(np.concatenate([g.u[d == d.max()], g.v[d == d.max()]])):
            own = label[g.near(x)]
            mid = (own.max() + own.min()) // 2
            for y in np.flatnonzero(np.abs(mid - label) < abs(mid - label[x])):
                label[[x, y]] = label[[y, x]]
                assert (g.bandwidth(label), g.critical(label)) >= score
                label[[x, y]] = label[[y, x]]


def test_vns_reaches_both_shakes(spark, monkeypatch):
    used = []
    for name in ("shake_swaps", "shake_rotations"):
        monkeypatch.setattr(kernels, name, lambda g, label, k, rng, name=name, f=getattr(kernels, name): used.append((name, k)) or f(g, label, k, rng))
    g = kernels.Graph(10, *zip(*G10, strict=True))
    how = {k: p.default for k, p in inspect.signature(O.vns).parameters.items() if k.startswith("k_")}
    label = kernels.vns(g, kernels.labels_of(kernels.cuthill_mckee(g)), **how, alpha=10, seed=0)
    assert sorted(label) == list(range(1, 11))
    assert used[-44:] == [("shake_swaps", k) for k in range(5, 101, 5)] + [("shake_rotations", k) for k in range(20, 44)]


def test_first_appearance_in_a_file(spark, tmp_path):
    """Entries in a drawn order, both triangles, a diagonal: full bandwidth of the order in which vertices appear."""
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(1, 80, (300, 2))]
    (tmp_path / "drawn.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n79 79 300\n" + "\n".join(f"{a} {b}" for a, b in pairs) + "\n")
    seen = {}
    for a, b in pairs:
        if a != b:
            for x in (min(a, b), max(a, b)):
                seen.setdefault(x, len(seen))
    want = max(2 * abs(seen[a] - seen[b]) + 1 for a, b in pairs if a != b)
    e = G.edges_of(M.read_coo(spark, str(tmp_path)))
    pos = G.insertion_order(e).toPandas()
    assert dict(zip(pos.v, pos.pos, strict=True)) == seen
    labels = spark.createDataFrame([("drawn", "file", v, p + 1) for v, p in seen.items()], "instance string, solution string, v int, label int")
    assert B.full_bandwidth(e.select("instance", "u", "v"), labels).first()["full_bandwidth"] == want


def test_harwell_boeing(spark, tmp_path):
    head = "A title".ljust(72) + "KEY\n" + f"{3:14d}{1:14d}{1:14d}{1:14d}{0:14d}\n" + f"RUA           {3:14d}{3:14d}{4:14d}{0:14d}\n" + "(8I4)           (8I4)           (4E12.4)            \n"
    (tmp_path / "m.rua").write_text(head + "   1   3   4   5\n   1   3   2   3\n  1.0000E+00  2.5000D+00 -3.0000E+00  4.0000E+00\n")
    got = sorted((r["i"], r["j"], r["val"]) for r in M.read_harwell_boeing(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1.0), (2, 2, -3.0), (3, 1, 2.5), (3, 3, 4.0)]


def test_batch_goes_on_after_errors(spark):
    e = frame(spark, G5).union(frame(spark, [(u + 1, v + 1) for u, v in G10], "h"))

    def fails(g):
        if g.n > 5:
            raise ValueError("too large")
        return np.arange(g.n) + 1

    got = {(r["instance"], r["solver"]): r for r in O.batch(e, {"cm": lambda g: kernels.labels_of(kernels.cuthill_mckee(g)), "fails": fails}).collect()}
    assert got["g", "fails"]["bandwidth"] == 3 and got["h", "fails"]["bandwidth"] is None and got["h", "fails"]["error"] == "ValueError: too large"
    assert got["h", "cm"]["bandwidth"] == 4 and got["h", "cm"]["error"] is None and got["h", "cm"]["seconds"] >= 0


def test_values_that_have_not_converged_are_an_error(spark):
    path = frame(spark, [(i, i + 1) for i in range(1, 60)])
    with pytest.raises(RuntimeError, match="not converged"):
        C.eigenvector(path, rounds=8, tol=1e-9)


def test_parents_of_levels(spark):
    e = frame(spark, G5)
    got = {r["v"]: (r["level"], r["parent"]) for r in T.bfs(e, spark.createDataFrame([("g", 1)], "instance string, root int")).collect()}
    assert got == {1: (0, None), 2: (1, 1), 4: (1, 1), 3: (2, 2), 5: (2, 2)}


def test_streams_give_what_tables_give(spark, tmp_path):
    from ordograph.streaming import incremental as I

    e, labels = frame(spark, G5), B.identity_labels(frame(spark, G5))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("degrees", I.running_degree(stream)), ("widths", I.running_bandwidth(stream, labels))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {r["v"]: r["degree"] for r in spark.table("degrees").collect()} == {1: 2, 2: 4, 3: 2, 4: 3, 5: 3}
    assert [r["bandwidth"] for r in spark.table("widths").collect()] == [3]


def test_written_tables(spark, tmp_path, monkeypatch):
    from ordograph.plans import storage

    t = storage.written(spark.range(5), "five")
    assert t.count() == 5 and os.path.isdir(t._written_to.removeprefix("file:"))
    storage.discard(t)
    assert not os.path.exists(t._written_to.removeprefix("file:"))
    monkeypatch.setattr(storage, "MANY_ROWS", 40)
    rows = storage.running_totals(spark.range(1000).withColumnRenamed("id", "k"), ["k"], "k", "before").collect()
    assert all(r["before"] == r["k"] * (r["k"] - 1) // 2 for r in rows)


def test_matrix_market_files(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% x\n3 3 3\n1 1 2.5\n2 1 1\n3 2 0\n")
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix array real general\n2 1\n4.0\n5.0\n")
    (tmp_path / "c.mtx").write_text("3 2\n1 2\n2 3\n")
    heads = {r["instance"]: r for r in M.headers(M.lines(spark, str(tmp_path), "*.mtx")).collect()}
    assert heads["a"]["valid"] and heads["a"]["nnz_header"] == 3 and heads["c"]["nnz_header"] is None
    got = M.read_coo(spark, str(tmp_path), "*.mtx").orderBy("ord").collect()
    assert [(r["i"], r["j"], r["val"]) for r in got] == [(1, 1, 2.5), (2, 1, 1.0), (3, 2, 0.0)]
    assert M.read_coo(spark, str(tmp_path), "c.mtx", legacy=True).count() == 2
    assert [r["val"] for r in M.read_vector(spark, str(tmp_path), "b.mtx").orderBy("v").collect()] == [4.0, 5.0]
    M.write_matrix_market(M.read_coo(spark, str(tmp_path), "a.mtx"), str(tmp_path / "out"), 3, 3)
    again = M.read_coo(spark, str(tmp_path / "out"), "*.txt").orderBy("ord").collect()
    assert [(r["i"], r["j"], r["val"]) for r in again] == [(1, 1, 2.5), (2, 1, 1.0), (3, 2, 0.0)]
    (tmp_path / "e.txt").write_text("a b\nb c\n")
    assert {(r["u"], r["v"]) for r in M.with_ids(M.read_edge_list(spark, str(tmp_path / "e.txt"))).collect()} == {(1, 2), (2, 3)}
    (tmp_path / "l.txt").write_text("a b c\nb c\n")
    assert M.read_adjacency_list(spark, str(tmp_path / "l.txt")).count() == 3


def _bipartite(users, kinds=5):
    """Users linked with all kinds, but for the first, which lacks one."""
    u, v = (x.ravel() for x in np.meshgrid(np.arange(users), np.arange(users, users + kinds)))
    keep = ~((u == 0) & (v == users))
    return kernels.Graph(users + kinds, u[keep], v[keep])


def _in_time(seconds, function):
    began = time.perf_counter()
    out = function()
    assert time.perf_counter() - began < seconds
    return out


def test_gps_pair_of_many_alike():
    """20,000 vertices with the same neighbours; breadth-first searches from each would take minutes."""
    g = _bipartite(20_000)
    assert _in_time(10, lambda: kernels.gps_pair(g, g.parts()[0])) == (0, 20_000)


def test_betweenness_of_many_alike():
    """1500 vertices linked with the same five: each lies on a 1500th of the paths of 10 pairs."""
    u, v = (x.ravel() for x in np.meshgrid(np.arange(1500), np.arange(1500, 1505)))
    got = _in_time(10, lambda: kernels.betweenness(kernels.Graph(1505, u, v)))
    assert np.allclose(got[:1500], 10 / 1500 * 2 / (1504 * 1503)) and np.allclose(got[1500:], 1500 * 1499 / 2 / 5 * 2 / (1504 * 1503))


def test_betweenness_by_classes_is_that_by_vertices():
    rng = np.random.default_rng(5)
    for _ in range(20):
        kinds = rng.integers(0, 3, 12)
        u, v = np.nonzero((rng.random((3, 4)) < 0.7)[kinds])
        g = kernels.Graph(16, u, v + 12)
        assert np.allclose(kernels.betweenness(g), kernels.betweenness(g, range(16)), atol=1e-12)


def test_current_flow_of_many_alike():
    def by_pairs(g):
        lap = np.diag(g.degree.astype(float))
        lap[g.u, g.v] = lap[g.v, g.u] = -1
        inv, out = np.linalg.pinv(lap), np.zeros(g.n)
        for s in range(g.n):
            for t in range(s + 1, g.n):
                flow = np.abs((inv[g.u, s] - inv[g.u, t]) - (inv[g.v, s] - inv[g.v, t]))
                through = np.bincount(g.u, flow, g.n) + np.bincount(g.v, flow, g.n)
                through[[s, t]] = 0
                out += through / 2
        return out * 2 / ((g.n - 1) * (g.n - 2))

    for g in (_bipartite(9, 3), kernels.Graph(10, *zip(*G10, strict=True))):
        assert np.allclose(kernels.current_flow_betweenness(g), by_pairs(g), atol=1e-9)
    assert len(_in_time(10, lambda: kernels.current_flow_betweenness(_bipartite(1500)))) == 1505


def test_percolation_of_many_alike():
    """With equal states it is betweenness; with others a path's source counts by its share of the others' states."""
    g = _bipartite(1500)
    got = _in_time(10, lambda: kernels.percolation(g))
    assert np.allclose(got, kernels.betweenness(g))
    path = kernels.Graph(3, [0, 1], [1, 2])
    assert np.allclose(kernels.percolation(path, [2, 1, 3]), [0, 1, 0])


def test_random_level_search_of_many_alike(spark):
    from ordograph.operators import construct as K

    g = _bipartite(1500)
    got = _in_time(40, lambda: K.random_level_search(frame(spark, zip(g.u.tolist(), g.v.tolist(), strict=True))).collect())
    assert sorted(r["label"] for r in got) == list(range(1, 1506))


def test_grid_search_of_many_alike(spark):
    g = _bipartite(1500)
    e = frame(spark, zip(g.u.tolist(), g.v.tolist(), strict=True))
    got = _in_time(40, lambda: L.grid_search(e, L.parameter_grid(spark).filter("param_id < 4")).collect())
    assert len(got) == 4 and all(r["bandwidth"] >= r["lower_bound"] for r in got)


def test_topology_of_many_alike(spark):
    g = _bipartite(6000)
    e = frame(spark, zip(g.u.tolist(), g.v.tolist(), strict=True))
    t = _in_time(60, lambda: T.topology(e, with_connectivity=True).first())
    assert (t["nodes"], t["edges"], t["num_comp"], t["diameter"], t["node_conn"], t["edge_conn"]) == (6005, 29999, 1, 3, 4, 4)


def test_connectivity_is_that_of_the_smallest_cut():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, kinds = 8, rng.integers(0, 2, 5)
        u, v = np.nonzero((rng.random((2, 3)) < 0.8)[kinds])
        g = kernels.Graph(n, np.append(u, 5), np.append(v + 5, 6))
        lap = np.diag(g.degree.astype(float))
        lap[g.u, g.v] = lap[g.v, g.u] = -1
        sides = [np.array([bool(k >> i & 1) for i in range(n)]) for k in range(1, 2**n - 1)]
        assert kernels.edge_connectivity(g) == min(int((s[g.u] != s[g.v]).sum()) for s in sides)

        def apart(keep, g=g):
            both = keep[g.u] & keep[g.v]
            rank = np.cumsum(keep) - 1
            return len(kernels.Graph(int(keep.sum()), rank[g.u[both]], rank[g.v[both]]).parts()) > 1

        cuts = [int((~s).sum()) for s in sides if apart(s)] + ([0] if apart(np.ones(n, dtype=bool)) else [])
        assert kernels.node_connectivity(g) == min(cuts)
        assert math.isclose(kernels.algebraic_connectivity(g), np.linalg.eigvalsh(lap)[1], abs_tol=1e-9)


def test_distance_counts_are_those_of_distances(spark):
    """Classes, a vertex with a loop only, several components and instances."""
    e = frame(spark, [(1, 9), (2, 9), (3, 9), (1, 8), (2, 8), (4, 8), (5, 6), (7, 7)]).union(frame(spark, [(u + 1, v + 1) for u, v in G10], "h"))
    classes = {(r["instance"], r["v"]): r["rep"] for r in G.twins(e).collect()}
    assert classes["g", 2] == 1 and classes["g", 7] == 7 and classes["g", 3] == 3
    want = {}
    for r in T.distances(e).collect():
        want[r["instance"], r["src"], r["d"]] = want.get((r["instance"], r["src"], r["d"]), 0) + 1
    got = {(r["instance"], r["rep"], r["d"]): r["n"] for r in T.distance_counts(e).collect()}
    assert {(i, v, d): got[i, classes[i, v], d] for i, v, d in want} == want
    assert len(got) == len({(i, classes[i, v], d) for i, v, d in want})


def test_long_lines_of_an_adjacency_list(spark, tmp_path):
    """60,000 neighbours in a line; a split of the line for each would take minutes."""
    (tmp_path / "l.txt").write_text("hub " + " ".join(f"v{i}" for i in range(60_000)) + "\nalone\n")
    got = _in_time(30, lambda: M.read_adjacency_list(spark, str(tmp_path / "l.txt")).toPandas())
    assert len(got) == 60_000 and set(got.a) == {"hub"} and got.b.nunique() == 60_000


def _without_pairs(spark, monkeypatch, name):
    """The query's rows where a row a pair is an error; 15 users linked with the same five kinds."""

    def pairs(*_):
        raise AssertionError("a row a pair")

    monkeypatch.setattr(T, "distances", pairs)
    monkeypatch.setattr(C, "distances", pairs, raising=False)
    return sorted(map(tuple, catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect()))


def test_histogram_without_pairs(spark, monkeypatch):
    assert _without_pairs(spark, monkeypatch, "apsp_hist") == [(0, 20), (1, 150), (2, 230)]


def test_diameter_without_pairs(spark, monkeypatch):
    assert _without_pairs(spark, monkeypatch, "diameter") == [(2,)]


def test_closeness_without_pairs(spark, monkeypatch):
    assert _without_pairs(spark, monkeypatch, "closeness") == [(v, round(19 / 33 if v <= 15 else 19 / 23, 9)) for v in range(1, 21)]


def test_mean_distance_without_pairs(spark, monkeypatch):
    assert _without_pairs(spark, monkeypatch, "aspl") == [(round(610 / 380, 9),)]


def test_harmonic_without_pairs(spark, monkeypatch):
    assert _without_pairs(spark, monkeypatch, "harmonic") == [(v, 12.0 if v <= 15 else 17.0) for v in range(1, 21)]


def test_level_counts_from_parts_of_the_edges(monkeypatch):
    """Small pieces, edges in several parts, either end first; against levels()."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(kernels, "PIECE", 64)
    for _ in range(40):
        n, m = rng.integers(1, 150), rng.integers(0, 300)
        g = kernels.Graph(n, rng.integers(0, n, m), rng.integers(0, n, m))
        swap, cut = rng.random(len(g.u)) < 0.5, np.sort(rng.integers(0, len(g.u) + 1, 2))
        parts = [np.split(np.where(swap, a, b).astype(np.int32), cut) for a, b in ((g.u, g.v), (g.v, g.u))]
        dst, at = kernels.arcs(np.arange(n), list(zip(*parts, strict=True)))
        roots = rng.permutation(n)
        want = {(k, d): int((g.levels(x) == d).sum()) for k, x in enumerate(roots) for d in range(int(g.levels(x).max()) + 1)}
        assert {(k, d): c for k, d, c in kernels.level_counts(dst, at, g.size, roots)} == want


def test_distances_of_few_alike_in_little_memory(spark, tmp_path, monkeypatch):
    """4000 vertices linked with half of 200 others, each with its own choice: a task takes few bytes an edge."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    def measured(apply):
        def wrapped(self, f, schema):
            def run(own, parts):
                import tracemalloc
                import uuid

                import pandas  # noqa: F401  not part of what is measured

                tracemalloc.start()
                try:
                    return f(own, parts)
                finally:
                    (tmp_path / uuid.uuid4().hex).write_text(str(tracemalloc.get_traced_memory()[1]))
                    tracemalloc.stop()

            return apply(self, run, schema)

        return wrapped

    for name in ("applyInPandas", "applyInArrow"):
        monkeypatch.setattr(PandasCogroupedOps, name, measured(getattr(PandasCogroupedOps, name)))
    made = spark.range(4000 * 200).filter("pmod(xxhash64(id), 2) = 0")
    e = made.select(F.lit("g").alias("instance"), F.expr("cast(id div 200 as int)").alias("u"), F.expr("cast(4000 + id % 200 as int)").alias("v"))
    a = np.zeros((4000, 200))
    ids = made.toPandas()["id"]
    a[ids // 200, ids % 200] = 1
    near, back = a @ a.T > 0, a.T @ a > 0
    total = np.where(near, 2, 4).sum() - 2 * 4000 + np.where(back, 2, 4).sum() - 2 * 200 + 2 * np.where(a > 0, 1, 3).sum()
    assert T.distance_counts(e).agg(F.sum(F.col("size") * F.col("d") * F.col("n"))).first()[0] == total
    peaks = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert peaks and max(peaks) < 25e6, peaks


def test_mean_distance_is_that_of_topology(spark):
    e = frame(spark, G10).union(frame(spark, [*G5, (7, 8)], "h")).union(frame(spark, [(3, 3)], "one"))
    got = {r["instance"]: r["aspl"] for r in T.mean_distance(e).collect()}
    assert got == {"g": 2.0, "h": None, "one": None}
    assert {r["instance"]: r["aspl"] for r in T.topology(frame(spark, G10).union(frame(spark, [*G5, (7, 8)], "h"))).collect()} == {"g": 2.0, "h": None}
