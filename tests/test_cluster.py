"""Similarity joins and DBSCAN against brute force (F8)."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import cluster, graph, pca, similarity
from tests.conftest import rows


def cos_dist(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return min(max(1 - sum(x * y for x, y in zip(a, b)) / (na * nb), 0.0), 1.0)


def test_fixture_f8(spark):
    pts = spark.createDataFrame([(0, [0.0, 0.0, 1.0]), (1, [1.0, 0.0, 0.0]), (2, [0.81, 0.586, 0.0]),
                                 (3, [0.0, 1.0, 0.0])], "id long, vec array<double>")
    got = dict(rows(cluster.dbscan(pts, eps=0.2, min_samples=2)))
    assert got == {0: -1, 1: 0, 2: 0, 3: -1}


def test_chain_and_border(spark):
    # chain 0-1-2 is one component although its ends are far apart
    vecs = [(0, [1.0, 0.0]), (1, [math.cos(0.5), math.sin(0.5)]), (2, [math.cos(1.0), math.sin(1.0)]),
            (3, [-1.0, 0.0])]
    pts = spark.createDataFrame(vecs, "id long, vec array<double>")
    got = dict(rows(cluster.dbscan(pts, eps=1 - math.cos(0.55), min_samples=2)))
    assert got == {0: 0, 1: 0, 2: 0, 3: -1}
    # min 3: only the middle point is core; both ends are its border points
    got3 = dict(rows(cluster.dbscan(pts, eps=1 - math.cos(0.55), min_samples=3)))
    assert got3 == {0: 0, 1: 0, 2: 0, 3: -1}


def brute_dbscan(vecs, eps, min_samples):
    n = len(vecs)
    nb = {i: [j for j in range(n) if j != i and cos_dist(vecs[i], vecs[j]) <= eps] for i in range(n)}
    core = [len(nb[i]) + 1 >= min_samples for i in range(n)]
    labels, cid = [-1] * n, 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        stack, labels[i] = [i], cid
        while stack:
            u = stack.pop()
            for v in nb[u]:
                if labels[v] == -1:
                    labels[v] = cid
                    if core[v]:
                        stack.append(v)
        cid += 1
    return labels


def test_dbscan_matches_brute_force(spark):
    rnd = random.Random(3)
    vecs = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    pts = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, vec array<double>")
    for ms in (2, 3, 4):
        got = dict(rows(cluster.dbscan(pts, eps=0.15, min_samples=ms)))
        assert [got[i] for i in range(60)] == brute_dbscan(vecs, 0.15, ms)


def test_labels_invariant_under_shuffle(spark):
    rnd = random.Random(5)
    data = [(i, [rnd.random(), rnd.random(), rnd.random()]) for i in range(40)]
    a = dict(rows(cluster.dbscan(spark.createDataFrame(data, "id long, vec array<double>"), 0.05, 2)))
    rnd.shuffle(data)
    b = dict(rows(cluster.dbscan(spark.createDataFrame(data, "id long, vec array<double>").repartition(3), 0.05, 2)))
    assert a == b


def test_cosine_edges_brute_force(spark):
    rnd = random.Random(7)
    vecs = [[rnd.gauss(0, 1) for _ in range(5)] for _ in range(50)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, vec array<double>")
    got = rows(similarity.cosine_edges(df, 0.5, cell=8), "src", "dst")
    want = sorted((i, j) for i, j in itertools.combinations(range(50), 2) if cos_dist(vecs[i], vecs[j]) <= 0.5)
    assert got == want


def test_jaccard_brute_force(spark):
    rnd = random.Random(11)
    sets = {u: {rnd.randrange(12) for _ in range(rnd.randrange(0, 6))} for u in range(30)}
    df = spark.createDataFrame([(u, str(i)) for u, s in sets.items() for i in s], "id long, item string")
    got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.jaccard_pairs(df, min_similarity=1e-9, block=3).collect()}
    for a, b in itertools.combinations(range(30), 2):
        j = similarity.jaccard(sets[a], sets[b]) if (sets[a] or sets[b]) else 1.0
        if sets[a] & sets[b]:
            assert abs(got[(a, b)] - j) < 1e-12 and 0 <= got[(a, b)] <= 1
        else:
            assert (a, b) not in got
    assert similarity.jaccard([], []) == 1.0


def test_centroid_representative_and_counts(spark):
    m = spark.createDataFrame([(0, 0, "Ada_1.json", [0.0, 0.0]), (0, 1, "Ada_2.json", [1.0, 0.0]),
                               (0, 2, "Ben x.json", [0.4, 0.0]), (1, 3, "Cy.json", [5.0, 5.0]),
                               (-1, 4, "Dee.json", [9.0, 9.0])],
                              "cluster_id long, id long, file string, vec array<double>")
    reps = {r["cluster_id"]: r["rep_id"] for r in cluster.representatives(m.where("cluster_id >= 0")).collect()}
    assert reps == {0: 2, 1: 3}
    s = {r["cluster_id"]: (r["n_members"], r["n_providers"], r["is_common"])
         for r in cluster.cluster_summary(m).collect()}
    assert s == {0: (3, 2, False), 1: (1, 1, False)}
    assert rows(cluster.noise_count(m), "n_noise") == [(1,)]


def test_variance_filter_and_scale(spark):
    rowsd = [(i, "a" if i < 99 else "b") for i in range(100)]
    ind = cluster.one_hot(spark.createDataFrame(rowsd, "id int, c string"), "id", ["c"])
    v = {r["feature"]: r["keep"] for r in cluster.variance_filter(ind, "id").collect()}
    assert v == {"c=a": False, "c=b": False}  # p(1-p) = 0.0099
    s = cluster.min_max_scale(spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double"), ["x"])
    assert sorted(r[0] for r in s.collect()) == [0.0, 0.5, 1.0]
    u = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(cluster.normalise("v")).first()[0]
    assert u == [0.6, 0.8]


def test_provider_table_and_flag_matrix(spark):
    counts = spark.createDataFrame([(0, "Ada", 2), (0, "Ben", 1), (1, "Ada", 3)],
                                   "cluster_id long, provider string, n_members long")
    reps = spark.createDataFrame([(0, "rest"), (1, "walk")], "cluster_id long, representative string")
    t = {r["representative"]: (r["Ada"], r["Ben"]) for r in
         cluster.provider_table(counts, reps, providers=["Ada", "Ben"]).collect()}
    assert t == {"rest": (2, 1), "walk": (3, None)}
    flags = spark.createDataFrame([("p", "A", True, None), ("p", "N", None, "7")],
                                  "patient_id string, field string, is_true boolean, value string")
    assert rows(cluster.flag_matrix(flags)) == [("p", "A")]


def test_similarity_needs_a_threshold(spark):
    df = spark.createDataFrame([("a", "x")], "id string, item string")
    with pytest.raises(ValueError):
        similarity.jaccard_pairs(df, min_similarity=0.0)


def test_string_ids_and_components(spark):
    sets = spark.createDataFrame([("P1", "x"), ("P1", "y"), ("P2", "x"), ("P2", "y"), ("P10", "x")], "id string, item string")
    got = sorted((r["a"], r["b"], r["jaccard"]) for r in similarity.jaccard_pairs(sets, min_similarity=0.5).collect())
    assert got == [("P1", "P10", 0.5), ("P1", "P2", 1.0), ("P10", "P2", 0.5)]
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(25)] + [("z", "y"), ("q", "q")], "src string, dst string")
    found = {r["v"]: r["root"] for r in graph.connected_components(edges).collect()}
    assert found == {**{f"n{i:02d}": "n00" for i in range(26)}, "z": "y", "y": "y"}


def test_noise_has_no_representative(spark):
    m = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.8, 0.2]), (-1, 3, [0.0, 1.0])], "cluster_id long, id long, vec array<double>")
    assert [r["cluster_id"] for r in cluster.representatives(m).collect()] == [0]


def _clustered(seed, n, dim=5):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [[c + rnd.gauss(0, rnd.choice([0.02, 0.1, 0.5])) for c in rnd.choice(centres)] for _ in range(n)]


def test_cells_hold_every_neighbour_once(spark):
    from quire.operators import metric
    vecs = _clustered(4, 150)
    nodes = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vecs)], "node long, v array<double>, weight long")
    for eps in (0.002, 0.05, 1.0):
        members = metric.cells(nodes, eps, cell=12, pivots=5, chunk=40).collect()
        home = {r["node"]: r["cell"] for r in members if r["home"]}
        there = {(r["cell"], r["node"]) for r in members}
        assert len(there) == len(members) and len([r for r in members if r["home"]]) == 150
        for i in range(150):
            for j in range(150):
                if cos_dist(vecs[i], vecs[j]) <= eps:
                    assert (home[i], j) in there
    assert len({r["cell"] for r in metric.cells(nodes, 0.001, cell=12).collect()}) > 6


def test_dbscan_in_cells_with_odd_rows(spark):
    vecs = _clustered(9, 140) + [[1.0] * 5, [2.0] * 5]
    bad = [None, [], [0.0] * 5, [1.0, None, 1.0, 1.0, 1.0], [math.inf] * 5, [math.nan] * 5]
    rows_ = [(f"k{i:03d}", v, i) for i, v in enumerate(vecs)] + [(f"z{i}", v, 0) for i, v in enumerate(bad)] + [(None, vecs[0], 0)]
    # a third of all rows are copies of one vector
    copies = [(f"y{i:03d}", vecs[3], 0) for i in range(70)]
    pts = spark.createDataFrame(rows_ + copies, "id string, vec array<double>, node int")
    own = [(r[0], r[1]) for r in rows_[:142] + copies]
    for eps, ms, cell in ((0.01, 4, 25), (0.05, 3, 5000)):
        want = dict(zip([i for i, _ in own], brute_dbscan([v for _, v in own], eps, ms)))
        got = {r["id"]: r["cluster_id"] for r in cluster.dbscan(pts, eps, ms, cell=cell).collect()}
        assert {k: got[k] for k in want} == want, (eps, ms, cell)
        assert all(got[f"z{i}"] == -1 for i in range(6)) and got[None] == -1 and len(got) == len(want) + 7
    assert cluster.dbscan(pts.where("false"), 0.1, 2).count() == 0


def test_cosine_edges_of_odd_rows(spark):
    rows_ = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]),
             (6, [math.nan, 1.0]), (7, [5.0, 0.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows_, "id long, vec array<double>")
    assert rows(similarity.cosine_edges(df, 0.1), "src", "dst") == [(1, 4), (5, 7)]
    assert similarity.cosine_edges(df.where("false"), 0.1).count() == 0


def test_jaccard_thresholds_and_hot_prefixes(spark):
    rnd = random.Random(23)
    base = [rnd.sample(range(60), 12) for _ in range(4)]
    sets = {u: {x for x in rnd.choice(base) if rnd.random() < 0.85} | {rnd.randrange(90) for _ in range(rnd.randrange(4))} for u in range(90)}
    sets = {u: s for u, s in sets.items() if s}
    items = [(u, str(i)) for u, s in sets.items() for i in s]
    df = spark.createDataFrame(items + items[:9] + [(None, "3"), (5, None)], "id long, item string")
    for t, block in ((0.2, 4), (0.5, 2048), (2 / 3, 4), (1.0, 4)):
        want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if similarity.jaccard(sets[a], sets[b]) >= t}
        got = [(r["a"], r["b"]) for r in similarity.jaccard_pairs(df, min_similarity=t, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want, (t, block)
    assert similarity.jaccard_pairs(df.where("false")).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_sets_meet_once(spark):
    rnd = random.Random(31)
    sets = {f"U{u}": {x for x in range(70) if rnd.random() < rnd.choice([0.2, 0.4, 0.9])} | {u % 70} for u in range(120)}
    sets |= {f"V{u}": sets["U5"] for u in range(20)}
    items = [(u, str(i)) for u, s in sets.items() for i in s]
    df = spark.createDataFrame(items + items[:9] + [(None, "3"), ("U5", None)], "id string, item string")
    for t, block in ((1e-9, 4), (0.3, 4), (0.3, 2048), (2 / 3, 16), (1.0, 4)):
        found = similarity.jaccard_pairs(df, min_similarity=t, block=block)
        if t < 1:
            assert "FlatMapGroupsInPandas" not in _plan(found)  # not once for each common prefix item
        got = sorted(tuple(r) for r in found.collect())
        want = []
        for a, b in itertools.combinations(sorted(sets), 2):
            inter, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if inter / union >= t:
                want.append((a, b, inter, union, inter / union))
        assert got == want, (t, block)
    few = spark.createDataFrame([(u, str(u % 50 + k)) for u in range(100) for k in range(3)], "id long, item string")
    assert "FlatMapGroupsInPandas" in _plan(similarity.jaccard_pairs(few, min_similarity=0.9))


def test_products_of_many_items_are_cut(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_CELLS", 64)
    rnd = random.Random(32)
    sets = {u: set(rnd.sample(range(40), rnd.randrange(1, 40))) for u in range(50)}
    rows_ = [(k % 3, u, sorted(s)) for k, (u, s) in enumerate(sets.items())]
    whole = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_)], names=["block", "id", "tokens"])]
    packed = pa.Table.from_batches(similarity._packed(40)(whole)).to_pylist()
    held = [[{k: r[k] for k in ("id", "size", "bits")} for r in packed if r["block"] == b] for b in range(3)]
    tiles = [(a, b, held[a], held[b]) for a in range(3) for b in range(a, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*tiles)], names=["down", "across", "first", "second"])
    found = list(similarity._products(0.4, 40)([batch]))
    got = sorted((min(r["a"], r["b"]), max(r["a"], r["b"]), r["inter"]) for x in found for r in x.to_pylist())
    assert max(x.num_rows for x in found) <= 64
    assert got == [(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(range(50), 2)
                   if similarity.jaccard(sets[a], sets[b]) >= 0.4]


def test_join_by_weight_keeps_all_rows(spark):
    from quire.plans.hot import join_by_weight
    left = spark.range(300).selectExpr("id", "if(id % 3 = 0, null, if(id % 3 = 1, 'hot', cast(id AS string))) AS k")
    table = left.groupBy("k").count().withColumn("twice", F.col("count") * 2)
    got = {r["id"]: r["twice"] for r in join_by_weight(left, table, ["k"], "count", share=10).collect()}
    assert got == {i: 200 if i % 3 < 2 else 2 for i in range(300)}


def _dense(rows_, ids, features):
    x = np.zeros((len(ids), len(features)))
    for i, f, v in rows_:
        x[ids.index(i), features.index(f)] = v
    return x - x.mean(axis=0)


@pytest.mark.parametrize("block,rounds,small", [(32, 5, None), (6, 3, 0)])
def test_components_by_dense_eigenvectors(spark, monkeypatch, block, rounds, small):
    if small is not None:
        monkeypatch.setattr(pca, "SMALL", small)  # every join by its keys
    rnd = random.Random(31)
    rows_ = []
    for i in range(60):
        a, b = rnd.gauss(0, 3), rnd.gauss(0, 1)
        for j in range(14):
            if rnd.random() < 0.8:
                rows_.append((f"id{i}", f"f{j:02d}", a * (j % 3) + b * (j % 5 - 2) + rnd.gauss(0, 0.05)))
    df = spark.createDataFrame(rows_ + [(None, "f00", 5.0), ("id1", None, 5.0), ("id99", "f00", None)], "k string, feature string, v double")
    c = pca.components(df, "k", value=F.col("v"), block=block, rounds=rounds)
    ids, features = sorted({r[0] for r in rows_}), sorted({r[1] for r in rows_})
    x = _dense(rows_, ids, features)
    size, vectors = np.linalg.eigh(x.T @ x / (len(ids) - 1))
    want = vectors[:, ::-1][:, :2]
    want = want * np.sign(want[np.abs(want).round(9).argmax(axis=0), [0, 1]])
    got = {r["feature"]: r["loading"] for r in c.loadings.collect()}
    assert np.abs(np.array([got[f] for f in features]) - want).max() < 1e-5
    assert np.allclose(c.explained, size[::-1][:2] / size.sum(), atol=1e-7)
    points = {r["id"]: r["point"] for r in c.points.collect()}
    assert np.abs(np.array([points[i] for i in ids]) - x @ want).max() < 1e-3
    top = c.top(3).where("component = 0").orderBy("rank").collect()
    assert [r["feature"] for r in top] == [features[k] for k in np.argsort(-np.abs(want[:, 0]), kind="stable")[:3]]


def test_components_without_variance(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id long, feature string")
    c = pca.components(df, "id")
    assert c.explained == [0.0, 0.0] and [r["loading"] for r in c.loadings.collect()] == [[0.0, 0.0]]
    assert rows(pca.components(df.where("false"), "id").points) == []
    one = pca.components(spark.createDataFrame([(1, "a"), (2, "b")], "id long, feature string"), "id")
    assert abs(one.explained[0] - 1) < 1e-9 and abs(one.explained[1]) < 1e-12
    assert {r["id"]: [round(abs(v), 6) for v in r["point"]] for r in one.points.collect()} == {1: [0.707107, 0.0], 2: [0.707107, 0.0]}


def test_tasks_of_a_split_return_no_copies():
    from quire.operators import metric
    rnd = np.random.default_rng(3)
    v = list(rnd.standard_normal((200, 8)))
    rows_ = pd.DataFrame({"cell": 8 * metric._LENGTH, "node": range(200), "v": v, "weight": 1, "home": True})
    got = metric._assigned(2.0)(rows_, rows_.iloc[:20][["cell", "node", "v"]])
    assert len(got) == 200 and {len(c) for c in got["children"]} == {20}  # every cell needs every vector
    assert all(own in c for own, c in zip(got["own"], got["children"]))


def test_pairs_leave_a_tile_in_pieces(monkeypatch):
    from quire.operators import metric
    monkeypatch.setattr(metric, "_DISTANCES", 1000)
    v = np.ones((100, 4)) / 2
    nodes = pd.DataFrame({"node": range(100)})
    parts = list(metric.pair_kernel(nodes, nodes, metric.Near(0.1, v, v)))
    assert max(len(p["a"]) for p in parts) <= 1000 and len(parts) > 5
    assert sum(len(p["a"]) for p in parts) == 100 * 99 // 2 and all((p["a"] < p["b"]).all() for p in parts)
