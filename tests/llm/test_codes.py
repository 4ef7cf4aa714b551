import math

import duckdb
import numpy as np

from quire.llm import codes
from quire.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _nearest(x, points):
    d = ((x[:, None].astype(object) - points[None].astype(object)) ** 2).sum(-1).astype(np.int64)
    return d.argmin(1), d.min(1)


def _books(seed, n, dim, spread, repeats=0):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, size=(n, dim))
    for _ in range(repeats):
        points[rng.integers(n)] = points[rng.integers(n)]
    return points, rng.integers(-spread, spread + 1, size=(400, dim))


def test_tree_finds_nearest_with_ties_to_the_lowest_index():
    for seed, (n, dim, spread, repeats) in enumerate(
            [(256, 16, 400, 0), (256, 2, 6, 100), (256, 1, 40, 30), (7, 3, 2, 2), (1, 4, 5, 0), (40, 3, 0, 0),
             (200, 4, 1 << 26, 20), (256, 8, 3, 50)]):
        points, queries = _books(seed, n, dim, spread, repeats)
        for degree, leaf in ((8, 6), (2, 1), (30, 3)):
            index, square = codes.Search(points, degree, leaf).nearest(queries)
            want, least = _nearest(queries, points)
            assert (index == want).all() and (square == least).all(), (seed, degree)


def test_tree_leaves_out_subtrees():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, size=(32, 16))
    points = np.repeat(centres, 8, axis=0) + rng.integers(-20, 21, size=(256, 16))
    queries = points[rng.integers(256, size=3000)] + rng.integers(-9, 10, size=(3000, 16))
    search = codes.Search(points)
    index, _ = search.nearest(queries)
    assert (index == _nearest(queries, points)[0]).all()
    assert search.measured < 0.5 * len(queries) * len(points)


def _brute(rows, entries, parts, rounds):
    kept = [(i, label, [math.floor(1024 * c) for c in v]) for i, v, label in rows
            if v is not None and None not in v and all(map(math.isfinite, v))]
    width = min((i, len(x)) for i, _, x in kept if i is not None)[1]
    own = [k for k in kept if len(k[2]) == width]
    first = {}
    for i, _, x in own:
        if i is not None:
            first[i] = min(first.get(i, x), x)
    start = np.array([first[i] for i in sorted(first)[:entries]])
    x = np.array([k[2] for k in own])
    books, step = np.split(start, parts, axis=1), width // parts
    for r in range(rounds + 1):
        found = [_nearest(x[:, p * step:(p + 1) * step], b) for p, b in enumerate(books)]
        if r < rounds:
            for p, b in enumerate(books):
                for e in range(len(b)):
                    mine = x[found[p][0] == e, p * step:(p + 1) * step]
                    if len(mine):
                        b[e] = np.floor_divide(mine.sum(0), len(mine))
    errors = sum(f[1] for f in found)
    total = {}
    for (_, label, _), e in zip(own, errors):
        total[label] = total.get(label, 0) + int(e)
    out = [(i, label, tuple(int(f[0][k]) for f in found), int(errors[k]), total[label]) for k, (i, label, _) in enumerate(own)]
    return sorted(out + [(i, label, None, None, total.get(label)) for i, label, x in kept if len(x) != width], key=repr)


def test_codes_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=8) * 0.01], int(rng.integers(3))) for i in range(120)]
    rows += [(5, rows[9][1], 1), (5, rows[9][1], 1), (None, rows[3][1], 1), (900, rows[3][1], None), (901, rows[4][1], None),
             (902, None, 1), (903, [0.0, None] * 4, 1), (904, [math.nan] * 8, 1), (905, [math.inf] * 8, 1),
             (906, [1.0, 2.0], 1), (907, [], 2), (908, [-0.5 / 1024] * 8, 2)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, x string")
    rounded = [(i, v if v is None else [None if c is None else float(np.float32(c)) for c in v], l) for i, v, l in rows]
    ints = codes.integer_vectors(table)
    for entries, parts, rounds in ((16, 4, 4), (256, 2, 2), (3, 1, 1)):
        books = codes.train(ints, entries, parts, rounds)
        got = codes.with_label_error(codes.encode(ints, books)).collect()
        found = sorted(((r["id"], r["label"], r["codes"] and tuple(r["codes"]), r["error"], r["label_error"]) for r in got), key=repr)
        assert found == _brute(rounded, entries, parts, rounds), entries


def test_defined_edges(spark):
    kind = "vec_id long, embedding array<double>, label string"
    empty = codes.integer_vectors(spark.createDataFrame([], kind))
    assert codes.train(empty) == [] and codes.with_label_error(codes.encode(empty, [])).count() == 0
    odd = codes.integer_vectors(spark.createDataFrame([(1, [1.0, 2.0, 3.0], "a")], kind))
    assert codes.train(odd) == []
    assert [tuple(r) for r in codes.with_label_error(codes.encode(odd, [])).collect()] == [(1, "a", None, None, None)]
    huge = codes.integer_vectors(spark.createDataFrame([(1, [1e300, -1e300, 0.0, 0.0], None), (2, [0.0] * 4, None)], kind))
    assert huge.where("id = 1").first()["x"] == [1 << 26, -(1 << 26), 0, 0]
    books = codes.train(huge)
    assert sorted(tuple(r["codes"]) for r in codes.encode(huge, books).collect()) == [(0, 0, 0, 0), (1, 1, 0, 0)]


def test_hot_labels_are_joined_apart(spark):
    coded = spark.range(3000).selectExpr("id", "if(id % 3 = 0, null, if(id % 3 = 1, -1, id)) AS label",
                                         "array(0) AS codes", "id AS error")
    got = {r["id"]: r["label_error"] for r in codes.with_label_error(coded, share=10).collect()}
    assert len(got) == 3000
    assert all(v == (sum(range(i % 3, 3000, 3)) if i % 3 < 2 else i) for i, v in got.items())


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(ORACLES["op13_gnat_codes"]).fetchall()
    got = QUERIES["op13_gnat_codes"](spark, SF).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
