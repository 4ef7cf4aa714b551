import math
import random

import numpy as np

from quire.llm import vectors


def _table(spark, n=260, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    rows, centre = [], None
    for i in range(n):
        if i % 7 == 0 or centre is None:
            centre = rng.normal(size=dim)
        v = centre * rng.uniform(0.5, 3) + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.12, 0.5])
        rows.append((i, [float(x) for x in v], int(rng.choice([1, 1, 1, 2])), "x"))
    rows += [(900, rows[0][1], rows[0][2], "x"), (901, rows[0][1], rows[0][2], "x"), (901, rows[0][1], rows[0][2], "x"),
             (902, rows[0][1], None, "x"), (903, None, 1, "x"), (904, [0.0] * dim, 1, "x"), (905, [], 1, "x"),
             (906, [1.0, None] + [1.0] * (dim - 2), 1, "x"), (907, [math.inf] * dim, 1, "x"), (908, [math.nan] * dim, 1, "x"),
             (None, rows[0][1], rows[0][2], "x"), (909, [1e-300] * dim, 3, "x"), (910, [1e300] * dim, 3, "x"), (911, [1.0, 1.0], 3, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string"), rows


def _brute(rows, cosine):
    ok = [(k, r) for k, r in enumerate(rows) if r[0] is not None and r[2] is not None and r[1] and None not in r[1]
          and all(map(math.isfinite, r[1])) and any(r[1])]
    links = {k: set() for k in range(len(rows))}
    for a, (_, u, lu, _) in ok:
        for b, (_, v, lv, _) in ok:
            if a < b and lu == lv and len(u) == len(v):
                x, y = np.array(u) / max(map(abs, u)), np.array(v) / max(map(abs, v))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k, (i, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out.append((str(i), len(links[k]), min(rows[x][0] for x in seen) if i is not None else None))
    return sorted(out, key=str)


def test_links_and_components_by_brute_force(spark):
    table, rows = _table(spark)
    wanted = _brute(rows, 0.98)
    assert any(n > 3 for _, n, _ in wanted)
    for sizes in ({}, {"cell": 20, "pivots": 9, "chunk": 50}, {"cell": 7, "pivots": 3, "chunk": 11}):
        found = vectors.near_duplicates(table, cosine=0.98, **sizes).collect()
        assert sorted(((str(r["id"]), r["n_links"], r["component"]) for r in found), key=str) == wanted, sizes


def test_replicas_are_all_that_the_range_needs():
    rng = random.Random(1)
    x = vectors.unit([[rng.gauss(0, 1) for _ in range(5)] for _ in range(300)])
    reach = 0.4
    home, needs = vectors.homes_and_replicas(x, x[:12], reach)
    distance = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    for a, b in zip(*np.nonzero(distance <= reach)):
        assert needs[b, home[a]]
    assert needs[np.arange(len(x)), home].all() and not needs.all()


def test_empty_table(spark):
    table, _ = _table(spark)
    assert vectors.near_duplicates(table.where("false")).count() == 0
    single = vectors.near_duplicates(table.where("vec_id = 3")).collect()
    assert [tuple(r) for r in single] == [(3, 0, 3)]
