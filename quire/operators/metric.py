"""Metric partition of vectors for range joins by cosine (JN2, ML4).

Cosine distance at most ``eps`` is Euclidean distance at most ``sqrt(2 eps)``
between unit vectors.  Pivots cut the vectors into cells: a vector's home is the
cell of its nearest pivot, and by the triangle inequality it can be in range of
another cell's home vectors only if it is nearly as near to that pivot, and no
farther than the range from the border between both; there it gets a copy.  So
every home vector meets all its neighbours in its own cell.

Cells that are too large get pivots of their own, level by level, until they
fit.  A split is undone if it leaves most of the comparisons (a loose range, or
vectors spread evenly, cannot be cut by any pivots).  What is still large is
compared in tiles, so that a task's memory never depends on the data.  Tasks
return the numbers of a vector's cells; its copies are made by Spark, once the
split is known to be worth them.

Kernels run over (home vectors, all vectors) of a tile and yield what they find
piece by piece; only that leaves the tile: sums, parts and short lists, not
pairs, unless pairs are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import shared_table, shuffle_partitions

CELL = 8192  # vectors of a cell that needs no split; also home vectors of a tile
CHUNK = 16384  # vectors dealt to a task for its pivots, and partners in a tile
PIVOTS = 64  # pivots of a cell, about (they are chosen by a hash)
LEVELS = 4
_LENGTH = 1 << 40  # a cell's number: the vectors' length, then a digit from 1 for each level
_BASE = 4 * PIVOTS
GAIN = 0.7  # share of the comparisons from which on a split isn't worth its copies
_ROWS = 512
_DISTANCES = 1 << 20  # of a tile, at once

Kernel = Callable[[pd.DataFrame, pd.DataFrame, "Near"], Iterator[dict[str, np.ndarray]]]


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length one, in double precision (safe for large and small values)."""
    return _scaled(np.vstack([np.asarray(v, dtype=np.float64) for v in vectors]))


def _scaled(x: np.ndarray) -> np.ndarray:
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of an Arrow column; those of a tile have one length."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks])
    return _scaled(flat.astype(np.float64).reshape(len(vectors), -1))


def usable(vec: str):
    """Vectors that have a direction: no nulls, finite, not zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def needs(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each unit vector, and which cells (vector, pivot) need it."""
    square = np.maximum(0.0, 2 - 2 * (x @ pivots.T))
    home = square.argmin(axis=1)
    own = square[np.arange(len(x)), home][:, None]
    distance = np.sqrt(square)
    near = distance <= np.sqrt(own) + 2 * reach + 1e-9
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots @ pivots.T)))[home]
    return home, near & (square - own <= 2 * apart * (reach + 1e-9) + 1e-12)


class Near:
    """Which vectors of a tile are in range, a few rows at a time."""

    def __init__(self, eps: float, home: np.ndarray, other: np.ndarray):
        self.eps, self.a, self.b = eps, home, other

    def __iter__(self):
        rows = max(1, _DISTANCES // len(self.b))
        for start in range(0, len(self.a), rows):
            distance = self.a[start:start + rows] @ self.b.T
            np.subtract(1.0, distance, out=distance)
            np.clip(distance, 0.0, 1.0, out=distance)
            yield start, distance, distance <= self.eps


def _assigned(reach: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Rows with the number of their nearest pivot and those of the pivots whose
    cells need them (-1: no split)."""
    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        kept = rows[["cell", "node", "v", "weight", "home"]]
        if rows.empty or len(pivots) < 2:  # no split
            return kept.assign(own=-1, children=[[-1]] * len(rows))
        centres = unit(pivots.sort_values("node")["v"])
        own, children = [], []
        for start in range(0, len(rows), _ROWS):
            nearest, wanted = needs(unit(rows["v"].iloc[start:start + _ROWS]), centres, reach)
            own.append(nearest)
            children += [np.flatnonzero(w) for w in wanted]
        return kept.assign(own=np.concatenate(own), children=children)
    return run


def cells(nodes: DataFrame, eps: float, cell: int = CELL, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """``(cell, node, v, weight, home)`` of ``nodes(node, v, weight)``, a stored table.

    Every node is at home in one cell, and that cell has a copy of each node
    within ``eps`` of it.  Vectors must be :func:`usable`; vectors of different
    length are in different cells.
    """
    kind = dict(nodes.dtypes)["v"]
    reach = math.sqrt(2 * eps) if eps < 1 else 2.0
    schema = f"cell long, node long, v {kind}, weight long, home boolean, own int, children array<int>"
    open_ = nodes.select((F.size("v") * F.lit(_LENGTH)).alias("cell"), "node", "v", F.col("weight").cast("long"),
                         F.lit(True).alias("home"))
    done = None
    for level in range(LEVELS):
        sizes = open_.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("h"))
        if level == 0 and (eps >= 1 or (sizes.agg(F.max("n")).first()[0] or 0) <= cell):
            return open_
        sized = open_.join(sizes, "cell")
        small = sized.where((F.col("n") <= cell) | (F.col("h") == 0))
        large = sized.where((F.col("n") > cell) & (F.col("h") > 0))
        done = _plus(done, small.select(*open_.columns))
        if not large.limit(1).count():
            break
        parts = F.ceil(F.col("n") / chunk)
        lot = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)).cast("double") / (1 << 30)
        few = F.least(F.lit(pivots), F.ceil(F.col("h") / cell) + 1)
        chosen = large.where(F.col("home") & (lot < few / F.col("h"))).select(
            "cell", "node", "v", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        dealt = large.select(*open_.columns, F.pmod(F.xxhash64("node"), parts).alias("salt"))
        chosen, dealt = chosen.toDF(*chosen.columns), dealt.toDF(*dealt.columns)
        split = shared_table(dealt.groupBy("cell", "salt").cogroup(chosen.groupBy("cell", "salt"))
                             .applyInPandas(_assigned(reach), schema))
        # comparisons before and after; a split without gain is undone before it is copied
        at_home = (F.col("home") & (F.col("k") == F.col("own"))).alias("home")
        by_child = split.select("cell", "home", "own", F.explode("children").alias("k")).select("cell", "k", at_home) \
            .groupBy("cell", "k").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("h"))
        after = by_child.groupBy("cell").agg(F.sum(F.col("n") * F.col("h")).alias("after"))
        gain = after.join(sizes, "cell").select(
            "cell", (F.col("after") <= F.col("n") * F.col("h") * GAIN).alias("better"))
        whole = large.select(*open_.columns).join(gain.where(~F.col("better")), "cell").select(*open_.columns)
        done = _plus(done, whole)
        inner = F.col("cell") % _LENGTH
        child = F.when(F.col("k") < 0, F.col("cell")).otherwise(F.col("cell") - inner + inner * _BASE + F.col("k") + 1)
        open_ = shared_table(split.join(gain.where("better"), "cell").select("*", F.explode("children").alias("k"))
                             .select(child.alias("cell"), "node", "v", "weight", at_home))
    else:
        done = _plus(done, open_)
    return shared_table(done)


def _plus(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def by_tile(members: DataFrame, eps: float, kernel: Kernel, schema: str, extra: tuple[str, ...] = (),
            cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """``kernel`` over every tile: at most about ``cell`` home vectors by ``chunk``
    vectors of a cell.  Rows have ``node``, ``v``, ``weight`` and the columns
    ``extra`` of ``members``."""
    sizes = members.groupBy("cell").agg(F.ceil(F.count_if("home") / cell).alias("down"),
                                        F.ceil(F.count(F.lit(1)) / chunk).alias("across"))
    dealt = members.join(sizes, "cell").where(F.col("down") > 0)
    row, column = (F.pmod(F.xxhash64("node"), F.col(n)) for n in ("down", "across"))
    keys, kept = ["cell", "row", "column"], ["node", "v", "weight", *extra]

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    home = dealt.where("home").select("cell", row.alias("row"), every("across").alias("column"), *kept, F.lit(True).alias("left"))
    other = dealt.select("cell", every("down").alias("row"), column.alias("column"), *kept, F.lit(False).alias("left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(list(batches))
        left = tile["left"].to_numpy()
        plain = tile.select(["node", "weight", *extra]).to_pandas()
        a, b = plain[left].reset_index(drop=True), plain[~left].reset_index(drop=True)
        if a.empty or b.empty:
            return
        v = _matrix(tile["v"])
        del tile, plain
        for found in kernel(a, b, Near(eps, v[left], v[~left])):
            yield pa.RecordBatch.from_pydict(found)

    # small in bytes, but not in work: all partitions are used
    return (home.unionByName(other).repartition(shuffle_partitions(members.sparkSession), *keys).groupBy(keys)
            .applyInArrow(run, schema))


# Kernels ------------------------------------------------------------------------------------
def count_kernel(a: pd.DataFrame, b: pd.DataFrame, near: Near) -> Iterator[dict[str, np.ndarray]]:
    """``node, near``: weight of the vectors in range, the node's own included."""
    weight = b["weight"].to_numpy(np.int64)
    found = np.concatenate([hit @ weight for _, _, hit in near])
    yield {"node": a["node"].to_numpy(), "near": found}


def pair_kernel(a: pd.DataFrame, b: pd.DataFrame, near: Near) -> Iterator[dict[str, np.ndarray]]:
    """``a, b, dist``: pairs of different nodes in range, ``a < b``."""
    left, right = a["node"].to_numpy(), b["node"].to_numpy()
    for start, distance, hit in near:
        hit &= left[start:start + len(hit), None] < right[None]
        i, j = np.nonzero(hit)
        if len(i):
            yield {"a": left[start + i], "b": right[j], "dist": distance[i, j]}


def part_kernel(a: pd.DataFrame, b: pd.DataFrame, near: Near) -> Iterator[dict[str, np.ndarray]]:
    """``node, other, border``: a smaller node of the same connected part of core
    nodes, for every core node that isn't its part's smallest; and the core
    nodes in range of each home node that is none (fewer than the threshold)."""
    core_a, core_b = a["core"].to_numpy(bool), b["core"].to_numpy(bool)
    left, right = a["node"].to_numpy(), b["node"].to_numpy()
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    at_a, at_b = place[:len(a)], place[len(a):]
    parent = np.arange(len(nodes))

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (parent[up] == up).all():
                return up
            parent[x] = x = parent[up]

    edge_node, edge_core = [], []
    for start, _, hit in near:
        hit &= core_b[None]
        for k in np.flatnonzero(hit.any(axis=1)):
            partners = at_b[hit[k]]
            if core_a[start + k]:
                own = np.unique(roots(np.append(partners, at_a[start + k])))
                parent[own] = own[0]
            else:
                edge_node.append(np.full(len(partners), left[start + k]))
                edge_core.append(nodes[partners])
    root = roots(np.arange(len(nodes)))
    moved = root != np.arange(len(nodes))
    none = np.zeros(0, dtype=np.int64)
    yield {"node": nodes[moved], "other": nodes[root[moved]], "border": np.zeros(moved.sum(), dtype=bool)}
    pairs = np.concatenate([none, *edge_node])
    yield {"node": pairs, "other": np.concatenate([none, *edge_core]), "border": np.ones(len(pairs), dtype=bool)}
