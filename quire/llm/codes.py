"""Product codes of vectors, with entries found by a geometric tree (GNAT).

A vector's integer components are cut into equal parts; every part gets the
index of its codebook's nearest entry.  Codebooks start from given vectors and
are refined by rounds of assignment and averaging.

The nearest entry is searched in a tree over the entries.  A node has a few
split points and, for each split point and each child, the range of distances
from the split point to the child's entries.  A query's distances to the split
points eliminate every child whose range lies farther from them than the best
entry so far.  Ranges and distances are rounded outwards and only strictly
farther children go, and candidates are compared by exact integer squares, so
ties always fall to the lowest index.

Vectors stay in their tasks: a round sends one partial sum per task and entry.
The codebooks (entries x components, whatever the table's size) are the only
thing that comes to the driver and goes out to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import shared_table

ENTRIES = 256
PARTS = 4
ROUNDS = 4
SCALE = 1024
DEGREE = 8  # split points of a node
LEAF = 6  # entries that need no split
LARGEST = 1 << 26  # integer components beyond it count as it
_EXACT = 1 << 53
_ROWS = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two integer matrices."""
    if not (len(a) and len(b) and a.shape[1]):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = int(max(np.abs(a).max(), np.abs(b).max()))
    if 4 * a.shape[1] * most * most < _EXACT:  # every step is an integer that doubles hold
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(a.shape[1]):
        out += np.square(a[:, k, None] - b[None, :, k])
    return out


def _below(square: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(square.astype(np.float64)), -np.inf)


def _above(square: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(square.astype(np.float64)), np.inf)


@dataclass
class Node:
    entries: np.ndarray  # a leaf's entries, or a node's split points
    low: np.ndarray | None = None  # (split point, child): least distance, rounded down
    high: np.ndarray | None = None
    children: list[Node | None] = field(default_factory=list)


def build_tree(points: np.ndarray, which: np.ndarray | None = None, degree: int = DEGREE, leaf: int = LEAF) -> Node:
    """The tree over the rows ``which`` of ``points`` (all by default)."""
    which = np.arange(len(points)) if which is None else which
    if len(which) <= leaf:
        return Node(which)
    distance = squared(points[which], points[which])
    chosen, near = [0], distance[0].copy()
    while len(chosen) < degree and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distance[chosen[-1]])
    if len(chosen) == 1:  # all entries are equal
        return Node(which)
    home = distance[:, chosen].argmin(axis=1)
    home[chosen] = np.arange(len(chosen))
    low = np.stack([_below(distance[chosen][:, home == j].min(axis=1)) for j in range(len(chosen))], axis=1)
    high = np.stack([_above(distance[chosen][:, home == j].max(axis=1)) for j in range(len(chosen))], axis=1)
    rest = np.ones(len(which), dtype=bool)
    rest[chosen] = False
    children = []
    for j in range(len(chosen)):
        own = which[(home == j) & rest]
        children.append(build_tree(points, own, degree, leaf) if len(own) else None)
    return Node(which[chosen], low, high, children)


class Search:
    """Nearest entries of many queries at once; ``measured`` counts distances."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.points, self.measured = points, 0
        self.root = build_tree(points, None, degree, leaf)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each query's nearest entry (the lowest of equally near ones)
        and the squared distance."""
        index = np.full(len(queries), len(self.points), dtype=np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max, dtype=np.int64)
        self._visit(self.root, queries, np.arange(len(queries)), index, best)
        return index, best

    def _visit(self, node: Node, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        square = squared(queries[rows], self.points[node.entries])
        self.measured += square.size
        for k in np.argsort(node.entries):
            entry = node.entries[k]
            better = (square[:, k] < best[rows]) | ((square[:, k] == best[rows]) & (entry < index[rows]))
            best[rows[better]] = square[better, k]
            index[rows[better]] = entry
        if node.low is None:
            return
        down, up = _below(square), _above(square)
        bound = np.full(square.shape, -np.inf)  # no entry of the child is nearer
        for i in range(square.shape[1]):
            np.maximum(bound, down[:, i, None] - node.high[i], out=bound)
            np.maximum(bound, node.low[i] - up[:, i, None], out=bound)
        bound = np.nextafter(bound, -np.inf)
        first = square.argmin(axis=1)
        for j, child in enumerate(node.children):  # the nearest split point's child, for a good first entry
            if child is not None:
                at = np.flatnonzero(first == j)
                self._visit(child, queries, rows[at[bound[at, j] <= _above(best[rows[at]])]], index, best)
        for j, child in enumerate(node.children):
            if child is not None:
                at = np.flatnonzero(first != j)
                self._visit(child, queries, rows[at[bound[at, j] <= _above(best[rows[at]])]], index, best)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``(id, label, x)`` with components ``floor(scale * component)``.  Rows go
    whose vector is null or holds null or non-finite components; results
    beyond 2^26 in size count as that."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))),
                                                          F.lit(float(-LARGEST)))).cast("int"))
    return rows.where(F.coalesce(finite, F.lit(False))).select("id", "label", whole.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _same_length(rows: DataFrame, width: int) -> DataFrame:
    return rows.where(F.size("x") == width)


def train(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook (entries x components) for each part position of the vectors
    ``x`` of :func:`integer_vectors`.

    The vectors' length is that of the smallest id (for repeated ids: of the
    shortest one); vectors of other lengths don't count.  A codebook starts as
    that part of the ``entries`` smallest ids (for repeated ids: the smallest
    vector; null ids start none); unused entries stay as they are.  No list of
    codebooks (empty) comes out where there's no vector or its length can't be
    cut into equal parts.
    """
    lengths = rows.where(F.col("id").isNotNull()).agg(F.min(F.struct("id", F.size("x").alias("n"))).alias("m")).first()
    if lengths["m"] is None or lengths["m"]["n"] % parts:
        return []
    width = lengths["m"]["n"]
    usable = _same_length(rows, width)
    ids = [r["id"] for r in usable.where(F.col("id").isNotNull()).select("id").distinct()
           .orderBy("id").limit(entries).collect()]
    start = usable.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("x").alias("x")).collect()
    first = np.array([r["x"] for r in sorted(start, key=lambda r: r["id"])], dtype=np.int64).reshape(len(start), width)
    books = list(np.split(first, parts, axis=1))
    for _ in range(rounds if width else 0):
        books = _averaged(usable, books)
    return books


def _averaged(usable: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: entries become the floored means of the parts they get."""
    count, part = len(books[0]), books[0].shape[1]
    width = part * len(books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("rows", pa.int64()),
                        ("sums", pa.list_(pa.int64()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Search(b) for b in books]
        sums = np.zeros((len(books), count, part), dtype=np.int64)
        used = np.zeros((len(books), count), dtype=np.int64)
        for x in _slices(batches, "x", width):
            for p, tree in enumerate(trees):
                own = x[:, p * part:(p + 1) * part]
                index, _ = tree.nearest(own)
                np.add.at(sums[p], index, own)
                used[p] += np.bincount(index, minlength=count)
        p, e = np.nonzero(used)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(used[p, e]),
                 pa.array(list(sums[p, e]), type=pa.list_(pa.int64()))], schema=schema)

    sent = usable.select("x").mapInArrow(partial, "part int, entry int, rows long, sums array<long>")
    total = (sent.select("part", "entry", "rows", F.posexplode("sums").alias("at", "s"))
             .groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("rows").alias("n"))
             .select("part", "entry", "at", F.col("s"), "n").collect())  # at most entries x components
    new = [b.copy() for b in books]
    for r in total:
        new[r["part"]][r["entry"], r["at"]] = r["s"] // r["n"]
    return new


def _slices(batches: Iterator[pa.RecordBatch], column: str, width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield _matrix(batch.slice(start, _ROWS).column(batch.schema.get_field_index(column)), width)


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``(id, label, codes, error)`` for every row of :func:`integer_vectors`:
    the index of the nearest entry for each part, and the squared distances'
    sum.  Both are null for vectors whose length the codebooks don't fit."""
    kinds = dict(rows.dtypes)
    if not books:
        return rows.select("id", "label", F.lit(None).cast("array<int>").alias("codes"),
                           F.lit(None).cast("long").alias("error"))
    part = books[0].shape[1]
    width = part * len(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Search(b) for b in books]
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                x = _matrix(batch.column(2), width)
                found = [tree.nearest(x[:, p * part:(p + 1) * part]) for p, tree in enumerate(trees)]
                codes = np.stack([index for index, _ in found], axis=1).astype(np.int32)
                offsets = np.arange(len(x) + 1, dtype=np.int32) * len(books)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel())),
                     pa.array(sum(d for _, d in found))], names=["id", "label", "codes", "error"])

    fits = _same_length(rows, width).select("id", "label", "x")
    other = rows.where(F.size("x") != width).select(
        "id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    return fits.mapInArrow(coded, f"id long, label {kinds['label']}, codes array<int>, error long").unionByName(other)


def with_label_error(coded: DataFrame, share: int = 1000) -> DataFrame:
    """``coded`` plus ``label_error``, the error summed over equal labels (nulls
    are equal).  Labels with more than one in ``share`` of all rows, so fewer
    than ``share``, are broadcast; no other label is large enough to be hot."""
    coded = shared_table(coded)
    totals = shared_table(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    size = totals.agg(F.sum("n")).first()[0] or 0
    totals = totals.select(F.col("label").alias("_label"), "label_error", (F.col("n") * share > size).alias("_hot"))
    hot = F.broadcast(totals.where("_hot"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    rest = coded.join(hot, same, "left_anti").join(totals.where(~F.col("_hot")), same)
    return coded.join(hot, same).unionByName(rest).drop("_label", "_hot")
