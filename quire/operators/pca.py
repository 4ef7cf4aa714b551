"""Principal components of long-form rows (ML3, SRT4, ML7) by block Krylov
iteration.

Rows ``(id, feature, value)`` are a sparse matrix X, one row per id.  A block of
random directions, one number per feature and direction, is multiplied by the
covariance matrix with two joins and aggregates: by feature to the ids, and by
id back to the features.  The blocks of all rounds span the space in which the
components are found.  Neither ids nor features ever come to the driver, only
the blocks' products with each other (block x rounds numbers, squared).

With as many directions as features the result is exact; else its error falls
with the rounds as fast as a conjugate-gradient method's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.hot import join_by_weight
from quire.session import shared_table

BLOCK = 32
ROUNDS = 5
SMALL = 1 << 17  # numbers of a table that is broadcast; larger ones are joined by their keys
_TINY = 1e-12


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Number and array columns side by side."""
    parts = []
    for c in columns:
        values = batch.column(batch.schema.get_field_index(c))
        flat = values.flatten() if pa.types.is_list(values.type) else values
        parts.append(flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0)))
    return np.hstack(parts)


def _product(table: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """``L' R`` over all rows of the table: a partial product for each task."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch, left).T @ _matrix(batch, right)
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, j, total)], names=["i", "j", "p"])

    parts = table.select(*dict.fromkeys(left + right)).mapInArrow(partial, "i long, j long, p double")
    found = parts.groupBy("i", "j").agg(F.sum("p").alias("p")).toArrow()
    i, j, p = (found.column(c).to_numpy() for c in ("i", "j", "p"))
    out = np.zeros((i.max() + 1, j.max() + 1))
    out[i, j] = p
    return out


def _combined(table: DataFrame, columns: list[str], weights: np.ndarray, out: str) -> DataFrame:
    """``table`` with ``out``: linear combinations of the given columns."""
    kept = [c for c in table.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = _matrix(batch, columns) @ weights
                offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(made.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(c)) for c in kept] + [lists], names=[*kept, out])

    kinds = dict(table.dtypes)
    return table.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{out}` array<double>"]))


def _whitening(gram: np.ndarray) -> np.ndarray:
    """A matrix T with ``T' gram T = I`` on the directions that gram has."""
    size, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = size > _TINY * max(size.max(initial=0), _TINY)
    return vectors[:, good] / np.sqrt(size[good])


class Components:
    """``loadings(feature, loading)`` and ``points(id, point)``, arrays with an
    entry for each component, and ``explained``, their shares of the variance.
    Loadings have length one, and their largest entry (of equally large ones the
    first feature's) is positive."""

    def __init__(self, loadings: DataFrame, explained: list[float], points: DataFrame):
        self.loadings, self.explained, self.points = loadings, explained, points

    def top(self, n: int) -> DataFrame:
        """SRT4: the ``n`` features with the largest loadings of each component (of
        loadings equal to 9 digits the first feature's)."""
        long = self.loadings.select("feature", F.posexplode("loading").alias("component", "loading"))
        w = Window.partitionBy("component").orderBy(F.round(F.abs("loading"), 9).desc(), "feature")
        share = F.get(F.array(*[F.lit(float(x)) for x in self.explained]), F.col("component"))
        return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                .select("component", "rank", "feature", "loading", F.abs("loading").alias("abs_loading"),
                        share.alias("explained")))


def components(rows: DataFrame, id_col: str, feature_col: str = "feature", value: Column | None = None, k: int = 2,
               block: int = BLOCK, rounds: int = ROUNDS) -> Components:
    """The first ``k`` principal components of ``rows``, one row per id and feature
    (absent ones are 0; ``value`` is 1 by default).  Rows with nulls count for
    nothing.  Where fewer than ``k`` directions have any variance, the others are 0.
    """
    x = shared_table(rows.select(
        F.col(id_col).alias("id"), F.col(feature_col).cast("string").alias("feature"),
        (F.lit(1.0) if value is None else value.cast("double")).alias("x")).dropna())
    ids = shared_table(x.groupBy("id").agg(F.count(F.lit(1)).alias("w")))
    features = shared_table(x.groupBy("feature").agg(
        F.count(F.lit(1)).alias("w"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")))
    n = ids.count()
    seen = features.agg(F.count(F.lit(1)).alias("n"), F.sum(
        F.col("q") - F.col("s") * F.col("s") / F.lit(float(max(n, 1)))).alias("v")).first()
    width, total = seen["n"], seen["v"] or 0.0
    if n < 2 or total <= _TINY:
        none = F.array(*[F.lit(0.0)] * k)
        return Components(features.select("feature", none.alias("loading")), [0.0] * k, ids.select("id", none.alias("point")))

    block = min(block, width)
    lot = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.pmod(
        F.xxhash64("feature", i), F.lit(1 << 40)).cast("double") / (1 << 39) - 1)
    table = shared_table(features.select("feature", "w", "s", F.array().cast("array<double>").alias("basis"),
                                         F.array().cast("array<double>").alias("image"), lot.alias("way")))
    sums = np.zeros(0)  # of the features' sums times the basis
    for _ in range(rounds):
        # directions at right angles to each other and to those before
        against = _product(table, ["basis", "way", "s"], ["way"])
        earlier, gram, own = against[:len(sums)], against[len(sums):-1], against[-1]
        turn = _whitening(gram - earlier.T @ earlier)
        if not turn.shape[1]:
            break
        weights = np.vstack([-earlier @ turn, turn])
        means = np.concatenate([sums, own]) @ weights
        sums = np.concatenate([sums, means])
        turned = shared_table(_combined(table, ["basis", "way"], weights, "way"))
        moved = _covariance(x, ids, turned, "way", means / n, n, width)
        table = shared_table(turned.join(moved, "feature").select(
            "feature", "w", "s", F.concat("basis", "way").alias("basis"), F.concat("image", "moved").alias("image"),
            F.col("moved").alias("way")))
        if len(sums) >= width:
            break
    both = _product(table, ["basis"], ["basis", "image"])
    white = _whitening(both[:, :len(sums)])
    size, vectors = np.linalg.eigh((lambda h: (h + h.T) / 2)(white.T @ both[:, len(sums):] @ white))
    best = np.argsort(size)[::-1][:k]
    weights = np.zeros((len(sums), k))
    weights[:, :len(best)] = white @ vectors[:, best]
    loadings = shared_table(_combined(table.select("feature", "w", "s", "basis"), ["basis"], weights, "loading").drop("basis"))
    largest = loadings.agg(*[F.min_by(F.col("loading")[i], F.struct(-F.round(F.abs(F.col("loading")[i]), 9), "feature")).alias(f"c{i}")
                             for i in range(k)]).first()
    signs = np.array([-1.0 if x < 0 else 1.0 for x in largest])
    loadings = shared_table(_combined(loadings, ["loading"], np.diag(signs), "loading"))
    points = _projected(x, loadings, "loading", sums @ weights * signs / n, width)
    return Components(loadings.select("feature", "loading"), [*(np.maximum(size[best], 0) * (n - 1) / total).tolist(),
                                                              *[0.0] * (k - len(best))],
                      points.withColumnRenamed("loading", "point"))


def _attached(x: DataFrame, table: DataFrame, key: str, numbers: int) -> DataFrame:
    if numbers <= SMALL:
        return x.join(F.broadcast(table.drop("w")), key)
    return join_by_weight(x, table, [key], "w")


def _sums(x: DataFrame, key: str, way: str, width: int) -> DataFrame:
    """``(key, way)``: values times ``way``, summed by key."""
    added = x.groupBy(key).agg(*[F.sum(F.col("x") * F.col(way)[i]).alias(f"s{i}") for i in range(width)])
    return added.select(key, F.array(*[f"s{i}" for i in range(width)]).alias(way))


def _projected(x: DataFrame, table: DataFrame, way: str, means: np.ndarray, features: int) -> DataFrame:
    """``(id, way)``: the centred rows times the directions ``way`` of the features."""
    joined = _attached(x, table.select("feature", "w", way), "feature", features * len(means))
    centre = F.array(*[F.lit(float(m)) for m in means])
    return _sums(joined, "id", way, len(means)).select("id", F.zip_with(way, centre, lambda a, m: a - m).alias(way))


def _covariance(x: DataFrame, ids: DataFrame, table: DataFrame, way: str, means: np.ndarray, n: int, features: int) -> DataFrame:
    """``(feature, moved)``: the covariance matrix times the directions ``way``."""
    there = shared_table(_projected(x, table, way, means, features).join(ids, "id"))
    # centred projections sum to 0, so the other factor needs no centring
    back = _sums(_attached(x, there, "id", n * len(means)), "feature", way, len(means))
    return back.select("feature", F.transform(way, lambda a: a / (n - 1)).alias("moved"))
