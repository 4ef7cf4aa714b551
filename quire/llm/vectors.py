"""Embedding near-duplicates: an exact metric range join on pivots.

Cosine at least c is distance at most ``sqrt(2 - 2c)`` between unit vectors.  In
each label, pivots taken from the vectors cut the space into cells: a vector's
home is the cell of its nearest pivot.  By the triangle inequality a vector can
be within range of another cell's home vectors only if it is nearly as near to
that pivot (``d(v, p) <= d(v, home) + 2 r``) and, more tightly, lies within the
range of the border between both; it is then replicated there.  So every home
vector finds all its partners in its own cell, and cells join independently.

Equal vectors of a label are one vector with a weight.  A cell is joined in
tiles of bounded size; a tile gives each home vector its number of links and
each linked vector the smallest vector of its connected part, never pairs.
Labels and cells may hold any share of the rows: every step deals them out in
chunks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hash_fraction, shared_table
from quire.operators.graph import connected_components

CELL = 4096  # vectors of a label for each pivot; also home vectors of a tile
PIVOTS = 64  # most pivots of a label (about: they are chosen by a hash)
CHUNK = 16384  # vectors dealt to a task, and partners in a tile
_ROWS = 512


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length one, in double precision (safe for large and small values)."""
    x = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def homes_and_replicas(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector, and which cells (vector, pivot) need it."""
    square = np.maximum(0.0, 2 - 2 * (x @ pivots.T))
    distance = np.sqrt(square)
    home = square.argmin(axis=1)
    rows = np.arange(len(x))
    near = distance <= distance[rows, home][:, None] + 2 * reach + 1e-9
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots @ pivots.T)))[home]
    border = (square - square[rows, home][:, None]) <= 2 * apart * (reach + 1e-9) + 1e-12
    return home, near & border


def _assign(reach: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=["label", "cell", "node", "v", "weight", "home"])
        parts = []
        if pivots.empty:
            return rows[["label", "node", "v", "weight"]].assign(cell=0, home=True)
        centres = unit(pivots.sort_values("node")["v"])
        for start in range(0, len(rows), _ROWS):
            part = rows.iloc[start:start + _ROWS]
            home, needs = homes_and_replicas(unit(part["v"]), centres, reach)
            which, cell = np.nonzero(needs)
            parts.append(part.iloc[which][["label", "node", "v", "weight"]]
                         .assign(cell=cell, home=home[which] == cell))
        return pd.concat(parts)
    return run


def _join_tile(cosine: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Links of a tile's home vectors, and the connected part of every linked one."""
    def run(home: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if home.empty or other.empty:
            return pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")
        a, b = unit(home["v"]), unit(other["v"])
        nodes, place = np.unique(np.concatenate([home["node"], other["node"]]), return_inverse=True)
        left, right = place[:len(home)], place[len(home):]
        weight = other["weight"].to_numpy(np.int64)
        root = np.arange(len(nodes))
        links = np.zeros(len(home), dtype=np.int64)
        for start in range(0, len(home), _ROWS):
            near = a[start:start + _ROWS] @ b.T >= cosine
            near &= left[start:start + _ROWS, None] != right[None]
            links[start:start + _ROWS] = near @ weight
            for row in np.flatnonzero(near.any(axis=1)):
                members = np.append(right[near[row]], left[start + row])
                roots = np.unique(root[members])
                if len(roots) > 1:
                    root[np.isin(root, roots[1:])] = roots[0]
        moved = root != np.arange(len(nodes))
        return pd.concat([
            pd.DataFrame({"node": home["node"].to_numpy(), "links": links, "root": home["node"].to_numpy()}),
            pd.DataFrame({"node": nodes[moved], "links": 0, "root": nodes[root[moved]]})])
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", cosine: float = 0.98, cell: int = CELL, pivots: int = PIVOTS,
                    chunk: int = CHUNK) -> DataFrame:
    """``(id, n_links, component)`` for every row of ``vectors``.

    Vectors link when their labels are equal and not null and their cosine is
    ``cosine`` or more.  Null, empty and zero vectors, those with null or
    non-finite components, and rows with a null id link with nothing; neither
    do vectors of different length.  Repeated rows are vectors of their own.
    ``component`` is the smallest id reachable, the row's own without links.
    """
    id_, v = F.col("id"), F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    usable = (id_.isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
              & F.exists("v", lambda x: x != 0))
    # vectors of another length are another label
    same = F.concat_ws(":", F.size("v"), "label")
    valid = rows.where(F.coalesce(usable, F.lit(False))).select("id", same.alias("label"), "v")
    groups = shared_table(valid.groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight")))
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sized = groups.join(sizes, "label").withColumn(
        "parts", F.ceil(F.col("n") / chunk)).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")))
    chosen = sized.where((F.col("n") > cell) & (
        hash_fraction(F.col("node"), salt="pivot") < F.least(F.lit(pivots), F.ceil(F.col("n") / cell)) / F.col("n")))
    chosen = chosen.select("label", "node", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    chosen = chosen.toDF(*chosen.columns)  # columns of its own, as cogroup asks for
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    dealt_out = sized.select("label", "salt", "node", "v", "weight")
    dealt_out = dealt_out.toDF(*dealt_out.columns)
    members = shared_table(
        dealt_out.groupBy("label", "salt")
        .cogroup(chosen.groupBy("label", "salt"))
        .applyInPandas(_assign(reach), f"label string, cell int, node long, v {dict(rows.dtypes)['v']}, "
                                       "weight long, home boolean"))

    # tiles of a cell: home vectors in rows, all its vectors in columns
    tiles = members.groupBy("label", "cell").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / cell).alias("down"), F.ceil(F.count(F.lit(1)) / chunk).alias("across"))
    dealt = members.join(tiles, ["label", "cell"])
    row, column = (F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))) for n in ("down", "across"))
    keys = ["label", "cell", "row", "column"]
    home = dealt.where("home").select(
        "label", "cell", row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("column"),
        "node", "v")
    other = dealt.where(F.col("down") > 0).select(
        "label", "cell", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("row"), column.alias("column"),
        "node", "v", "weight")
    home, other = home.toDF(*home.columns), other.toDF(*other.columns)
    found = shared_table(home.groupBy(keys).cogroup(other.groupBy(keys))
                         .applyInPandas(_join_tile(cosine), "node long, links long, root long"))

    roots = connected_components(found, "node", "root")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = (counted.join(roots.withColumnRenamed("v", "member"), F.col("node") == F.col("member"), "left")
          .select("node", "links", F.coalesce("root", "node").alias("component")))
    per_group = groups.join(of, "node")
    linked = valid.join(per_group, ["label", "v"]).select(
        "id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), id_.alias("component"))
    return linked.union(alone)
