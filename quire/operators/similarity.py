"""Exact similarity joins: JN1 (Jaccard of sets), JN2 (cosine of vectors).

Neither compares all pairs.  Vectors are cut into metric cells (see
:mod:`quire.operators.metric`).  Sets are joined on the rarest items of their
prefixes: two sets with a Jaccard similarity of ``t`` share one of the first
``n - ceil(t n) + 1`` items of each, in any common order.  Where the sets hold
so much of a small vocabulary that nearly all meet on some prefix item, and most
on many, each pair is compared once instead, by products of 0/1 blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import metric
from quire.plans.hot import join_by_weight
from quire.session import shared_table, shuffle_partitions

# Sets of a prefix item that are compared in one task, squared; more are split.
PREFIX_BLOCK = 2048
_BITS = 256
# Items that sets may have in all to be compared as 0/1 rows.
DENSE_ITEMS = 4096
# A meeting on a prefix item takes as long as so many cells of a product (measured: 400 ns, 0.1 ns).
MEETING_CELLS = 4096
_CELLS = 1 << 20  # cells of a product, four times as many in a factor


def cosine_edges(vecs: DataFrame, eps: float, id_col: str = "id", vec_col: str = "vec",
                 cell: int = metric.CELL) -> DataFrame:
    """Pairs ``(src < dst, dist)`` with cosine distance ``clip(1 - cos, 0, 1) <= eps``.

    Null, empty and zero vectors, those with null or non-finite components, and
    null ids link with nothing; neither do vectors of different length.  Vectors
    need not have length one.  Repeated ids are one point (its smallest vector).
    """
    points = (vecs.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
              .where(F.col("id").isNotNull() & metric.usable("v")).groupBy("id").agg(F.min("v").alias("v")))
    # node numbers in the order of the ids: src < dst holds for both
    ordered = points.repartitionByRange("id").sortWithinPartitions("id")
    named = shared_table(ordered.withColumn("node", F.monotonically_increasing_id()))
    members = metric.cells(named.select("node", "v", F.lit(1).cast("long").alias("weight")), eps, cell=cell)
    found = metric.by_tile(members, eps, metric.pair_kernel, "a long, b long, dist double", cell=cell)
    names = named.select("node", "id")
    return (found.join(names.select(F.col("node").alias("a"), F.col("id").alias("src")), "a")
            .join(names.select(F.col("node").alias("b"), F.col("id").alias("dst")), "b").select("src", "dst", "dist"))


def _numbered(sets: DataFrame, id_col: str, item_col: str) -> tuple[DataFrame, int]:
    """Sets as sorted token arrays, and the number of items.

    Tokens are numbers of the items, rarest first; those of up to ``DENSE_ITEMS``
    items have no gaps.
    """
    rows = shared_table(sets.select(F.col(id_col).alias("id"), F.col(item_col).cast("string").alias("item"))
                        .where("id IS NOT NULL AND item IS NOT NULL").distinct())
    items = shared_table(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    many = items.count()  # one number
    if many <= DENSE_ITEMS:
        ranked = items.agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("all")) \
            .select(F.posexplode("all").alias("token", "x")).select("x.n", "x.item", F.col("token").cast("long").alias("token"))
    else:
        ranked = items.repartitionByRange("n", "item").sortWithinPartitions("n", "item") \
            .withColumn("token", F.monotonically_increasing_id())
    tokens = join_by_weight(rows, shared_table(ranked), ["item"], "n").groupBy("id").agg(
        F.sort_array(F.collect_list("token")).alias("tokens"))
    return shared_table(tokens.withColumn("set", F.monotonically_increasing_id())), many


def _prefixes(whole: DataFrame, t: float) -> DataFrame:
    """One row for each prefix token of each set."""
    n = F.size("tokens")
    # a little longer than the bound, against rounding
    length = F.least(n, n - F.ceil(n * t - 1e-9).cast("int") + 1)
    return whole.select("set", "tokens", F.posexplode(F.slice("tokens", F.lit(1), length)).alias("place", "token"))


def _bits(number: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """A bitmap of ``_BITS`` bits for each set."""
    bits = np.zeros((sets, _BITS), dtype=bool)
    bits[owner, number % _BITS] = True
    return np.packbits(bits, axis=1).view(np.uint64)


class _Sets:
    """Sets of a tile in one flat array, with tokens numbered within the tile."""

    def __init__(self, rows: pd.DataFrame, vocabulary: np.ndarray):
        lists = [np.asarray(x, dtype=np.int64) for x in rows["tokens"]]
        self.size = np.array([len(x) for x in lists])
        self.place, self.name = rows["place"].to_numpy(), rows["set"].to_numpy()
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.searchsorted(vocabulary, np.concatenate(lists))
        self.bits = _bits(self.flat, np.repeat(np.arange(len(lists)), self.size), len(lists))

    def tokens(self, k: int, stop: int | None = None) -> np.ndarray:
        return self.flat[self.start[k]:self.start[k] + (self.size[k] if stop is None else stop)]

    def common(self, has: np.ndarray, which: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Marked tokens among the first ``lengths`` of the sets ``which``."""
        total = int(lengths.sum())
        owner = np.repeat(np.arange(len(which)), lengths)
        within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        hit = has[self.flat[self.start[which][owner] + within]]
        return np.bincount(owner[hit], minlength=len(which))


def _verify(t: float):
    """Pairs of one prefix token's sets.  Length, place and a bitmap's bound on
    the common tokens sift them; a pair is verified only under its smallest
    common token, so once."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["down"].iloc[0] == pdf["across"].iloc[0]
        first, second = pdf[pdf["block"] == pdf["down"]], pdf[pdf["block"] == pdf["across"]]
        if not (len(first) and len(second)):
            return pd.DataFrame({"a": [], "b": [], "inter": [], "union": [], "jaccard": []})
        vocabulary = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["tokens"]]))
        left = _Sets(first, vocabulary)
        right = left if same else _Sets(second, vocabulary)
        has = np.zeros(len(vocabulary), dtype=bool)
        none = np.zeros(0, dtype=np.int64)
        found_a, found_b, found_inter, found_union = [none], [none], [none], [none]
        for i, (size, place) in enumerate(zip(left.size, left.place)):
            wanted = t / (1 + t) * (size + right.size) - 1e-9  # least number of common tokens
            apart = np.bitwise_count(left.bits[i] ^ right.bits).sum(axis=1, dtype=np.int64)
            fits = (size + right.size - apart) / 2 >= wanted
            fits &= np.minimum(size - place, right.size - right.place) >= wanted
            if same:
                fits[:i + 1] = False
            which = np.flatnonzero(fits)
            if not len(which):
                continue
            early = left.tokens(i, place)  # a pair with an earlier common token meets there
            has[early] = True
            which = which[right.common(has, which, right.place[which]) == 0]
            has[left.tokens(i)] = True
            inter = right.common(has, which, right.size[which])
            has[left.tokens(i)] = False
            union = size + right.size[which] - inter
            near = inter / union >= t
            found_a.append(np.full(near.sum(), left.name[i]))
            found_b.append(right.name[which[near]])
            found_inter.append(inter[near])
            found_union.append(union[near])
        inter, union = np.concatenate(found_inter), np.concatenate(found_union)
        return pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b), "inter": inter, "union": union,
                             "jaccard": inter / union})
    return run


def _packed(items: int):
    """Sets as bitmaps of ``items`` bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            size = lists.value_lengths().to_numpy()
            has = np.zeros((len(lists), items), dtype=bool)
            has[np.repeat(np.arange(len(lists)), size), lists.flatten().to_numpy()] = True
            bits = pa.array([row.tobytes() for row in np.packbits(has, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("id"), pa.array(size, pa.int64()), bits],
                                             names=["block", "id", "size", "bits"])
    return run


def _products(t: float, items: int):
    """Pairs of two blocks of bitmaps.  Two more columns of the factors take
    ``t / (1 + t)`` of both sizes off the common items, so what is left of a pair
    that is near enough is not below 0; the rest is sifted, then verified."""
    share = t / (1 + t)

    def factor(bits: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        x = np.empty((len(bits), items + 2), dtype=np.float32)
        x[:, :items] = np.unpackbits(bits, axis=1, count=items)
        x[:, items], x[:, items + 1] = first, second
        return x

    def block(rows: pa.ListScalar) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        ids, size, bits = (pa.RecordBatch.from_struct_array(rows.values).column(c) for c in ("id", "size", "bits"))
        return ids, size.to_numpy(), np.frombuffer(b"".join(bits.to_pylist()), dtype=np.uint8).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for down, across, one, two in zip(*(batch.column(c) for c in ("down", "across", "first", "second"))):
                same = down == across
                (ids, size, bits), (others, their, more) = block(one), block(two)
                wide = min(len(others), 4 * _CELLS // (items + 2))
                for right in range(0, len(others), wide):
                    y = factor(more[right:right + wide], 1, -share * their[right:right + wide])
                    tall = max(1, _CELLS // len(y))
                    for left in range(0, min(len(ids), right + wide) if same else len(ids), tall):
                        x = factor(bits[left:left + tall], -share * size[left:left + tall], 1)
                        over = x @ y.T
                        i, j = np.divmod(np.flatnonzero(over > -0.1), len(y))  # far above the rounding of float32
                        above = over[i, j]
                        i, j = i + left, j + right
                        if same:
                            upper = i < j
                            i, j, above = i[upper], j[upper], above[upper]
                        both = size[i] + their[j]
                        inter = np.rint(above + share * both).astype(np.int64)
                        ratio = inter / (both - inter)
                        near = np.flatnonzero(ratio >= t)
                        i, j, inter = i[near], j[near], inter[near]
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(i)), others.take(pa.array(j)), pa.array(inter), pa.array(both[near] - inter),
                             pa.array(ratio[near])], names=["a", "b", "inter", "union", "jaccard"])
    return run


def _by_products(whole: DataFrame, t: float, items: int, sets: int, block: int) -> DataFrame:
    """Every pair of sets meets once, in the tile of its two blocks."""
    spark = whole.sparkSession
    blocks = max(-(-sets // (4 * block)), min(8, -(-sets // block)))
    dealt = whole.select(F.pmod(F.xxhash64("set"), F.lit(blocks)).alias("block"), "id", "tokens")
    name = whole.schema["id"].dataType.simpleString()
    packed = dealt.mapInArrow(_packed(items), f"block long, id {name}, size long, bits binary")
    held = shared_table(packed.groupBy("block").agg(F.collect_list(F.struct("id", "size", "bits")).alias("sets")))
    down = held.select(F.col("block").alias("down"), F.col("sets").alias("first"),
                       F.explode(F.sequence("block", F.lit(blocks - 1).cast("long"))).alias("across"))
    across = held.select(F.col("block").alias("across"), F.col("sets").alias("second"),
                         F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("down"))
    # small in bytes, but not in work: all partitions are used
    parts = max(shuffle_partitions(spark), blocks * (blocks + 1) // 32)
    tiles = down.repartition(parts, "down", "across").hint("merge").join(across.repartition(parts, "down", "across"), ["down", "across"])
    found = tiles.mapInArrow(_products(t, items), f"a {name}, b {name}, inter long, union long, jaccard double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "inter", "union", "jaccard")


def _by_prefix(whole: DataFrame, many: DataFrame, t: float, block: int) -> DataFrame:
    """Pairs of sets meet in the tiles of their common prefix items."""
    prefix = _prefixes(whole, t)
    dealt = prefix.join(many.withColumn("blocks", F.ceil(F.col("n") / block)), "token")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = dealt.select("token", "set", "tokens", "place", "block", other).select(
        "token", "set", "tokens", "place", "block", F.least("block", "other").alias("down"),
        F.greatest("block", "other").alias("across"))
    # small in bytes, but not in work: all partitions are used
    found = tiles.repartition(shuffle_partitions(whole.sparkSession), "token", "down", "across") \
        .groupBy("token", "down", "across").applyInPandas(
        _verify(t), "a long, b long, inter long, union long, jaccard double")
    a, b = (whole.select(F.col("set").alias(s), F.col("id").alias(f"_{s}")) for s in ("a", "b"))
    return found.join(a, "a").join(b, "b").select(
        F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "inter", "union", "jaccard")


def jaccard_pairs(sets: DataFrame, id_col: str = "id", item_col: str = "item",
                  min_similarity: float = 0.5, block: int = PREFIX_BLOCK) -> DataFrame:
    """Pairs ``(a < b)`` with ``|A & B| / |A | B| >= min_similarity``, with
    intersection and union sizes; the threshold must be positive (at 0 nearly
    all pairs would come out).

    ``sets(id, item)`` is the long form of 0/1 rows; repeated rows count once,
    rows with a null id or item not at all.  A prefix item of very many sets is
    split into blocks of about ``block`` sets, compared two by two.  Where that
    would take longer than all pairs by products (see :func:`_products`), both
    counted, blocks of up to four times as many sets are multiplied.
    """
    if min_similarity <= 0:
        raise ValueError("jaccard_pairs needs a positive threshold")
    whole, items = _numbered(sets, id_col, item_col)
    many = _prefixes(whole, min_similarity).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if 0 < items <= DENSE_ITEMS:
        n = F.col("n").cast("double")
        meetings = many.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0  # one number
        count = whole.count()
        if count * (count - 1) / 2 * (items + 64) <= meetings * MEETING_CELLS:
            return _by_products(whole, min_similarity, items, count, block)
    return _by_prefix(whole, many, min_similarity, block)


def jaccard(a_items, b_items) -> float:
    """Pair formula; two empty sets count as identical (1.0)."""
    sa, sb = set(a_items), set(b_items)
    if not sa and not sb:
        return 1.0
    return len(sa & sb) / len(sa | sb)
