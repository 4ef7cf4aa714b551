"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of the document id: ``BLOCKS``, or more
where the table has over ``BLOCK_ROWS`` rows for each.  Its target buys whole passes over its blocks and a part of one more pass, whose
blocks come in a hashed permutation, each that still fits; of one more block
the documents come in a hashed permutation until the words are reached.  The block
copies of all sources (the exact quotas) are then split among the output shards
by a binary tree: each node draws, from its block copies without replacement,
those of its left half, and the right half gets the rest.  A shard so holds an
exact number of copies of each source; it takes the next ones of the source's
permuted list, so that shards are disjoint, and puts their documents into a
hashed order of its own.  All draws depend on the seed and the data only.

Sums are combined before they are shuffled.  What a block's copies are is known
from the sums; only the one block of a source that is cut in its part pass has its
documents' sizes put in order (never texts), which gives the hash to cut at.  So
documents need nothing but their block's row, and a source that holds a third of
all rows spreads over its blocks.  Only tables with one row per source (targets) or per source and shard
(quotas) are handled as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD_PATTERN, hash_fraction, shared_table

BLOCKS = 1024  # of a source, at least
BLOCK_ROWS = 8192  # rows for each block that a source may have, on average
SHARDS = 16
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
            cap: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size; one row each) with ``target``.

    Weights are dealt to the sources by code point, null last, repeating.  A
    target stops at ``cap`` times the source's size and what it leaves goes to
    the others by weight: with the sources in order of room per weight, those
    at their cap come first, and all others get one common level per weight.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    s = (sources.withColumn("weight", F.element_at(
        weight, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
        .withColumn("room", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("room") / F.col("weight")))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    want = F.least(F.lit(float(share)) * F.sum("source_size").over(everything), F.sum("room").over(everything))
    s = s.withColumn("level", (want - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after))
    full = F.col("level") >= F.col("ratio")
    # the first source below its cap has the right level; later ones count rooms that aren't filled
    level = F.max(F.when(~full, F.col("level"))).over(everything)
    return s.withColumn("target", F.when(full, F.col("room")).otherwise(level * F.col("weight"))) \
        .select("source", "source_size", "target")


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """``(source, shard, start, copies)``: the exact quotas of block copies
    (source, quota) dealt to ``shards`` shards of equal size (within one)."""
    nodes = quotas.select("source", "quota", F.lit(0).alias("first"), F.lit(shards).alias("past"))
    schema = "source string, quota long, first int, past int"

    def halve(node: pd.DataFrame) -> pd.DataFrame:
        first, past = int(node["first"].iloc[0]), int(node["past"].iloc[0])
        if past - first < 2:
            return node
        node = node.sort_values("source", na_position="last")
        quota = node["quota"].to_numpy(np.int64)
        middle = (first + past) // 2
        rng = np.random.default_rng([seed, first, past])
        # the left half of the shards takes its share of the node's copies
        size = int(quota.sum()) * (middle - first) // (past - first)
        left = rng.multivariate_hypergeometric(quota, size, method="marginals") if size else quota * 0
        return pd.concat([node.assign(quota=left, past=middle), node.assign(quota=quota - left, first=middle)])

    width = 1
    while width < shards:
        nodes = nodes.groupBy("first", "past").applyInPandas(halve, schema)
        width *= 2
    by_shard = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (nodes.select("source", F.col("first").alias("shard"), F.col("quota").alias("copies"))
            .withColumn("start", F.coalesce(F.sum("copies").over(by_shard), F.lit(0).cast("long")))
            .select("source", "shard", "start", "copies"))


def _part_pass(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one source for its part pass, in permuted order: each that
    still fits, and last the smallest that didn't, with the words ``left`` for it."""
    blocks = blocks.sort_values(["order", "block"])
    left = float(blocks["part"].iloc[0])
    taken, missed = [], None
    for row, size in enumerate(blocks["words"]):
        if size <= left:
            taken.append(row)
            left -= size
        elif missed is None or size < blocks["words"].iat[missed]:
            missed = row
    chosen = blocks.iloc[taken].assign(left=float("nan"))
    if missed is not None and left > 0:
        chosen = pd.concat([chosen, blocks.iloc[[missed]].assign(left=left)])
    return chosen[["key", "block", "turn", "order", "left"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        size_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
        cap: float = 2.0, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 42,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``docs`` with a struct column ``mix``:

    ``size`` (words; ``size_col`` if given), ``source_size``, ``target`` (of its
    source, in words), ``taken`` (words that the mix takes, repeats counted) and
    ``copies``, an array with ``(shard, place)`` for each time the document is
    taken; a shard's order is that of ``place``.  A column ``mix`` that is
    already there is replaced.

    A null source is a source of its own, the last one.  Documents without
    words are taken like the rest of their block, as zero words.  Repeated rows
    are rows like any other; of two alike, which one is cut at the end of a
    source's part pass is left open.  Rows with a null id are spread by their text
    (by their size, with ``size_col``).  No rows give no rows.
    """
    salt = str(seed)
    src = F.col(source_col).cast("string")
    size = F.col(size_col).cast("long") if size_col else word_count(F.col(text_col))
    id_ = F.col(id_col)
    spread = F.when(id_.isNull(), F.xxhash64(F.col(size_col) if size_col else F.col(text_col)))  # null changes no hash
    blocks = max(blocks, -(-docs.count() // block_rows))
    rows = docs.drop("mix").withColumns({
        "_quire_key": F.coalesce(F.concat(F.lit("="), src), F.lit("")),
        "_quire_block": F.floor(hash_fraction(id_, spread, salt=salt) * blocks).cast("int"),
        "_quire_order": F.xxhash64(F.lit(salt), F.lit("document"), id_, spread),
        "_quire_size": size})
    sizes = shared_table(rows.select(F.col("_quire_key").alias("key"), F.col("_quire_block").alias("block"),
                                     F.col("_quire_order").alias("order"), F.col("_quire_size").alias("size")))
    by_block = shared_table(sizes.groupBy("key", "block").agg(F.sum("size").alias("words")))
    by_source = by_block.groupBy("key").agg(F.sum("words").alias("source_size"))
    plan = shared_table(targets(
        by_source.select(F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("source"), "source_size"),
        weights, share, cap).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("passes", F.floor(rate).cast("int")).withColumn(
        "part", F.col("target") - F.col("passes") * F.col("source_size"))

    # copies of blocks: whole passes, then the part pass
    turns = (by_block.join(plan.drop("source"), "key")
             .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("passes"))))
             .withColumn("order", F.xxhash64(F.lit(salt), "key", "block", "turn")))
    whole = F.col("turn") < F.col("passes")
    columns = "key string, block int, turn int, order long, left double"
    copies = turns.where(whole).select("key", "block", "turn", "order", F.lit(None).cast("double").alias("left")).union(
        turns.where(~whole).select("key", "block", "turn", "order", "words", "part")
        .groupBy("key").applyInPandas(_part_pass, columns))
    copies = shared_table(copies.withColumn(
        "place", F.row_number().over(Window.partitionBy("key").orderBy("turn", "order", "block")) - 1))
    quotas = copies.groupBy("key").agg(F.count(F.lit(1)).alias("quota"))
    leaves = split_quotas(quotas.select(F.col("key").alias("source"), "quota"), shards, seed)
    starts = leaves.where(F.col("copies") > 0).groupBy(F.col("source").alias("key")).agg(
        F.array_sort(F.collect_list(F.struct("start", "shard"))).alias("starts"))
    dealt = (copies.join(starts, "key")
             .withColumn("shard", F.element_at(F.filter(
                 "starts", lambda x: x["start"] <= F.col("place")), -1)["shard"])
             .groupBy("key", "block").agg(F.collect_list(F.struct("turn", "left", "shard")).alias("dealt")))
    # documents of a cut block in hashed order: it takes them while half of each still fits
    cut = copies.where(F.col("left").isNotNull()).select("key", "block", "left")
    in_block = Window.partitionBy("key", "block").orderBy("order", "size") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (sizes.join(cut, ["key", "block"])
            .withColumn("fits", F.sum("size").over(in_block) - F.col("size") / 2 <= F.col("left"))
            .groupBy("key", "block", "order").agg(F.count_if("fits").alias("some"), F.count_if(~F.col("fits")).alias("none"))
            .where("none > 0").groupBy("key", "block").agg(F.min(F.struct("order", "some")).alias("end")))
    table = shared_table(
        by_block.select("key", "block").join(plan.select("key", "source_size", "target"), "key")
        .join(dealt, ["key", "block"], "left").join(ends, ["key", "block"], "left")
        .select(F.col("key").alias("_quire_key"), F.col("block").alias("_quire_block"),
                F.col("source_size").alias("_quire_source_size"), F.col("target").alias("_quire_target"),
                F.col("dealt").alias("_quire_dealt"), F.col("end.order").alias("_quire_end"), F.col("end.some").alias("_quire_some")))

    rows = rows.join(table, ["_quire_key", "_quire_block"])
    rows = rows.withColumn("_quire_fits", F.col("_quire_end").isNull() | (F.col("_quire_order") < F.col("_quire_end")))
    if not table.where("_quire_some > 0").isEmpty():  # rows with the id at the cut, some of which still fit
        split = F.coalesce((F.col("_quire_order") == F.col("_quire_end")) & (F.col("_quire_some") > 0), F.lit(False))
        alike = Window.partitionBy("_quire_key", "_quire_block").orderBy("_quire_size")
        rows = rows.where(~split).union(rows.where(split).withColumn(
            "_quire_fits", F.row_number().over(alike) <= F.col("_quire_some")))
    fits = F.col("_quire_fits")
    taken = F.transform(
        F.filter(F.coalesce(F.col("_quire_dealt"), F.array()), lambda x: x["left"].isNull() | fits),
        lambda x: F.struct(x["shard"].alias("shard"),
                           F.xxhash64(F.lit(salt), x["shard"], x["turn"], id_, spread).alias("place")))
    result = F.struct(F.col("_quire_size").alias("size"), F.col("_quire_source_size").alias("source_size"),
                      F.col("_quire_target").alias("target"),
                      (F.size("_quire_copies") * F.col("_quire_size")).cast("long").alias("taken"),
                      F.col("_quire_copies").alias("copies"))
    return (rows.withColumn("_quire_copies", taken)
            .select(*[rows[c] for c in docs.columns if c != "mix"], result.alias("mix")))


def shard_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: one row per taken copy, with its shard and its place in
    the shard's local shuffle (sort each shard by ``place`` when writing)."""
    each = mixed.withColumn("_quire_copy", F.explode("mix.copies"))
    return each.select(*[c for c in mixed.columns if c != "mix"],
                       F.col("_quire_copy.shard").alias("mix_shard"), F.col("_quire_copy.place").alias("mix_place"))
