"""SimHash near-duplicates, joined on deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments, one fewer than two
differing bits would need for an untouched segment: of two linked fingerprints
either one segment is equal, or both segments differ in exactly one bit.  Equal
segments meet by equality of the segment; the other pairs meet by equality of a
one-wildcard variant of the upper segment (32 variants, the wildcard bit being
1 on one side and 0 on the other).  Every candidate is verified on all 64 bits.

A segment value shared by very many different fingerprints would make all
pairs of them.  Such fingerprints, with the ones a bit beside them, are linked
through two-wildcard variants of the whole fingerprint instead (any two that
share one differ in two bits at most): the members of a variant all link to its
smallest member.  This keeps every connection and is linear in the group.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_rows, record_batches, shared_table, words
from quire.operators.graph import connected_components

# Different fingerprints in one segment bucket up to which its pairs are made.
BUCKET_PAIRS = 128
_LOW = (1 << 32) - 1
_CHUNK = 1 << 14


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(tokens: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 values of all word shingles (unsigned)."""
    n = len(tokens)
    if n == 0:
        return 0
    if n < shingle:
        joined = [b" ".join(tokens)]
    else:
        joined = list(map(b" ".join, zip(*(tokens[i:] for i in range(shingle)))))
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(joined), _CHUNK):
        part = joined[start:start + _CHUNK]
        h = np.fromiter(map(digest, part), dtype="<u8", count=len(part))
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(len(part), 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    major = 2 * ones > len(joined)
    return int(np.packbits(major, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp, digest)`` for every row; ``fp`` is the fingerprint as a signed
    long, ``digest`` a hash of the text as it stands.  A null or wordless text
    has fingerprint zero."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("digest", pa.int64())])

    def run(batches):
        rows = ((i, _signed(fingerprint(words(t), shingle, seed)), d) for i, t, d in batch_rows(batches))
        return record_batches(rows, schema)

    return (docs.select(F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).cast("binary").alias("text"),
                        F.xxhash64(F.col(text_col)).alias("digest"))
            .mapInArrow(run, "id long, fp long, digest long"))


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _upper(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _lower(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(_LOW))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _pairs(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    """Verified pairs of two ``(key, fp)`` tables that share a key."""
    a, b = left.alias("a"), right.alias("b")
    ok = _distance(F.col("a.fp"), F.col("b.fp")) <= bits
    return (a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") != F.col("b.fp")) & ok)
            .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))


def links(fps: DataFrame, bits: int = 2, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Edges ``(a, b)`` that connect the different values of ``fp`` exactly as
    all links within ``bits`` (at most 2) differing bits do."""
    if not 0 <= bits <= 2:
        raise ValueError("two segments with one wildcard reach at most two bits")
    distinct = shared_table(fps.select("fp").where(F.col("fp").isNotNull()).distinct())
    fp = F.col("fp")
    counted = {}
    for name, seg in (("upper", _upper), ("lower", _lower)):
        counted[name] = (distinct.select(seg(fp).alias("key")).groupBy("key").count()
                         .where(F.col("count") > bucket_pairs).select("key"))
    hot_upper, hot_lower = shared_table(counted["upper"]), shared_table(counted["lower"])

    def cold(seg, hot):
        return distinct.select(seg(fp).alias("key"), "fp").join(hot, "key", "left_anti")

    upper, lower = cold(_upper, hot_upper), cold(_lower, hot_lower)
    found = [_pairs(t, t.select("key", "fp"), bits).where(F.col("a") < F.col("b")) for t in (upper, lower)]

    # both segments differ in one bit: wildcard variants of the upper segment
    place = F.posexplode(F.array(*[F.lit(1 << j) for j in range(32)])).alias("j", "bit")
    variant = (upper.select("key", "fp", place)
               .select("fp", F.col("key").bitwiseAND(F.col("bit")).alias("set"),
                       (F.shiftleft(F.col("j").cast("long"), 32)
                        + F.col("key").bitwiseAND(F.bitwise_not(F.col("bit")))).alias("key")))
    found.append(_pairs(variant.where(F.col("set") != 0).select("key", "fp"),
                        variant.where(F.col("set") == 0).select("key", "fp"), bits))

    # crowded segment values: two-wildcard variants of the whole fingerprint
    beside = hot_upper.select(F.explode(F.array(F.col("key"), *[
        F.col("key").bitwiseXOR(F.lit(1 << j)) for j in range(32)])).alias("key")).distinct()
    crowd = (distinct.withColumn("key", _upper(fp)).join(beside, "key", "left_semi").select("fp")
             .union(distinct.withColumn("key", _lower(fp)).join(hot_lower, "key", "left_semi")
                    .select("fp")).distinct())
    masks = [_signed(sum(1 << j for j in js)) for js in combinations(range(64), bits)]
    masked = (shared_table(crowd)
              .select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
              .withColumn("rest", fp.bitwiseAND(F.bitwise_not(F.col("mask")))))
    least = masked.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("most"))
    found.append(masked.join(least.where(F.col("a") != F.col("most")), ["mask", "rest"])
                 .where(fp != F.col("a")).select("a", fp.alias("b")).distinct())

    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, seed: int,
             bucket_pairs: int) -> DataFrame:
    """``(id, fp, digest, root, component)`` of every row; ``root`` names the
    group by a fingerprint, ``component`` by its smallest id."""
    fps = shared_table(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(fps, bits, bucket_pairs), "a", "b")
    of = shared_table(nodes.join(roots, nodes["fp"] == roots["v"], "left")
                      .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    low = of.groupBy("root").agg(F.min("least").alias("component"))
    return fps.join(of.join(low, "root").select("fp", "root", "component"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, bits: int = 2, seed: int = 42,
                    bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``.

    ``component`` is the smallest id reachable by links.  Ids must be integers;
    rows with a null id are linked like any other but never name a component (one
    of null ids alone is null).  Repeated rows each come out; an empty table
    gives an empty result.  Columns other than the two named are not read.
    """
    return (_grouped(docs, id_col, text_col, shingle, bits, seed, bucket_pairs)
            .select("id", "fp", "component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` without near-duplicates: of every group the row with the
    smallest id stays, once, with all its columns (a group of null ids keeps one
    row as well; a repeated row stays once)."""
    found = _grouped(docs, id_col, text_col, shingle, bits, 42, BUCKET_PAIRS)
    keep = (found.groupBy("root")
            .agg(F.min(F.struct(F.col("id").isNull().alias("void"), "id", "digest")).alias("k"))
            .select(_row_key(F.col("k.id"), F.col("k.digest")).alias("_quire_key")))
    keyed = docs.withColumn("_quire_key", _row_key(docs[id_col].cast("long"), F.xxhash64(docs[text_col])))
    return keyed.join(keep, "_quire_key", "left_semi").dropDuplicates(["_quire_key"]).drop("_quire_key")


def _row_key(id_: Column, digest: Column) -> Column:
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), digest.cast("string"))
