"""Token counts by a byte-pair vocabulary, each distinct piece encoded once
(UDF1, AGG13).

A byte-pair tokenizer first cuts a text into pieces (words with a blank before
them, numbers, marks) and then encodes every piece on its own.  So the pieces of
all texts are counted by built-in functions, each distinct one is encoded once,
and its number of tokens goes back to the texts weighted by a join in which
frequent pieces are no hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.hot import join_by_weight
from quire.session import shared_table

# Fixed value: how byte-level vocabularies of the 50k kind cut texts into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

FREQUENT = 100_000  # pieces with more than one in so many of all are broadcast: fewer than that, of at most
LONG = 64  # characters; longer ones are known by their digest


@lru_cache(maxsize=1)
def _encoding(ranks_path: str):
    """The vocabulary, loaded once in a Python worker, which runs many tasks."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def _encoded(ranks_path: str):
    """Pieces to numbers of tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_path).encode_ordinary
        for batch in batches:
            counts = [len(encode(p)) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(counts, pa.int64())],
                                             names=["key", "w", "tokens"])
    return run


def token_counts(texts: DataFrame, ranks_path: str, id_col: str, text_col: str = "text", pattern: str = PIECES) -> DataFrame:
    """``(id, n_tokens)`` for every distinct id of ``texts``.

    ``ranks_path`` names a vocabulary file (a base64 token and its rank a line)
    that every machine has.  Null and empty texts have no tokens; rows with one
    id are counted together, a null id is an id.
    """
    key = F.when(F.length("piece") <= LONG, F.col("piece")).otherwise(F.sha2("piece", 512))
    rows = texts.select(F.col(id_col).alias("id"), F.explode(
        F.regexp_extract_all(text_col, F.lit(f"(?U){pattern}"), 0)).alias("piece"))
    # a count by the pieces themselves is hashed; with a string among its results, all rows would be sorted
    distinct = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("w")).select("piece", "w", key.alias("key"))
    known = shared_table(distinct.mapInArrow(_encoded(ranks_path), "key string, w long, tokens long"))
    # most pieces are frequent ones, which meet their tokens before any shuffle
    there = join_by_weight(rows.select("id", key.alias("key")), known, ["key"], "w", share=FREQUENT)
    none = texts.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("tokens"))
    return there.select("id", "tokens").unionByName(none).groupBy("id").agg(F.sum("tokens").alias("n_tokens"))
