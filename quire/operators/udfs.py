"""The four replaceable per-row calls (UDF1 - UDF4) in one place.

* UDF1 token count: :func:`quire.operators.tokens.token_counts` with a
  vocabulary file, or :func:`quire.operators.textops.token_counter` with any encoder.
* UDF2 text generation: :func:`quire.operators.reports.generate`, or
  :func:`quire.operators.answers.answer_once` with answers kept by prompt.
* UDF3 chunk translation: :func:`quire.operators.textops.translate_chunks`.
* UDF4 sentence embedding: :func:`embed` (injected encoder in Arrow batches,
  or hashed term weights by default).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from quire.operators.reports import generate  # noqa: F401  (UDF2)
from quire.operators.textops import token_counter, translate_chunks  # noqa: F401  (UDF1, UDF3)
from quire.session import shared_table


def embed(df: DataFrame, text_col: str, out_col: str = "embedding",
          encoder: Callable[[list[str]], np.ndarray] | None = None,
          num_features: int = 1 << 8) -> DataFrame:
    """Unit-length sentence vectors as ``array<float>``.

    With ``encoder(texts) -> (n, d) array`` the texts go through it batch by
    batch (``mapInPandas``).  Without one, :func:`term_vectors` stands in; texts
    without a term, null ones too, have the zero vector.
    """
    if encoder is not None:
        schema = StructType(list(df.schema.fields) + [StructField(out_col, ArrayType(FloatType()))])

        def run(batches):
            for pdf in batches:
                m = np.asarray(encoder(pdf[text_col].fillna("").tolist()), dtype=np.float64)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, n, out=np.zeros_like(m), where=n > 0).astype(np.float32)
                pdf[out_col] = pd.Series(list(m), index=pdf.index)
                yield pdf

        return df.mapInPandas(run, schema)

    rows = shared_table(df.withColumn("_row", F.monotonically_increasing_id()))
    vectors = term_vectors(rows, "_row", text_col, num_features)
    joined = rows.join(vectors.withColumnRenamed("id", "_row"), "_row", "left")
    dense = F.coalesce(_dense("terms", num_features), F.array_repeat(F.lit(0.0).cast("float"), num_features))
    return joined.withColumn(out_col, dense).drop("_row", "terms")


def term_vectors(df: DataFrame, id_col: str, text_col: str, num_features: int = 1 << 8) -> DataFrame:
    """``(id, terms)``: sorted ``(slot, weight)`` of unit length for every id with a
    text that has a term.

    Terms are lower-cased words of letters, digits and underscores, dealt to
    slots by their md5; a slot weighs its occurrences times ``ln((n + 1) / (d + 1))``
    for n ids, d of them with the slot.  Ids whose weights are all 0 have zeros.
    """
    slot = F.pmod(F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long"), F.lit(num_features)).cast("int")
    words = df.select(F.col(id_col).alias("id"), F.explode(
        F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("term"))
    # an id has few slots, so counts shrink ahead of the shuffle; its terms needn't be told apart
    counted = shared_table(words.groupBy("id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")))
    n = df.select(id_col).distinct().count()
    weight = F.log(F.lit(float(n + 1)) / (F.count(F.lit(1)) + 1))
    held = F.broadcast(counted.groupBy("slot").agg(weight.alias("w")))  # at most num_features rows
    weighted = counted.join(held, "slot").select("id", "slot", (F.col("n") * F.col("w")).alias("x"))
    per = weighted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("t"),
                                     F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    lengths = F.array_repeat("length", F.size("t"))
    unit = F.zip_with("t", lengths, lambda t, m: F.struct(
        t["slot"].alias("slot"), F.when(m > 0, t["x"] / m).otherwise(F.lit(0.0)).alias("weight")))
    return per.select("id", unit.alias("terms"))


def _dense(terms: str, size: int):
    """Sorted ``(slot, weight)`` as an array with zeros in the gaps."""
    zero = F.lit(0.0).cast("float")
    before = F.concat(F.array(F.lit(-1)), F.slice(F.col(terms)["slot"], F.lit(1), F.greatest(F.size(terms) - 1, F.lit(0))))
    runs = F.zip_with(terms, before, lambda t, b: F.concat(
        F.array_repeat(zero, t["slot"] - b - 1), F.array(t["weight"].cast("float"))))
    return F.concat(F.flatten(runs), F.array_repeat(zero, F.lit(size - 1) - F.element_at(F.col(terms)["slot"], -1)))
