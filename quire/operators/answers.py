"""Model answers kept by prompt (UDF2): equal prompts are asked once.

Answers live in a table of the shared folder, keyed by the prompt's digest.
Rows take theirs by a join in which a prompt that a third of them share is no
hot key; prompts that the table has already are not asked again, by this or any
later call, nor after the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.reports import generate
from quire.plans.hot import join_by_weight
from quire.session import shared_table

_KEPT = "digest string, answer string, error string"


def kept_answers(spark: SparkSession, store: str) -> DataFrame:
    """``(digest, answer, error)`` of the answer table (empty before its first use)."""
    try:
        return spark.read.schema(_KEPT).parquet(store)
    except AnalysisException:
        return spark.createDataFrame([], _KEPT)


def answer_once(df: DataFrame, generator: Callable[[list[str]], list[str]], store: str,
                prompt_col: str = "prompt") -> DataFrame:
    """``df`` plus ``answer`` and ``error`` (see :func:`quire.operators.reports.generate`).

    Prompts that failed are asked again by a later call.  A null prompt is not
    asked and has null answers.
    """
    spark = df.sparkSession
    rows = shared_table(df.withColumn("_digest", F.sha2(F.col(prompt_col).cast("binary"), 256)))
    asked = rows.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(
        F.first(prompt_col).alias("prompt"), F.count(F.lit(1)).alias("_w"))
    asked = shared_table(asked)
    good = kept_answers(spark, store).where("error IS NULL").select(F.col("digest").alias("_digest"))
    new = asked.join(good, "_digest", "left_anti").select(F.col("_digest").alias("digest"), "prompt")
    generate(new, generator).select("digest", "answer", "error").write.mode("append").parquet(store)
    # of several tries of a prompt the successful one counts
    final = kept_answers(spark, store).groupBy(F.col("digest").alias("_digest")).agg(
        F.min(F.struct(F.col("error").isNotNull(), "answer", "error")).alias("_a"))
    table = shared_table(asked.join(final, "_digest").select("_digest", "_w", "_a.answer", "_a.error"))
    there = join_by_weight(rows.where(F.col("_digest").isNotNull()), table, ["_digest"], "_w")
    none = F.lit(None).cast("string")
    rest = rows.where(F.col("_digest").isNull()).withColumns({"answer": none, "error": none})
    names = [*df.columns, "answer", "error"]
    return there.select(*[F.col(f"`{c}`") for c in names]).unionByName(rest.select(*[F.col(f"`{c}`") for c in names]))
