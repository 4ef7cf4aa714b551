"""Per-record operators on streaming DataFrames.

The reference has no streaming; its batch scripts list a folder once.  The
per-record parts of this library are plain column expressions, so the same
code runs on a ``readStream`` source: new documents or answers dropped into
a folder are cleaned, cut into passages or parsed as they arrive, with the
progress kept in a checkpoint folder on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import clean_text, pick_fenced_json
from quire.operators import textops

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, folder: str, schema: str = DOCUMENT_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet documents arriving in ``folder`` as a stream."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def passages_stream(docs: DataFrame, start=textops.PASSAGE_START, stop=textops.PASSAGE_STOP) -> DataFrame:
    """WIN3 + PRJ14 + SCL8 on a stream: cleaned passage per document."""
    return (textops.passages(docs.select("doc_id", "text"), start=start, stop=stop)
            .select("doc_id", clean_text("passage").alias("passage")))


def answers_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers (text files) arriving in ``folder``: file name and the
    first usable fenced JSON block."""
    raw = spark.readStream.text(folder, wholetext=True)
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), "^.*/", "").alias("file"),
                      pick_fenced_json("value").alias("json"))


def start_to_parquet(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = False):
    """Append the stream to parquet with exactly-once file output; the
    checkpoint must be on storage every executor and the driver share."""
    w = stream.writeStream.format("parquet").option("path", path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
