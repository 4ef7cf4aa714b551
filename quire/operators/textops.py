"""Document operators: passages, headed sections, chunks, token budgets
(WIN3, PRJ14, SCL16, PRJ18, SCL13, SCL14, AGG13, WIN4, SRC5).

Documents are rows; a whole text is processed inside one row with array
functions (no Python), and anything that fans out (chunks, lines) becomes
rows so that Spark spreads it over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.text import (normalise_lines, _C, _col, chunk_text, non_blank, split_lines,
                                  split_sentences, ws_trim)
from quire.plans import scan

# Fixed values of the reference's passage rule -------------------------------
PASSAGE_START = ("based on", "recommendations are")
PASSAGE_STOP = "follow-up"
# Token pacing: budget per window and safety factor on each request.
TOKEN_LIMIT = 20000
TOKEN_FACTOR = 1.75
# Translation target languages (name -> code).
LANGUAGES = {"spanish": "es"}
# -----------------------------------------------------------------------------


# WIN3 / SCL10 / PRJ14 ---------------------------------------------------------
def passage(text: _C, start: Sequence[str] = PASSAGE_START, stop: str = PASSAGE_STOP) -> Column:
    """Sentences from the first one containing every ``start`` phrase
    (case-insensitive) up to, not including, the first *later* sentence
    containing ``stop``; joined by a blank and stripped; NULL when no
    sentence starts a passage.

    One ``aggregate`` pass over the sentences finds both positions, so the
    text is split once per use and the work is linear in its length.
    """
    return _passage_of(split_sentences(text), start, stop)


def _passage_of(sents: Column, start: Sequence[str], stop: str) -> Column:
    init = F.struct(sents.alias("s"), F.lit(0).alias("i"), F.lit(0).alias("first"),
                    F.lit(0).alias("end"))

    def merge(acc, x):
        i = acc["i"] + 1
        lx = F.lower(x)
        first = F.when((acc["first"] == 0) & _contains_all(lx, start), i).otherwise(acc["first"])
        end = F.when((acc["first"] > 0) & (acc["end"] == 0) & lx.contains(stop.lower()), i) \
            .otherwise(acc["end"])
        return F.struct(acc["s"].alias("s"), i.alias("i"), first.alias("first"), end.alias("end"))

    def finish(acc):
        first, end = acc["first"], acc["end"]
        length = F.when(end > 0, end - first).otherwise(F.size(acc["s"]) - first + 1)
        body = ws_trim(F.array_join(F.slice(acc["s"], F.greatest(first, F.lit(1)), length), " "))
        return F.when(first > 0, body)

    return F.aggregate(sents, init, merge, finish)


def _contains_all(lower_s: Column, phrases: Sequence[str]) -> Column:
    cond = F.lit(True)
    for p in phrases:
        cond = cond & lower_s.contains(p.lower())
    return cond


def passages(docs: DataFrame, text_col: str = "text", start: Sequence[str] = PASSAGE_START,
             stop: str = PASSAGE_STOP) -> DataFrame:
    """Documents with a non-empty passage (WIN3 + PRJ14).

    The sentence array is its own projection (used twice, so Catalyst keeps
    it apart), and the passage comes out of a one-element ``inline``: a
    filter on a generator's output cannot be pushed below it, so the
    emptiness test does not copy the whole passage expression.
    """
    s = docs.withColumn("_sents", split_sentences(text_col))
    one = F.array(F.struct(_passage_of(F.col("_sents"), start, stop).alias("passage")))
    s = s.select(*docs.columns, F.inline(one))
    return s.where(non_blank("passage"))


# SRC5 -------------------------------------------------------------------------
def drop_blank_lines(text: _C) -> Column:
    """Blank paragraphs dropped, the rest joined by newline."""
    return F.array_join(F.filter(F.split(_col(text), "\n"), lambda x: ws_trim(x) != ""), "\n")


# SCL16 ------------------------------------------------------------------------
HEADER = r"(?U)^=+\s*(.*?)\s*=+$"


def text_lines(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``(id, line_no, line)`` with ``str.splitlines`` semantics."""
    return docs.select(id_col, F.posexplode(split_lines(text_col)).alias("line_no", "line"))


def headed_sections(lines: DataFrame, id_col: str, order_cols: Sequence[str] = ("line_no",),
                    line_col: str = "line") -> DataFrame:
    """Parse ``=== name ===`` headed text given as ordered lines.

    A header line starts a section; its body is the following lines joined
    by newline and stripped.  Text before the first header, and text under a
    header whose name is empty, is dropped; a header without lines is not
    emitted; a later section of the same name overwrites an earlier one.
    Works on lines, so a huge document is spread over tasks; the header of
    each line comes from a skew-safe forward fill.
    """
    order_cols = list(order_cols)
    is_h = F.col(line_col).rlike(HEADER)
    tagged = lines.withColumn("_is_h", is_h).withColumn(
        "_h", F.when(is_h, F.struct(*[F.col(c) for c in order_cols],
                                    ws_trim(F.regexp_extract(line_col, HEADER, 1)).alias("name"))))
    filled = scan.forward_fill(tagged, [id_col], order_cols, F.col("_h"), "_cur")
    body_lines = filled.where(~F.col("_is_h") & F.col("_cur").isNotNull()
                              & (F.col("_cur.name") != ""))
    ordkey = F.struct(*[F.col(c) for c in order_cols])
    per = body_lines.groupBy(id_col, F.col("_cur").alias("_hdr")).agg(
        F.array_sort(F.collect_list(F.struct(ordkey.alias("k"), F.col(line_col).alias("v"))))
        .alias("_ls"))
    per = per.select(id_col, F.col("_hdr.name").alias("section"), F.col("_hdr").alias("_hk"),
                     ws_trim(F.array_join(F.transform("_ls", lambda x: x["v"]), "\n")).alias("body"))
    return per.groupBy(id_col, "section").agg(F.max_by("body", "_hk").alias("body"))


# PRJ18 / SCL13 / SCL14 / UDF3 ----------------------------------------------------
def chunks(docs: DataFrame, id_col: str, text_col: str = "text", size: int = 4500) -> DataFrame:
    """One row per ``size``-character chunk: ``(id, pos, chunk)``."""
    return docs.select(id_col, F.posexplode(chunk_text(text_col, size)).alias("pos", "chunk"))


def fan_out_languages(docs: DataFrame, languages: dict[str, str] | None = None) -> DataFrame:
    """One row per document and target language (a literal array, no join)."""
    langs = languages or LANGUAGES
    arr = F.array(*[F.struct(F.lit(n).alias("lang_name"), F.lit(c).alias("lang"))
                    for n, c in langs.items()])
    return docs.select("*", F.inline(arr))


def translate_chunks(chunk_rows: DataFrame,
                     translator: Callable[[list[str], list[str]], list[str]] | None = None,
                     chunk_col: str = "chunk", lang_col: str = "lang") -> DataFrame:
    """Apply ``translator(chunks, langs) -> translations`` batch-wise in
    Arrow batches (``mapInPandas``); a failing batch marks its rows with
    ``Error: <message>``.  Without a translator the chunk is kept."""
    if translator is None:
        return chunk_rows.withColumn("translated", F.col(chunk_col))
    schema = StructType(list(chunk_rows.schema.fields) + [StructField("translated", StringType())])

    def run(batches):
        for pdf in batches:
            try:
                out = translator(pdf[chunk_col].tolist(), pdf[lang_col].tolist())
                pdf["translated"] = pd.Series(out, index=pdf.index, dtype=object)
            except Exception as e:  # keep the rows, mark the failure
                pdf["translated"] = f"Error: {e}"
            yield pdf

    return chunk_rows.mapInPandas(run, schema)


def reassemble(pieces: DataFrame, key_cols: Sequence[str], pos_col: str = "pos",
               piece_col: str = "translated", sep: str = "\n") -> DataFrame:
    """Pieces joined by ``sep`` in position order, one row per key."""
    return pieces.groupBy(*key_cols).agg(
        F.count("*").alias("n_chunks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos_col, piece_col))),
                                 lambda x: x[piece_col]), sep).alias("text"))


# AGG13 / UDF1 -------------------------------------------------------------------
def token_counter(encode: Callable[[str], int] | None = None):
    """A vectorised token counter (``pandas_udf``) around ``encode``.

    ``encode(text) -> int`` is built once per Python worker.  With no
    encoder the count is the number of characters, computed JVM-side.
    """
    if encode is None:
        return lambda c: F.length(_col(c)).cast("long")

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else int(encode(t))).astype("int64")

    return lambda c: count(_col(c))


def preview(text: _C, n: int = 5) -> Column:
    """First ``n`` non-blank lines, stripped, joined by newline."""
    return F.array_join(F.slice(normalise_lines(text), 1, n), "\n")


# WIN4 ------------------------------------------------------------------------------
def token_windows(requests: DataFrame, order_cols: Sequence[str], tokens: Column,
                  limit: float = TOKEN_LIMIT, out: str = "window_no") -> DataFrame:
    """Budget windows for paced requests: a request starts a new window when
    it and the request just before it exceed ``limit`` together (the
    reference compares with the previous request only).  Global order, done
    with skew-safe scans rather than a single-partition window."""
    r = requests.withColumn("_tok", tokens)
    r = scan.previous_value(r, [], order_cols, F.col("_tok"), "_prev")
    flag = F.when(F.col("_prev").isNotNull() & (F.col("_prev") + F.col("_tok") > limit), 1) \
        .otherwise(0).cast("long")
    return scan.running_sum(r, [], order_cols, flag, out).drop("_tok", "_prev")
