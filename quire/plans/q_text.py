"""Text queries on documents, pages, conversations and events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import recommend, textops
from quire.plans.catalog import register
from quire.session import read_table

# Passage phrases for the driver documents (the reference's clinical
# phrases do not occur in them).
START = ("the", "and")
STOP = "of"

SENT_SQL = r"""s AS (
  SELECT doc_id, unnest(l) AS sent, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)) AS l
    FROM documents))"""


@register("passage_collect", headline=True, oracle="WITH " + SENT_SQL + r""",
b AS (
  SELECT doc_id, min(i) FILTER (WHERE contains(lower(sent), 'the') AND contains(lower(sent), 'and')) AS st
  FROM s GROUP BY doc_id),
e AS (
  SELECT s.doc_id, min(i) FILTER (WHERE i > st AND contains(lower(sent), 'of')) AS en
  FROM s JOIN b ON s.doc_id = b.doc_id GROUP BY s.doc_id),
p AS (
  SELECT s.doc_id,
         regexp_replace(string_agg(sent, ' ' ORDER BY i), '^\s+|\s+$', '', 'g') AS passage
  FROM s JOIN b ON s.doc_id = b.doc_id JOIN e ON s.doc_id = e.doc_id
  WHERE b.st IS NOT NULL AND i >= b.st AND (e.en IS NULL OR i < e.en)
  GROUP BY s.doc_id)
SELECT doc_id, CAST(length(passage) AS BIGINT) AS n_chars, md5(passage) AS passage_md5
FROM p WHERE passage <> ''
""")
def passage_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    p = textops.passages(d, start=START, stop=STOP)
    return p.select("doc_id", F.length("passage").cast("long").alias("n_chars"),
                    F.md5("passage").alias("passage_md5"))


@register("text_between", oracle=r"""
SELECT page_id,
       CASE WHEN regexp_matches(html, '(?s)<title>(.*?)</title>')
            THEN regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^\s+|\s+$', '', 'g')
       END AS title
FROM pages
""")
def text_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", T.between_markers("html", "<title>", "</title>").alias("title"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as headed text, one row per line: a ``=== role ===``
    header per turn followed by the turn's lines."""
    c = read_table(spark, sf_dir, "conversations")
    head = c.select("conv_id", "turn", F.lit(0).alias("sub"),
                    F.concat(F.lit("=== "), F.col("role"), F.lit(" ===")).alias("line"))
    body = c.select("conv_id", "turn", F.posexplode(T.split_lines("text")).alias("sub", "line")) \
        .select("conv_id", "turn", (F.col("sub") + 1).alias("sub"), "line")
    return head.unionByName(body)


@register("headed_sections", oracle=r"""
SELECT conv_id, role AS section,
       arg_max(regexp_replace(text, '^\s+|\s+$', '', 'g'), turn) AS body
FROM conversations WHERE text <> '' GROUP BY conv_id, role
""")
def headed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = conversation_lines(spark, sf_dir)
    return textops.headed_sections(lines, "conv_id", ["turn", "sub"])


FENCE_PREFIX = '```json\n{"$defs": {"a": 1}}\n``` draft ```json {not json} ``` final ```json\n'


@register("fenced_json", oracle="""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    doc = F.concat(F.lit(FENCE_PREFIX), F.col("props"), F.lit("\n```"))
    picked = T.pick_fenced_json(doc)
    return e.select("event_id", F.get_json_object(picked, "$.k").cast("long").alias("k"))


@register("text_clean", oracle=r"""
SELECT doc_id, md5(c) AS clean_md5, CAST(length(c) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, regexp_replace(
           regexp_replace(replace(replace(replace(text, chr(0), ''), chr(65533), ''), chr(10), ' '),
                          '[\x00-\x08\x0A-\x1F]', '', 'g'),
           '^\s+|\s+$', '', 'g') AS c
  FROM documents)
""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    c = T.clean_text("text")
    return d.select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("n_chars"))


@register("cell_clean", oracle=r"""
SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda line:
  regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'),
                                '^[''"]+', ''), '['',"\s]+$', '')), chr(10))) AS cells_md5
FROM documents
""")
def cell_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text, cleaned as a cell."""
    d = read_table(spark, sf_dir, "documents")
    cells = F.transform(F.split("text", "\n"), T.clean_cell)
    return d.select("doc_id", F.md5(F.array_join(cells, "\n")).alias("cells_md5"))


@register("think_strip", oracle=r"""
SELECT page_id, md5(s) AS html_md5, CAST(length(s) AS BIGINT) AS n_chars FROM (
  SELECT page_id, regexp_replace(html, '(?s)<script>.*?</script>', '', 'g') AS s FROM pages)
""")
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    s = T.strip_tagged("html", "script")
    return p.select("page_id", F.md5(s).alias("html_md5"), F.length(s).cast("long").alias("n_chars"))


def _identity_translate(chunks: list[str], langs: list[str]) -> list[str]:
    return list(chunks)


@register("chunk_reassemble", oracle="""
WITH c AS (
  SELECT doc_id, 'es' AS lang, i, substring(text, i * 4500 + 1, 4500) AS piece
  FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / 4500.0) AS BIGINT))) AS i))
SELECT doc_id, lang, count(*) AS n_chunks, md5(string_agg(piece, chr(10) ORDER BY i)) AS text_md5
FROM c GROUP BY doc_id, lang
""")
def chunk_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fan = textops.fan_out_languages(d)
    ch = fan.select("doc_id", "lang", F.posexplode(T.chunk_text("text")).alias("pos", "chunk"))
    tr = textops.translate_chunks(ch, _identity_translate)
    r = textops.reassemble(tr, ["doc_id", "lang"])
    return r.select("doc_id", "lang", "n_chunks", F.md5("text").alias("text_md5"))


@register("paragraphs_html", oracle="""
SELECT doc_id, md5('<p>' || replace(text, chr(10), '</p><p>') || '</p>') AS html_md5 FROM documents
""")
def paragraphs_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.paragraphs_html("text")).alias("html_md5"))


@register("document_scan", oracle=r"""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, md5(array_to_string(l, chr(10))) AS text_md5 FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)),
                             lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS l
  FROM documents)
""")
def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    kept = textops.drop_blank_lines("text")
    return d.select("doc_id", F.when(kept == "", 0).otherwise(F.size(F.split(kept, "\n"))).cast("long").alias("n_lines"),
                    F.md5(kept).alias("text_md5"))


@register("token_totals", oracle=r"""
SELECT lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS tokens FROM documents GROUP BY lang
""")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    count = textops.token_counter()
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(count("text")).alias("tokens"))


@register("token_words", oracle=r"""
SELECT lang, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]'))) AS BIGINT) AS tokens FROM documents GROUP BY lang
""")
def token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF1: a tokenizer of the caller, through the Arrow path."""
    pattern = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f\v]")
    count = textops.token_counter(lambda text: len(pattern.findall(text)))
    return read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(count("text")).alias("tokens"))


@register("normal_lines", oracle=r"""
SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(replace(html, chr(10), ' '), '>'),
         lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|')) AS lines_md5
FROM pages
""")
def normal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL17: what stands between tags, as stripped non-blank lines."""
    p = read_table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("\n"), F.lit(" ")))
    lines = T.normalise_lines(F.replace("html", F.lit(">"), F.lit("\n")))
    return p.select("page_id", F.md5(F.array_join(lines, "|")).alias("lines_md5"))


@register("token_preview", oracle=r"""
SELECT doc_id, md5(array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)),
         lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 1, 5), chr(10))) AS preview_md5
FROM documents
""")
def token_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(textops.preview("text")).alias("preview_md5"))


@register("token_windows", oracle="""
SELECT doc_id, CAST(sum(flag) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS window_no FROM (
  SELECT doc_id, CASE WHEN lag(n_chars * 1.75) OVER (ORDER BY doc_id) + n_chars * 1.75 > 20000
                      THEN 1 ELSE 0 END AS flag
  FROM documents)
""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    w = textops.token_windows(d, ["doc_id"], F.col("n_chars") * F.lit(textops.TOKEN_FACTOR))
    return w.select("doc_id", "window_no")


@register("answer_rejects", oracle="""
SELECT 'e' || CAST(event_id AS VARCHAR) || '.json' AS file,
       CASE WHEN event_type = 'error' THEN 'no valid JSON block without ''$defs''' ELSE 'themes is not a list' END AS reason
FROM events
""")
def answer_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL12 reject table: error events answer with a schema block and a
    broken block only, the others with a block that has no themes."""
    e = read_table(spark, sf_dir, "events")
    good = F.concat(F.lit("final ```json\n"), F.col("props"), F.lit("\n```"))
    decoys = '```json\n{"$defs": {"a": 1}}\n``` draft ```json {not json} ``` '
    text = F.concat(F.lit(decoys), F.when(F.col("event_type") == "error", F.lit("")).otherwise(good))
    answers = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".json")).alias("file"),
                       text.alias("text"))
    return recommend.answer_rejects(answers)
