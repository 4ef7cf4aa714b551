"""Report queries: conversations as patients, roles as report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import reports, udfs
from quire.plans.catalog import register
from quire.session import read_table, spread

REQUESTED = ["assistant", "user", "system", "summary"]
# Prompt length without the data (no role has its own example).
PROMPT_OVERHEAD = (len(reports.INSTRUCTIONS) + len("\n\nFields:\n") + len("\n\nExample:\n```\n")
                   + len(reports.DEFAULT_EXAMPLE) + len("\n```"))


def stub_generator(prompts: list[str]) -> list[str]:
    """Deterministic model stand-in: fails on odd-length prompts."""
    out = []
    for p in prompts:
        if len(p) % 2 == 1:
            raise ValueError(f"odd prompt of {len(p)} characters")
        out.append(f"ANSWER {len(p)}<think>draft</think>")
    return out


def _section_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read_table(spark, sf_dir, "conversations")
    data = c.groupBy("conv_id", F.col("role").alias("section")).agg(
        F.max_by("text", "turn").alias("data"))
    prompts = data.withColumn("prompt", reports.build_prompt("data", "section"))
    answers = reports.generate(prompts, stub_generator)
    req = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("pos"))
                    for i, s in enumerate(REQUESTED)])
    requested = c.select("conv_id").distinct().select("conv_id", F.inline(req))
    return requested, answers


@register("section_report", oracle=f"""
WITH d AS (SELECT conv_id, role AS section, arg_max(text, turn) AS data FROM conversations GROUP BY 1, 2),
req AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT * FROM (VALUES ('assistant', 0), ('user', 1), ('system', 2), ('summary', 3)) AS t(section, pos))
SELECT req.conv_id, s.section, s.pos,
  CASE WHEN d.data IS NULL THEN 'Missing'
       WHEN ({PROMPT_OVERHEAD} + length(d.data)) % 2 = 1
         THEN 'Error: odd prompt of ' || CAST({PROMPT_OVERHEAD} + length(d.data) AS VARCHAR) || ' characters'
       ELSE 'ANSWER ' || CAST({PROMPT_OVERHEAD} + length(d.data) AS VARCHAR) END AS text
FROM req CROSS JOIN s LEFT JOIN d ON d.conv_id = req.conv_id AND d.section = s.section
""")
def section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested, answers = _section_answers(spark, sf_dir)
    return reports.collect_sections(requested, answers, ["conv_id"])


_SECTION = "'<section id=\"section-' || CAST(id AS VARCHAR) || '\"><h2>' || section || '</h2><pre>' || text || '</pre></section>'"
_LINK = "'<li><a href=\"#section-' || CAST(id AS VARCHAR) || '\">' || section || '</a></li>'"


@register("report_html", oracle=f"""
WITH d AS (SELECT conv_id, role AS section, arg_max(text, turn) AS data FROM conversations GROUP BY 1, 2),
req AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT * FROM (VALUES ('assistant', 0), ('user', 1), ('system', 2), ('summary', 3)) AS t(section, id)),
x AS (
  SELECT req.conv_id, s.section, s.id,
    CASE WHEN d.data IS NULL THEN 'Missing'
         WHEN ({PROMPT_OVERHEAD} + length(d.data)) % 2 = 1
           THEN 'Error: odd prompt of ' || CAST({PROMPT_OVERHEAD} + length(d.data) AS VARCHAR) || ' characters'
         ELSE 'ANSWER ' || CAST({PROMPT_OVERHEAD} + length(d.data) AS VARCHAR) END AS text
  FROM req CROSS JOIN s LEFT JOIN d ON d.conv_id = req.conv_id AND d.section = s.section),
h AS (
  SELECT conv_id, '<!DOCTYPE html><html><head><meta charset="UTF-8"><title>Report</title></head><body>'
    || '<table><tr><th>Name</th><td>Conversation ' || CAST(conv_id AS VARCHAR) || '</td></tr><tr><th>Date of birth</th><td>N/A</td></tr>'
    || '<tr><th>Dates of service</th><td>N/A</td></tr><tr><th>Age</th><td>Unknown</td></tr></table><nav><ul>'
    || string_agg({_LINK}, '' ORDER BY id) || '</ul></nav>' || string_agg({_SECTION}, '' ORDER BY id) || '</body></html>' AS html
  FROM x GROUP BY conv_id)
SELECT conv_id, md5(html) AS html_md5, CAST(length(html) AS INT) AS n_chars FROM h
""")
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ15 + SCL26: lead section first, empty ones skipped, one HTML per conversation."""
    requested, answers = _section_answers(spark, sf_dir)
    sections = reports.collect_sections(requested, answers, ["conv_id"])
    ordered = reports.order_sections(sections, ["user", "system", "summary"], lead="assistant")
    header = read_table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        "conv_id", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("name"),
        F.lit("N/A").alias("date_of_birth"), F.lit("N/A").alias("dates_of_service"),
        F.lit("Unknown").alias("age_at_evaluation"))
    html = reports.render_report(ordered, header, "conv_id")
    return html.select("conv_id", F.md5("html").alias("html_md5"), F.length("html").alias("n_chars"))


@register("embed_stub", oracle=r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents),
c AS (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS slot, count(*) AS n FROM t GROUP BY 1, 2),
w AS (SELECT slot, ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1) / (count(*) + 1)) AS w FROM c GROUP BY slot),
x AS (SELECT doc_id, slot, n * w AS x FROM c JOIN w USING (slot))
SELECT doc_id, CAST(slot AS INT) AS slot, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 3) AS weight FROM x
QUALIFY sum(x * x) OVER (PARTITION BY doc_id) > 0 AND x <> 0
""")
def embed_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF4 default model: hashed term vectors of the documents, without the zeros."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    e = udfs.embed(d, "text").select("doc_id", F.posexplode("embedding").alias("slot", "weight"))
    return e.where("weight <> 0").select("doc_id", "slot", F.round(F.col("weight").cast("double"), 3).alias("weight"))


def _letter_shares(texts: list[str]):
    import numpy as np

    return np.array([[t.count(c) for c in "aeio"] for t in texts], dtype=float)


@register("embed_injected", oracle="""
WITH c AS (SELECT doc_id, [length(text) - length(replace(text, 'a', '')), length(text) - length(replace(text, 'e', '')),
                           length(text) - length(replace(text, 'i', '')), length(text) - length(replace(text, 'o', ''))] AS v
           FROM documents),
x AS (SELECT doc_id, unnest(v) AS v, unnest(range(4)) AS i FROM c)
SELECT doc_id, CAST(i AS INT) AS i,
       round(coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 0), 0), 3) AS x FROM x
""")
def embed_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF4 with an encoder of the caller: unit vectors come back."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    e = udfs.embed(d, "text", encoder=_letter_shares)
    return e.select("doc_id", F.posexplode("embedding").alias("i", "x")).select(
        "doc_id", "i", F.round(F.col("x").cast("double"), 3).alias("x"))
