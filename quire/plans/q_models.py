"""Queries of the replaceable calls: token counts, answers kept by prompt."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import answers, tokens
from quire.plans.catalog import register
from quire.session import read_table, shared_path, spread

# Vocabulary file of the token count (a parameter; not part of the library).
RANKS = os.environ.get("QUIRE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@register("token_counts", oracle=rf"""
WITH RECURSIVE ranks AS (
  SELECT hex(from_base64(split_part(l, ' ', 1))) AS t, CAST(split_part(l, ' ', 2) AS INT) AS r
  FROM read_csv('{RANKS}', columns = {{'l': 'VARCHAR'}}, delim = '\t', header = false, quote = '', escape = '', auto_detect = false)),
marked AS (  -- the last of several blanks belongs to what follows
  SELECT doc_id, regexp_replace(text, '([\s\v\x{{85}}\p{{Z}}]+)([\s\v\x{{85}}\p{{Z}}])([^\s\v\x{{85}}\p{{Z}}])', '\1' || chr(1) || '\2\3', 'g') AS x
  FROM documents),
split AS (
  SELECT doc_id, unnest(regexp_extract_all(x,
    '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\v\x{{85}}\p{{Z}}\p{{L}}\p{{N}}\x01]+|[\s\v\x{{85}}\p{{Z}}]+')) AS piece FROM marked),
counted AS (SELECT doc_id, piece, count(*) AS n FROM split GROUP BY 1, 2),
merged(piece, parts) AS (
  SELECT piece, [substr(hex(encode(piece)), 2 * i + 1, 2) FOR i IN range(octet_length(encode(piece)))] FROM (SELECT DISTINCT piece FROM counted)
  UNION ALL
  SELECT piece, parts[:i - 1] || [parts[i] || parts[i + 1]] || parts[i + 2:] FROM (
    SELECT piece, parts, i FROM (SELECT piece, parts, unnest(range(1, len(parts))) AS i FROM merged WHERE len(parts) > 1) p
    JOIN ranks ON ranks.t = p.parts[i] || p.parts[i + 1]
    QUALIFY row_number() OVER (PARTITION BY piece ORDER BY r, i) = 1)),
tokens AS (SELECT piece, min(len(parts)) AS k FROM merged GROUP BY piece)
SELECT d.doc_id, CAST(coalesce(sum(n * k), 0) AS BIGINT) AS n_tokens
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN counted USING (doc_id) LEFT JOIN tokens USING (piece) GROUP BY 1
""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF1: tokens of every document by a real vocabulary; the SQL merges the
    bytes of every distinct piece pair by pair."""
    d = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    return tokens.token_counts(d, RANKS, "doc_id").withColumnRenamed("id", "doc_id")


def _shout(prompts: list[str]) -> list[str]:
    return [f"<think>{len(p)}</think>{p.upper()}" for p in prompts]


@register("answers_once", oracle="""
SELECT event_type, 'ANSWER ' || upper(event_type) || ' OF ' || strftime(ts, '%Y-%m-%d') AS answer, count(*) AS n_rows,
       (SELECT count(DISTINCT event_type || strftime(ts, '%Y-%m-%d')) FROM events) AS n_asked
FROM events GROUP BY 1, 2
""")
def answers_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF2: many rows with few prompts; the answer table has one row a prompt,
    also after the same rows came a second time."""
    e = read_table(spark, sf_dir, "events")
    prompt = F.concat(F.lit("answer "), F.col("event_type"), F.lit(" of "), F.date_format("ts", "yyyy-MM-dd"))
    rows, store = e.select("event_type", prompt.alias("prompt")), shared_path(spark, "answers")
    answers.answer_once(rows, _shout, store)
    again = answers.answer_once(rows, _shout, store).groupBy("event_type", "answer").agg(F.count(F.lit(1)).alias("n_rows"))
    asked = answers.kept_answers(spark, store).count()  # one number
    return again.withColumn("n_asked", F.lit(asked).cast("long"))
