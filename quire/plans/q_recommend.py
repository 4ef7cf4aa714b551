"""Recommendation queries: themes from parts and conversations, providers
from file names, cluster/provider counts over the embedding labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import cluster, recommend
from quire.plans.catalog import register
from quire.session import read_table


def part_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme answers from parts: the name (with case and blank noise) is the
    theme, size the count, brand the sample, type and brand the items."""
    p = read_table(spark, sf_dir, "part")
    theme = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")) \
        .otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    return p.select(theme.alias("theme"), F.col("p_size").alias("count"),
                    F.array("p_brand").alias("sample_recommendations"),
                    F.array("p_type", "p_brand").alias("all_recommendations"))


@register("theme_merge", oracle="""
SELECT list_aggr(list_transform(string_split(k, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS theme,
       CAST(sum(p_size) AS BIGINT) AS count,
       array_to_string(list_slice(list_sort(list_distinct(list(p_brand))), 1, 3), '|') AS samples,
       array_to_string(list_sort(list_distinct(flatten(list([p_type, p_brand])))), '|') AS items
FROM (SELECT lower(p_name) AS k, * FROM part) GROUP BY k
""")
def theme_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = recommend.merge_themes(part_themes(spark, sf_dir))
    return m.select("theme", "count",
                    F.array_join("sample_recommendations", "|").alias("samples"),
                    F.array_join("all_recommendations", "|").alias("items"))


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a model answer: a decoy block, then the themes block
    whose recommendations are the turn's lines.  File = role_conv.json."""
    c = read_table(spark, sf_dir, "conversations")
    themes = F.struct(F.array(F.struct(
        F.col("role").alias("theme"), F.lit(1).alias("count"),
        F.array().cast("array<string>").alias("sample_recommendations"),
        F.split("text", "\n").alias("all_recommendations"))).alias("themes"))
    text = F.concat(F.lit('Schema:\n```json\n{"$defs": {"x": {}}}\n```\nAnswer:\n```json\n'),
                    F.to_json(themes), F.lit("\n```\n"))
    file = F.concat(F.col("role"), F.lit("_"), F.col("conv_id").cast("string"), F.lit("_"),
                    F.col("turn").cast("string"), F.lit(".json"))
    return c.select(file.alias("file"), text.alias("text"))


@register("theme_flatten", oracle=r"""
SELECT role || '_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '.json' AS file,
       CAST(i - 1 AS BIGINT) AS idx, role AS theme,
       regexp_replace(r, '^\s+|\s+$', '', 'g') AS recommendation
FROM (SELECT *, unnest(string_split(text, chr(10))) AS r,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations)
""")
def theme_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.flatten_themes(conversation_answers(spark, sf_dir))


@register("file_counts", oracle="""
SELECT sum(len(string_split(text, chr(10)))) :: BIGINT AS n_rows, count(*) AS n_files FROM conversations
""")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.file_counts(recommend.flatten_themes(conversation_answers(spark, sf_dir)))


@register("provider_name", oracle="""
SELECT 'part' AS kind, p_partkey AS key,
       CASE WHEN contains(replace(p_name, '.json', ''), '_') THEN split_part(replace(p_name, '.json', ''), '_', 1)
            ELSE split_part(replace(p_name, '.json', ''), ' ', 1) END AS provider FROM part
UNION ALL
SELECT 'supplier', s_suppkey,
       CASE WHEN contains(replace(s_name, '.json', ''), '_') THEN split_part(replace(s_name, '.json', ''), '_', 1)
            ELSE split_part(replace(s_name, '.json', ''), ' ', 1) END FROM supplier
""")
def provider_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("key"),
        T.provider_from_file("p_name").alias("provider"))
    s = read_table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"),
        T.provider_from_file("s_name").alias("provider"))
    return p.unionByName(s)


def embedding_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as cluster members: label = cluster, file names spread
    over five providers."""
    e = read_table(spark, sf_dir, "embeddings")
    file = F.concat(F.lit("p"), (F.col("vec_id") % 5).cast("string"), F.lit("_"),
                    F.col("vec_id").cast("string"), F.lit(".json"))
    return e.select(F.col("vec_id").alias("idx"), F.col("label").cast("long").alias("cluster_id"),
                    file.alias("file"), F.col("embedding").alias("vec"))


@register("provider_counts", oracle="""
SELECT CAST(label AS BIGINT) AS cluster_id, 'p' || CAST(vec_id % 5 AS VARCHAR) AS provider, count(*) AS n_members
FROM embeddings GROUP BY 1, 2
""")
def provider_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.provider_counts(embedding_members(spark, sf_dir))


@register("cluster_summary", oracle="""
SELECT CAST(label AS BIGINT) AS cluster_id, count(*) AS n_members,
       count(DISTINCT vec_id % 5) AS n_providers, count(DISTINCT vec_id % 5) = 3 AS is_common
FROM embeddings GROUP BY 1
""")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_summary(embedding_members(spark, sf_dir))


@register("shared_clusters", oracle="""
SELECT CAST(label AS BIGINT) AS cluster_id, count(*) AS n_members,
       count(DISTINCT vec_id % 7) AS n_providers, count(DISTINCT vec_id % 7) = 3 AS is_common
FROM embeddings WHERE label < 5 GROUP BY 1 HAVING count(DISTINCT vec_id % 7) > 1
""")
def shared_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    # labels >= 5 all come from one provider, so only labels < 5 are shared
    prov = F.when(F.col("label") < 5, F.concat(F.lit("q"), (F.col("vec_id") % 7).cast("string"))) \
        .otherwise(F.lit("solo"))
    m = e.select(F.col("label").cast("long").alias("cluster_id"),
                 F.concat(prov, F.lit("_"), F.col("vec_id").cast("string"), F.lit(".json")).alias("file"))
    return cluster.shared_clusters(m)


_PROVIDERS = ("O'Brien", 'Lee "x"', "D'Arcy \"y\"", "Roy")

# labels up to 5 have all four providers, 6 has one, 7 two, 8 three, 9 four
_REPORT_SQL = """
WITH m AS (
  SELECT CAST(label AS BIGINT) AS cluster_id, vec_id AS idx,
         ['O''Brien', 'Lee "x"', 'D''Arcy "y"', 'Roy'][vec_id % (CASE WHEN label BETWEEN 6 AND 8 THEN label - 5 ELSE 4 END) + 1]
         AS provider, 'text ' || CAST(vec_id AS VARCHAR) AS t
  FROM embeddings),
"""


def _report_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members with awkward provider names, their summary and representatives."""
    e = read_table(spark, sf_dir, "embeddings")
    names = F.array(*[F.lit(n) for n in _PROVIDERS])
    many = F.when(F.col("label").between(6, 8), F.col("label") - 5).otherwise(len(_PROVIDERS))
    m = e.select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("idx"),
                 F.concat(F.get(names, (F.col("vec_id") % many).cast("int")), F.lit("_"), F.col("vec_id").cast("string"),
                          F.lit(".json")).alias("file"),
                 F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("recommendation"))
    reps = m.groupBy("cluster_id").agg(F.min_by("recommendation", "idx").alias("representative"))
    return m, cluster.cluster_summary(m), reps


@register("report_lines", oracle=_REPORT_SQL + r"""
p AS (SELECT cluster_id, provider, min(idx) AS first FROM m GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN contains(provider, '''') AND NOT contains(provider, '"') THEN '"' || provider || '"'
                     ELSE '''' || replace(provider, '''', chr(92) || '''') || '''' END AS quoted FROM p),
h AS (SELECT cluster_id, string_agg(quoted, ', ' ORDER BY first) AS names, count(*) AS n FROM q GROUP BY 1)
SELECT cluster_id, CAST(-1 AS BIGINT) AS line_no, '' AS line FROM h
UNION ALL SELECT cluster_id, 0, '-- Cluster ' || CAST(cluster_id AS VARCHAR) || ' -- ' || CASE WHEN n = 3 THEN '[COMMON]' ELSE '' END FROM h
UNION ALL SELECT cluster_id, 1, 'Representative: ' || arg_min(t, idx) FROM m GROUP BY 1
UNION ALL SELECT cluster_id, 2, 'Providers in cluster: [' || names || ']' FROM h
UNION ALL SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY idx) + 2,
                 '  [' || provider || '_' || CAST(idx AS VARCHAR) || '.json] ' || t FROM m
""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.report_lines(*_report_frames(spark, sf_dir))


@register("report_parse", oracle=_REPORT_SQL + """
c AS (SELECT cluster_id, provider, count(*) AS n FROM m GROUP BY 1, 2),
h AS (SELECT cluster_id, string_agg(provider, '|' ORDER BY provider) AS providers FROM c GROUP BY 1)
SELECT c.cluster_id, arg_min(m.t, m.idx) AS representative, h.providers, c.provider, c.n
FROM c JOIN h USING (cluster_id) JOIN m USING (cluster_id) GROUP BY c.cluster_id, h.providers, c.provider, c.n
""")
def report_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10 over the lines of SRC9: what was written comes back."""
    lines = recommend.report_lines(*_report_frames(spark, sf_dir)).withColumnRenamed("cluster_id", "file")
    clusters, counts = recommend.parse_lines(lines, ["file", "line_no"])
    return clusters.join(counts, "cluster_id").select(
        "cluster_id", "representative", F.array_join(F.array_sort("providers"), "|").alias("providers"), "provider", "n")


@register("provider_pivot", oracle=_REPORT_SQL + """
r AS (SELECT cluster_id, arg_min(t, idx) AS representative FROM m GROUP BY 1)
SELECT representative, """ + ", ".join(
    "nullif(count(*) FILTER (WHERE provider = '{}'), 0) AS \"{}\"".format(p.replace("'", "''"), p.replace('"', '""'))
    for p in _PROVIDERS) + """
FROM m JOIN r USING (cluster_id) GROUP BY representative
""")
def provider_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16, one column per provider."""
    m, _, reps = _report_frames(spark, sf_dir)
    return cluster.provider_table(cluster.provider_counts(m), reps, providers=_PROVIDERS)


@register("sorted_names", oracle=r"""
SELECT DISTINCT split_part(regexp_replace(p_name, '^\s+|\s+$', '', 'g'), ' ', 1) AS first_word FROM part
""")
def sorted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT5: first word of each provider name, distinct (sorted on output)."""
    p = read_table(spark, sf_dir, "part")
    w = F.get(F.split(T.ws_trim("p_name"), r"(?U)\s+"), 0)
    return p.select(w.alias("first_word")).distinct().orderBy("first_word")
