"""Similarity and clustering queries over embeddings, events and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import cluster, pca, similarity
from quire.plans.catalog import register
from quire.session import read_table

# eps for the driver embeddings (the reference's 0.2 links no pair there).
EPS = 0.6

COS = ("list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))")
EDGES_SQL = f"""e AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE 1 - {COS} <= {EPS})"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@register("cosine_edges", oracle=f"""
SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE 1 - {COS} <= {EPS}
""")
def cosine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cosine_edges(points(spark, sf_dir), EPS).select("src", "dst")


def _dbscan_sql(min_samples: int) -> str:
    return f"""
WITH RECURSIVE {EDGES_SQL},
deg AS (SELECT vec_id AS id, 1 + (SELECT count(*) FROM e WHERE e.src = vec_id) AS d FROM embeddings),
core AS (SELECT id FROM deg WHERE d >= {min_samples}),
ce AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
reach(v, r) AS (SELECT id, id FROM core UNION SELECT ce.dst, reach.r FROM reach JOIN ce ON reach.v = ce.src),
comp AS (SELECT v, min(r) AS root FROM reach GROUP BY v),
num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM (SELECT DISTINCT root FROM comp)),
corelab AS (SELECT v AS id, cluster_id FROM comp JOIN num ON comp.root = num.root),
border AS (
  SELECT e.src AS id, min(c.cluster_id) AS cluster_id FROM e JOIN corelab c ON e.dst = c.id
  WHERE e.src NOT IN (SELECT id FROM core) GROUP BY e.src)
SELECT vec_id AS id, CAST(coalesce(c.cluster_id, b.cluster_id, -1) AS BIGINT) AS cluster_id
FROM embeddings LEFT JOIN corelab c ON c.id = vec_id LEFT JOIN border b ON b.id = vec_id
"""


@register("dbscan", headline=True, oracle=_dbscan_sql(2))
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(points(spark, sf_dir), EPS, 2)


@register("dbscan_border", oracle=_dbscan_sql(3))
def dbscan_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(points(spark, sf_dir), EPS, 3)


@register("noise_count", oracle="WITH RECURSIVE " + _dbscan_sql(2).split("WITH RECURSIVE ", 1)[1]
          .rsplit("SELECT vec_id AS id", 1)[0] + """
SELECT count(*) FILTER (WHERE coalesce(c.cluster_id, b.cluster_id, -1) = -1) AS n_noise, count(*) AS n_points
FROM embeddings LEFT JOIN corelab c ON c.id = vec_id LEFT JOIN border b ON b.id = vec_id
""")
def noise_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.noise_count(dbscan(spark, sf_dir))


@register("dbscan_names", oracle="SELECT 'v' || CAST(id AS VARCHAR) AS id, cluster_id = -1 AS noise FROM ("
          + _dbscan_sql(2) + ")")
def dbscan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String ids (clusters are then numbered by name, so only noise is compared)."""
    named = points(spark, sf_dir).withColumn("id", F.concat(F.lit("v"), F.col("id").cast("string")))
    return cluster.dbscan(named, EPS, 2).select("id", (F.col("cluster_id") == cluster.NOISE).alias("noise"))


@register("cluster_representative", oracle=f"""
WITH l AS ({_dbscan_sql(2)}),
x AS (SELECT cluster_id, vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i
      FROM embeddings JOIN l ON l.id = vec_id WHERE cluster_id <> -1),
c AS (SELECT cluster_id, i, avg(v) AS m FROM x GROUP BY cluster_id, i),
d AS (SELECT x.cluster_id, x.vec_id, round(sqrt(sum((x.v - c.m) * (x.v - c.m))), 5) AS dist
      FROM x JOIN c ON x.cluster_id = c.cluster_id AND x.i = c.i GROUP BY x.cluster_id, x.vec_id)
SELECT cluster_id, count(*) AS n_members, min(dist) AS nearest FROM d GROUP BY cluster_id
""")
def cluster_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6 and AGG7 over real DBSCAN labels: noise has no centroid."""
    m = dbscan(spark, sf_dir).join(points(spark, sf_dir), "id")
    r = cluster.representatives(m).join(points(spark, sf_dir).withColumnRenamed("id", "rep_id"), "rep_id")
    d2 = F.aggregate(F.zip_with("vec", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return r.select("cluster_id", "n_members", F.round(F.sqrt(d2), 5).alias("nearest"))


@register("centroid_representative", oracle="""
WITH x AS (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i),
d AS (SELECT x.label, x.vec_id, sqrt(sum((x.v - c.m) * (x.v - c.m))) AS dist
      FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY x.label, x.vec_id),
r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM d),
n AS (SELECT label, sqrt(sum(m * m)) AS cn FROM c GROUP BY label)
SELECT CAST(r.label AS BIGINT) AS cluster_id, r.n AS n_members, r.vec_id AS rep_id,
       round(n.cn, 3) AS centroid_norm
FROM r JOIN n ON r.label = n.label WHERE rn = 1
""")
def centroid_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("id"),
        F.col("embedding").alias("vec"))
    r = cluster.representatives(e)
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda acc, x: acc + x * x))
    return r.select("cluster_id", "n_members", "rep_id", F.round(norm, 3).alias("centroid_norm"))


@register("jaccard_pairs", oracle="""
WITH f AS (SELECT DISTINCT user_id, event_type || '@' || strftime(ts, '%Y-%m-%d') AS feat FROM events),
s AS (SELECT user_id, count(*) AS sz FROM f GROUP BY user_id),
i AS (SELECT a.user_id AS a, b.user_id AS b, count(*) AS inter
      FROM f a JOIN f b ON a.feat = b.feat AND 'U' || CAST(a.user_id AS VARCHAR) < 'U' || CAST(b.user_id AS VARCHAR) GROUP BY 1, 2)
SELECT 'U' || CAST(i.a AS VARCHAR) AS a, 'U' || CAST(i.b AS VARCHAR) AS b, i.inter, sa.sz + sb.sz - i.inter AS "union",
       round(i.inter / (sa.sz + sb.sz - i.inter), 6) AS jaccard
FROM i JOIN s sa ON sa.user_id = i.a JOIN s sb ON sb.user_id = i.b
WHERE i.inter >= 0.3 * (sa.sz + sb.sz - i.inter)
""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    # string ids, as the record reader yields them
    sets = ev.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id"),
                     F.concat(F.col("event_type"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))
                     .alias("item"))
    p = similarity.jaccard_pairs(sets, min_similarity=0.3)
    return p.select("a", "b", "inter", "union", F.round("jaccard", 6).alias("jaccard"))


@register("variance_filter", oracle="""
WITH f AS (
  SELECT DISTINCT c_custkey, 'c_mktsegment=' || c_mktsegment AS feature FROM customer
  UNION SELECT DISTINCT c_custkey, 'c_nationkey=' || CAST(c_nationkey AS VARCHAR) FROM customer),
n AS (SELECT count(DISTINCT c_custkey) AS n FROM customer)
SELECT feature, count(DISTINCT c_custkey) AS n_true,
       round((count(DISTINCT c_custkey) / max(n.n)) * (1 - count(DISTINCT c_custkey) / max(n.n)), 6) AS variance,
       (count(DISTINCT c_custkey) / max(n.n)) * (1 - count(DISTINCT c_custkey) / max(n.n)) > 0.01 AS keep
FROM f, n GROUP BY feature
""")
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    ind = cluster.one_hot(c, "c_custkey", ["c_mktsegment", "c_nationkey"])
    v = cluster.variance_filter(ind, "c_custkey")
    return v.select("feature", "n_true", F.round("variance", 6).alias("variance"), "keep")


@register("unit_vectors", oracle="""
WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT vec_id, CAST(i AS INT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 5) AS x FROM x
""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    return e.select("vec_id", F.posexplode(cluster.normalise(scaled)).alias("i", "x")) \
        .select("vec_id", "i", F.round("x", 5).alias("x"))


@register("minmax", oracle="""
SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value
FROM events
""")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "value")
    s = cluster.min_max_scale(e, ["value"])
    return s.select("event_id", F.round("value", 6).alias("value"))


def _components_sql(squarings: int = 14) -> str:
    """``v1``, ``v2`` and ``l1``, ``l2``: the first two eigenvectors and values of
    the covariance matrix of ``x(id, f, x)``, by squaring it over and over (a power
    of it keeps one direction), then taking that direction out.  The largest entry
    is positive."""
    parts = ["""
n AS (SELECT count(DISTINCT id) AS n FROM x),
m AS (SELECT f, sum(x) AS s FROM x GROUP BY f),
xx AS (SELECT a.f AS f, b.f AS g, sum(a.x * b.x) AS p FROM x a JOIN x b ON a.id = b.id GROUP BY 1, 2),
c1 AS (SELECT a.f AS f, b.f AS g, (coalesce(p, 0) - a.s * b.s / n) / (n - 1) AS v
       FROM m a CROSS JOIN m b CROSS JOIN n LEFT JOIN xx ON xx.f = a.f AND xx.g = b.f),
t AS (SELECT sum(v) AS total FROM c1 WHERE f = g)"""]
    for k in (1, 2):
        last = f"c{k}"
        for i in range(squarings):
            parts.append(f"""
q{k}_{i} AS (SELECT f, g, v / max(abs(v)) OVER () AS v FROM (
  SELECT a.f, b.g, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.g = b.f GROUP BY 1, 2))""")
            last = f"q{k}_{i}"
        parts.append(f"""
d{k} AS (SELECT f, v FROM {last} WHERE f = g),
b{k} AS (SELECT f FROM d{k} ORDER BY round(sqrt(v / (SELECT sum(v) FROM d{k})), 9) DESC, f LIMIT 1),
v{k} AS (SELECT f, v / sqrt(sum(v * v) OVER ()) AS v FROM {last} WHERE g = (SELECT f FROM b{k})),
l{k} AS (SELECT sum(a.v * c.v * b.v) AS l FROM c1 c JOIN v{k} a ON a.f = c.f JOIN v{k} b ON b.f = c.g)""")
        if k == 1:
            parts.append("""
c2 AS (SELECT c.f, c.g, c.v - l.l * a.v * b.v AS v FROM c1 c CROSS JOIN l1 l JOIN v1 a ON a.f = c.f JOIN v1 b ON b.f = c.g)""")
    return ",".join(parts)


_USER_FLAGS_SQL = """x AS (SELECT DISTINCT user_id AS id, event_type || '@' || strftime(ts, '%Y-%m-%d') AS f, 1.0::DOUBLE AS x FROM events),"""


def user_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id"), F.concat(F.col("event_type"), F.lit("@"),
                                               F.date_format("ts", "yyyy-MM-dd")).alias("feature")).distinct()


@register("pca_top", oracle=f"""
WITH {_USER_FLAGS_SQL} {_components_sql()},
r AS (SELECT 0 AS component, f, v, l / total AS explained FROM v1, l1, t UNION ALL SELECT 1, f, v, l / total FROM v2, l2, t)
SELECT CAST(component AS INT) AS component, f AS feature, round(abs(v), 4) AS abs_loading, round(explained, 5) AS explained,
       CAST(row_number() OVER (PARTITION BY component ORDER BY round(abs(v), 9) DESC, f) AS INT) AS rank
FROM r QUALIFY row_number() OVER (PARTITION BY component ORDER BY round(abs(v), 9) DESC, f) <= 20
""")
def pca_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML3 + SRT4: top loadings of user x (type, day) flags."""
    top = cluster.pca_loadings(user_flags(spark, sf_dir), "user_id", k=2, top_n=20)
    return top.select("component", "feature", F.round("abs_loading", 4).alias("abs_loading"),
                      F.round("explained", 5).alias("explained"), "rank")


@register("pca_points", oracle=f"""
WITH {_USER_FLAGS_SQL} {_components_sql()},
u AS (SELECT DISTINCT id FROM x),
p AS (SELECT id, sum(x.x * v1.v) AS a, sum(x.x * v2.v) AS b FROM x JOIN v1 ON v1.f = x.f JOIN v2 ON v2.f = x.f GROUP BY id),
c AS (SELECT sum(s * v1.v) / any_value(n) AS a, sum(s * v2.v) / any_value(n) AS b FROM m JOIN v1 ON v1.f = m.f JOIN v2 ON v2.f = m.f, n)
SELECT id AS user_id, round((p.a - c.a) * (p.a - c.a), 3) AS first, round((p.b - c.b) * (p.b - c.b), 3) AS second FROM p, c
""")
def pca_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML3: every user's squared distance from the centre along each component."""
    points = pca.components(user_flags(spark, sf_dir), "user_id").points
    first, second = F.col("point")[0], F.col("point")[1]
    return points.select(F.col("id").alias("user_id"), F.round(first * first, 3).alias("first"),
                         F.round(second * second, 3).alias("second"))


_JITTER_SQL = """(CAST('0x' || substr(md5(CAST(cluster_id AS VARCHAR) || '|' || provider || '|{axis}|0'), 1, 8) AS BIGINT)
                  / 4294967295.0 * 2 - 1) * 0.02"""


@register("cluster_map", oracle=f"""
WITH e AS (SELECT CAST(label AS BIGINT) AS id, unnest(embedding) AS v, CAST(unnest(range(len(embedding))) AS VARCHAR) AS f FROM embeddings),
x AS (SELECT id, f, avg(CAST(v AS DOUBLE)) AS x FROM e GROUP BY id, f), {_components_sql()},
p AS (SELECT id, sum(x.x * v1.v) AS a, sum(x.x * v2.v) AS b FROM x JOIN v1 ON v1.f = x.f JOIN v2 ON v2.f = x.f GROUP BY id),
o AS (SELECT id AS cluster_id, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS x,
             (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS y FROM p),
k AS (SELECT CAST(label AS BIGINT) AS cluster_id, 'p' || CAST(vec_id % 5 AS VARCHAR) AS provider, count(*) AS count FROM embeddings GROUP BY 1, 2)
SELECT cluster_id, round(x, 4) AS x, round(y, 4) AS y, 'center' AS provider, CAST(0 AS BIGINT) AS count, 'Cluster Center' AS type FROM o
UNION ALL
SELECT cluster_id, round(x + {_JITTER_SQL.format(axis='x')}, 4), round(y + {_JITTER_SQL.format(axis='y')}, 4), provider, count, 'Provider'
FROM k JOIN o USING (cluster_id)
""")
def cluster_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML7: cluster centres at their first two principal components, providers
    jittered around them."""
    from quire.plans.q_recommend import embedding_members
    m = embedding_members(spark, sf_dir)
    at = cluster.plane(cluster.centroids(m, "cluster_id", "vec"))
    placed = cluster.cluster_map(at, cluster.provider_counts(m))
    return placed.withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})
