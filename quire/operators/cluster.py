"""Density clustering and cluster facts (ML4, AGG3 - AGG7, ML1 - ML3, ML5 -
ML7, PRJ13, PRJ17).

DBSCAN runs over metric cells: each counts the neighbours of its vectors, then
returns the connected parts of its core points, which star contraction joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import provider_from_file
from quire.operators import metric, pca
from quire.operators.graph import connected_components
from quire.plans import scan
from quire.plans.hot import join_by_weight
from quire.session import shared_table

# Fixed values of the reference ------------------------------------------------
DEFAULT_EPS = 0.2
DEFAULT_MIN_SAMPLES = 2
COMMON_PROVIDERS = 3
JITTER = 0.02
NOISE = -1
# -------------------------------------------------------------------------------


def dbscan(points: DataFrame, eps: float = DEFAULT_EPS, min_samples: int = DEFAULT_MIN_SAMPLES,
           id_col: str = "id", vec_col: str = "vec", cell: int = metric.CELL) -> DataFrame:
    """``(id, cluster_id)`` for every row; noise is -1.

    Same labels as scikit-learn's DBSCAN on a precomputed cosine distance
    matrix: neighbours within ``eps`` (inclusive) counting the point itself,
    clusters numbered by their smallest core point, a border point joins the
    lowest-numbered cluster among its core neighbours.  Repeated rows are points
    of their own.  Rows with a null id, and vectors that are null, empty, zero
    or hold null or non-finite components are noise.

    Equal vectors are one node with a weight.  Tiles of metric cells give each
    node its number of neighbours, then the connected parts of core nodes and
    the few core neighbours of the others: no edge table exists.
    """
    rows = points.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    fine = rows.where(F.col("id").isNotNull() & metric.usable("v"))
    groups = fine.groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first"))
    nodes = shared_table(groups.withColumn("node", F.monotonically_increasing_id()))
    members = metric.cells(nodes.select("node", "v", "weight"), eps, cell=cell)

    near = metric.by_tile(members, eps, metric.count_kernel, "node long, near long", cell=cell)
    core = shared_table(near.groupBy("node").agg((F.sum("near") >= min_samples).alias("core")))
    marked = shared_table(members.join(core, "node"))
    parts = shared_table(metric.by_tile(marked, eps, metric.part_kernel, "node long, other long, border boolean",
                                        extra=("core",), cell=cell))
    linked = connected_components(parts.where(~F.col("border")), "node", "other").withColumnRenamed("v", "_node")
    of = (core.where("core").join(linked, F.col("node") == F.col("_node"), "left")
          .select("node", F.coalesce("root", "node").alias("root")))
    of = shared_table(of.join(nodes.select("node", "first"), "node"))
    numbered = scan.row_number(of.groupBy("root").agg(F.min("first").alias("first")), [], ["first"], "_rank")
    core_label = of.join(numbered.select("root", (F.col("_rank") - 1).alias("cluster_id")), "root").select("node", "cluster_id")
    border = (parts.where("border").join(core_label.withColumnRenamed("node", "other"), "other")
              .groupBy("node").agg(F.min("cluster_id").alias("cluster_id")))
    label = core_label.unionByName(border)
    by_vector = shared_table(nodes.join(label, "node", "left")
                             .select("v", "weight", F.coalesce("cluster_id", F.lit(NOISE)).cast("long").alias("cluster_id")))
    rest = rows.where(~(F.col("id").isNotNull() & metric.usable("v")))
    return (join_by_weight(fine, by_vector, ["v"], "weight").select("id", "cluster_id")
            .unionByName(rest.select("id", F.lit(NOISE).cast("long").alias("cluster_id"))))


# AGG5 -------------------------------------------------------------------------------
def noise_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_if(F.col("cluster_id") == -1).alias("n_noise"),
                      F.count("*").alias("n_points"))


# AGG6, AGG7 -------------------------------------------------------------------------
def centroids(members: DataFrame, cluster_col: str = "cluster_id", vec_col: str = "vec") -> DataFrame:
    """Element-wise mean vector per cluster (partial aggregation of vectors);
    noise is no cluster."""
    v = members.where(F.col(cluster_col) != NOISE).select(cluster_col, array_to_vector(vec_col).alias("_v"))
    return v.groupBy(cluster_col).agg(
        vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"),
        F.count("*").alias("n_members"))


def representatives(members: DataFrame, cluster_col: str = "cluster_id", id_col: str = "id",
                    vec_col: str = "vec") -> DataFrame:
    """Member nearest (L2) to its cluster centroid; the smallest id on ties."""
    c = centroids(members, cluster_col, vec_col)
    j = members.join(c, cluster_col)
    d2 = F.aggregate(F.zip_with(vec_col, "centroid", lambda x, y: (x - y) * (x - y)),
                     F.lit(0.0), lambda acc, x: acc + x)
    j = j.withColumn("_d", F.sqrt(d2))
    return j.groupBy(cluster_col).agg(
        F.min_by(F.col(id_col), F.struct("_d", id_col)).alias("rep_id"),
        F.first("n_members").alias("n_members"),
        F.first("centroid").alias("centroid"))


# AGG3, AGG16, PRJ13 ----------------------------------------------------------------------
def provider_counts(members: DataFrame, cluster_col: str = "cluster_id",
                    file_col: str = "file") -> DataFrame:
    """Members per (cluster, provider); provider from the file name (SCL7)."""
    m = members.where(F.col(cluster_col) != NOISE)
    return m.groupBy(cluster_col, provider_from_file(file_col).alias("provider")) \
        .agg(F.count("*").alias("n_members"))


def cluster_summary(members: DataFrame, cluster_col: str = "cluster_id", file_col: str = "file",
                    common: int = COMMON_PROVIDERS) -> DataFrame:
    """Per cluster: members, distinct providers, and the ``[COMMON]`` mark
    (exactly ``common`` providers, as in the reference)."""
    pc = provider_counts(members, cluster_col, file_col)
    s = pc.groupBy(cluster_col).agg(F.sum("n_members").alias("n_members"),
                                    F.count("*").alias("n_providers"))
    return s.withColumn("is_common", F.col("n_providers") == common)


def shared_clusters(members: DataFrame, cluster_col: str = "cluster_id",
                    file_col: str = "file") -> DataFrame:
    """PRJ13: clusters with more than one distinct provider."""
    return cluster_summary(members, cluster_col, file_col).where(F.col("n_providers") > 1)


# ML1, ML2, PRJ17 ---------------------------------------------------------------------------
def one_hot(rows: DataFrame, id_col: str, cat_cols: Sequence[str]) -> DataFrame:
    """Long-form indicators ``(id, feature)`` with feature ``column=value``;
    NULL categories give no indicator (the reference fills them with 0)."""
    parts = [rows.where(F.col(c).isNotNull())
             .select(id_col, F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("feature"))
             for c in cat_cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def variance_filter(indicators: DataFrame, id_col: str, threshold: float = 0.01,
                    records: DataFrame | None = None) -> DataFrame:
    """Population variance ``p(1-p)`` of each 0/1 feature; ``keep`` when it
    exceeds ``threshold`` (scikit-learn's VarianceThreshold semantics).  Give
    ``records`` if some of them have no indicator at all."""
    people = indicators if records is None else records
    n = people.select(F.count_distinct(id_col)).first()[0]  # one scalar
    f = indicators.groupBy("feature").agg(F.count_distinct(id_col).alias("n_true"))
    p = F.col("n_true") / F.lit(float(n))
    return f.select("feature", "n_true", (p * (1 - p)).alias("variance"),
                    (p * (1 - p) > threshold).alias("keep"))


# ML3 -------------------------------------------------------------------------------------------
def pca_loadings(indicators: DataFrame, id_col: str, k: int = 2, top_n: int = 20) -> DataFrame:
    """Centred PCA of the 0/1 matrix: ``(component, rank, feature, loading,
    abs_loading, explained)`` of the ``top_n`` features with the largest absolute
    loading per component (see :mod:`quire.operators.pca`)."""
    return pca.components(indicators.select(id_col, "feature").distinct(), id_col, k=k).top(top_n)


# ML7 -------------------------------------------------------------------------------------------
def plane(centres: DataFrame, cluster_col: str = "cluster_id", vec_col: str = "centroid") -> DataFrame:
    """``(cluster, x, y)``: each centre at its first two principal components,
    scaled to [0, 1]."""
    long = centres.select(cluster_col, F.posexplode(vec_col).alias("feature", "value"))
    points = pca.components(long, cluster_col, value=F.col("value")).points
    at = points.select(F.col("id").alias(cluster_col), F.col("point")[0].alias("x"), F.col("point")[1].alias("y"))
    return min_max_scale(at, ["x", "y"])


# ML5, ML6 ---------------------------------------------------------------------------------------
def normalise(vec: Column | str) -> Column:
    """Unit-length vector (zero vectors stay zero)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    # the norm is repeated into an array once per row; a lambda that used the
    # outer norm directly would recompute it for every element
    norms = F.array_repeat(norm, F.size(v))
    return F.zip_with(v, norms, lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def min_max_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column scaled to [0, 1] over the whole frame (constant -> 0)."""
    stats = df.agg(*[F.min(c).alias(f"min_{c}") for c in cols],
                   *[F.max(c).alias(f"max_{c}") for c in cols]).first()  # one row of scalars
    out = df
    for c in cols:
        lo, hi = stats[f"min_{c}"], stats[f"max_{c}"]
        if lo is None or hi is None or hi <= lo:
            out = out.withColumn(c, F.lit(0.0))
        else:
            out = out.withColumn(c, (F.col(c) - F.lit(lo)) / F.lit(hi - lo))
    return out


# ML7 ---------------------------------------------------------------------------------------------
def cluster_map(positions: DataFrame, counts: DataFrame, cluster_col: str = "cluster_id",
                seed: str = "0") -> DataFrame:
    """Chart points: one centre per cluster at its 2-d position, one point
    per provider jittered by up to ``JITTER`` (seeded hash), sized by count.

    ``positions(cluster, x, y)``; ``counts(cluster, provider, n_members)``.
    """
    centres = positions.select(cluster_col, "x", "y", F.lit("center").alias("provider"),
                               F.lit(0).cast("long").alias("count"),
                               F.lit("Cluster Center").alias("type"))

    def jit(axis: str) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(cluster_col).cast("string"),
                                                  "provider", F.lit(axis), F.lit(seed))), 1, 8),
                   16, 10).cast("double")
        return (h / F.lit(float(0xFFFFFFFF)) * 2 - 1) * JITTER

    prov = (counts.join(positions, cluster_col)
            .select(cluster_col, (F.col("x") + jit("x")).alias("x"), (F.col("y") + jit("y")).alias("y"),
                    "provider", F.col("n_members").cast("long").alias("count"),
                    F.lit("Provider").alias("type")))
    return centres.unionByName(prov)


# AGG16 -------------------------------------------------------------------------------------------
def provider_table(counts: DataFrame, reps: DataFrame, cluster_col: str = "cluster_id",
                   by_provider: bool = False, providers: Sequence[str] | None = None) -> DataFrame:
    """Chart tables: ``(representative, provider, count)`` long form, pivoted
    to one column per provider (or per representative when ``by_provider``).
    Give ``providers`` to skip the distinct pass of the pivot."""
    long = counts.join(reps.select(cluster_col, "representative"), cluster_col) \
        .select("representative", "provider", F.col("n_members").alias("count"))
    if by_provider:
        return long.groupBy("provider").pivot("representative").agg(F.sum("count"))
    return long.groupBy("representative").pivot(
        "provider", list(providers) if providers is not None else None).agg(F.sum("count"))


# PRJ17 -------------------------------------------------------------------------------------------
def flag_matrix(flags: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """0/1 patient-by-field indicators in long form ``(id, feature)`` for the
    true flags.  The id itself is not a feature (the reference counted it,
    which made every pair look more alike)."""
    return flags.where(F.coalesce(F.col("is_true"), F.lit(False))) \
        .select(id_col, F.col("field").alias("feature")).distinct()
