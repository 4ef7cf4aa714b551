"""Recommendation answers and cluster reports (SET3, AGG2, AGG4, SCL12,
SRC9, SRC10).

Answers are model outputs holding a fenced JSON block with themes.  The
typed schema below is the only explicit schema of the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_text, pick_fenced_json, provider_from_file, title_case, ws_trim
from quire.plans import scan
from quire.plans.barrier import with_computed

THEMES_SCHEMA = ("struct<themes: array<struct<theme: string, count: int, "
                 "sample_recommendations: array<string>, all_recommendations: array<string>>>>")
# Words of the cluster report.
SAMPLE_SIZE = 3
TITLE = "=== Semantic Clusters of Recommendations ==="
NO_CLUSTERS = "No meaningful clusters found."
CLUSTER, COMMON = "-- Cluster ", "[COMMON]"
REPRESENTATIVE, PROVIDERS = "Representative: ", "Providers in cluster: "
# ---------------------------------------------------------------------------
# One quoted name of a provider list, in either kind of quotes, with escapes.
_NAME = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def parse_answers(answers: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """``(file, json, themes)``: the first usable fenced block of each answer,
    typed; ``json`` is NULL when the answer has none (see :func:`answer_rejects`)."""
    picked = pick_fenced_json(text_col)
    j = with_computed(answers.select(file_col, text_col), json=picked)
    return with_computed(j.drop(text_col), themes=F.from_json("json", THEMES_SCHEMA)["themes"])


def answer_rejects(answers: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """``(file, reason)`` of the answers that give no recommendation rows."""
    reason = (F.when(F.col("json").isNull(), "no valid JSON block without '$defs'")
              .when(F.col("themes").isNull(), "themes is not a list"))
    return (parse_answers(answers, file_col, text_col).select(file_col, reason.alias("reason"))
            .where(F.col("reason").isNotNull()))


def flatten_themes(answers: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """SET3: one row per recommendation of every theme of every answer,
    stripped, duplicates kept; ``idx`` numbers them within the file.
    Answers whose ``themes`` is not a list give no rows."""
    p = parse_answers(answers, file_col, text_col).where(F.col("themes").isNotNull())
    empty = F.array().cast("array<string>")
    # an answer is one row, so the position across its themes comes from the
    # theme sizes in that row: no window, no shuffle
    p = p.withColumn("_sizes", F.transform(
        "themes", lambda t: F.size(F.coalesce(t["all_recommendations"], empty))))
    t = p.select(file_col, "_sizes", F.posexplode("themes").alias("_ti", "_t"))
    r = t.select(file_col, "_sizes", "_ti", F.col("_t.theme").alias("theme"),
                 F.posexplode(F.coalesce(F.col("_t.all_recommendations"), empty)).alias("_ri", "_r"))
    before = F.aggregate(F.slice("_sizes", 1, F.col("_ti")), F.lit(0), lambda a, x: a + x)
    return r.select(file_col, (before + F.col("_ri")).cast("long").alias("idx"), "theme",
                    ws_trim("_r").alias("recommendation"))


def file_counts(recs: DataFrame, file_col: str = "file") -> DataFrame:
    """AGG4: rows and distinct files."""
    return recs.agg(F.count("*").alias("n_rows"), F.count_distinct(file_col).alias("n_files"))


def merge_themes(themes: DataFrame, sample_size: int = SAMPLE_SIZE) -> DataFrame:
    """AGG2: themes keyed by lower-cased, stripped name; counts summed,
    samples and recommendations united without duplicates; display name
    title-cased.  Samples are the first ``sample_size`` in sorted order (the
    reference takes them in set order).  Items are de-duplicated per key
    before they are grouped, so a hot theme ships each item once."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")

    def items(col: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(col), empty), lambda x: F.struct(
            F.lit(kind).alias("kind"), x.alias("item"), F.lit(None).cast("long").alias("n")))

    # one pass: the count and all items of a theme row, items then united by key
    head = F.array(F.struct(F.lit("count").alias("kind"), none.alias("item"), F.col("count").cast("long").alias("n")))
    rows = themes.select(ws_trim(F.lower("theme")).alias("_key"), F.inline(F.concat(
        head, items("sample_recommendations", "sample"), items("all_recommendations", "all"))))
    united = rows.groupBy("_key", "kind", "item").agg(F.sum("n").alias("n")).groupBy("_key").agg(
        F.sum("n").alias("count"),
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("item")))).alias(k) for k in ("sample", "all")])
    return united.select(title_case("_key").alias("theme"), "count",
                         F.slice("sample", 1, sample_size).alias("sample_recommendations"),
                         F.col("all").alias("all_recommendations"))


def quoted_list(names: Column) -> Column:
    """Names as a list of quoted texts: single quotes, double ones around a name
    that holds a single quote only; backslashes escape what is left."""
    def one(x: Column) -> Column:
        slashed = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        double = x.contains("'") & ~x.contains('"')
        return F.when(double, F.concat(F.lit('"'), slashed, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(slashed, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(names, one), ", "), F.lit("]"))


def read_list(text: Column) -> Column:
    """The names of a quoted list, whatever quotes it uses; an empty array if the
    text isn't one.  Nothing is ever evaluated."""
    whole = text.rlike(rf"^\[\s*(?:(?:{_NAME})\s*(?:,\s*(?:{_NAME})\s*)*)?\]$")
    names = F.transform(F.regexp_extract_all(text, F.lit(f"({_NAME})"), 1), lambda x: F.regexp_replace(
        F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    return F.when(whole, names).otherwise(F.array().cast("array<string>"))


# SRC9 -----------------------------------------------------------------------------
def report_lines(members: DataFrame, summary: DataFrame, reps: DataFrame,
                 cluster_col: str = "cluster_id", id_col: str = "idx",
                 file_col: str = "file", text_col: str = "recommendation") -> DataFrame:
    """Cluster report as ``(cluster_id, line_no, line)`` rows: a blank line (-1),
    header with the ``[COMMON]`` mark (0), representative, provider list
    (first-seen order), then one ``  [file] text`` line per member.  Write with
    :func:`write_report`, which adds the title.  No cluster is gathered into one
    row."""
    m = members.where(F.col(cluster_col) != -1)
    firsts = (m.groupBy(cluster_col, provider_from_file(file_col).alias("provider"))
              .agg(F.min(id_col).alias("_first")))
    plist = firsts.groupBy(cluster_col).agg(
        F.array_sort(F.collect_list(F.struct("_first", "provider"))).alias("_p"))
    head = (summary.join(reps, cluster_col).join(plist, cluster_col)
            .select(cluster_col, F.array(
                F.lit(""),
                F.concat(F.lit(CLUSTER), F.col(cluster_col).cast("string"), F.lit(" -- "),
                         F.when(F.col("is_common"), F.lit(COMMON)).otherwise(F.lit(""))),
                F.concat(F.lit(REPRESENTATIVE), F.col("representative")),
                F.concat(F.lit(PROVIDERS), quoted_list(F.col("_p.provider")))).alias("_l")))
    heads = head.select(cluster_col, F.posexplode("_l").alias("_i", "line")) \
        .select(cluster_col, (F.col("_i") - 1).alias("line_no"), "line")
    body = scan.row_number(m.select(cluster_col, id_col, file_col, text_col), [cluster_col],
                           [id_col], "_rn")
    body = body.select(cluster_col, (F.col("_rn") + 2).alias("line_no"),
                       F.concat(F.lit("  ["), F.col(file_col), F.lit("] "), F.col(text_col))
                       .alias("line"))
    return heads.select(cluster_col, F.col("line_no").cast("long"), "line").unionByName(body)


def write_report(lines: DataFrame, path: str, cluster_col: str = "cluster_id",
                 empty_line: str = NO_CLUSTERS) -> None:
    """Text sink: title, then the lines in (cluster, line) order; a fixed line
    when there is no cluster."""
    if lines.limit(1).count() == 0:
        lines.sparkSession.createDataFrame([(empty_line,)], "value string") \
            .coalesce(1).write.mode("overwrite").text(path)
        return
    title = lines.sparkSession.createDataFrame([(TITLE,)], "line string").select(
        F.lit(None).cast(lines.schema[cluster_col].dataType).alias(cluster_col),
        F.lit(-1).cast("long").alias("line_no"), "line")
    lines = title.unionByName(lines.select(cluster_col, F.col("line_no").cast("long"), "line"))
    (lines.repartitionByRange(cluster_col, "line_no").sortWithinPartitions(cluster_col, "line_no")
     .select(F.col("line").alias("value")).write.mode("overwrite").text(path))


# SRC10 ----------------------------------------------------------------------------
HEADER = rf"^{CLUSTER}(-?\d+) --"


def parse_lines(lines: DataFrame, order_cols: Sequence[str] = ("file", "pos"),
                line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Clusters of report lines, in order: ``(clusters, counts)``.

    ``clusters(cluster_id, representative, providers ARRAY)``: blocks with
    fewer than three lines are skipped; the provider list is read by pattern
    (see :func:`read_list`).  ``counts(cluster_id, provider, n)``: members per
    provider from the ``[file] ...`` lines.  Line-based, so a huge cluster is
    not one row.
    """
    o = list(order_cols)
    raw = lines.select(*o, clean_text(line_col).alias("line")).where(F.col("line") != "")
    hdr = F.when(F.col("line").rlike(HEADER),
                 F.struct(*o, F.regexp_extract("line", HEADER, 1).cast("long").alias("cid")))
    filled = scan.forward_fill(raw, [], o, hdr, "_h").where(F.col("_h").isNotNull())
    pos = scan.row_number(filled, ["_h"], o, "_k")  # 1 = header line
    blocks = pos.groupBy("_h").agg(
        F.count("*").alias("_n"),
        F.max_by("line", F.when(F.col("_k") == 2, F.lit(1))).alias("_rep"),
        F.max_by("line", F.when(F.col("_k") == 3, F.lit(1))).alias("_prov"))
    blocks = blocks.where(F.col("_n") >= 3)
    names = F.transform(read_list(F.regexp_replace("_prov", f"^{PROVIDERS}", "")), clean_text)
    clusters = blocks.select(F.col("_h.cid").alias("cluster_id"),
                             ws_trim(F.regexp_replace("_rep", REPRESENTATIVE, "")).alias("representative"),
                             names.alias("providers"))
    member = pos.join(blocks.select("_h"), "_h").where(F.col("_k") > 3)
    inner = F.regexp_extract(ws_trim("line"), r"^\[(.*?)\]", 1)
    m = member.where(ws_trim("line").rlike(r"^\[(.*?)\]")).select(
        F.col("_h.cid").alias("cluster_id"),
        clean_text(F.when(inner.contains("_"), F.substring_index(inner, "_", 1))
                   .otherwise(F.substring_index(inner, " ", 1))).alias("provider"))
    counts = m.groupBy("cluster_id", "provider").agg(F.count("*").alias("n"))
    return clusters, counts


def parse_report(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Read a cluster report back (see :func:`parse_lines`)."""
    return parse_lines(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line")))
