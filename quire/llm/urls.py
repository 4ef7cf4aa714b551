"""URL filters: dated list entries joined to captures as of their fetch time.

A list entry adds a key to a list, or removes it, at some time.  The entries of
a (list, key) become validity intervals.  A key is a host, which covers its
subdomains, or a host with leading path segments.  Every capture is cut into all
keys that could cover it, and meets by equality the intervals of these keys that
are valid when it was fetched.  Intervals are cut along fixed spans of days and
the span is part of the join key, so that neither long histories nor a host
with a third of all captures make one large group; for the same reason histories
are read by segmented scans.  Only built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import scan

SPAN_DAYS = 28
# What the entries say.
ADD, REMOVE = "add", "remove"
BLOCK, ALLOW = "block", "allow"


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.coalesce(F.lower(F.regexp_replace(found, r"\.+$", "")), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys(url: Column) -> Column:
    """All keys that cover a URL: the host and its parent domains, and the host
    with one or more leading path segments."""
    labels = F.split(host(url), r"\.")
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    domains = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    places = F.transform(segments, lambda _, i: F.concat(
        host(url), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/")))
    return F.when(host(url) != "", F.array_distinct(F.concat(domains, places))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame, list_col: str = "list", key_col: str = "key", action_col: str = "action",
              at_col: str = "at") -> DataFrame:
    """``(list, key, since, until)``: when each key was on its list, ``until``
    exclusive and null if still so.

    Of entries at the same time a removal counts last.  Adding what is there, or
    removing what isn't, changes nothing, and repeated rows are one.  Rows with a
    null, or with another action, say nothing.
    """
    e = (entries.select(F.col(list_col).alias("list"), F.lower(F.col(key_col)).alias("key"),
                        F.col(action_col).alias("action"), F.col(at_col).alias("at"))
         .where(F.col("action").isin(ADD, REMOVE)).dropna()
         # one row for each time: the removal, if there is one
         .groupBy("list", "key", "at").agg((F.max("action") == ADD).alias("on")))
    by = ["list", "key"]
    changes = (scan.previous_value(e, by, ["at"], F.col("on"), "was")
               .where(F.col("on") != F.coalesce(F.col("was"), F.lit(False))).drop("was"))
    # additions and removals take turns: a removal ends what the change before it began
    changes = scan.previous_value(changes, by, ["at"], F.col("at"), "since")
    ended = changes.where(~F.col("on")).select(*by, "since", F.col("at").alias("until"))
    still = (changes.groupBy(*by).agg(F.max(F.struct("at", "on")).alias("last")).where("last.on")
             .select(*by, F.col("last.at").alias("since"), F.lit(None).cast(e.schema["at"].dataType).alias("until")))
    return ended.union(still)


def _span(at: Column) -> Column:
    return F.floor(F.datediff(at, F.lit("1970-01-01")) / SPAN_DAYS)


def evaluate(captures: DataFrame, valid: DataFrame, id_col: str = "page_id", url_col: str = "url",
             at_col: str = "fetched") -> DataFrame:
    """``(id, url, fetched, blocked, list, key, since)`` for every capture.

    Of the intervals valid at the fetch time the one with the longest key
    decides; of equally long ones that valid since last; of these one that
    allows.  ``blocked`` is true if it is of the list ``block``; any other list
    lets the capture pass.  Nothing valid, a null or malformed URL or a null
    time: not blocked, and the last columns are null.  Captures that agree in
    id, URL and time are one.
    """
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("fetched"))
    first, last = c.agg(_span(F.min("fetched")), _span(F.max("fetched"))).first()
    if first is None:
        first = last = 0
    cut = valid.withColumn("span", F.explode(F.sequence(
        F.greatest(_span(F.col("since")), F.lit(first)),
        F.least(F.coalesce(_span(F.col("until")), F.lit(last)), F.lit(last))))) \
        .where((F.col("span") >= _span(F.col("since"))) & F.col("span").between(first, last)).alias("v")
    asked = (c.where(F.col("fetched").isNotNull())
             .withColumn("key", F.explode(keys(F.col("url")))).withColumn("span", _span(F.col("fetched"))).alias("c"))
    now = (F.col("c.key") == F.col("v.key")) & (F.col("c.span") == F.col("v.span")) \
        & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    hit = F.struct(F.length("v.key").alias("n"), F.col("since"), (F.col("list") == ALLOW).alias("allow"),
                   F.col("v.key").alias("key"), F.col("list"))
    hits = asked.join(cut, now).select("id", "url", "fetched", hit.alias("hit"))
    both = hits.union(c.select("id", "url", "fetched", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit")))
    return (both.groupBy("id", "url", "fetched").agg(F.max("hit").alias("hit"))
            .select("id", "url", "fetched", F.coalesce(F.col("hit.list") == BLOCK, F.lit(False)).alias("blocked"),
                    "hit.list", "hit.key", "hit.since"))


def kept(captures: DataFrame, valid: DataFrame, id_col: str = "page_id", url_col: str = "url",
         at_col: str = "fetched") -> DataFrame:
    """The captures that no list blocks at their fetch time, with all their columns."""
    judged = evaluate(captures, valid, id_col, url_col, at_col).where("blocked").select(
        F.col("id").alias("_quire_id"), F.col("url").alias("_quire_url"), F.col("fetched").alias("_quire_at"))
    same = captures[id_col].eqNullSafe(F.col("_quire_id")) & captures[url_col].eqNullSafe(F.col("_quire_url")) \
        & captures[at_col].eqNullSafe(F.col("_quire_at"))
    return captures.join(judged, same, "left_anti")
