import datetime as dt
import random

from pyspark.sql import functions as F

from quire.llm import urls
from quire.plans import scan

DAY = dt.date(2024, 1, 1)
HOSTS = ["a.com", "x.a.com", "y.x.a.com", "b.org", "ba.com"]


def _entries(rng, n=120):
    keys = HOSTS + ["a.com/p", "x.a.com/p/q", "com", "B.org"]
    return [(rng.choice(["block", "allow", "watch"]), rng.choice(keys), rng.choice(["add", "add", "remove", "other"]),
             DAY + dt.timedelta(rng.randint(0, 200))) for _ in range(n)]


def _captures(rng, n=150):
    urls_ = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{h}{rng.choice(['', '.', ':80'])}{p}"
             for h in HOSTS for p in ("", "/", "/p", "//p/q/r?x=http://b.org/", "/pp#a")]
    rows = [(i, rng.choice(urls_), DAY + dt.timedelta(rng.randint(0, 220))) for i in range(n)]
    return rows + [(900, None, DAY), (901, "no url", DAY), (902, "http://", DAY), (903, "http://a.com", None), (None, "http://b.org/", DAY),
                   (0, rows[0][1], rows[0][2])]


def _state(entries, name, key, at):
    """Since when the key is on the list at that time, by replaying its history."""
    since = None
    history = {(a, act) for n, k, act, a in entries if n == name and k.lower() == key and act in ("add", "remove")}
    for a, act in sorted(history):  # "add" sorts before "remove"
        if a <= at:
            removed = (a, "remove") in history
            since = None if removed else since if since is not None else a
    return since


def _verdict(entries, url, at):
    if url is None or at is None or "://" not in url or url.endswith("://"):
        return None
    rest = url.split("://", 1)[1]
    place = rest.split("#")[0].split("?")[0]
    host, *segments = place.split("/")
    host = host.split("@")[-1].split(":")[0].rstrip(".").lower()
    labels, segments = host.split("."), [s for s in segments if s]
    keys = [".".join(labels[i:]) for i in range(len(labels))] + \
        [host + "/" + "/".join(segments[:i]) for i in range(1, len(segments) + 1)]
    best = None
    for name in ("block", "allow", "watch"):
        for k in keys:
            since = _state(entries, name, k, at)
            if since is not None:
                best = max(best or (0,), (len(k), since, name == "allow", k, name))
    return best


def test_verdicts_by_replay(spark):
    rng = random.Random(6)
    entries, captures = _entries(rng), _captures(rng)
    e = spark.createDataFrame(entries + [(None, "a.com", "add", DAY), ("block", None, "add", DAY), ("block", "a.com", None, DAY),
                                         ("block", "a.com", "add", None), entries[0]],
                              "list string, key string, action string, at date")
    c = spark.createDataFrame([(*r, True) for r in captures], "page_id long, url string, fetched date, blocked boolean")
    valid = urls.intervals(e)
    found = {(r["id"], r["url"], r["fetched"]): r for r in urls.evaluate(c, valid).collect()}
    assert set(found) == set(captures) and len(found) == len(captures) - 1
    for (i, u, at), r in found.items():
        best = _verdict(entries, u, at)
        assert (r["key"], r["since"], r["list"]) == ((best[3], best[1], best[4]) if best else (None, None, None)), (u, at)
        assert r["blocked"] == bool(best and best[4] == "block")
    kept = urls.kept(c, valid)
    assert kept.columns == c.columns
    assert kept.count() == sum(not found[r]["blocked"] for r in captures)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "list string, key string, action string, at date")
    c = spark.createDataFrame([(1, "http://a.com", DAY)], "page_id long, url string, fetched date")
    assert [r["blocked"] for r in urls.evaluate(c, urls.intervals(e)).collect()] == [False]
    assert urls.evaluate(c.where("false"), urls.intervals(e)).count() == 0


def test_a_long_history_is_more_than_one_segment(spark, monkeypatch):
    n, read, write = 2_000, [], scan.shared_table

    def keep(df):
        written = write(df)
        read.append([r["count"] for r in written.groupBy(scan.SEG).count().collect()])
        return written

    monkeypatch.setattr(scan, "shared_table", keep)
    day = F.date_add(F.lit(DAY), F.col("id").cast("int"))
    action = F.when(F.col("id") % 2 == 0, "add").otherwise("remove")
    e = spark.range(2 * n + 1).select(F.lit("block").alias("list"), F.lit("a.com").alias("key"), action.alias("action"),
                                      day.alias("at"))
    found = urls.intervals(e).collect()
    assert sorted((r["since"], r["until"] or dt.date.max) for r in found) == [
        (DAY + dt.timedelta(2 * k), DAY + dt.timedelta(2 * k + 1) if k < n else dt.date.max) for k in range(n + 1)]
    assert len(read) == 2 and all(sum(rows) == 2 * n + 1 and max(rows) < 2 * n for rows in read)
