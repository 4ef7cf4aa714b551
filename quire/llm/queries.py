"""The queries of the training-data operators over the given tables.

Each applies its operator, with production parameters, to its whole table and
derives the result columns from the operator's output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (chat, codes, decontaminate, langid, lattice, mixing, periodic, quality, simhash, toxicity, urls, vectors,
                       warc)
from quire.llm.common import held_out, read, shared_path, shared_table
from quire.plans.barrier import with_computed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn
    return keep


@_query("op1_toxic_segments")
def toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    fold = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels, train=~fold)
    scored = docs.select("doc_id", fold.alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query("op2_qgram_decontamination")
def qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds; clean documents have no row."""
    indexes = decontaminate.blocks(read(spark, sf_dir, "benchmark"))
    found = decontaminate.leaks(read(spark, sf_dir, "documents"), indexes)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "edits", "budget", "place")


def _listed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures (with a fetch date from the id) and dated list entries (of the
    hosts that occur, by the lengths of their names): ``pages`` has neither."""
    captures = pages.select("page_id", "url", F.date_add(
        F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched"))
    hosts = captures.select(urls.host(F.col("url")).alias("host")).where("host <> ''").distinct() \
        .withColumn("n", F.length("host"))
    parent = F.substring_index("host", ".", -2)
    plan = [("block", F.col("host"), "add", F.col("n") * 7 % 180), ("block", F.col("host"), "remove", F.col("n") * 7 % 180 + 60),
            ("block", F.col("host"), "add", F.col("n") * 7 % 180 + 150), ("allow", F.concat("host", F.lit("/en")), "add", F.col("n") % 40),
            ("allow", F.concat("host", F.lit("/en")), "remove", F.col("n") % 40 + 200),
            ("block", parent, "add", F.lit(100)), ("block", parent, "remove", F.lit(130))]
    rows = F.array(*[F.struct(F.lit(a).alias("list"), k.alias("key"), F.lit(b).alias("action"),
                              F.date_add(F.lit("2024-01-01").cast("date"), d.cast("int")).alias("at"))
                     for a, k, b, d in plan])
    return captures, hosts.select(F.inline(rows))


@_query("op3_temporal_url_lists", r"""
WITH c AS (
  SELECT DISTINCT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INT) AS DATE) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
h AS (SELECT DISTINCT host, length(host) AS n, regexp_extract(host, '([^.]+\.)?[^.]+$') AS parent FROM c WHERE host <> ''),
v AS (
  SELECT 'block' AS list, host AS key, n * 7 % 180 AS a, n * 7 % 180 + 60 AS b FROM h
  UNION ALL SELECT 'block', host, n * 7 % 180 + 150, NULL FROM h
  UNION ALL SELECT 'allow', host || '/en', n % 40, n % 40 + 200 FROM h
  UNION ALL SELECT DISTINCT 'block', parent, 100, 130 FROM h WHERE parent NOT IN (SELECT host FROM h)),
i AS (
  SELECT list, key, CAST(DATE '2024-01-01' + CAST(a AS INT) AS DATE) AS since,
         CAST(DATE '2024-01-01' + CAST(b AS INT) AS DATE) AS until FROM v),
m AS (
  SELECT c.page_id, c.url, c.fetched, i.list, i.key, i.since,
         row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched
                            ORDER BY length(i.key) DESC, i.since DESC, (i.list = 'allow') DESC, i.key DESC, i.list DESC) AS r
  FROM c JOIN i ON i.since <= c.fetched AND (i.until IS NULL OR c.fetched < i.until)
   AND (c.host = i.key OR ends_with(c.host, '.' || i.key)
        OR starts_with(c.host || rtrim(regexp_replace(c.path, '/+', '/', 'g'), '/') || '/', i.key || '/')))
SELECT c.page_id, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(m.list = 'block', false) AS blocked, m.list, m.key,
       CAST(m.since AS VARCHAR) AS since
FROM c LEFT JOIN m ON m.page_id IS NOT DISTINCT FROM c.page_id AND m.url IS NOT DISTINCT FROM c.url
 AND m.fetched IS NOT DISTINCT FROM c.fetched AND m.r = 1
""")
def temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = _listed(read(spark, sf_dir, "pages"))
    found = urls.evaluate(captures, urls.intervals(entries))
    return found.select(F.col("id").alias("page_id"), F.col("fetched").cast("string"), "blocked", "list", "key",
                        F.col("since").cast("string"))


@_query("op4_byte_cnn_language")
def byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"), 4, 2)
    network = langid.fit(docs, train_rows=~fold)
    return (docs.select("doc_id", fold.alias("held_out"), langid.predict(network, F.col("text")).alias("p"))
            .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score"))


@_query("op5_pivot_range_join", """
WITH RECURSIVE u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
""")
def pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


@_query("op6_cotrained_quality")
def cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    fold = held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, labels, train=~fold)
    scored = docs.select("doc_id", fold.alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query("op7_lattice_lm_scoring")
def lattice_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = lattice.score_documents(docs, train=~held_out(F.col("doc_id"), 7, 2))
    return scored.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"),
                         "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op8_warc_salvage", """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
         list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
             (CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31
             AS INT), 1)), 'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
""")
def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(warc.planned(read(spark, sf_dir, "pages")), path)
    found = warc.read_back(spark, path, with_payload=False)
    return found.where(F.col("reason").isNull()).select(
        F.col("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        "record_type", "refers_to")


@_query("op9_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, bits=2)
    return found.select(F.col("id").alias("doc_id"),
                        simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@_query("op10_mixing_splitting_tree")
def mixing_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = shared_table(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    mixed = mixing.mix(sized, size_col="size", shards=16)
    return mixed.select("doc_id", "size", "mix.source_size", "mix.target", "mix.taken")


# Fixed value: what both turns of the added conversation say.
_CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _conversation_records(conversations: DataFrame) -> DataFrame:
    """``(conv_id, record)``: each conversation as a JSON record, in a layout that
    its roles and id choose: ``conversations`` itself has only one."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    added = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_CONTROL_TEXT).alias("text"))
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    whole = (own.unionByName(added).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")))
    roles = F.array_join("t.role", " ")
    plain = F.forall("t", lambda t: t["role"].isin("system", "user", "assistant"))
    even, third = F.pmod("conv_id", F.lit(2)) == 0, F.pmod("conv_id", F.lit(3))

    def said(i: int) -> Column:
        return F.col("t")[i]["text"]

    def items(role: str, text: str) -> Column:
        return F.transform("t", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text)))

    share = F.transform("t", lambda t: F.struct(
        F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"),
        t["text"].alias("value")))
    record = (
        F.when((roles == "user assistant") & even,
               F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("completion"))))
        .when((roles == "system user assistant") & even,
              F.to_json(F.struct(said(0).alias("system"), said(1).alias("instruction"), said(2).alias("output"))))
        .when((roles == "user assistant") & (third == 0),
              F.to_json(F.struct(said(0).alias("instruction"), said(1).alias("output"))))
        .when(plain & (third == 1), F.to_json(F.struct(F.col("conv_id").alias("id"), share.alias("conversations"))))
        .when(third == 2, F.to_json(F.struct(F.struct(items("speaker", "utterance").alias("dialogue")).alias("data"))))
        .otherwise(F.to_json(F.struct(items("role", "content").alias("messages")))))
    return whole.select("conv_id", record.alias("record"))


_ESCAPED = ("length(t) + length(t) - length(replace(t, chr(92), ''))" + "".join(
    f" + (length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in chat.Template().controls))


@_query("op11_chat_fingerprint", f"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS r, coalesce(text, '') AS t
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{_CONTROL_TEXT}'),
f AS (SELECT *, {_ESCAPED} AS body, {_ESCAPED.replace("(t)", "(r)").replace("(t,", "(r,")} AS head FROM c),
g AS (
  SELECT conv_id, string_agg(r, ' ' ORDER BY turn NULLS FIRST, r, t) AS roles, count(*) AS n_turns,
         bool_and(r IN ('system', 'user', 'assistant')) AS plain,
         string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t) AS said,
         coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '') AS loss,
         CAST(sum(head + body + {sum(map(len, (chat.Template().start, chat.Template().separator, chat.Template().end)))})
              AS BIGINT) AS formatted_chars
  FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars,
       CASE WHEN roles = 'user assistant' AND conv_id % 2 = 0 THEN 'prompt'
            WHEN roles = 'system user assistant' AND conv_id % 2 = 0 THEN 'instruction'
            WHEN roles = 'user assistant' AND conv_id % 3 = 0 THEN 'instruction'
            WHEN plain AND (conv_id % 3 + 3) % 3 = 1 THEN 'share'
            WHEN (conv_id % 3 + 3) % 3 = 2 THEN 'dialogue' ELSE 'messages' END AS layout
FROM g
""")
def chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _conversation_records(read(spark, sf_dir, "conversations"))
    made = shared_table(chat.format_turns(chat.canonical_turns(records, "conv_id", "record"))
                        .select("id", "layout", "formatted", "pieces"))
    back = with_computed(made, turns=chat.read_turns(F.col("formatted")), loss=chat.loss_text(F.col("pieces")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout")


def _with_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; about every tenth text goes on, from a word that its id
    chooses, with copies of the words that follow there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    wide = with_computed(docs.select("doc_id", "text"), h=h, words=F.when(h % 10 == 0, split))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    wide = with_computed(wide, n=n, a=F.when(n > 0, g % n), k=g % 8 + 3)
    wide = with_computed(wide, rest=F.col("n") - F.col("a"), p=F.floor((F.col("n") - F.col("a")) / F.col("k")) + 1)
    a, p, rest = (F.col(c).cast("int") for c in ("a", "p", "rest"))
    copies = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(rest / p).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(copies, F.lit(1), rest)), " ")
    return wide.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


@_query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_repeats(read(spark, sf_dir, "documents")))
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return with_computed(found, best=best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _codes_sql(rounds: int) -> str:
    """Assignment (``a``) and averaging (``b``) round by round, in double
    products that hold these integers exactly."""
    steps = ["""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, q, CAST(x[q * len(x) // 4 + 1 : (q + 1) * len(x) // 4] AS DOUBLE[]) AS v FROM k, range(4) AS r(q)),
b0 AS (
  SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS e, v FROM p
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT vec_id, p.q, any_value(p.label) AS label, any_value(p.v) AS v, CAST(min((list_inner_product(p.v, p.v)
         + list_inner_product(b.v, b.v) - 2 * list_inner_product(p.v, b.v)) * 256 + e) AS BIGINT) AS m
  FROM p JOIN b{i} b ON p.q = b.q GROUP BY vec_id, p.q)""")
        if i < rounds:
            steps.append(f"""
b{i + 1} AS (
  SELECT b.q, b.e, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN (
    SELECT q, e, list(c ORDER BY i) AS v FROM (
      SELECT q, e, i, floor(sum(c) / count(*)) AS c
      FROM (SELECT q, m % 256 AS e, unnest(v) AS c, unnest(range(len(v))) AS i FROM a{i}) GROUP BY q, e, i)
    GROUP BY q, e) n ON n.q = b.q AND n.e = b.e)""")
    steps.append(f"""
s AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m % 256), '' ORDER BY q) AS code,
         CAST(sum(m // 256) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id),
h AS (
  SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY q, e, i)) AS codebooks_sha256
  FROM (SELECT q, e, unnest(v) AS c, unnest(range(len(v))) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM s, h
""")
    return ",".join(steps[:1] + steps[1:])


@_query("op13_gnat_codes", _codes_sql(codes.ROUNDS))
def gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared_table(codes.integer_vectors(read(spark, sf_dir, "embeddings")))
    books = codes.train(rows)
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    digest = hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()
    return codes.with_label_error(codes.encode(rows, books)).select(
        F.col("id").alias("vec_id"), F.when(F.col("codes").isNotNull(), F.array_join(digits, "")).alias("code"), "error",
        "label_error", F.lit(digest).alias("codebooks_sha256"))
