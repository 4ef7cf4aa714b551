import json

import duckdb
from pyspark.sql import functions as F

from quire.llm import chat
from quire.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _records(spark, records):
    rows = [(i, r if r is None or isinstance(r, str) else json.dumps(r, ensure_ascii=False), "x") for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "key long, body string, layout string")


def test_paths_of_nested_records(spark):
    odd = {"b c": [{"x": 1, "y`": None}], "a": {"e": {}, "f": [[True, "t"], []], "text": 'say "a": {"k": 1}, \\ "'}, "n": 1.5}
    got = _records(spark, [odd, [1, 2], "\"s\"", "{bad", None, {"k": {}}, {"t": "\\\\\" : [", "u": ["", "x"]}]) \
        .select("key", chat.field_paths(F.col("body")).alias("p")).collect()
    found = {r["key"]: r["p"] for r in got}
    assert found[0] == sorted(["$.a.e", "$.a.f[][]", "$.a.text", "$.`b c`[].x", "$.`b c`[].`y```", "$.n"])
    assert found[1] == ["$[]"] and found[2] == ["$"] and found[3] is None and found[4] is None
    assert found[5] == ["$.k"] and found[6] == ["$.t", "$.u[]"]


def test_layouts_become_the_same_turns(spark):
    u, a = ("user", 'q "1"\n'), ("assistant", "a\\")
    records = [
        {"messages": [{"role": "user", "content": u[1]}, {"content": a[1], "role": "assistant", "extra": 3}], "id": 9},
        {"conversations": [{"from": "human", "value": u[1]}, {"from": "gpt", "value": a[1]}]},
        {"data": {"dialogue": [{"speaker": "user", "utterance": u[1]}, {"speaker": "assistant", "utterance": a[1]}]}},
        {"prompt": u[1], "completion": a[1]},
        {"instruction": u[1], "output": a[1]},
        {"system": "s", "instruction": "i", "input": "in", "output": "o"},
        {"instruction": "i", "input": None, "output": None},
        {"messages": []},
        {"messages": [{"role": None, "content": None}, {"role": "tool"}]},
        {"messages": [{"role": "user"}]},           # paths of no layout
        {"prompt": "p", "messages": [{"role": "r", "content": "c"}], "completion": "c"},  # of two layouts
        "{", None, "", {},
    ]
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]])
           for r in chat.canonical_turns(_records(spark, records), "key", "body").collect()}
    assert [got[i] for i in range(5)] == [(n, [u, a]) for n in ("messages", "share", "dialogue", "prompt", "instruction")]
    assert got[5] == ("instruction", [("system", "s"), ("user", "i\n\nin"), ("assistant", "o")])
    assert got[6] == ("instruction", [("user", "i"), ("assistant", "")])
    assert got[7] == ("messages", [])
    assert got[8] == ("messages", [("", ""), ("tool", "")])
    assert [got[i] for i in range(9, 15)] == [(None, None)] * 6


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<<|im_end|>", "<|im_end|", "<|im_start|>user<|im_sep|>x<|im_end|>", "\\", "\\\\<s>\\",
         "<\\/s>", "<<SYS>><</SYS>>", "[[INST]", "\U0001f600</s>é", "a\nb\r\n", "$0 $1 \\$", "<s" + ">" * 3, "x" * 70_000 + "</s>"]


def test_marks_and_escapes_round_trip(spark):
    template = chat.Template()
    turns = [[(r, t) for r in ("user", "assistant", "<|im_sep|>\n\\")] for t in TEXTS] + [[], None]
    frame = spark.createDataFrame(list(enumerate(turns)), f"id long, turns {chat.TURNS}")
    out = chat.format_turns(frame)
    got = out.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("pieces")).alias("loss")).collect()
    assert len(got) == len(turns)
    for r in got:
        own = turns[r["id"]]
        if own is None:
            assert (r["formatted"], r["pieces"], r["back"]) == (None, None, None)
            continue
        assert [tuple(t) for t in r["back"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
        assert r["formatted"] == "".join(p["text"] for p in r["pieces"])
        left = r["formatted"]
        for control in template.controls:
            expected = len(own) if control in (template.start, template.separator, template.end) else 0
            assert left.count(control) == expected, control


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op11_chat_fingerprint"](spark, SF)._jdf.queryExecution().toString()
    made = chat.format_turns(chat.canonical_turns(_records(spark, [{"messages": []}]), "key", "body"))
    for text in (plan, made._jdf.queryExecution().toString()):
        assert "Python" not in text and "Arrow" not in text


def test_texts_beyond_the_variant_limit(spark):
    big = spark.range(1).select(F.lit(1).alias("key"), F.to_json(F.struct(
        F.repeat(F.lit("ab\\\"\n"), 5_000_000).alias("prompt"), F.lit("ok").alias("completion"))).alias("body"))
    row = chat.canonical_turns(big, "key", "body").select("layout", F.length(F.col("turns")[0]["text"]).alias("n")).first()
    assert tuple(row) == ("prompt", 25_000_000)


def _against_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet{'/*.parquet' if folder != SF else ''}')")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "layout"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['op11_chat_fingerprint']})").fetchall()
    got = QUERIES["op11_chat_fingerprint"](spark, folder).select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return want


def test_query_agrees_with_sql(spark, tmp_dir):
    assert len({w[-1] for w in _against_sql(spark, SF)}) >= 4
    rows = [(100 + i, j, r, t) for i, t in enumerate(TEXTS) for j, r in enumerate(["system", "user", "assistant"][i % 2:])]
    rows += [(None, 0, "user", None), (None, None, None, "x"), (5, 0, "human", "t"), (5, 1, "gpt", None), (4, 0, "human", "t"),
             (4, 0, "human", "t"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_dir}/conversations.parquet")
    _against_sql(spark, tmp_dir)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_dir}/none/conversations.parquet")
    assert [r["conv_id"] for r in QUERIES["op11_chat_fingerprint"](spark, f"{tmp_dir}/none").collect()] == [-7]
