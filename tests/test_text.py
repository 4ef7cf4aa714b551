"""Text functions and document operators (F6, F7, F11, F13, F14)."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import recommend, textops
from quire.sources.files import decode_fallback
from tests.conftest import rows


def one(spark, value, fn, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(fn(F.col(schema.split()[0]))).first()[0]


@pytest.mark.parametrize("text,expected", [
    ("Intro. Based on tests, the recommendations are: rest. Do X. Do Y! Schedule follow-up soon. More.",
     "Based on tests, the recommendations are: rest. Do X. Do Y!"),
    ("Plan follow-up. Based on A, recommendations are B. C.", "Based on A, recommendations are B. C."),
    ("Based on A, recommendations are a follow-up. C.", "Based on A, recommendations are a follow-up. C."),
    ("Nothing here.", None),
])
def test_passage(spark, text, expected):
    assert one(spark, text, textops.passage) == expected


def test_passages_filter(spark):
    d = spark.createDataFrame([(1, "Nothing."), (2, "Based on x, recommendations are y.")], "id int, text string")
    assert [r[0] for r in rows(textops.passages(d), "id")] == [2]


def test_headed_sections(spark):
    text = "preamble\n=== A ===\none\n=== B ===\n=== A ===\ntwo\n====\nlost"
    d = spark.createDataFrame([(1, text)], "id int, text string")
    out = textops.headed_sections(textops.text_lines(d, "id"), "id")
    assert rows(out, "section", "body") == [("A", "two")]


@pytest.mark.parametrize("n,chunks", [(0, 0), (4500, 1), (4501, 2)])
def test_chunk_counts(spark, n, chunks):
    assert len(one(spark, "é" * n, T.chunk_text)) == chunks


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60),
       st.integers(min_value=1, max_value=7))
def test_chunks_rejoin(spark, s, size):
    pieces = one(spark, s, lambda c: T.chunk_text(c, size))
    assert "".join(pieces) == s
    assert all(len(p) <= size for p in pieces)


def test_reassemble_with_translator(spark):
    d = spark.createDataFrame([(1, "abcdefg")], "id int, text string")
    ch = textops.fan_out_languages(d).select("id", "lang", F.posexplode(T.chunk_text("text", 3)).alias("pos", "chunk"))
    tr = textops.translate_chunks(ch, lambda cs, ls: [c.upper() for c in cs])
    assert rows(textops.reassemble(tr, ["id", "lang"]), "text") == [("ABC\nDEF\nG",)]


def test_translator_failure_marks_rows(spark):
    d = spark.createDataFrame([(1, "es", 0, "x")], "id int, lang string, pos int, chunk string")

    def boom(cs, ls):
        raise RuntimeError("down")
    assert rows(textops.translate_chunks(d, boom), "translated") == [("Error: down",)]


def test_paragraphs(spark):
    assert one(spark, "a\n\nb", T.paragraphs_html) == "<p>a</p><p></p><p>b</p>"


def test_token_windows(spark):
    r = spark.createDataFrame([(i, t) for i, t in enumerate([8000.0, 9000.0, 12000.0, 15000.0, 1000.0])],
                              "seq int, tokens double")
    out = textops.token_windows(r, ["seq"], F.col("tokens"))
    assert [x[1] for x in rows(out, "seq", "window_no")] == [0, 0, 1, 2, 2]


def test_title_case(spark):
    assert one(spark, "it's follow-up care", T.title_case) == "It'S Follow-Up Care"
    assert one(spark, "élan 2nd", T.title_case) == "élan 2nd".title()


@pytest.mark.parametrize("raw,clean", [
    (None, ""), ("a\x00b�c\nd\re\tf  ", "abc de\tf"), ("  x  ", "x")])
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, T.clean_text) == clean


def test_clean_cell_and_strip(spark):
    assert one(spark, "  \"'abc',  ", T.clean_cell) == "abc"
    assert one(spark, " x ", T.ws_trim) == "x"
    assert one(spark, "a<think>\nno\n</think>b<think>c</think>", T.strip_think) == "ab"


def test_between_markers(spark):
    assert one(spark, "x START a \n b END y END", lambda c: T.between_markers(c, "START", "END")) == "a \n b"
    assert one(spark, "x START", lambda c: T.between_markers(c, "START", "END")) is None
    assert one(spark, "END START", lambda c: T.between_markers(c, "START", "END")) is None


def test_provider_and_names(spark):
    assert one(spark, "Ada_1.json", T.provider_from_file) == "Ada"
    assert one(spark, "Ben notes.json", T.provider_from_file) == "Ben"
    assert one(spark, "Cy.json", T.provider_from_file) == "Cy"
    assert one(spark, "BASC-P1-2025-Mother.pdf", T.file_stem) == "BASC-P1-2025-Mother"
    assert one(spark, "BASC-P1-2025-Mother.pdf", T.short_title) == "BASC-P1"


def test_fenced_json_pick(spark):
    text = '```json\n{"$defs": {"a": 1}}\n``` ```json {broken} ``` ```json\n{"themes": []}\n```'
    assert one(spark, text, T.pick_fenced_json) == '{"themes": []}'
    assert one(spark, "no block", T.pick_fenced_json) is None


def test_charset_fallback(spark):
    df = spark.createDataFrame([(bytes([0x93, 0x61, 0x62, 0x94]),), ("é".encode(),)], "b binary")
    got = [r[0] for r in df.select(decode_fallback("b")).collect()]
    assert got == ["“ab”", "é"]


def test_theme_flatten_and_merge(spark):
    answers = spark.createDataFrame([
        ("f1.json", 'x ```json\n{"themes": [{"theme": "t", "count": 1, "sample_recommendations": [],'
                    ' "all_recommendations": [" a ", "b"]}]}\n```'),
        ("f2.json", '```json\n{"themes": {"theme": "t"}}\n```'),
        ("f3.json", "nothing")], "file string, text string")
    got = rows(recommend.flatten_themes(answers), "file", "idx", "recommendation")
    assert got == [("f1.json", 0, "a"), ("f1.json", 1, "b")]
    assert rows(recommend.answer_rejects(answers), "file", "reason") == [
        ("f2.json", "themes is not a list"), ("f3.json", "no valid JSON block without '$defs'")]
    themes = spark.createDataFrame(
        [(" Sleep ", 1, ["a"], ["a", "b"]), ("sleep", 2, ["c", "d", "e"], ["b", "c"])],
        "theme string, count int, sample_recommendations array<string>, all_recommendations array<string>")
    m = recommend.merge_themes(themes).first()
    assert (m["theme"], m["count"], m["sample_recommendations"], m["all_recommendations"]) == \
        ("Sleep", 3, ["a", "c", "d"], ["a", "b", "c"])


def test_lines_and_ranges(spark):
    assert one(spark, " a \n\n b\n", T.normalise_lines) == ["a", "b"]
    assert one(spark, "a\r\nb\rc\n", T.split_lines) == ["a", "b", "c"]
    df = spark.createDataFrame([("6 - 18",), ("7-9x",), ("few",)], "s string")
    lo, hi = T.range_bounds("s")
    got = [tuple(r) for r in df.select(T.is_range("s"), lo, hi).collect()]
    assert got == [(True, 6, 18), (True, 7, 9), (False, None, None)]


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=-50, max_value=50), st.integers(min_value=0, max_value=30))
def test_seeded_int_in_range(spark, lo, width):
    df = spark.range(50).select(T.seeded_int(F.lit(lo), F.lit(lo + width), "id", seed="x").alias("v"))
    vals = [r[0] for r in df.collect()]
    assert all(lo <= v <= lo + width for v in vals)


def _passage_rule(text, start=("based on", "recommendations are"), stop="follow-up"):
    """The passage rule written out in plain Python, for comparison."""
    import re
    out, on = [], False
    for s in re.split(r"(?<=[.!?]) +", text):
        low = s.lower()
        if not on:
            if all(p in low for p in start):
                on = True
                out.append(s)
        elif stop in low:
            break
        else:
            out.append(s)
    return " ".join(out).strip() if out else None


WORDS = ["Based on", "the", "recommendations are", "follow-up", "rest", "x", "Do", "é"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(WORDS), min_size=1, max_size=5),
                          st.sampled_from([".", "!", "?", ""]),
                          st.sampled_from([" ", "  ", ""])), min_size=1, max_size=8))
def test_passage_matches_rule(spark, parts):
    text = "".join(" ".join(ws) + p + gap for ws, p, gap in parts)
    assert one(spark, text, textops.passage) == _passage_rule(text)


def _sections_rule(text):
    """The headed-section rule written out in plain Python, for comparison."""
    import re
    head = re.compile(r"^=+\s*(.*?)\s*=+$")
    out, cur, buf = {}, None, []
    for line in text.splitlines():
        m = head.match(line)
        if m:
            if cur and buf:
                out[cur] = "\n".join(buf).strip()
                buf = []
            cur = m.group(1).strip()
        elif cur:
            buf.append(line)
    if cur and buf:
        out[cur] = "\n".join(buf).strip()
    return out


LINES = ["=== A ===", "== B ==", "====", "=== A===", "text", "", "  more  ", "x = y"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(LINES), min_size=0, max_size=12), st.booleans())
def test_headed_sections_match_rule(spark, lines, trailing):
    text = "\n".join(lines) + ("\n" if trailing else "")
    d = spark.createDataFrame([(1, text)], "id int, text string")
    got = dict(rows(textops.headed_sections(textops.text_lines(d, "id"), "id"), "section", "body"))
    assert got == _sections_rule(text)


def test_flatten_numbers_across_themes(spark):
    answers = spark.createDataFrame([
        ("f.json", '```json\n{"themes": [{"theme": "a", "count": 1, "sample_recommendations": [],'
                   ' "all_recommendations": ["x", "y"]}, {"theme": "b", "count": 1,'
                   ' "sample_recommendations": [], "all_recommendations": null},'
                   ' {"theme": "c", "count": 1, "sample_recommendations": [], "all_recommendations": ["z"]}]}\n```')],
        "file string, text string")
    got = rows(recommend.flatten_themes(answers), "idx", "theme", "recommendation")
    assert got == [(0, "a", "x"), (1, "a", "y"), (2, "c", "z")]
