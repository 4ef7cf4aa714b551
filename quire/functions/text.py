"""Column functions for text: markers, dates, labels, cleaning, chunks, HTML.

Every function maps Columns to a Column and stays inside whole-stage
codegen (built-in expressions only, no Python per row).  Python's ``strip``,
``split`` and ``\\s`` treat Unicode blanks as blanks, so patterns use the
``(?U)`` flag and :func:`ws_trim` replaces Spark's space-only ``trim``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for equal results --------------
# Labels that end the relationship value in a score-report header.
RATER_FIELD_STOPS = ["Age:", "Gender:", "Birth Date:", "Language:", "School:"]
# Form-type markers and the relationship label each one selects.
PARENT_FORM_MARK = "Parent Rating Scales"
TEACHER_FORM_MARK = "Teacher Rating Scales"
PARENT_RATER_LABEL = "Relationship"
TEACHER_RATER_LABEL = "Rater Position"
# Score-block markers, tried in this order.
SCORE_MARKERS = ["General Combined", "Clinical Combined"]
# Severity thresholds: adaptive scales are reverse scored.
ADAPTIVE_SIGNIFICANT_MAX = 30
ADAPTIVE_AT_RISK_MAX = 40
CLINICAL_SIGNIFICANT_MIN = 70
CLINICAL_AT_RISK_MIN = 60
# Default chunk length for translation.
CHUNK_CHARS = 4500
# -----------------------------------------------------------------------------

_C = Column | str


def _col(c: _C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote_regex(s: str) -> str:
    """Literal regex for ``s`` (Java ``\\Q..\\E`` with embedded ``\\E`` handled)."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


# Python's whitespace (``str.isspace``), derived from the interpreter.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def ws_trim(c: _C) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends
    (``btrim`` with the whitespace set: codegen, no regex)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def non_blank(c: _C) -> Column:
    """Truthiness of an optional string: not null and not empty."""
    c = _col(c)
    return c.isNotNull() & (c != "")


# SCL1 ------------------------------------------------------------------------
def once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it
    (Spark would compute it anew at every place inside a conditional)."""
    return F.get(F.transform(F.array(value), use), 0)


def between_markers(text: _C, start: str, end: str) -> Column:
    """Shortest span after the first ``start`` up to the next ``end`` (across
    lines), stripped; NULL when the markers do not occur in that order."""
    # Plain substring search: the first ``start``, then the first ``end``
    # after it, which is what the lazy regex ``start(.*?)end`` finds.
    at = F.instr(_col(text), start)
    rest = once(F.struct(_col(text).alias("t"), at.alias("a")), lambda x: F.when(
        x["a"] > 0, x["t"].substr(x["a"] + F.lit(len(start)), F.lit(1 << 30))))
    return once(once(rest, lambda r: F.struct(r.alias("r"), F.instr(r, end).alias("b"))),
                lambda x: F.when(x["b"] > 0, ws_trim(x["r"].substr(F.lit(1), x["b"] - 1))))


# SCL2, SCL3, SCL5 --------------------------------------------------------------
def test_date(text: _C) -> Column:
    """First ``Test Date: m/d/yyyy``; ``Unknown`` when absent."""
    d = F.regexp_extract(_col(text), r"(?U)Test Date:\s*(\d{1,2}/\d{1,2}/\d{4})", 1)
    return once(d, lambda x: F.when(x != "", x).otherwise(F.lit("Unknown")))


def rater_type(text: _C) -> Column:
    """Which relationship label the form uses (parent form first)."""
    t = _col(text)
    return (F.when(t.contains(PARENT_FORM_MARK), F.lit(PARENT_RATER_LABEL))
            .when(t.contains(TEACHER_FORM_MARK), F.lit(TEACHER_RATER_LABEL))
            .otherwise(F.lit(PARENT_RATER_LABEL)))


def _relationship_for(t: Column, label: str) -> Column:
    stops = "|".join(quote_regex(s) for s in RATER_FIELD_STOPS)
    pat = f"(?sU){quote_regex(label)}:\\s*(.*?)\\s*(?={stops}|$)"
    # no match gives an empty text, and so does an empty value
    return once(ws_trim(F.regexp_extract(t, pat, 1)), lambda v: F.when(v != "", v).otherwise(F.lit("Unknown")))


def rater_relationship(text: _C) -> Column:
    """Text after the form's relationship label up to the next known label."""
    t = _col(text)
    return (F.when(t.contains(PARENT_FORM_MARK), _relationship_for(t, PARENT_RATER_LABEL))
            .when(t.contains(TEACHER_FORM_MARK), _relationship_for(t, TEACHER_RATER_LABEL))
            .otherwise(_relationship_for(t, PARENT_RATER_LABEL)))


def rater_label(date: _C, relationship: _C) -> Column:
    return F.concat(_col(date), F.lit(", ("), _col(relationship), F.lit(")"))


# SCL4 ------------------------------------------------------------------------
def number_run(text: _C, markers: list[str] | None = None) -> Column:
    """Whitespace-split run of digits after the first marker found; NULL if none."""
    t = _col(text)
    # a match always captures at least one character, so '' means no match
    runs = [once(F.regexp_extract(t, "(?U)" + quote_regex(m) + r"\s+([\d\s]+)", 1), lambda x: F.when(x != "", x))
            for m in (markers or SCORE_MARKERS)]
    return F.split(ws_trim(F.coalesce(*runs)), r"(?U)\s+")


# SCL6 ------------------------------------------------------------------------
def title_case(c: _C) -> Column:
    """Python ``str.title()``: upper after any uncased character, else lower."""
    chars = F.regexp_extract_all(_col(c), F.lit("(?s)."), 0)
    cased = "[\\p{Lu}\\p{Ll}\\p{Lt}]"
    # pair every character with the one before it (no outer array inside
    # the lambda, which would be re-evaluated per character)
    prev = F.concat(F.array(F.lit("")), F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))))

    def step(ch, before):
        return F.when(before.rlike(cased), F.lower(ch)).otherwise(F.upper(ch))

    return F.when(_col(c).isNotNull(), F.array_join(F.zip_with(chars, prev, step), ""))


# SCL7 ------------------------------------------------------------------------
def provider_from_file(name: _C) -> Column:
    """Drop ``.json``; text before the first ``_`` if any, else before the first blank."""
    base = F.replace(_col(name), F.lit(".json"), F.lit(""))
    return F.when(base.contains("_"), F.substring_index(base, "_", 1)) \
        .otherwise(F.substring_index(base, " ", 1))


# SCL8, SCL9, SCL11 -----------------------------------------------------------
def clean_text(c: _C) -> Column:
    """NULL -> '', drop NUL and U+FFFD, newline -> blank, drop other control
    characters except tab, strip."""
    t = F.coalesce(_col(c), F.lit(""))
    t = F.regexp_replace(t, "[\\x00\\x{FFFD}]", "")
    t = F.regexp_replace(t, "\n", " ")
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0A-\\x1F]", "")
    return ws_trim(t)


def clean_cell(c: _C) -> Column:
    """Spreadsheet cell: strip, drop leading quotes, drop trailing quotes,
    commas and blanks; NULL stays NULL."""
    t = ws_trim(_col(c))
    t = F.ltrim(t, F.lit("'\""))
    return F.rtrim(t, F.lit("'\"," + WHITESPACE))


def strip_tagged(c: _C, tag: str) -> Column:
    """Delete every ``<tag>...</tag>`` span (shortest, across lines)."""
    t = quote_regex(tag)
    return F.regexp_replace(_col(c), f"(?s)<{t}>.*?</{t}>", "")


def strip_think(c: _C) -> Column:
    """Delete model reasoning spans ``<think>...</think>``."""
    return strip_tagged(c, "think")


# SCL10 -----------------------------------------------------------------------
def split_sentences(c: _C) -> Column:
    """Split at blanks that follow ``.``, ``!`` or ``?``."""
    return F.split(_col(c), "(?<=[.!?]) +")


# SCL12 -----------------------------------------------------------------------
FENCED_JSON = "(?s)```json\\s*(\\{.*?\\})\\s*```"


def fenced_json_blocks(c: _C) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(FENCED_JSON), 1)


def pick_fenced_json(c: _C, forbidden_key: str = "$defs") -> Column:
    """First fenced ``json`` block that parses and lacks ``forbidden_key``;
    NULL when none does."""
    good = F.filter(
        fenced_json_blocks(c),
        lambda b: F.try_parse_json(b).isNotNull()
        & ~F.coalesce(F.array_contains(F.json_object_keys(b), F.lit(forbidden_key)),
                      F.lit(False)))
    return F.get(good, 0)


# SCL13 - SCL15, SCL17 --------------------------------------------------------
def chunk_text(c: _C, size: int = CHUNK_CHARS) -> Column:
    """Pieces of ``size`` characters (code points), order kept; '' -> []."""
    t = _col(c)
    return F.coalesce(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), F.array().cast("array<string>"))


def html_escape(c: _C) -> Column:
    t = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def paragraphs_html(c: _C, escape: bool = False) -> Column:
    """Each line wrapped in ``<p>..</p>``, concatenated."""
    lines = F.split(_col(c), "\n")
    wrap = (lambda x: F.concat(F.lit("<p>"), html_escape(x), F.lit("</p>"))) if escape \
        else (lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    return F.array_join(F.transform(lines, wrap), "")


def html_page(title: _C, body: _C) -> Column:
    """A minimal standalone HTML page with a heading."""
    return F.format_string(
        "<!DOCTYPE html><html><head><meta charset=\"UTF-8\"><title>%s</title></head>"
        "<body><h1>%s</h1>%s</body></html>", _col(title), _col(title), _col(body))


LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def split_lines(c: _C) -> Column:
    """Python ``str.splitlines()``: every line terminator, no trailing empty line."""
    t = _col(c)
    parts = F.split(t, LINE_BREAK)
    ends_with_break = t.rlike("(" + LINE_BREAK + ")\\z")
    return (F.when(t == "", F.array().cast("array<string>"))
            .when(ends_with_break, F.slice(parts, 1, F.size(parts) - 1))
            .otherwise(parts))


def normalise_lines(c: _C) -> Column:
    """Lines stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(_col(c), "\n"), ws_trim), lambda x: x != "")


# SCL18, SCL20 - SCL22 --------------------------------------------------------
INT_TEXT = r"(?U)^\s*[+-]?\d+\s*$"


def as_int(c: _C) -> Column:
    """Python ``int(str)``: an optionally signed digit run with blanks around."""
    t = _col(c)
    return F.when(t.rlike(INT_TEXT), ws_trim(t).try_cast("int"))


def severity_band(value: _C, adaptive: _C) -> Column:
    """``significant`` / ``at risk`` / NULL; adaptive scales are reverse scored."""
    v = as_int(value)
    a = _col(adaptive)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(a & (v <= ADAPTIVE_SIGNIFICANT_MAX), F.lit("significant"))
            .when(a & (v <= ADAPTIVE_AT_RISK_MAX), F.lit("at risk"))
            .when(~a & (v >= CLINICAL_SIGNIFICANT_MIN), F.lit("significant"))
            .when(~a & (v >= CLINICAL_AT_RISK_MIN), F.lit("at risk")))


def is_adaptive_scale(scale: _C, adaptive_name: str = "Adaptive Skills") -> Column:
    return _col(scale) == F.lit(adaptive_name)


def score_display(value: _C, adaptive: _C, missing: str = "n/a") -> Column:
    v = _col(value)
    return F.when(v.isNull() | (v == missing), F.lit(missing)) \
        .otherwise(F.concat(v, F.when(_col(adaptive), F.lit("*")).otherwise(F.lit(""))))


def numeric_score(c: _C) -> Column:
    """Digits-only value as int, anything else NULL (a gap in a profile)."""
    t = ws_trim(_col(c))
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))


# SCL23, SCL24, SCL29 ---------------------------------------------------------
RANGE_TEXT = r"(?U)^\d+\s*-\s*\d+"


def is_range(c: _C) -> Column:
    return F.coalesce(_col(c).rlike(RANGE_TEXT), F.lit(False))


def range_bounds(c: _C) -> tuple[Column, Column]:
    nums = F.regexp_extract_all(_col(c), F.lit(r"(?U)\d+"), 0)
    return F.get(nums, 0).try_cast("int"), F.get(nums, 1).try_cast("int")


def rescale(count: _C, total_from_config: _C, total: _C) -> Column:
    """``round(count / config_total * total)`` with half-to-even rounding."""
    pct = _col(count).cast("double") / _col(total_from_config).cast("double")
    return F.bround(pct * _col(total).cast("double"), 0).cast("long")


def seeded_unit_hash(*parts: _C, seed: str = "0") -> Column:
    """Deterministic 32-bit integer from md5 of the parts (stable across engines)."""
    key = F.concat_ws("|", *[_col(p).cast("string") for p in parts], F.lit(seed))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def seeded_int(lo: _C, hi: _C, *parts: _C, seed: str = "0") -> Column:
    """Uniform integer in ``[lo, hi]`` from a hash of ``parts`` and ``seed``."""
    lo_c, hi_c = _col(lo).cast("long"), _col(hi).cast("long")
    return lo_c + F.pmod(seeded_unit_hash(*parts, seed=seed), hi_c - lo_c + 1)


# SCL27, SCL28 ----------------------------------------------------------------
def file_stem(c: _C) -> Column:
    """Name without its last extension; leading dots do not start one."""
    base = F.regexp_replace(_col(c), "^.*/", "")
    return F.regexp_replace(base, "(?<=[^.])\\.[^./]*$", "")


def file_name(c: _C) -> Column:
    return F.regexp_replace(_col(c), "^.*/", "")


def short_title(c: _C) -> Column:
    """First two ``-`` separated parts."""
    return F.substring_index(_col(c), "-", 2)
