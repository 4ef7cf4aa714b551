"""Chat formatting: records of many layouts to canonical turns to marked text.

A record is a JSON text.  Its nested field paths, hashed, are its fingerprint;
the fingerprint selects one of a list of declarative mappings, which reads the
record into canonical turns ``(role, text)``.  A template then marks the turns,
escapes control strings inside roles and texts, and says which characters the
loss covers.  Everything is built-in column functions.

Paths are taken from a skeleton of the record, with every string value emptied:
it is small however long the texts are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How to read one layout.

    Either ``items`` is the path of a list of messages with fields ``role`` and
    ``text`` (``aliases`` renames roles), or ``fields`` lists, for each turn, its
    role and the paths whose texts it joins by an empty line.  A path that ends
    in ``?`` may be absent; a turn whose paths are all absent is no turn.
    """
    name: str
    items: str = ""
    role: str = "role"
    text: str = "content"
    aliases: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def shapes(self) -> list[tuple[str, ...]]:
        """The sets of paths that records of this layout have."""
        if self.items:
            base = f"$.{self.items}[]"
            return [tuple(sorted((f"{base}.{self.role}", f"{base}.{self.text}"))), (base,)]
        paths = [p for _, own in self.fields for p in own]
        sure = [f"$.{p}" for p in paths if not p.endswith("?")]
        maybe = [f"$.{p[:-1]}" for p in paths if p.endswith("?")]
        return [tuple(sorted([*sure, *some])) for n in range(len(maybe) + 1) for some in combinations(maybe, n)]

    def turns(self, record: Column) -> Column:
        if self.items:
            item = StructType([StructField(self.role, StringType()), StructField(self.text, StringType())])
            read = _at(_read(record, {self.items: ArrayType(item)}), self.items)
            renamed = dict(self.aliases)

            def turn(m: Column) -> Column:
                role = m[self.role]
                for old, new in renamed.items():
                    role = F.when(m[self.role] == old, F.lit(new)).otherwise(role)
                return F.struct(F.coalesce(role, F.lit("")).alias("role"),
                                F.coalesce(m[self.text], F.lit("")).alias("text"))
            return F.transform(read, turn)
        paths = [p.rstrip("?") for _, own in self.fields for p in own]
        read = _read(record, {p: StringType() for p in paths})
        made = []
        for role, own in self.fields:
            # fields that must be there count as empty texts when null
            parts = [_at(read, p[:-1]) if p.endswith("?") else F.coalesce(_at(read, p), F.lit("")) for p in own]
            there = parts[0].isNotNull()
            for p in parts[1:]:
                there = there | p.isNotNull()
            made.append(F.when(there, F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *parts).alias("text"))))
        return F.filter(F.array(*made), lambda t: t.isNotNull())


def _nested(leaves: dict) -> StructType:
    """A struct type with the given types at dotted paths."""
    tops: dict[str, dict] = {}
    for path, kind in leaves.items():
        head, _, rest = path.partition(".")
        tops.setdefault(head, {})[rest] = kind
    return StructType([StructField(head, own[""] if "" in own else _nested(own)) for head, own in tops.items()])


def _read(record: Column, leaves: dict) -> Column:
    return F.from_json(record, _nested(leaves), {"maxStringLen": str(2**31 - 1)})  # Spark's limit: 20 million


def _at(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value[name]
    return value


# Layouts in common use (field names are those of the public formats).
MAPPINGS = (
    Mapping("messages", items="messages"),
    Mapping("share", items="conversations", role="from", text="value",
            aliases=(("human", "user"), ("gpt", "assistant"))),
    Mapping("dialogue", items="data.dialogue", role="speaker", text="utterance"),
    Mapping("instruction", fields=(("system", ("system?",)), ("user", ("instruction", "input?")),
                                   ("assistant", ("output",)))),
    Mapping("prompt", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
)


def skeleton(record: Column) -> Column:
    """The JSON text with all string values empty (and escapes out of the names)."""
    bare = F.replace(F.replace(record, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    return F.regexp_replace(bare, r'"([^"]*+)"(\s*+:)|"[^"]*+"', '"$1"$2')


# pieces of a schema text: a field's name, an empty object, brackets, a leaf's type
_PIECE = r"(?:`(?:[^`]|``)*`|\w+): |OBJECT<>|OBJECT<|ARRAY<|>|, |\w+(?:\(\d+,\d+\))?"


def field_paths(record: Column) -> Column:
    """Sorted paths of all leaves of a JSON text, such as ``$.messages[].role``;
    null where it isn't JSON.  Types don't matter, a null is a leaf."""
    schema = F.schema_of_variant(F.try_parse_json(skeleton(record)))
    pieces = F.regexp_extract_all(schema, F.lit(f"({_PIECE})"), 1)
    start = F.struct(F.array(F.lit("$")).alias("stack"), F.array().cast("array<string>").alias("paths"))

    def step(state: Column, piece: Column) -> Column:
        stack, paths = state["stack"], state["paths"]
        top = F.element_at(stack, -1)
        below = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        name = F.concat(top, F.lit("."), F.substring(piece, F.lit(1), F.length(piece) - 2))
        moved = (F.when(piece.endswith(": "), F.concat(stack, F.array(name)))
                 .when(piece == "ARRAY<", F.concat(stack, F.array(F.concat(top, F.lit("[]")))))
                 .when(piece.isin(">", ", "), below).otherwise(stack))
        leaf = ~(piece.isin("OBJECT<", "ARRAY<", ">", ", ") | piece.endswith(": "))
        return F.struct(moved.alias("stack"), F.when(leaf, F.concat(paths, F.array(top))).otherwise(paths).alias("paths"))

    return F.aggregate(pieces, start, step, lambda s: F.array_sort(F.array_distinct(s["paths"])))


def _digest(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def fingerprint(record: Column, mappings: Sequence[Mapping] = MAPPINGS) -> Column:
    """SHA-256 of the record's paths, of those that any mapping knows."""
    known = sorted({p for m in mappings for s in m.shapes() for p in s})
    return _digest(F.filter(field_paths(record), lambda p: p.isin(*known)))


def canonical_turns(records: DataFrame, id_col: str, record_col: str,
                    mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``(id, layout, turns)`` for every row of ``records``.

    ``turns`` is an array of ``(role, text)``; null roles and texts are empty
    ones, an empty list gives no turns.  Fields that no mapping knows are ignored.
    ``layout`` and ``turns`` are null for records that are null, no JSON, or have
    paths that select no mapping (the first mapping with such paths counts).
    Extra columns are ignored, repeated rows stay.
    """
    marked = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"),
                            fingerprint(F.col(record_col), mappings).alias("fingerprint"))
    layout, seen = F.lit(None).cast("string"), set()
    for m in mappings:
        shapes = [s for s in m.shapes() if s not in seen]
        seen.update(shapes)
        hit = F.col("fingerprint").isin(*[_digest(F.array(*[F.lit(p) for p in s])) for s in shapes])
        layout = F.when(layout.isNotNull(), layout).when(hit, F.lit(m.name))
    named = marked.select("id", "record", layout.alias("layout"))
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        turns = F.when(F.col("layout") == m.name, m.turns(F.col("record")).cast(TURNS)).otherwise(turns)
    return named.select("id", "layout", turns.alias("turns"))


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and the control strings that texts must not hold."""
    start: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_role: str = "assistant"

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.separator, self.end, *self.others)

    def escape(self, text: Column) -> Column:
        """Backslashes are doubled, and one goes behind the first character of
        every control string, overlapping ones too."""
        parts = [f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls]
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        return F.regexp_replace(doubled, "|".join(parts), r"$0\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(canonical: DataFrame, template: Template = Template()) -> DataFrame:
    """``canonical`` plus ``pieces`` and ``formatted``.

    A piece is a turn's marked text with the characters (code points) that the
    loss covers, ``loss_from`` counted from 0 within the piece; both are null
    for turns without loss.  ``formatted`` is the pieces' texts in order.  Null
    turns give nulls, no turns an empty text.
    """
    def piece(t: Column) -> Column:
        head = F.concat(F.lit(template.start), template.escape(t["role"]), F.lit(template.separator))
        body = template.escape(t["text"])
        loss = t["role"] == template.loss_role
        return F.struct(F.concat(head, body, F.lit(template.end)).alias("text"),
                        F.when(loss, F.length(head)).alias("loss_from"), F.when(loss, F.length(body)).alias("loss_chars"))

    pieces = canonical.withColumn("pieces", F.transform("turns", piece))
    return pieces.withColumn("formatted", F.when(F.col("pieces").isNotNull(), F.array_join("pieces.text", "")))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns that a formatted text marks, unescaped."""
    parts = F.filter(F.split(formatted, re.escape(template.end), -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        template.unescape(F.split_part(F.substring(p, F.lit(len(template.start) + 1), F.length(p)),
                                       F.lit(template.separator), F.lit(1))).alias("role"),
        template.unescape(F.split_part(p, F.lit(template.separator), F.lit(2))).alias("text")))


def loss_text(pieces: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order."""
    covered = F.filter(pieces, lambda p: p["loss_from"].isNotNull())
    return F.array_join(F.transform(covered, lambda p: template.unescape(
        F.substring(p["text"], p["loss_from"] + 1, p["loss_chars"]))), "")
