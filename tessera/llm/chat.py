"""Chat formatting by schema fingerprint.

A record's nested field names (arrays as one level, types left out) are written
as a canonical tree; the hash of the tree selects a declarative mapping, which
says where the turns are and what its names for the roles mean.  A tree that no
mapping has is looked up once more without the fields that say nothing of
the turns (``EXTRAS``: ids, sources, metadata of any depth), in record and mapping alike.
The trees of the records come from Spark's schema_of_variant, those of the mappings from
their field paths, and all conversion is done by variant expressions.

Results in odd cases
  * null or empty text, or text that isn't JSON (also JSON beyond the 128 MB that a variant holds): one row
    with layout 'invalid', turn and role null, and the record as its text.
  * a tree that no mapping has (also an empty list of turns): one row with layout 'unknown', and the record as its text.
  * a null field of a known layout: a turn with null text in lists, no turn in flat layouts.  An empty field that
    is joined to another adds nothing.
  * an unknown role: kept, in lower case; a null role stays null.
  * repeated rows: each gives its turns.  An empty table: an empty result.
  * very long texts: whole.  Further columns are not read.
  * ``records``: rows of a null conv_id are a record each; 512 turn numbers of a conversation are a record.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
_TURN = "array<struct<role:string,text:string>>"
#: Turn numbers of a conversation that ``records`` puts into one record.
SPAN = 512


@dataclass(frozen=True)
class Mapping:
    """Turns in fields of their own (role, then the paths that are joined to its text), and in a list (``turns``: its path, with names of the role's and the text's field) after them."""

    layout: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, ...], ...] = ()
    roles: dict[str, str] = field(default_factory=lambda: _ROLES)


_SHARED = ("conversations[].from", "conversations[].value")
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Mapping("from_value", _SHARED, "conversations", "from", "value"),
    Mapping("system_from_value", ("system", *_SHARED), "conversations", "from", "value", (("system", "system"),)),
    Mapping("speaker", ("dialog.turns[].speaker", "dialog.turns[].utterance", "dialog.lang"), "dialog.turns", "speaker", "utterance"),
    Mapping("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), fields=(("user", "instruction", "input"), ("assistant", "output"))),
    Mapping("system_instruction", ("system", "instruction", "output"), fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt_completion", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt", ("prompt",), fields=(("user", "prompt"),)),
)

#: Fields that a record may have beside those of its layout.
EXTRAS = ("category", "created_at", "id", "idx", "index", "lang", "language", "meta", "metadata", "model", "name", "score", "source", "tags", "timestamp", "tool_calls", "tools", "url", "weight")


def tree(paths: tuple[str, ...]) -> str:
    """The canonical tree of field paths, as normalised() writes a record's."""
    root: dict = {}
    for p in paths:
        at = root
        for name in p.replace("[]", ".[]").split("."):
            at = at.setdefault(name, {})

    def show(node: dict) -> str:
        if "[]" in node:
            return "ARRAY<" + (show(node["[]"]) or "") + ">"
        if not node:
            return ""
        return "OBJECT<" + ", ".join(k + (": " + s if (s := show(v)) else "") for k, v in sorted(node.items())) + ">"

    return show(root)


def normalised(schema: Column) -> Column:
    """A schema_of_variant without the types of its leaves."""
    return F.regexp_replace(schema, r": (?:(?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9, ]*\))?)(?=[,>])", "")


def _nested(depth: int) -> str:
    return "[^<>]*+" if not depth else "(?:[^<>]++|<" + _nested(depth - 1) + ">)*+"


#: A further field with whatever it holds, and the comma that it leaves behind.
_EXTRA = "(?<=[< ])(?:" + "|".join(EXTRAS) + ")(?:: (?:OBJECT|ARRAY)<" + _nested(6) + ">)?(?=[,>])"
_COMMAS = "(?<=<)(?:, )+|(?:, )+(?=>)|(?:, )+(?=, )"


def without_extras(shape: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(shape, _EXTRA, ""), _COMMAS, "")


def _layouts(trees: dict[str, str]) -> Column:
    return F.create_map(*[x for t, layout in trees.items() for x in (F.xxhash64(F.lit(t)), F.lit(layout))])


def layout_of(shape: Column, mappings: tuple[Mapping, ...]) -> Column:
    """The layout whose fingerprint the tree has, or has without further fields; null if there is none."""
    whole = {tree(m.paths): m.layout for m in reversed(mappings)}
    bare = {re.sub(_COMMAS, "", re.sub(_EXTRA, "", t)): layout for t, layout in whole.items()}
    return F.coalesce(F.try_element_at(_layouts(whole), F.xxhash64(shape)), F.try_element_at(_layouts(bare), F.xxhash64(without_extras(shape))))


def _named(role: Column, roles: dict[str, str]) -> Column:
    low = F.lower(role)
    return F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in sorted(roles.items())], low)


def _turns(v: Column, m: Mapping) -> Column:
    get = lambda x, p: F.try_variant_get(x, "$." + p, "string")
    joined = lambda ps: get(v, ps[0]) if len(ps) == 1 else F.when(F.coalesce(*[get(v, p) for p in ps]).isNotNull(), F.array_join(F.filter(F.array(*[get(v, p) for p in ps]), lambda x: x != ""), "\n\n"))
    each = F.filter(F.array(*[F.struct(F.lit(role).alias("role"), joined(ps).alias("text")) for role, *ps in m.fields]), lambda x: x["text"].isNotNull()) if m.fields else F.array()
    if not m.turns:
        return each.cast(_TURN)
    listed = F.transform(F.try_variant_get(v, "$." + m.turns, "array<variant>"), lambda x: F.struct(_named(get(x, m.role), m.roles).alias("role"), get(x, m.text).alias("text")))
    return F.concat(each.cast(_TURN), listed.cast(_TURN)) if m.fields else listed.cast(_TURN)


def turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, layout, turn, role, text) from (conv_id, record): record is JSON text of any layout."""
    parsed = records.select("conv_id", "record", F.try_parse_json("record").alias("v"))
    found = F.coalesce(F.when(F.col("v").isNull(), "invalid"), layout_of(normalised(F.schema_of_variant("v")), mappings), F.lit("unknown"))
    known = parsed.withColumn("layout", found)
    lists = F.coalesce(*[F.when(F.col("layout") == m.layout, _turns(F.col("v"), m)) for m in mappings])
    rows = known.select("conv_id", "layout", F.when(F.col("layout").isin("invalid", "unknown"), F.col("record")).alias("record"), lists.alias("list"))
    each = rows.select("conv_id", "layout", "record", F.posexplode_outer("list").alias("turn", "x"))
    return each.select("conv_id", "layout", F.col("turn").cast("long").alias("turn"), F.col("x.role").alias("role"), F.coalesce("x.text", "record").alias("text"))


def records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation as JSON in one of the layouts that can express it, chosen by conv_id."""
    turn = F.struct("turn", "role", "text")
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    named = conversations.withColumn("conv_id", F.col("conv_id").cast("long")).select("conv_id", "turn", "role", "text", alone.alias("alone"), F.floor(F.col("turn") / SPAN).alias("span"))
    rows = named.groupBy("conv_id", "alone", "span").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    shape = F.concat_ws(",", F.transform("t", lambda x: F.coalesce(x["role"], F.lit("?"))))
    full = {"ignoreNullFields": "false"}
    text = lambda i: F.get("t", F.lit(i))["text"]
    other = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    number = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(10))
    kind, more = number % 5, number >= 5
    listed = {
        0: (F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"),),
        1: (F.transform("t", lambda x: F.struct(F.coalesce(F.try_element_at(other, x["role"]), x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"),),
        2: (F.struct(F.lit("xx").alias("lang"), F.transform("t", lambda x: F.struct(F.initcap(x["role"]).alias("speaker"), x["text"].alias("utterance"))).alias("turns")).alias("dialog"),),
    }
    meta = (F.col("conv_id").alias("id"), F.struct(F.array(F.struct(F.lit("made").alias("how"))).alias("steps")).alias("metadata"))
    as_list = {k: F.when(more, F.to_json(F.struct(*meta, *fields), full)).otherwise(F.to_json(F.struct(*fields), full)) for k, fields in listed.items()}
    any_list = F.when(kind == 0, as_list[0]).when(kind == 1, as_list[1]).otherwise(as_list[2])
    flat = lambda **fields: F.to_json(F.struct(*[x.alias(k) for k, x in fields.items()]))
    pair = F.when(kind >= 2, flat(prompt=text(0), completion=text(1))).when(more, flat(instruction=text(0), input=F.lit(""), output=text(1))).otherwise(flat(instruction=text(0), output=text(1)))
    record = F.when(F.exists("t", lambda x: x["text"].isNull()) | (kind == 4), any_list).when(shape == "user,assistant", pair).when(shape == "system,user,assistant", flat(system=text(0), instruction=text(1), output=text(2))).when(shape == "user", flat(prompt=text(0))).otherwise(any_list)
    return rows.select("conv_id", record.alias("record"))


SQL = f"""
WITH r AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, role, text, turn AS place, turn // {SPAN} AS span, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, pmod(coalesce(conv_id, 0), 10) AS number FROM conversations),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone, span ORDER BY place NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS turn FROM r),
x AS (SELECT *, string_agg(coalesce(role, '?'), ',') OVER (PARTITION BY conv_id, alone, span ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS shape,
    bool_or(text IS NULL) OVER (PARTITION BY conv_id, alone, span) AS gap, CASE number % 5 WHEN 0 THEN 'messages' WHEN 1 THEN 'from_value' ELSE 'speaker' END AS listed FROM w)
SELECT conv_id, turn, role, text,
  CASE WHEN gap OR number % 5 = 4 THEN listed WHEN shape = 'user,assistant' THEN CASE WHEN number % 5 >= 2 THEN 'prompt_completion' WHEN number >= 5 THEN 'instruction_input' ELSE 'instruction' END
    WHEN shape = 'system,user,assistant' THEN 'system_instruction' WHEN shape = 'user' THEN 'prompt' ELSE listed END AS layout
FROM x
""".replace("pmod(coalesce(conv_id, 0), 10)", "(coalesce(conv_id, 0) % 10 + 10) % 10")
