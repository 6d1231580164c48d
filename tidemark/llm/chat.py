"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record's layout is recognised by a hash of the nested field paths that it
fills. Each known fingerprint selects a declarative mapping that turns the
record into canonical turns, which a template then writes with markers,
reversible escapes and a loss mask over the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "struct<role:string,text:string>"
TURNS = f"array<{TURN}>"
END = " </turn>\n"
#: role -> what the template writes; other roles are written as @ and the escaped role
SHOWN = {"system": "System", "user": "User", "assistant": "Assistant"}

#: layout name -> (field paths it fills, turns); a turn is (role, path of the text), a list layout is (list path, role field, text field, renamed roles)
MAPPINGS = {
    "prompt_completion": (["prompt", "completion"], [("user", "prompt"), ("assistant", "completion")]),
    "prompt_response": (["prompt", "response"], [("user", "prompt"), ("assistant", "response")]),
    "instruction_output": (["instruction", "output"], [("user", "instruction"), ("assistant", "output")]),
    "instruction_input_output": (["instruction", "input", "output"], [("user", "instruction"), ("user", "input"), ("assistant", "output")]),
    "system_prompt_response": (["system", "prompt", "response"], [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "messages": (["messages.role", "messages.content"], ("messages", "role", "content", {})),
    "conversations": (["conversations.from", "conversations.value"], ("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    "nested_prompt": (["data.prompt", "data.completion"], [("user", "data.prompt"), ("assistant", "data.completion")]),
}


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Dotted paths of all leaves; a list adds no step of its own."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at)
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}".lstrip("."))]
    return [at]


def _quoted(path: str) -> str:
    return ".".join(f"`{p}`" for p in path.split("."))


def _filled(schema: T.DataType, col: Column, at: str = "") -> list[tuple[str, Column]]:
    """(path, whether the record fills it) for every leaf."""
    if isinstance(schema, T.StructType):
        return [x for f in schema.fields for x in _filled(f.dataType, col.getField(f.name), f"{at}.{f.name}".lstrip("."))]
    if isinstance(schema, T.ArrayType) and isinstance(schema.elementType, T.StructType):
        # a list of turns fills all fields of its elements, so one null text does not change the layout
        return [(p, col.isNotNull()) for p in field_paths(schema, at)]
    return [(at, col.isNotNull())]


def fingerprint(schema: T.StructType, record: str) -> Column:
    """Hash of the sorted nested field paths that a record fills."""
    paths = [F.when(there, F.lit(p)) for p, there in _filled(schema, F.col(record))]
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*paths))), "\n"))


def _turns(record: str, how) -> Column:
    if isinstance(how, tuple):
        items, role, text, renamed = how
        named = lambda x: F.coalesce(*[F.when(x == a, b) for a, b in renamed.items()], x, F.lit(""))
        turn = lambda x: F.struct(named(x.getField(role)).alias("role"), F.coalesce(x.getField(text), F.lit("")).alias("text"))
        return F.transform(F.col(f"{_quoted(record)}.{_quoted(items)}"), turn).cast(TURNS)
    return F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.col(f"{_quoted(record)}.{_quoted(p)}"), F.lit("")).alias("text")) for r, p in how]).cast(TURNS)


def canonical_turns(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """Adds ``layout`` and ``turns`` (array of role, text) to records of mixed layouts.

    ``record`` is a struct column with the fields of all layouts, those a row does not use being null. A
    layout whose fields the struct lacks can't occur and is left out. Rows of an unknown
    fingerprint keep their columns with null layout and turns, so nothing is
    dropped unseen; null texts become empty ones, empty lists give no turns.
    """
    schema = records.schema[record].dataType
    there = set(field_paths(schema))
    d = records.withColumn("_print", fingerprint(schema, record))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (paths, how) in mappings.items():
        if set(paths) <= there:
            fits = F.col("_print") == F.xxhash64(F.lit("\n".join(sorted(paths))))
            layout, turns = F.when(fits, name).otherwise(layout), F.when(fits, _turns(record, how)).otherwise(turns)
    return d.withColumn("layout", layout).withColumn("turns", turns).drop("_print")


def escape(text: Column) -> Column:
    """A backslash before every backslash, # and <, so that no marker can occur in a text."""
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _show_role(role: Column) -> Column:
    other = F.concat(F.lit("@"), F.regexp_replace(F.regexp_replace(escape(role), "%", "%25"), ":", "%3A"))
    return F.coalesce(*[F.when(role == a, b) for a, b in SHOWN.items()], other)


def _read_role(shown: Column) -> Column:
    other = unescape(F.regexp_replace(F.regexp_replace(F.substring(shown, 2, 2**31 - 1), "%3A", ":"), "%25", "%"))
    return F.coalesce(*[F.when(shown == b, a) for a, b in SHOWN.items()], other)


def format_turns(df: DataFrame, turns: str = "turns", target: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` (array of start, length in characters of ``formatted``).

    A turn is ``### Role: text </turn>`` and a line end. The mask covers the escaped text of each
    target turn and nothing else. Null or empty turns give an empty string and mask.
    """
    parts = F.transform(
        F.coalesce(F.col(turns), F.array().cast(TURNS)),
        lambda t: F.struct(F.concat(F.lit("### "), _show_role(F.coalesce(t["role"], F.lit(""))), F.lit(": ")).alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), (t["role"] == target).alias("loss")),
    )
    d = df.withColumn("_parts", parts)
    d = d.withColumn("formatted", F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc, p):
        body_at = acc["at"] + F.length(p["head"])
        span = F.struct(body_at.cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))
        spans = F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((body_at + F.length(p["body"]) + len(END)).cast("long").alias("at"), spans.alias("spans"))

    return d.withColumn("loss_mask", F.aggregate("_parts", start, step, lambda acc: acc["spans"])).drop("_parts")


def parse_formatted(formatted: Column) -> Column:
    """Inverse of ``format_turns``: array of (role, text)."""
    blocks = F.slice(F.split(formatted, END), 1, F.greatest(F.size(F.split(formatted, END)) - 1, F.lit(0)))
    return F.transform(
        blocks,
        lambda b: F.struct(_read_role(F.regexp_extract(b, r"(?s)^### ([^:]*): ", 1)).alias("role"), unescape(F.regexp_replace(b, r"(?s)^### [^:]*: ", "")).alias("text")),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under a loss mask."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """One ``messages`` record for each conversation of (conv_id, turn, role, text) rows.

    Turns go by number, nulls first; equal numbers by role and text. Null texts and roles are empty.
    A conversation is one record by definition; its rows are bounded by what one training text may hold.
    """
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return per.select("conv_id", F.struct(messages.alias("messages")).alias("record"))
