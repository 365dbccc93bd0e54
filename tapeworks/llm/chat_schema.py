"""Chat records of mixed layouts, brought into one form by the fingerprint of their schema.

A record is a JSON text. Its fingerprint is the hash of its nested field paths with the
value types taken out, so all records of one layout share it, whatever they say. A
layout is declared by an example of each shape it may take and by the place of its
turns; the fingerprints of the examples select the layout. No rule looks at field
values, and a shape that nobody declared is reported, not guessed.

Formatted text: ``### role: text</turn>\\n`` per turn. Inside roles and texts the
characters ``\\``, ``<``, ``#`` and ``:`` become a backslash and a letter, so control
strings cannot occur there and the text can be read back exactly.

The loss mask has an entry per turn: how many characters of the turn to skip and how
many to take. Assistant turns take their text, others nothing.

All of it is DataFrame functions: ``schema_of_variant``, ``variant_get`` and array
expressions inside one row. A conversation is one training example and so one row.

Defined cases: a null or empty text is an empty turn; a null role is the role "";
repeated turn numbers are ordered by role and text; malformed JSON and undeclared
shapes give layout null and no turns; a record without turns formats to "". A null
conversation id is a conversation of its own.
"""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "</turn>\n"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``items``: path of the list of turns with its role and text field; or ``fields``: (role, path) of single turns."""

    name: str
    examples: tuple
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()  # renamed roles


LAYOUTS = (
    Layout("messages", ({"messages": [{"role": "r", "content": "t"}]}, {"messages": []}),
           items=("$.messages", "$.role", "$.content")),
    Layout("from_value", ({"conversations": [{"from": "r", "value": "t"}]},),
           items=("$.conversations", "$.from", "$.value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", ({"prompt": "t", "completion": "t"},), fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("instruction", ({"system": "t", "instruction": {"text": "t"}, "output": "t"},),
           fields=(("system", "$.system"), ("user", "$.instruction.text"), ("assistant", "$.output"))),
)


def fingerprint(v: Column) -> Column:
    """Hash of the nested field paths of a variant, without the types of its values."""
    paths = F.regexp_replace(F.schema_of_variant(v), r"(?<=[ <])(?:STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\([0-9,]*\))(?=[,>])", "v")
    return F.xxhash64(paths)


def layout_table(spark: SparkSession, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, layout): one row per declared shape."""
    rows = [F.struct(F.lit(x.name).alias("layout"), F.lit(json.dumps(e)).alias("example")) for x in layouts for e in x.examples]
    shapes = spark.range(1).select(F.inline(F.array(*rows)))
    return shapes.select(fingerprint(F.parse_json("example")).alias("fingerprint"), "layout").distinct()


def _turns(v: Column, layout: Layout) -> Column:
    renamed = F.create_map(*(F.lit(x) for pair in layout.roles for x in pair)) if layout.roles else None

    def turn(role: Column, text: Column) -> Column:
        role = F.coalesce(renamed[role], role) if renamed is not None else role
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if layout.items:
        path, role, text = layout.items
        return F.transform(F.variant_get(v, path, "array<variant>"),
                           lambda x: turn(F.variant_get(x, role, "string"), F.variant_get(x, text, "string")))
    return F.array(*(turn(F.lit(r), F.variant_get(v, p, "string")) for r, p in layout.fields))


def canonical_turns(records: DataFrame, id: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, fingerprint, layout, turns) of JSON records; the declared shapes are a literal table, a few rows long."""
    parsed = records.select(F.col(f"`{id}`").alias("conv_id"), F.try_parse_json(F.col(f"`{record}`")).alias("v"))
    parsed = parsed.withColumn("fingerprint", fingerprint(F.col("v")))
    known = F.broadcast(layout_table(records.sparkSession, layouts))
    turns = F.lit(None).cast(_TURNS)
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, _turns(F.col("v"), x)).otherwise(turns)
    return parsed.join(known, "fingerprint", "left").select("conv_id", "fingerprint", "layout", turns.cast(_TURNS).alias("turns"))


#: Characters that control strings need, and what stands for them. The backslash is escaped first and read back last.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(canonical: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` (skip and take per turn, in characters)."""
    head = lambda t: F.concat(F.lit("### "), escape(t["role"]), F.lit(": "))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))), "")
    mask = F.transform("turns", lambda t: F.struct(
        F.length(head(t)).alias("skip"), F.when(t["role"] == "assistant", F.length(escape(t["text"]))).otherwise(0).alias("take")))
    return canonical.withColumn("formatted", formatted).withColumn("loss_mask", mask)


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the mask, from ``formatted`` and ``loss_mask`` alone."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")  # the last one is empty
    header = r"(?s)^### ([^:]*+): "
    turns = F.transform("pieces", lambda p: F.struct(
        unescape(F.regexp_extract(p, header, 1)).alias("role"), unescape(F.regexp_replace(p, header, "")).alias("text")))
    loss = F.transform(F.arrays_zip("pieces", "loss_mask"), lambda x: unescape(
        x["pieces"].substr(x["loss_mask"]["skip"] + 1, x["loss_mask"]["take"])))
    return (formatted.withColumn("pieces", pieces).withColumn("read_turns", turns)
            .withColumn("loss_text", F.array_join(loss, "")).drop("pieces"))


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", "layout", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows (conv_id, turn, role, text): JSON in one of the layouts, by id and by what fits.

    Used to read a table of turns; prompt and instruction layouts take the conversations that have their form.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ",")
    text = lambda i: F.col("t")[i]["text"]
    kind = F.when(roles == "user,assistant", "prompt").when(roles == "system,user,assistant", "instruction").when(
        F.col("conv_id") % 2 == 0, "messages").otherwise("from_value")
    from_ = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    plain = ~F.exists("t", lambda x: x["role"].isin("human", "gpt"))  # else renaming could not be undone
    shapes = {
        "messages": F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")),
        "from_value": F.struct(F.transform("t", lambda x: F.struct(from_(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")),
        "prompt": F.struct(text(0).alias("prompt"), text(1).alias("completion")),
        "instruction": F.struct(text(0).alias("system"), F.struct(text(1).alias("text")).alias("instruction"), text(2).alias("output")),
    }
    conv = conv.withColumn("kind", F.when((kind == "from_value") & ~plain, "messages").otherwise(kind))
    record = F.lit(None).cast("string")
    for name, shape in shapes.items():
        record = F.when(F.col("kind") == name, F.to_json(shape)).otherwise(record)
    return conv.select("conv_id", record.alias("record"))
