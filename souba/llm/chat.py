"""Chat formatting: records of many layouts to canonical turns, turns to one training text, and back.

A record's schema fingerprint is the hash of its nested field paths, value types left out. Each declarative mapping
names an example record, whose fingerprint selects it, and where its turns are found. The template writes each turn as
``### role: text</turn>`` and a line break; control strings inside roles and texts are escaped with a backslash, so
that no text can open or close a turn, and reading back restores every character.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souba.llm.common import replaced

END = "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"
WHOLE = 16_000_000       # bytes of a record that the JSON parser (20,000,000 characters a text) and a variant (128 MiB) are sure to hold
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


@dataclass(frozen=True)
class Layout:
    """Where one layout keeps its turns: ``fixed`` (role, path) pairs first, then a ``list`` with a role and a text field."""

    name: str
    examples: tuple[str, ...]
    fixed: tuple[tuple[str, str], ...] = ()
    list: str = ""
    role: str = ""
    text: str = ""


LAYOUTS = (
    Layout("messages", ('{"messages":[{"role":"a","content":"b"}]}', '{"messages":[]}'), list="$.messages", role="role", text="content"),
    Layout("conversations", ('{"conversations":[{"from":"a","value":"b"}]}', '{"conversations":[]}'), list="$.conversations", role="from", text="value"),
    Layout("dialog", ('{"dialog":{"turns":[{"speaker":"a","utterance":"b"}]}}',), list="$.dialog.turns", role="speaker", text="utterance"),
    Layout("prompt", ('{"prompt":"a","completion":"b"}',), fixed=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("instruction", ('{"instruction":"a","output":"b"}',), fixed=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_system", ('{"system":"s","instruction":"a","output":"b"}',),
           fixed=(("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output"))),
)


def _skeleton(record: Column) -> Column:
    """A JSON string with empty texts, and equal flat objects that follow each other once: same field paths, few bytes."""
    marked = F.regexp_replace(record, rf"(?s)({_STRING}\s*+:)|{_STRING}", "$1\x01")        # a name keeps a mark behind it, a text is one
    bare = F.replace(F.replace(marked, F.lit(":\x01"), F.lit(":")), F.lit("\x01"), F.lit('""'))
    return F.regexp_replace(bare, r'(\{\s*+"[^{}\[\]]*+\})(?:\s*+,\s*+\1)++', "$1")


def schema_paths(record: Column) -> Column:
    """The nested field paths of a JSON string as one canonical string: fields sorted, value types left out.

    A record of more than WHOLE bytes is read by its skeleton; one whose skeleton is still too long is an error.
    """
    told = F.when(F.octet_length(record) > WHOLE, _skeleton(record)).otherwise(record)
    shape = F.schema_of_variant(F.try_parse_json(told))
    paths = F.regexp_replace(shape, r"(?<=[:<] ?)(?!OBJECT|ARRAY)[A-Z]+(\(\d+,\d+\))?(?=[,>]|$)", "_")
    return F.when(shape.isNull() & (F.octet_length(told) > WHOLE), F.raise_error(F.lit("a record is too long to be parsed")).cast("string")).otherwise(paths)


def schema_fingerprint(record: Column) -> Column:
    """Hash of the nested field paths; null for what is no JSON."""
    paths = schema_paths(record)
    return F.when(paths.isNotNull(), F.xxhash64(paths))


def _at(record: Column, path: str, kind: str) -> Column:
    """What stands at a path of plain names; records that a variant may not hold are read without its limits, or fail."""
    names = path.removeprefix("$.").split(".")
    schema = kind
    for name in reversed(names):
        schema = f"struct<`{name}`:{schema}>"
    read = F.from_json(record, schema, {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)})
    for name in names:
        read = read[name]
    return F.when(F.octet_length(record) > WHOLE, read).otherwise(F.try_variant_get(F.try_parse_json(record), path, kind))


def _turns(layout: Layout, record: Column) -> Column:
    fixed = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(_at(record, path, "string"), F.lit("")).alias("text"))
                      for role, path in layout.fixed]).cast(TURNS)
    if not layout.list:
        return fixed
    listed = _at(record, layout.list, f"array<struct<{layout.role}:string,{layout.text}:string>>")
    listed = F.transform(listed, lambda t: F.struct(F.coalesce(t[layout.role], F.lit("")).alias("role"),
                                                    F.coalesce(t[layout.text], F.lit("")).alias("text")))
    return F.concat(fixed, listed) if layout.fixed else listed


def to_turns(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` (JSON strings) with ``layout`` and ``turns`` (array of role, text).

    The mapping is the one an example of which has the record's fingerprint; a record that fits none, is no JSON or is
    null has null in both. Null roles and texts become empty strings. Columns named like a result give way. Long records
    are read whole; one of more than WHOLE bytes with a known layout but broken texts is an error.
    """
    spark = records.sparkSession
    examples = [(layout.name, e) for layout in layouts for e in layout.examples]
    hashes = spark.createDataFrame(examples, "name string, record string").select("name", schema_fingerprint(F.col("record")).alias("hash"))
    known = {(r["name"], r["hash"]) for r in hashes.collect()}   # a handful of declared examples
    marked = records.withColumn("_hash", schema_fingerprint(F.col(f"`{record}`")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        chosen = F.col("_hash").isin(sorted(h for n, h in known if n == layout.name))
        name = F.when(chosen, F.lit(layout.name)).otherwise(name)
        turns = F.when(chosen, _turns(layout, F.col(f"`{record}`"))).otherwise(turns)
    return replaced(marked, layout=name, turns=turns).drop("_hash")


def escape(text: Column) -> Column:
    r"""Control strings broken by a backslash: ``\`` as ``\\``, ``##`` as ``#\#``, ``</turn>`` as ``<\/turn>``."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("##"), F.lit("#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    """The reverse of ``escape`` for texts and roles."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    """One turn of the template; null counts as empty."""
    role = F.replace(escape(F.coalesce(role, F.lit(""))), F.lit(":"), F.lit("\\:"))
    return F.concat(F.lit("### "), role, F.lit(": "), escape(F.coalesce(text, F.lit(""))), F.lit(END))


def format_turns(turns: Column) -> Column:
    """The training text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: format_turn(t["role"], t["text"])), "")


def read_turns(formatted: Column) -> Column:
    """The turns of a training text, as they went in."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    head = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)$"
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"),
                                                 unescape(F.regexp_extract(p, head, 2)).alias("text")))


def loss_mask(turns: Column, roles: Sequence[str] = ("assistant",)) -> Column:
    """Runs of the training text in order, as struct(chars, loss): only the escaped texts of ``roles`` are under the loss."""
    def runs(t: Column) -> Column:
        whole, text = F.char_length(format_turn(t["role"], t["text"])), F.char_length(escape(F.coalesce(t["text"], F.lit(""))))
        return F.array(F.struct((whole - text - len(END)).alias("chars"), F.lit(False).alias("loss")),
                       F.struct(text.alias("chars"), F.coalesce(t["role"].isin(list(roles)), F.lit(False)).alias("loss")),
                       F.struct(F.lit(len(END)).alias("chars"), F.lit(False).alias("loss")))
    return F.flatten(F.transform(turns, runs))


def gather_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record per conversation (``conv_id``, ``record``) from rows by turn, in the layout its shape allows.

    Turns are ordered by number (null first), then role, then text. Which layout: prompt or instruction where the
    turns are user, assistant (after system: instruction with system), else one of the three lists, by id. A
    conversation is one training text, so its turns meet in one row; nothing else does.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    told = told.withColumn("way", F.pmod(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)), F.lit(3)))
    roles, keep = F.array_join("t.role", "|"), {"ignoreNullFields": "false"}

    def fields(a: str, b: str) -> Column:
        return F.transform("t", lambda t: F.struct(t["role"].alias(a), t["text"].alias(b)))
    text_of = lambda i: F.get("t", F.lit(i))["text"]
    record = F.when((roles == "user|assistant") & (F.col("way") == 0), F.to_json(F.struct(text_of(0).alias("prompt"), text_of(1).alias("completion")), keep)) \
        .when((roles == "user|assistant") & (F.col("way") == 1), F.to_json(F.struct(text_of(0).alias("instruction"), text_of(1).alias("output")), keep)) \
        .when((roles == "system|user|assistant") & (F.col("way") != 2), F.to_json(F.struct(
            text_of(0).alias("system"), text_of(1).alias("instruction"), text_of(2).alias("output")), keep)) \
        .when(F.col("way") == 0, F.to_json(F.struct(fields("role", "content").alias("messages")), keep)) \
        .when(F.col("way") == 1, F.to_json(F.struct(fields("from", "value").alias("conversations")), keep)) \
        .otherwise(F.to_json(F.struct(F.struct(fields("speaker", "utterance").alias("turns")).alias("dialog")), keep))
    return told.select("conv_id", record.alias("record"))


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with ``layout``, ``formatted`` and ``mask``; records of no known layout keep nulls."""
    turned = to_turns(records, record)
    return replaced(turned, formatted=format_turns(F.col("turns")), mask=loss_mask(F.col("turns"))).drop("turns")
