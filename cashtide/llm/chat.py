"""Chat formatting: schema fingerprints choose the mapping to canonical turns; a template makes them text and back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's marks, and the tails that make `<` or `[` the start of a control string.
TURN, TEXT, LOSS, END = "<|turn|>", "<|text|>", "<|loss|>", "<|end|>\n"
TAIL = r"(\||/?s>|/?INST\]|/?SYS>>)"
#: A word joiner after the opening sign breaks a control string; one more is added where some stand already.
JOINER = "\u2060"


def escaped(c: Column) -> Column:
    """Breaks control strings inside a text; `unescaped` gives the very text back."""
    return F.regexp_replace(c, rf"([<\[])(?={JOINER}*{TAIL})", f"$1{JOINER}")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[]){JOINER}(?={JOINER}*{TAIL})", "$1")


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema, e.g. messages[].role."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: Iterable[str]) -> str:
    """SHA-256 of the sorted nested paths, the key of a layout."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: the fields that make the layout, and either columns of a row that is one turn,
    an array of turns, or (role, column) pairs in order."""

    name: str
    paths: tuple[str, ...]
    row: dict[str, str] = field(default_factory=dict)
    array: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, str], ...] = ()


#: The layouts known from the start; others can be passed in.
LAYOUTS = (
    Layout("turns", ("conv_id", "role", "text", "turn"), row={"turn": "turn", "role": "role", "text": "text"}),
    Layout("messages", ("conv_id", "messages[].content", "messages[].role"), array=("messages", "role", "content")),
    Layout("conversations", ("conv_id", "conversations[].from", "conversations[].value"), array=("conversations", "from", "value")),
    Layout("prompt", ("completion", "conv_id", "prompt"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("conv_id", "input", "instruction", "output"), fixed=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout, chosen by the fingerprint of its field paths.

    Extra fields, at the top or nested, are ignored: of the layouts whose fingerprint equals that of the table's paths
    cut to the layout's own, the one with most fields wins. An unknown layout raises ValueError. Null texts become
    empty; null roles become empty strings; rows without conv_id form one conversation of their own. A null or empty
    array of turns is a conversation with one empty turn of no role, so no conversation vanishes.
    """
    known = {fingerprint(lay.paths): lay for lay in sorted(layouts, key=lambda x: len(x.paths))}
    have = set(field_paths(df.schema))
    for lay in sorted(layouts, key=lambda x: -len(x.paths)):
        if known.get(fingerprint(have & set(lay.paths))) is not lay:
            continue
        if lay.row:
            out = df.select("conv_id", *[F.col(v).alias(k) for k, v in lay.row.items()])
        elif lay.array:
            name, role, text = lay.array
            out = df.select("conv_id", F.posexplode_outer(name).alias("turn", "_m")).select(
                "conv_id", "turn", F.col(f"_m.{role}").alias("role"), F.col(f"_m.{text}").alias("text")
            )
        else:
            parts = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("text")) for r, c in lay.fixed])
            out = df.select("conv_id", F.posexplode(parts).alias("turn", "_m")).select("conv_id", "turn", "_m.role", "_m.text")
            out = out.where("role = 'assistant' or coalesce(text, '') <> ''")
        if not lay.row:
            names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
            out = out.withColumn("role", F.coalesce(F.element_at(names, F.col("role")), F.col("role")))
        return out.select(
            "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        )
    raise ValueError(f"no layout has the fingerprint of {field_paths(df.schema)}")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted.

    A turn is TURN role (LOSS or TEXT) text END; LOSS marks the texts under the loss mask (those of
    assistants). Order is by turn, then role, then text, so ties and repeated rows have a defined place. The
    list of a conversation is needed whole in its one output row; it is gathered with map-side combining.
    """
    mark = F.when(F.col("role") == "assistant", LOSS).otherwise(TEXT)
    one = F.concat(F.lit(TURN), escaped(F.col("role")), mark, escaped(F.col("text")), F.lit(END))
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "text", one.alias("piece"))))
    return turns.groupBy("conv_id").agg(F.array_join(listed["piece"], "").alias("formatted"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted and turns (array of role, text, loss), parsed from the formatted text alone."""
    pieces = F.slice(F.split("formatted", r"<\|end\|>\n"), 1, F.size(F.split("formatted", r"<\|end\|>\n")) - 1)
    body = lambda p: F.substring(p, len(TURN) + 1, 2147483647)
    part = lambda p, k: F.element_at(F.split(body(p), r"<\|(?:text|loss)\|>"), k)
    turn = lambda p: F.struct(
        unescaped(part(p, 1)).alias("role"), unescaped(part(p, 2)).alias("text"), F.contains(p, F.lit(LOSS)).alias("loss")
    )
    return chats.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"))
