"""Conversations of many layouts as canonical turns, formatted by one template.

The nested field paths of a record (or of a table's schema) that any layout names are
sorted and hashed; the hash selects a declarative layout, which says where the turns
lie and how their roles are called. The template marks turns, and control strings
inside texts are escaped so that a parser gets every role and text back. The formatted
text is a list of segments that say whether they count for the loss.

DataFrame functions only.

Defined cases: null texts and roles are empty; turns go by turn number, then role, then
text (null turn numbers first; repeated rows stay); rows without an id form one
conversation; a record whose layout is unknown, or that is no object, keeps its row with
no layout and no turns; fields that no layout names do not count for the hash; texts of
any length are formatted whole, a conversation is one row and has to fit a task; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TURNS = "array<struct<role string, text string>>"


# --- layouts -----------------------------------------------------------------

@dataclass(frozen=True)
class Said:
    """One turn of a flat record: the texts at ``paths``, joined by an empty line; left out if ``optional`` and empty."""

    role: str
    paths: tuple[str, ...]
    optional: bool = False


@dataclass(frozen=True)
class Each:
    """A list of turns, with the names of the fields that hold role and text."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class Row:
    """A record that is one turn of a conversation."""

    order: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    name: str
    parts: tuple[Said | Each | Row, ...]
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> set[str]:
        found: set[str] = set()
        for part in self.parts:
            if isinstance(part, Said):
                found |= set(part.paths)
            elif isinstance(part, Each):
                found |= {part.path, f"{part.path}.{part.role}", f"{part.path}.{part.text}"}
            else:
                found |= {part.order, part.role, part.text}
        return found


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_SYSTEM = Said("system", ("system",), optional=True)


def _pair(name: str, asked: tuple[str, ...], answer: str, system: bool = False) -> Layout:
    return Layout(name, (*((_SYSTEM,) if system else ()), Said("user", asked), Said("assistant", (answer,))))


LAYOUTS: tuple[Layout, ...] = (
    Layout("turn_rows", (Row("turn", "role", "text"),)),
    Layout("messages", (Each("messages", "role", "content"),), _SPEAKERS),
    Layout("speakers", (Each("conversations", "from", "value"),), _SPEAKERS),
    Layout("system_and_messages", (_SYSTEM, Each("messages", "role", "content")), _SPEAKERS),
    Layout("system_and_speakers", (_SYSTEM, Each("conversations", "from", "value")), _SPEAKERS),
    _pair("prompt_response", ("prompt",), "response"),
    _pair("prompt_completion", ("prompt",), "completion"),
    _pair("question_answer", ("question",), "answer"),
    _pair("instruction_output", ("instruction",), "output"),
    _pair("instruction_input_output", ("instruction", "input"), "output"),
    _pair("system_prompt_response", ("prompt",), "response", system=True),
    _pair("system_prompt_completion", ("prompt",), "completion", system=True),
    _pair("system_question_answer", ("question",), "answer", system=True),
    _pair("system_instruction_output", ("instruction",), "output", system=True),
    _pair("system_instruction_input_output", ("instruction", "input"), "output", system=True),
)


def vocabulary(layouts: Sequence[Layout] = LAYOUTS) -> list[str]:
    """Every path that some layout names; only these count for a fingerprint."""
    return sorted(set().union(*(x.paths() for x in layouts)))


def fingerprint(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(schema: T.StructType, before: str = "") -> list[str]:
    """Nested field paths of a schema; lists are passed through."""
    found = []
    for f in schema.fields:
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        found.append(before + f.name)
        if isinstance(kind, T.StructType):
            found += schema_paths(kind, f"{before}{f.name}.")
    return found


# --- reading records ---------------------------------------------------------

class JsonRecord:
    """Fields of a JSON text."""

    def __init__(self, record: Column):
        self.record = record

    def has(self, path: str) -> Column:
        name, _, inner = path.partition(".")
        if not inner:
            found = F.array_contains(F.json_object_keys(self.record), name)
        else:
            found = F.exists(self.items(name), lambda e: F.coalesce(F.array_contains(F.json_object_keys(e), inner), F.lit(False)))
        return F.coalesce(found, F.lit(False))

    def text(self, path: str) -> Column:
        return F.get_json_object(self.record, f"$['{path}']")

    def items(self, path: str) -> Column:
        return F.from_json(self.text(path), "array<string>")

    @staticmethod
    def of(item: Column, name: str) -> Column:
        return F.get_json_object(item, f"$['{name}']")


class TypedRecord:
    """Fields of a table's columns."""

    def text(self, path: str) -> Column:
        return F.col(path).cast("string")

    def items(self, path: str) -> Column:
        return F.col(path)

    @staticmethod
    def of(item: Column, name: str) -> Column:
        return item[name].cast("string")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _canonical(role: Column, roles: dict[str, str]) -> Column:
    if not roles:
        return role
    return F.coalesce(F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))[role], role)


def _each(part: Each, roles: dict[str, str], record: JsonRecord | TypedRecord) -> Column:
    return F.transform(record.items(part.path), lambda e: _turn(_canonical(record.of(e, part.role), roles), record.of(e, part.text)))


def _turns(layout: Layout, record: JsonRecord | TypedRecord) -> Column:
    """The turns of a record as a list."""
    lists = []
    for part in layout.parts:
        if isinstance(part, Said):
            texts = [F.coalesce(record.text(p), F.lit("")) for p in part.paths]
            text = texts[0] if len(texts) == 1 else F.array_join(F.filter(F.array(*texts), lambda t: t != ""), "\n\n")
            said = F.array(_turn(F.lit(part.role), text))
            lists.append(F.when(text != "", said).otherwise(F.array().cast(_TURNS)) if part.optional else said)
        elif isinstance(part, Each):
            lists.append(F.coalesce(_each(part, layout.roles, record), F.array().cast(_TURNS)))
        else:
            lists.append(F.array(_turn(_canonical(record.text(part.role), layout.roles), record.text(part.text))))
    return F.concat(*lists).cast(_TURNS) if len(lists) > 1 else lists[0].cast(_TURNS)


def _collected(rows: DataFrame) -> DataFrame:
    """conv_id, layout, turns from rows that hold one turn each (conv_id, layout, order, role, text)."""
    each = F.struct("order", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id", "layout").agg(F.array_sort(F.collect_list(each)).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: _turn(t["role"], t["text"])))


def table_turns(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """conv_id, layout, turns of a table, by the fingerprint of its schema."""
    known = set(vocabulary(layouts))
    seen = fingerprint([p for p in schema_paths(df.schema) if p in known])
    layout = next((x for x in layouts if fingerprint(x.paths()) == seen), None)
    if layout is None:
        raise ValueError(f"no layout for the fields {schema_paths(df.schema)}")
    row = layout.parts[0]
    if isinstance(row, Row):
        record = TypedRecord()
        role = _canonical(record.text(row.role), layout.roles)
        return _collected(df.select("conv_id", F.lit(layout.name).alias("layout"), F.col(row.order).alias("order"), role.alias("role"), record.text(row.text).alias("text")))
    return df.select("conv_id", F.lit(layout.name).alias("layout"), _turns(layout, TypedRecord()).alias("turns"))


def record_turns(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """conv_id, layout, turns of JSON texts, each by the fingerprint of its own fields.

    Records that hold one turn each are gathered by conv_id, all others are whole
    conversations already.
    """
    read = JsonRecord(F.col(record))
    paths = F.array_compact(F.array(*(F.when(read.has(p), F.lit(p)) for p in vocabulary(layouts))))
    names = F.create_map(*(F.lit(x) for layout in layouts for x in (fingerprint(layout.paths()), layout.name)))
    marked = records.select("conv_id", F.col(record), names[F.sha2(F.array_join(paths, "\n"), 256)].alias("layout"))
    by_row = [x for x in layouts if isinstance(x.parts[0], Row)]
    chosen = None
    for layout in layouts:
        if layout not in by_row:
            of = F.col("layout") == layout.name
            chosen = F.when(of, _turns(layout, read)) if chosen is None else chosen.when(of, _turns(layout, read))
    turns = F.array().cast(_TURNS) if chosen is None else F.coalesce(chosen, F.array().cast(_TURNS))
    one_turn = F.coalesce(F.col("layout").isin([x.name for x in by_row]), F.lit(False))
    whole = marked.filter(~one_turn).select("conv_id", "layout", turns.alias("turns"))
    for layout in by_row:
        row = layout.parts[0]
        rows = marked.filter(F.col("layout") == layout.name).select(
            "conv_id", "layout", read.text(row.order).cast("double").alias("order"),
            _canonical(read.text(row.role), layout.roles).alias("role"), read.text(row.text).alias("text"),
        )
        whole = whole.unionByName(_collected(rows))
    return whole


# --- template ----------------------------------------------------------------

@dataclass(frozen=True)
class ChatTemplate:
    """A turn is ``start`` role ``middle`` text ``end``; the controls may not stand in roles and texts.

    ``escaped`` doubles every backslash and puts one behind the first character of every
    control string, so that no control is left; ``restored`` drops the backslashes again.
    """

    start: str = "<s>[INST] "
    middle: str = " [/INST] "
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    def escaped(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        pattern = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(doubled, pattern, r"$0\\")

    @staticmethod
    def restored(text: Column) -> Column:
        return F.regexp_replace(text, r"\\([\s\S])", "$1")

    def segments(self, turns: Column, learn: Sequence[str] = ("assistant",)) -> Column:
        """Texts that make up the formatted conversation, and whether they count for the loss."""

        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        def marked(t: Column) -> Column:
            head = F.concat(F.lit(self.start), self.escaped(t["role"]), F.lit(self.middle))
            no = F.lit(False)
            return F.array(piece(head, no), piece(self.escaped(t["text"]), t["role"].isin(list(learn))), piece(F.lit(self.end), no))

        return F.flatten(F.transform(turns, marked))

    def parsed(self, formatted: Column) -> Column:
        """The turns of a formatted conversation."""
        pieces = F.split(formatted, re.escape(self.end), -1)

        def turn(p: Column) -> Column:
            at = F.instr(p, self.middle)
            role = F.substr(p, F.lit(len(self.start) + 1), at - F.lit(len(self.start) + 1))
            return F.struct(self.restored(role).alias("role"), self.restored(F.substr(p, at + F.lit(len(self.middle)))).alias("text"))

        return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


TEMPLATE = ChatTemplate()


def format_conversations(turns: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """conv_id, layout, segments (text, loss) and formatted (all segments in a row)."""
    cut = turns.select("conv_id", "layout", template.segments(F.col("turns")).alias("segments"))
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


# --- query -------------------------------------------------------------------

def probe_record(spark: SparkSession, conv_id: int, text: str) -> DataFrame:
    """A conversation of another layout in which user and assistant both say ``text``."""
    made = json.dumps({"prompt": text, "response": text})
    return spark.range(1).select(F.lit(conv_id).cast("long").alias("conv_id"), F.lit(made).alias("record"))


def format_digest(formatted: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """What a reader of the formatted conversations gets back, as counts and digests."""

    def text(t: Column) -> Column:
        return F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))

    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.restored(s["text"])), "")
    read = formatted.select("conv_id", "layout", "formatted", template.parsed(F.col("formatted")).alias("turns"), learned.alias("learned"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", text), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def format_table(conversations: DataFrame, probe: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """A table of turns and one record of another layout, formatted and read back."""
    extra = record_turns(probe_record(conversations.sparkSession, -1, probe))
    return format_digest(format_conversations(table_turns(conversations).unionByName(extra)))
