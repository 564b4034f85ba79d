r"""Chat formatting: records of many layouts to canonical turns, and turns to training text.

A record's layout is told by its schema fingerprint: the hash of the nested field paths
that it fills, among the paths that any known layout uses.  The fingerprint selects a
declarative mapping from fields to turns.  All of it is DataFrame code.

The training text marks turns as ``<|im_start|>role\ntext<|im_end|>\n``.  Control strings inside
texts and roles are escaped so that they cannot be taken for marks, and are restored on
reading: backslash to ``\e``, ``<|`` to ``\c``, and in roles line end to ``\n``.

Defined cases: a null text or role of a turn is empty; a list of turns may be empty; a
scalar field is filled when it is not null, a list field when the list is not; a record
whose filled paths match no layout keeps its row with null layout, turns and text;
columns that no layout names are passed through whatever their names; equal turn numbers
are ordered by role and text; repeated rows are formatted again; empty tables give empty
results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolens.functions.text import computed

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Said:
    """A turn of a fixed role; several fields are joined by a blank line."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Listed:
    """All turns of a list; ``names`` translates the list's roles."""

    field: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    name: str
    parts: tuple[Said | Listed, ...]

    def paths(self) -> list[str]:
        found = []
        for part in self.parts:
            if isinstance(part, Listed):
                found += [f"{part.field}[].{part.role}", f"{part.field}[].{part.text}"]
            else:
                found += part.fields
        return sorted(found)

    def fields(self) -> set[str]:
        return {path.split("[")[0].split(".")[0] for path in self.paths()}


def _layouts() -> tuple[Layout, ...]:
    pairs = {
        "instruction": (Said("user", ("instruction",)), Said("assistant", ("output",))),
        "instruction-input": (Said("user", ("instruction", "input")), Said("assistant", ("output",))),
        "prompt-completion": (Said("user", ("prompt",)), Said("assistant", ("completion",))),
        "prompt-response": (Said("user", ("prompt",)), Said("assistant", ("response",))),
        "question-answer": (Said("user", ("question",)), Said("assistant", ("answer",))),
        "messages": (Listed("messages", "role", "content"),),
        "conversations": (
            Listed("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
        ),
    }
    system = Said("system", ("system",))
    return tuple(
        layout for name, parts in pairs.items()
        for layout in (Layout(name, parts), Layout(f"system-{name}", (system, *parts)))
    )


LAYOUTS = _layouts()


def _field(frame: DataFrame, path: str) -> tuple[Column, T.DataType] | None:
    """The column and type at a path of structs and at most one list, or nothing."""
    steps = path.replace("[]", "").split(".")
    kind, column = frame.schema, None
    for step in steps:
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return None
        column = F.col(f"`{step}`") if column is None else column.getField(step)
        kind = kind[step].dataType
    return column, kind


def schema_fingerprint(frame: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The hash of the filled paths of a row, in order."""
    filled = []
    for path in sorted({path for layout in layouts for path in layout.paths()}):
        if _field(frame, path) is not None:
            held = _field(frame, path.split("[")[0])[0]
            filled.append(F.when(held.isNotNull(), F.lit(path)))
    return F.xxhash64(F.concat_ws(",", *filled) if filled else F.lit(""))


def layout_fingerprint(layout: Layout) -> Column:
    return F.xxhash64(F.lit(",".join(layout.paths())))


def _turns(frame: DataFrame, layout: Layout) -> Column:
    def text(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit(""))

    def listed(part: Listed) -> Column:
        def turn(entry: Column) -> Column:
            role = text(entry.getField(part.role))
            for given, wanted in part.names:
                role = F.when(entry.getField(part.role) == given, wanted).otherwise(role)
            return F.struct(role.alias("role"), text(entry.getField(part.text)).alias("text"))

        return F.transform(F.col(f"`{part.field}`"), turn)

    def said(part: Said) -> Column:
        words = F.concat_ws("\n\n", *[_field(frame, field)[0].cast("string") for field in part.fields])
        return F.array(F.struct(F.lit(part.role).alias("role"), words.alias("text")))

    parts = [listed(part) if isinstance(part, Listed) else said(part) for part in layout.parts]
    return F.concat(*[part.cast(TURNS) for part in parts])


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Every record as ``row`` with its ``fingerprint``, the ``layout`` it selects and the ``turns``."""
    usable = [layout for layout in layouts if all(_field(records, path) is not None for path in layout.paths())]
    marked = records.select(
        F.struct("*").alias("_row"), schema_fingerprint(records, layouts).alias("_fingerprint"),
        *[F.col(f"`{name}`") for name in sorted({name for layout in usable for name in layout.fields()})],
    )
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in usable:
        chosen = F.col("_fingerprint") == layout_fingerprint(layout)
        name, turns = F.when(chosen, layout.name).otherwise(name), F.when(chosen, _turns(records, layout)).otherwise(turns)
    return marked.select(
        F.col("_row").alias("row"), F.col("_fingerprint").alias("fingerprint"), name.alias("layout"), turns.alias("turns")
    )


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("\\c"))


def restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("<|")), F.lit("\\e"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def restored_role(role: Column) -> Column:
    return restored(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chat(records: DataFrame, trained: tuple[str, ...] = ("assistant",), layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``formatted``, the training text, and ``loss``, its ``(start, length)`` spans to learn from.

    Spans are in code points, from 0, and cover the texts of the ``trained`` roles.
    """
    written = computed(
        canonical_turns(records, layouts),
        _written=F.transform("turns", lambda turn: F.struct(
            escaped_role(turn["role"]).alias("role"), escaped(turn["text"]).alias("text"),
            turn["role"].isin(*trained).alias("trained"),
        )),
    )
    formatted = F.array_join(F.transform("_written", lambda turn: F.concat(
        F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END)
    )), "")

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + len(START) + F.char_length(turn["role"]) + 1
        length = F.char_length(turn["text"])
        span = F.struct(begin.alias("start"), length.alias("length"))
        return F.struct(
            (begin + length + len(END)).alias("at"),
            F.when(turn["trained"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("_written", empty, step, lambda state: state["spans"])
    return written.select("row", "fingerprint", "layout", "turns", formatted.alias("formatted"), spans.alias("loss"))


def read_chat(formatted: Column) -> Column:
    """The turns of a training text."""
    # Nothing stands before the first mark, and each further part ends with the end mark.
    parts = F.split(F.substring(formatted, len(START) + 1, 2**31 - 1), r"<\|im_start\|>")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.char_length(role) + 2, F.char_length(part) - F.char_length(role) - 1 - len(END))
        return F.struct(restored_role(role).alias("role"), restored(body).alias("text"))

    return F.when(formatted == "", F.array().cast(TURNS)).otherwise(F.transform(parts, turn))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the spans, restored, in order."""
    return F.array_join(F.transform(
        loss, lambda span: restored(F.substring(formatted, span["start"] + 1, span["length"]))
    ), "")


def from_rows(conversations: DataFrame) -> DataFrame:
    """One record per ``conv_id`` from rows ``(conv_id, turn, role, text)``.

    Two turns, of a user and then an assistant, are laid out as prompt and response; all
    others as a list of messages.
    """
    grouped = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")
        ))).alias("_said")
    )
    said = F.col("_said")
    # Spark may look at the second turn before it has tested the number of turns.
    first, second = F.get(said, 0), F.get(said, 1)
    pair = F.coalesce((F.size(said) == 2) & (first["role"] == "user") & (second["role"] == "assistant"), F.lit(False))
    messages = F.transform(said, lambda turn: F.struct(turn["role"].alias("role"), turn["content"].alias("content")))
    return grouped.select(
        "conv_id", F.when(pair, first["content"]).alias("prompt"),
        F.when(pair, second["content"]).alias("response"), F.when(~pair, messages).alias("messages"),
    )
