"""Chat formatting: layouts are told apart by a fingerprint of their fields.

Conversations come as rows of turns, or as JSON records of several shapes. The nested field paths,
with their types, are read from the data: from the schema of a table, or from each record, where a
null has the type that is declared and an empty list the fields that are. The hash of those paths that a
layout names selects its declarative mapping, which says where the turns, their roles and their
texts are; of several the first, and other fields play no part. Records that fit no layout are not
guessed at: they keep a null layout and no turn, next to their fingerprint, the hash of all paths in
them that some layout names.

The canonical turns of a conversation become one string. Every turn is
``<|im_start|>role<|im_sep|>text<|im_end|>``. In roles and texts a backslash is doubled, and a
control string gets a backslash after its first character, so that none remains and ``unescape``
gives back every text. ``loss`` lists the spans to train on, as bytes of the UTF-8 string, one for
the text of each assistant turn. All of it is DataFrame functions.

Defined cases: null roles and texts are empty; turns are in the order of turn (nulls first), role
and text, repeated rows are repeated turns; rows with a null conversation form one conversation;
an empty table gives an empty result; other columns of the input play no part, whatever their
names. One conversation is one string and so one row; its turns meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Control strings of common chat templates.
CONTROLS = (
    "<|im_start|>",
    "<|im_sep|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
START, SEPARATOR, END = CONTROLS[:3]
ASSISTANT = "assistant"

_CONTROL = "|".join(r"\Q" + control + r"\E" for control in CONTROLS)


def escape(text: Column) -> Column:
    """Texts without control strings; ``unescape`` gives the original back."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(?=(?:{_CONTROL}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _hash(paths: Iterable[str]) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class RowLayout:
    """A table with a row for each turn: the columns of conversation, order, role and text."""

    name: str
    conversation: str
    turn: str
    role: str
    text: str

    @property
    def columns(self) -> tuple[str, ...]:
        return self.conversation, self.turn, self.role, self.text

    @property
    def paths(self) -> frozenset[str]:
        kinds = ("integer", "integer", "string", "string")
        return frozenset(f"{c}:{kind}" for c, kind in zip(self.columns, kinds, strict=True))


@dataclass(frozen=True)
class RecordLayout:
    """Records in JSON: either a list of turns, or fields that are turns in order."""

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> frozenset[str]:
        if self.turns:
            return frozenset(f"{self.turns}[].{name}:string" for name in (self.role, self.text))
        return frozenset(f"{name}:string" for _, name in self.fields)


ROW_LAYOUTS = (
    RowLayout("turn rows", "conv_id", "turn", "role", "text"),
    RowLayout("message rows", "conversation_id", "message_index", "author", "content"),
)
RECORD_LAYOUTS = (
    RecordLayout("messages", "messages"),
    RecordLayout("from and value", "conversations", "from", "value"),
    RecordLayout("instruction", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    RecordLayout("instruction without input", fields=(("user", "instruction"), ("assistant", "output"))),
    RecordLayout("prompt", fields=(("user", "prompt"), ("assistant", "completion"))),
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def table_paths(schema: StructType) -> frozenset[str]:
    """The columns of a table with the kinds of their types."""
    kinds = {"byte": "integer", "short": "integer", "long": "integer"}
    return frozenset(f"{f.name}:{kinds.get(f.dataType.typeName(), f.dataType.typeName())}" for f in schema.fields)


def turns_of_rows(df: DataFrame, layouts: tuple[RowLayout, ...] = ROW_LAYOUTS) -> DataFrame:
    """Canonical turns ``conv_id, turn, role, text`` of a table with a row for each turn."""
    found = table_paths(df.schema)
    for layout in layouts:
        if _hash(found & layout.paths) == _hash(layout.paths):
            names = ("conv_id", "turn", "role", "text")
            return df.select(*(F.col(c).alias(n) for c, n in zip(layout.columns, names, strict=True)))
    raise ValueError(f"no layout has the fields of {df.schema.simpleString()}")


def _kind(value: Column) -> Column:
    """The kind of a variant: STRING, ARRAY, OBJECT and so on; VOID for null."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("VOID"))


def _keys(payload: Column) -> Column:
    return F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))


def record_paths(payload: Column, value: Column, layouts: Sequence[RecordLayout]) -> Column:
    """The paths of a record that some layout names, with types; ``value`` is the parsed payload."""
    lists: dict[str, list[str]] = {}
    for layout in layouts:
        if layout.turns:
            names = lists.setdefault(layout.turns, [])
            names += [n for n in (layout.role, layout.text) if n not in names]
    plain = dict.fromkeys(name for layout in layouts for _, name in layout.fields)

    def typed(path: str, good: Column) -> Column:
        return F.when(good, f"{path}:string").otherwise(f"{path}:other")

    found = []
    keys = _keys(payload)
    for name in plain:
        kind = _kind(F.try_variant_get(value, f"$.{name}", "variant"))
        found.append(F.when(F.array_contains(keys, name), typed(name, kind.isin("STRING", "VOID"))))
    for name, inner in lists.items():
        kind = _kind(F.try_variant_get(value, f"$.{name}", "variant"))
        items = _items(value, name)
        held = F.array_distinct(F.flatten(F.transform(items, lambda e: _keys(F.to_json(e)))))
        for field in inner:
            other = F.exists(items, _no_text(field))
            path = F.when(F.size(items) == 0, typed(f"{name}[].{field}", kind.isin("ARRAY", "VOID"))).when(
                F.array_contains(held, field), typed(f"{name}[].{field}", ~other)
            )
            found.append(F.when(F.array_contains(keys, name), path))
    return F.array_sort(F.array_compact(F.array(*found)))


def _no_text(field: str) -> Callable[[Column], Column]:
    return lambda e: ~_kind(F.try_variant_get(e, f"$.{field}", "variant")).isin("STRING", "VOID")


def _items(value: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def record_turns(payload: Column, layouts: tuple[RecordLayout, ...] = RECORD_LAYOUTS) -> Column:
    """``{fingerprint, layout, turns}`` of a JSON record; all null for what is no JSON object."""
    other = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))

    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(other[role], role).alias("role"), text.alias("text"))

    def among(layout: RecordLayout) -> Callable[[Column], Column]:
        return lambda path: path.isin(*layout.paths)

    def item(layout: RecordLayout) -> Callable[[Column], Column]:
        def read_item(e: Column) -> Column:
            role, text = (F.try_variant_get(e, f"$.{name}", "string") for name in (layout.role, layout.text))
            return turn(role, text)

        return read_item

    def read(bound: Column) -> Column:
        value, paths = bound["value"], bound["paths"]
        name = turns = None
        for layout in layouts:
            # The hash of those paths that the layout names.
            own = F.filter(paths, among(layout))
            is_it = F.sha2(F.array_join(own, "\n"), 256) == _hash(layout.paths)
            if layout.turns:
                made = F.transform(_items(value, layout.turns), item(layout))
            else:
                made = F.array(
                    *(turn(F.lit(role), F.try_variant_get(value, f"$.{field}", "string")) for role, field in layout.fields)
                )
            name = F.when(is_it, layout.name) if name is None else name.when(is_it, layout.name)
            turns = F.when(is_it, made) if turns is None else turns.when(is_it, made)
        fingerprint = F.sha2(F.array_join(paths, "\n"), 256)
        return F.struct(fingerprint.alias("fingerprint"), name.alias("layout"), turns.alias("turns"))

    # A transform over one element binds what is parsed to a name, so that it is parsed once.
    value = F.try_parse_json(payload)
    parsed = F.transform(
        F.array(value), lambda v: F.struct(v.alias("value"), record_paths(payload, v, layouts).alias("paths"))
    )
    return F.when(F.json_object_keys(payload).isNotNull() & value.isNotNull(), F.transform(parsed, read)[0])


def turns_of_records(
    df: DataFrame, conversation: str, payload: str, layouts: tuple[RecordLayout, ...] = RECORD_LAYOUTS
) -> DataFrame:
    """``conv_id, fingerprint, layout, turns`` of JSON records; turns are ``{role, text}`` lists."""
    read = df.select(F.col(conversation).alias("conv_id"), record_turns(F.col(payload), layouts).alias("r"))
    return read.select("conv_id", "r.fingerprint", "r.layout", "r.turns")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss`` of canonical turns, a row for each conversation."""
    role = F.coalesce("role", F.lit(""))
    text = F.coalesce("text", F.lit(""))
    order = [F.col("turn").asc_nulls_first(), role.asc(), text.asc()]
    by_conversation = Window.partitionBy("conv_id").orderBy(*order)
    ahead = by_conversation.rowsBetween(Window.unboundedPreceding, -1)
    escaped = turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(F.lit(START), escape(role), F.lit(SEPARATOR)).alias("head"),
        escape(text).alias("body"),
        (role == ASSISTANT).alias("trained"),
    )
    size = F.octet_length("head") + F.octet_length("body") + len(END)
    placed = escaped.select(
        "conv_id",
        F.row_number().over(by_conversation).alias("place"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        (F.coalesce(F.sum(size).over(ahead), F.lit(0)) + F.octet_length("head")).alias("start"),
        F.octet_length("body").cast("bigint").alias("length"),
        "trained",
    )
    gathered = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece", "start", "length", "trained"))).alias("all")
    )
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("all", lambda t: t["trained"]),
            lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["length"]).alias("end")),
        ).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted string, as a list of ``{role, text}``."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"\Q" + SEPARATOR + r"\E", 2)
        role = F.substring(halves[0], len(START) + 1, 1 << 30)
        return F.struct(unescape(role).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(F.filter(pieces, lambda piece: piece != ""), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""

    def cut(data: Column) -> Column:
        return F.transform(
            loss,
            lambda s: unescape(
                F.decode(F.substring(data, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8")
            ),
        )

    # Bound to a name, the string is encoded once and not again for every turn.
    return F.transform(F.array(F.encode(formatted, "UTF-8")), cut)[0]
