r"""Chat formatting: records of several layouts become one templated string with a loss mask.

A record is JSON. Its schema fingerprint is the hash of its nested field paths
at any depth (array positions and types of scalars are left out, absent fields
don't count). A declarative
mapping is registered for each fingerprint that its layout can have, and says
where the turns are, or which fields make up which turn.

The template marks a turn as ``<|im_start|>role\ntext<|im_end|>\n``. Control
strings in a text are escaped reversibly: a backslash is put after the ``<`` of
each ``<|``, and one more where backslashes already stand between the two.
In roles backslashes and line ends are escaped, as a role ends at its line.

Only DataFrame functions are used. A conversation becomes one row, since its
string and digests are one value: its size is that of the conversation.

Defined results: null text and null role count as empty; turns go by number,
nulls first, ties by role and text; repeated turns all stay; a record whose
fingerprint has no mapping gives null turns, with its fingerprint for repair;
empty tables give empty results; further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    ``many`` names a field with a list of turns, of which ``role`` and ``text``
    are fields and ``roles`` renames roles. Otherwise ``fixed`` lists
    (role, fields): the present fields, joined by a blank line, make the turn.
    """

    name: str
    paths: tuple[tuple[str, ...], ...]
    many: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: Layouts that are known; ``paths`` has each set of field paths that one can have.
MAPPINGS = (
    Mapping("messages", (("messages[].content", "messages[].role"), ("messages[]",)), many="messages", role="role", text="content"),
    Mapping(
        "share", (("conversations[].from", "conversations[].value"), ("conversations[]",)), many="conversations", role="from", text="value",
        roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Mapping("turns", (("turns[].role", "turns[].text"), ("turns[]",)), many="turns", role="role", text="text"),
    Mapping(
        "instruction", (("instruction", "output"), ("input", "instruction", "output")),
        fixed=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Mapping("prompt", (("completion", "prompt"),), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt", (("prompt", "response"),), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", (("answer", "question"),), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)


#: A scalar type in a schema text, where a field or a member has it.
_SCALAR = r"(: |<)(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))(?=[,>])"


#: A string of JSON; possessive, as it may be very long.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def field_paths(record: Column) -> Column:
    """The nested fields of a JSON object at any depth, as one text: names in order, the fields of a list those of all its members.

    A field that is of several types among them has a shape of its own, so that such records are left for repair.
    What is no JSON gives an empty text. String values are taken out before the
    record is parsed, as its shape doesn't depend on them and parsed JSON is limited in size.
    """
    bare = F.regexp_replace(record, rf"(?s)({_STRING}\s*+:)|{_STRING}", "$1")
    shape = F.schema_of_variant(F.try_parse_json(F.regexp_replace(bare, r"(?<=[:,\[])(?=\s*+[,\]}])", "0")))
    return F.coalesce(F.regexp_replace(shape, _SCALAR, "$1"), F.lit(""))


def shape_of(paths: tuple[str, ...]) -> str:
    """The text that ``field_paths`` gives for a record with such paths, as ``messages[].role``."""

    def text(tree: dict) -> str:
        fields = []
        for name in sorted(tree):
            inner = text(tree[name]) if tree[name] else ""
            fields.append(f"{name[:-2]}: ARRAY<{inner}>" if name.endswith("[]") else f"{name}: {inner}")
        return f"OBJECT<{', '.join(fields)}>"

    top: dict = {}
    for path in paths:
        at = top
        for name in path.split("."):
            at = at.setdefault(name, {})
    return text(top)


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def _turns(record: Column, mapping: Mapping) -> Column:
    if mapping.many:
        kind = f"struct<`{mapping.many}`:array<struct<`{mapping.role}`:string,`{mapping.text}`:string>>>"
        members = F.from_json(record, kind, {"maxStringLen": str(2**31 - 1)})[mapping.many]

        def turn(x: Column) -> Column:
            role = F.coalesce(x[mapping.role], F.lit(""))
            named = role
            for old, new in mapping.roles:
                named = F.when(role == old, F.lit(new)).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(x[mapping.text], F.lit("")).alias("text"))

        return F.transform(members, turn)
    turns = [
        F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.get_json_object(record, f"$.{f}") for f in fields)).alias("text"))
        for role, fields in mapping.fixed
    ]
    return F.array(*turns).cast(TURNS)


def canonical_turns(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with layout (long), layout_name and turns (array of role and text)."""
    marked = records.withColumn("layout", fingerprint(field_paths(F.col(record_col))))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for mapping in mappings:
        for paths in mapping.paths:
            known = F.col("layout") == F.xxhash64(F.lit(shape_of(paths)))
            turns = F.when(known, _turns(F.col(record_col), mapping).cast(TURNS)).otherwise(turns)
            name = F.when(known, F.lit(mapping.name)).otherwise(name)
    return marked.withColumn("layout_name", name).withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    pieces = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column) -> Column:
    """The templated string of an array of turns."""
    parts = F.transform(turns, lambda x: F.concat(F.lit(START), _escape_role(x["role"]), F.lit(LINE), escape(x["text"]), F.lit(END + LINE)))
    return F.array_join(parts, "")


def read_back(formatted: Column) -> Column:
    """Turns of a templated string, unescaped."""
    marked = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, LINE, 1)
        text = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END + LINE))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), turn)


def loss_text(turns: Column, trained: str = "assistant") -> Column:
    """All text under the loss mask: that of each turn of the trained role, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda x: x["role"] == trained), lambda x: x["text"]), "")


def format_chats(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with layout, layout_name, turns and formatted (the templated string)."""
    return canonical_turns(records, record_col, mappings).withColumn("formatted", render(F.col("turns")))


def as_records(rows: DataFrame) -> DataFrame:
    """conv_id, record: the rows of each conversation, by turn, as JSON.

    Conversations are dealt by a hash of conv_id to the layouts ``messages``,
    ``share`` and ``turns``. One whose own roles are names that ``share`` renames keeps to ``turns``.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), role.alias("role"), text.alias("content")))).alias("x"))
    named = lambda x: F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])
    listed = lambda field, role, text, name=lambda x: x["role"]: F.to_json(
        F.struct(F.transform("x", lambda x: F.struct(name(x).alias(role), x["content"].alias(text))).alias(field))
    )
    dealt = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    taken = F.exists("x", lambda x: x["role"].isin("human", "gpt"))
    record = F.when(dealt == 0, listed("messages", "role", "content")).when((dealt == 1) & ~taken, listed("conversations", "from", "value", named)).otherwise(listed("turns", "role", "text"))
    return gathered.select("conv_id", record.alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted strings."""
    back = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("back"))
    whole = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.withColumn("loss", loss_text(F.col("back"))).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
