"""Chat formatting by schema fingerprints.

Chat data comes in many layouts: prompt/response columns, instruction/input/output
columns, lists of messages under several names. A layout is recognised by hashing
the nested field paths of a record's schema. Every known hash selects a declarative
mapping (plain data, no code) that says where the turns, roles and texts lie, and one
interpreter of such mappings builds canonical turns, ``array<struct<role,text>>``.
Canonical turns are then written with a template whose control strings cannot occur
inside roles or texts, so that the formatted string can be read back without loss.

Everything here is a Column expression or a DataFrame operation.

Defined results: a null text or role is the empty string; a null record field of a
prompt-like layout makes no turn when the mapping marks it optional, else an empty
turn; an empty conversation formats to the empty string; turns with equal ``turn``
are ordered by role, then text, those without one come first; rows without a
conversation's id are one conversation; repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"

#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "instruction": "user"}

#: Declarative mappings. ``list``: path of an array of messages, with the field of an order (or none), of the role and
#: of the text. ``fields``: (role, parts, optional) per turn; several parts are joined by a blank line.
LAYOUTS: dict[str, dict] = {
    "turn_rows": {"list": "conversation", "order": "turn", "role": "role", "text": "text"},
    "messages": {"list": "messages", "role": "role", "text": "content"},
    "share": {"list": "conversations", "role": "from", "text": "value"},
    "dialogue": {"list": "dialogue", "role": "speaker", "text": "utterance"},
    "prompt_response": {"fields": [("user", ["prompt"], False), ("assistant", ["response"], False)]},
    "prompt_completion": {"fields": [("user", ["prompt"], False), ("assistant", ["completion"], False)]},
    "system_prompt_response": {"fields": [("system", ["system"], True), ("user", ["prompt"], False), ("assistant", ["response"], False)]},
    "instruction_input_output": {"fields": [("user", ["instruction", "input"], False), ("assistant", ["output"], False)]},
    "instruction_output": {"fields": [("user", ["instruction"], False), ("assistant", ["output"], False)]},
    "question_answer": {"fields": [("user", ["question"], False), ("assistant", ["answer"], False)]},
    "nested_data": {"fields": [("user", ["data.prompt"], False), ("assistant", ["data.response"], False)]},
}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves below a type: ``a.b`` for a field of a struct, ``a[]`` for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of a set of nested field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:32]


def layout_paths(layout: dict) -> list[str]:
    """The field paths that a mapping reads."""
    if "list" in layout:
        return [f"{layout['list']}[].{layout[k]}" for k in ("order", "role", "text") if k in layout]
    return [p for _, parts, _ in layout["fields"] for p in parts]


#: From the fingerprint of a schema to the name of its mapping.
REGISTRY = {fingerprint(layout_paths(v)): k for k, v in LAYOUTS.items()}


def select_layout(schema: T.StructType, ignore: Iterable[str] = ()) -> str:
    """The mapping for a schema: by the fingerprint of all its paths, else (for schemas with extra columns) by the
    largest set of known paths that it holds. Unknown schemas are an error."""
    paths = set(field_paths(T.StructType([f for f in schema.fields if f.name not in set(ignore)])))
    if (exact := REGISTRY.get(fingerprint(paths))) is not None:
        return exact
    held = [(len(p), k) for k, v in LAYOUTS.items() if set(p := layout_paths(v)) <= paths]
    if not held:
        raise ValueError(f"no mapping for a record with the fields {sorted(paths)}")
    most = max(n for n, _ in held)
    return next(k for n, k in held if n == most)


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(names[role], role, F.lit(""))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def turns_of(layout: str) -> Column:
    """Canonical turns of a record by the named mapping."""
    spec = LAYOUTS[layout]
    if "list" in spec:
        empty = F.array().cast("array<struct<role:string,text:string>>")
        rows = F.col(spec["list"])
        if "order" in spec:
            rows = F.array_sort(F.transform(rows, lambda m: F.struct(m[spec["order"]].alias("o"), _text(m[spec["role"]]).alias("role"), _text(m[spec["text"]]).alias("text"))))
            return F.coalesce(F.transform(rows, lambda m: F.struct(_role(m["role"]).alias("role"), m["text"].alias("text"))), empty)
        return F.coalesce(F.transform(rows, lambda m: F.struct(_role(m[spec["role"]]).alias("role"), _text(m[spec["text"]]).alias("text"))), empty)
    made = []
    for role, parts, optional in spec["fields"]:
        present = [F.when(_text(F.col(p)) != "", F.col(p).cast("string")) for p in parts]
        turn = F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *present).alias("text"))
        made.append(F.when(_text(F.col(parts[0])) != "", turn) if optional else turn)
    return F.filter(F.array(*made), lambda m: m.isNotNull())


def gather_rows(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn to one record a conversation, in the layout ``turn_rows``. A conversation is one output value, so
    that its turns meet in one row; nothing else is gathered."""
    row = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return df.groupBy(F.col(key).alias(key)).agg(F.collect_list(row).alias("conversation"))


def canonical(df: DataFrame, keys: Iterable[str] = ("conv_id",)) -> DataFrame:
    """Keys and canonical ``turns`` of every record; the mapping is chosen by the schema's fingerprint."""
    keys = list(keys)
    return df.select(*keys, turns_of(select_layout(df.schema, keys)).alias("turns"))


def escape(text: Column) -> Column:
    """No ``<|`` is left in a text; ``unescape`` undoes it for every text."""
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))


def formatted(turns: Column) -> Column:
    """The template: start mark, role, line end, text, end mark, for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))), "")


def loss_mask(turns: Column) -> Column:
    """Run lengths of the loss mask over the code points of the formatted string: only texts of assistants count."""
    def runs(t: Column) -> Column:
        head = F.length(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")))
        return F.array(
            F.struct(head.cast("long").alias("chars"), F.lit(False).alias("loss")),
            F.struct(F.length(escape(t["text"])).cast("long").alias("chars"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(len(END)).cast("long").alias("chars"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, runs))


def masked_text(text: Column, mask: Column) -> Column:
    """All text of a formatted string under its loss mask, unescaped, in order and with nothing between."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, run: Column) -> Column:
        piece = F.substr(text, s["at"].cast("int"), run["chars"].cast("int"))
        return F.struct((s["at"] + run["chars"]).alias("at"), F.when(run["loss"], F.concat(s["parts"], F.array(unescape(piece)))).otherwise(s["parts"]).alias("parts"))

    return F.aggregate(mask, start, step, lambda s: F.array_join(s["parts"], ""))


def read_back(text: Column) -> Column:
    """Turns read from a formatted string alone."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(
        body,
        lambda p: F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + F.lit(2))).alias("text"),
        ),
    )


def format_chat(df: DataFrame, keys: Iterable[str] = ("conv_id",)) -> DataFrame:
    """Keys, ``turns``, the ``formatted`` string and its ``loss_mask`` for records of any known layout."""
    return canonical(df, keys).withColumn("formatted", formatted(F.col("turns"))).withColumn("loss_mask", loss_mask(F.col("turns")))
