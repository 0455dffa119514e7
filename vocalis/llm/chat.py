"""Chat formatting: layouts recognised by a hash of their nested field paths, one canonical template.

A layout is declared as data: the field paths it requires, those it may have, and where its turns, roles and
texts are. The fingerprint of a row (or of a DataFrame's schema) is the hash of those of its paths that any
layout declares, so all other fields do not matter. A fingerprint leads to one mapping: of the layouts whose
required paths are all there, the one that declares most of what is there, the first declared among equals.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = T.ArrayType(T.StructType().add("role", "string").add("text", "string"))

# Role names of known layouts and the canonical role of each.
ROLES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "model": "assistant", "system": "system", "tool": "tool"}


@dataclass(frozen=True)
class Layout:
    """single: (role, field) pairs in order; or `turns` with its role and text fields and a `before` turn of (role, field).

    optional: fields of `single` that may be absent; where one is absent, null or empty it gives no text.
    """

    name: str
    single: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    before: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[frozenset[str], ...]:
        """Sets of paths of each of which one must be there."""
        if self.turns:
            # A list without elements has no field to show; a text may be a list of parts.
            empty, text = f"{self.turns}[]", f"{self.turns}[].{self.text}"
            return (frozenset({f"{empty}.{self.role}", empty}), frozenset({text, f"{text}[]", f"{text}[].text", empty}))
        if self.role:
            return (frozenset({self.role}), frozenset({self.text}))
        return tuple(frozenset({f}) for _, f in self.single if f not in self.optional)

    @property
    def paths(self) -> frozenset[str]:
        return frozenset().union(*self.required, self.optional, (f for _, f in self.before))


_SYSTEM = (("system", "system"),)
# Layouts of the same fields stand in order of how common they are.
LAYOUTS = (
    Layout("messages", turns="messages", role="role", text="content", before=_SYSTEM),
    Layout("message_text", turns="messages", role="role", text="text", before=_SYSTEM),
    Layout("sharing", turns="conversations", role="from", text="value", before=_SYSTEM),
    Layout("sharing_roles", turns="conversations", role="role", text="content", before=_SYSTEM),
    Layout("dialog", turns="turns", role="speaker", text="text", before=_SYSTEM),
    Layout("instruction", (*_SYSTEM, ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("instruction_response", (*_SYSTEM, ("user", "instruction"), ("user", "context"), ("assistant", "response")), optional=("system", "context")),
    Layout("prompt", (*_SYSTEM, ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("prompt_response", (*_SYSTEM, ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question", (*_SYSTEM, ("user", "context"), ("user", "question"), ("assistant", "answer")), optional=("system", "context")),
)
#: Of tables with a row a turn.
TURN_ROWS = Layout("turn_rows", role="role", text="text")
_KNOWN = frozenset(p for x in LAYOUTS for p in x.paths)


def fingerprint(paths: frozenset[str] | set[str]) -> str:
    """Hash of the declared field paths among those given."""
    return hashlib.sha256("\n".join(sorted(_KNOWN & set(paths))).encode()).hexdigest()


_BY_FINGERPRINT: dict[str, Layout | None] = {}


def layout_of(paths: frozenset[str] | set[str]) -> Layout | None:
    """The mapping that the fingerprint of these paths leads to, None if no layout has all it requires."""
    print_ = fingerprint(paths)
    if print_ not in _BY_FINGERPRINT:
        fit = [x for x in LAYOUTS if all(r & paths for r in x.required)]
        _BY_FINGERPRINT[print_] = max(fit, key=lambda x: len(x.paths & paths), default=None)
    return _BY_FINGERPRINT[print_]


def value_paths(value: object, prefix: str = "") -> set[str]:
    """Field paths of a parsed JSON value; elements of a list share one path."""
    found, todo = set(), [(value, prefix)]
    while todo:
        v, at = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                p = f"{at}.{k}" if at else k
                if not isinstance(x, (dict, list)):
                    found.add(p)
                todo.append((x, p))
        elif isinstance(v, list):
            if not all(isinstance(x, (dict, list)) for x in v) or not v:
                found.add(f"{at}[]")
            todo += [(x, f"{at}[]") for x in v]
    return found


def schema_paths(schema: T.DataType, prefix: str = "") -> set[str]:
    """Field paths of a DataFrame's schema, in the same form."""
    if isinstance(schema, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in schema.fields)) if schema.fields else set()
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return {prefix}


def _text(x: object) -> str:
    """A text field's value; of a list of parts, the texts of those that have one."""
    if isinstance(x, list):
        return "".join(y if isinstance(y, str) else _text(y.get("text")) if isinstance(y, dict) else "" for y in x)
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True)


def turns_of(value: object) -> tuple[str | None, list[dict] | None]:
    """The layout's name and canonical turns of one parsed row; None and None if no layout fits."""
    layout = layout_of(value_paths(value)) if isinstance(value, dict) else None
    if layout is None:
        return None, None
    turns: list[dict] = []
    for role, field in (*layout.before, *layout.single):
        text = _text(value.get(field))
        if not text and (layout.before or field in layout.optional):
            continue
        if turns and turns[-1]["role"] == role:
            turns[-1]["text"] += "\n\n" + text
        else:
            turns.append({"role": role, "text": text})
    if layout.turns:
        rows = value.get(layout.turns)
        for x in rows if isinstance(rows, list) else []:
            if isinstance(x, dict):
                role = _text(x.get(layout.role))
                turns.append({"role": ROLES.get(role.lower(), role), "text": _text(x.get(layout.text))})
    return layout.name, turns


def _json_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, turns = [], []
        for x in batch.column(1):
            try:
                value = json.loads(x.as_py() or "null")
            except ValueError:
                value = None
            name, own = turns_of(value)
            names.append(name)
            turns.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))], ["conv_id", "layout", "turns"])


def canonical_turns(rows: DataFrame, id_col: str = "conv_id", json_col: str | None = None, turn_col: str = "turn") -> DataFrame:
    """conv_id long, layout string, turns array<struct<role,text>>.

    With json_col, each row is one JSON conversation of any declared layout; a null, malformed or
    unknown one keeps its row with null layout and turns, an empty list of turns gives no turns. Without
    it, the schema must have the paths of one row a turn, whatever else it has: rows are grouped by id_col
    and put in order of turn_col, then role, then text (so repeated rows stay, side by side); a
    conversation's turns must fit in a task. Null roles and texts are empty; a null id is one
    conversation of its own; no rows give no rows; other columns are not read.
    """
    if json_col:
        return rows.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(_json_turns, T.StructType().add("conv_id", "long").add("layout", "string").add("turns", TURNS))
    layout = TURN_ROWS
    if not all(r & schema_paths(rows.schema) for r in layout.required):
        raise ValueError(f"no declared layout has the fields {sorted(schema_paths(rows.schema))}")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (layout.role, layout.text))
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    grouped = rows.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.lit(layout.name).alias("layout"), F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


# The template. Neither mark can appear in an escaped text.
OPEN, CLOSE = "### ", "</turn>\n"


def escape(text: str) -> str:
    """Reversible: afterwards no two # are neighbours and "</turn>" is absent."""
    return re.sub("#(?=#)", "#\\\\", text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>"))


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and [start, end) in code points of each assistant text in it."""
    out, mask, at = [], [], 0
    for t in turns:
        head = OPEN + escape(t["role"]).replace("\n", "\\\n") + "\n"
        body = escape(t["text"])
        if t["role"] == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask


_HEAD = re.compile(r"(?s)((?:[^\\\n]|\\.)*)\n")


def parse(formatted: str) -> list[dict]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        head = _HEAD.match(part, len(OPEN))
        turns.append({"role": unescape(head[1]), "text": unescape(part[head.end() :])})
    return turns


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [(None, None) if x is None else render(x) for x in batch.column("turns").to_pylist()]
        spans = [None if m is None else [{"start": a, "end": b} for a, b in m] for _, m in done]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array(spans, _SPANS)], [*batch.schema.names, "formatted", "loss_spans"])


def format_chat(turns: DataFrame) -> DataFrame:
    """canonical_turns' rows with `formatted string` and `loss_spans array<struct<start,end>>`.

    Spans are code points of `formatted` and cover each assistant text, nothing else. Null turns give
    null in both; a conversation without turns gives an empty string and no spans. Other columns stay;
    ones that bear one of the two names are replaced; repeated rows stay; no rows give no rows.
    """
    turns = turns.drop("formatted", "loss_spans")
    schema = T.StructType([*turns.schema.fields]).add("formatted", "string").add("loss_spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    return turns.mapInArrow(_format, schema)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            digest = hashlib.sha256("".join(f"{t['role']}\n{t['text']}\n" for t in turns).encode())
            out.append((conv, len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest columns of the contract, parsed from the formatted text and its loss mask.

    Rows without a formatted text have none; an empty one has no turns; repeated rows stay; other columns
    are not read; no rows give no rows.
    """
    return formatted.where("formatted IS NOT NULL").select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
