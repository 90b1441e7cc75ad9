"""Chat formatting: schema fingerprints pick the mapping that turns a record into canonical turns.

A record is JSON text of any layout. Its fingerprint is the hash of its nested field paths; a fingerprint
selects a declarative ``Mapping``. Turns are then written with a template whose marks cannot occur inside
a text, because the escape is reversible and covers every mark, and read back from the output.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

# The marks of the template.
ESCAPE = "␛"
TURN_OPEN, HEAD_CLOSE, TURN_CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that trainers and servers commonly treat as control tokens; in a text they are broken up.
CONTROL = (TURN_OPEN, HEAD_CLOSE, TURN_CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<unk>", "<pad>")
#: Roles by the names that layouts use for them.
ROLES = {"human": "user", "prompter": "user", "question": "user", "gpt": "assistant", "bot": "assistant",
         "model": "assistant", "answer": "assistant", "instructions": "system"}


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; array elements share the path ``[]``."""
    if isinstance(value, dict):
        return set().union(*({f"{at}.{k}"} | field_paths(v, f"{at}.{k}") for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else set()
    return set()


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """A layout and where its turns are.

    ``turns``: path of a list of messages, with ``role`` and ``text`` inside each; or, where ``turns`` is
    empty, ``parts`` lists (role, path) pairs; a role of ``@path`` is read from the record. ``optional``
    paths may be missing, which gives the layout several fingerprints.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> set[str]:
        sets = [set(self.paths)]
        for extra in self.optional:
            sets += [s | {extra} for s in sets]
        return {fingerprint(s) for s in sets}


#: Layouts known from the start; callers may add their own. The last message layout wins no ties: paths are exact.
LAYOUTS = (
    Mapping("row per turn", (".role", ".text"), parts=(("@role", "text"),), optional=(".conv_id", ".turn")),
    Mapping("messages", (".messages", ".messages[].role", ".messages[].content"), "messages", "role", "content", optional=(".id",)),
    Mapping("from and value", (".conversations", ".conversations[].from", ".conversations[].value"), "conversations", "from", "value", optional=(".id", ".system")),
    Mapping("prompt and response", (".prompt", ".response"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=(".id", ".system")),
    Mapping("prompt and completion", (".prompt", ".completion"), parts=(("user", "prompt"), ("assistant", "completion")), optional=(".id",)),
    Mapping("instruction", (".instruction", ".output"), parts=(("system", "system"), ("user", "instruction+input"), ("assistant", "output")), optional=(".id", ".input", ".system")),
    Mapping("question and answer", (".question", ".answer"), parts=(("user", "question"), ("assistant", "answer")), optional=(".id",)),
)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _role(value) -> str:
    value = _text(value)
    return ROLES.get(value, value)


def apply_mapping(mapping: Mapping, record: dict) -> Iterator[tuple[str, str]]:
    """(role, text) per turn; null texts are empty. Optional parts that are missing or empty make no turn."""
    if mapping.turns:
        if record.get("system"):
            yield "system", _text(record["system"])
        for message in record[mapping.turns] or ():
            yield _role(message[mapping.role]), _text(message[mapping.text])
        return
    for role, path in mapping.parts:
        names = path.split("+")
        if all(f".{n}" in mapping.optional for n in names) and not any(record.get(n) for n in names):
            continue
        said = "\n\n".join(_text(record.get(n)) for n in names if n == names[0] or record.get(n))
        yield (_role(record.get(role[1:])) if role[0] == "@" else role), said


def escape(text: str) -> str:
    """Put the escape sign behind the first character of every control string, and double the sign itself."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for mark in CONTROL:
        text = text.replace(mark, f"{mark[0]}{ESCAPE}.{mark[1:]}")
    return text


def unescape(text: str) -> str:
    out, at = [], 0
    while (found := text.find(ESCAPE, at)) >= 0:
        out.append(text[at:found])
        if text[found + 1] == ESCAPE:
            out.append(ESCAPE)
        at = found + 2
    return "".join(out) + text[at:]


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its loss mask begins and ends (code points; equal where nothing is learned)."""
    head, body = f"{TURN_OPEN}{escape(role)}{HEAD_CLOSE}", escape(text)
    whole = f"{head}{body}{TURN_CLOSE}\n"
    return whole, len(head), len(head) + (len(body) if role == "assistant" else 0)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text out of one formatted turn."""
    head, _, rest = formatted.removeprefix(TURN_OPEN).partition(HEAD_CLOSE)
    return unescape(head), unescape(rest[: -len(TURN_CLOSE) - 1])


FORMATTED = "part int, layout string, formatted string, loss_from int, loss_to int"


def format_records(records: DataFrame, record: str, keys: list[str], layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """One row per turn of each record: ``keys`` and ``part``, ``layout``, ``formatted``, ``loss_from``, ``loss_to``.

    ``part`` numbers the turns of a record from 0. A conversation's output is its rows' ``formatted`` in
    the order of ``keys`` and ``part``, so a conversation of any length never stands in one value. A
    record whose fingerprint no layout has, or that is no JSON object, gives one row with a null
    ``formatted`` and its fingerprint as ``layout``: nothing is lost silently. Null records likewise. Only
    ``keys`` and the record are read, so other columns may have any name.
    """
    chosen = {f: m for m in layouts for f in m.fingerprints()}
    fields = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            rows, out = [], {"part": [], "layout": [], "formatted": [], "loss_from": [], "loss_to": []}
            for row, raw in enumerate(batch.column(len(keys)).to_pylist()):
                for part, layout, made in _record_turns(raw, chosen):
                    rows.append(row)
                    for name, value in zip(out, (part, layout, *made)):
                        out[name].append(value)
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(keys)]]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(v, t) for v, t in zip(out.values(), kinds))], [*keys, *out])

    return records.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{record}`").alias("_record")).mapInArrow(run, f"{fields}, {FORMATTED}")


def _record_turns(raw: str | None, chosen: dict[str, Mapping]):
    try:
        value = json.loads(raw) if raw is not None else None
    except ValueError:
        value = None
    print_ = fingerprint(field_paths(value)) if isinstance(value, dict) else "unreadable"
    mapping = chosen.get(print_)
    if mapping is None:
        yield 0, print_, (None, None, None)
        return
    for part, (role, text) in enumerate(apply_mapping(mapping, value)):
        yield part, mapping.name, format_turn(role, text)


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(formatted: DataFrame, conversation: str, order: list[str]) -> DataFrame:
    """Per conversation what its formatted rows read back as: counts and hashes of turns and of the learned text.

    Rows are dealt by conversation and sorted in their task; the task streams over them with running
    hashes, so that a conversation of any length takes the memory of one row. ``formatted`` rows that are
    null (unknown layouts) do not count. Null conversations form one. The key may be of any type that can be sorted.
    """
    key = formatted.schema[conversation].dataType

    def run(batches):
        current, state = None, None
        for batch in batches:
            done = []
            for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, *state.result()))
                    current, state = conv, _Running()
                state.add(text, start, end)
            yield _digest_batch(done, schema)
        if state is not None:
            yield _digest_batch([(current, *state.result())], schema)

    schema = pa.schema([(conversation, to_arrow_type(key)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return (formatted.filter(F.col("formatted").isNotNull()).repartition(F.col(conversation)).sortWithinPartitions(conversation, *order)
            .select(conversation, "formatted", "loss_from", "loss_to").mapInArrow(run, f"`{conversation}` {key.simpleString()}, {DIGEST}"))


def _digest_batch(rows, schema):
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


class _Running:
    """Running digests over the turns of one conversation, read back from the formatted rows."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, start: int, end: int) -> None:
        role, text = read_turn(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        learned = unescape(formatted[start:end])
        self.loss.update(learned.encode())
        self.n, self.loss_chars, self.chars = self.n + 1, self.loss_chars + len(learned), self.chars + len(formatted)

    def result(self):
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
