"""Chat formatting by schema fingerprints.

A record of any layout (a prompt, an instruction, a list of messages, one turn) is
reduced to the sorted set of its nested field paths; the hash of that set selects a
declarative mapping that reads canonical (role, text) turns from it. Turns are then
written with control strings, every control string inside a text being escaped
reversibly, and with the character span under the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TURN, HEAD, TAIL = "<s>[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPED = re.compile(r"(?=" + "|".join(map(re.escape, CONTROLS)) + r")[\s\S]|\\")
_UNESCAPED = re.compile(r"\\(?:\\|u\{([0-9a-f]+)\})")
_CHUNK = re.compile(re.escape(TURN) + r"([\s\S]*?)" + re.escape(HEAD) + r"([\s\S]*?)" + re.escape(TAIL))


def escape(text: str) -> str:
    """Writes a backslash twice and the first character of each control string as a code point, so that no control string is left."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\u{{{ord(m[0]):x}}}", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else "\\", text)


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths; all elements of an array share the path ``x[]``. Values, null included, don't count."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How turns are read from records with exactly these field paths.

    each: path of the array whose elements are turns (with role and text paths inside
    an element); or parts: (role, text paths, joined by a blank line) one turn each, a
    part whose texts are all null or empty and not the user's or assistant's gives none.
    """

    name: str
    paths: tuple[str, ...]
    each: str | None = None
    role: str = "role"
    text: str = "text"
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.parts:
            out = []
            for role, paths in self.parts:
                texts = [t for p in paths if (t := _text(_get(record, p)))]
                if texts or role in ("user", "assistant"):
                    out.append((role, "\n\n".join(texts)))
            return out
        items = _get(record, self.each) if self.each else [record]
        named = ((_text(_get(x, self.role)), _text(_get(x, self.text))) for x in items or [])
        return [(self.roles.get(r, r), t) for r, t in named]


def _get(value: object, path: str) -> object:
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


#: Role names of message layouts and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn", ("role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), each="messages", text="content", roles=ROLES),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=ROLES),
    Mapping("instruction", ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction+input", ("instruction", "input", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system+instruction", ("system", "instruction", "output"), parts=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("prompt", ("prompt", "completion"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question", ("question", "answer.text"), parts=(("user", ("question",)), ("assistant", ("answer.text",)))),
)


def format_records(df: DataFrame, record: str, keys: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Formats records, given as JSON strings in the column record, turn by turn, without a shuffle.

    Returns keys plus ord (int, from 0 in a record), fingerprint, layout, formatted (one
    turn with its control strings), loss_start and loss_end (code points in formatted;
    equal outside assistant turns). A record whose fingerprint has no mapping, null and
    what isn't a JSON object included, gives one row with null layout and formatted, so
    that nothing is lost silently; a mapped record without turns gives no row.
    """
    by_print = {fingerprint(m.paths): m for m in mappings}
    kept = df.select(*keys, F.col(record).alias("__record"))
    schema = pa.schema([*((k, t) for k, t in _arrow(df, keys)), ("ord", pa.int32()), ("fingerprint", pa.string()), ("layout", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            index: list[int] = []
            for i, raw in enumerate(batch.column("__record").to_pylist()):
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                print_ = fingerprint(field_paths(value)) if isinstance(value, dict) else None
                if (m := by_print.get(print_)) is None:
                    rows.append((0, print_, None, None, None, None))
                    index.append(i)
                    continue
                for k, (role, text) in enumerate(m.turns(value)):
                    head, body = f"{TURN}{escape(role)}{HEAD}", escape(text)
                    end = len(head) + len(body) if role == "assistant" else len(head)
                    rows.append((k, print_, m.name, f"{head}{body}{TAIL}", len(head), end))
                    index.append(i)
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), list(schema.types)[len(keys) :], strict=True)] if rows else [pa.array([], t) for t in list(schema.types)[len(keys) :]]
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *made], schema=schema)

    return kept.mapInArrow(run, ", ".join([*(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys), "ord int, fingerprint string, layout string, formatted string, loss_start long, loss_end long"]))


def _arrow(df: DataFrame, keys: list[str]) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(k, to_arrow_type(df.schema[k].dataType)) for k in keys]


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    if not (m := _CHUNK.fullmatch(formatted)):
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def read_turns(joined: str) -> tuple[list[tuple[str, str]], str]:
    """The (role, text) of all whole turns that a conversation's formatted text starts with, and what is left."""
    out, at = [], 0
    while m := _CHUNK.match(joined, at):
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if joined[at : at + len(TURN)] != TURN[: len(joined) - at]:
        raise ValueError("no turn starts here")
    return out, joined[at:]


def conversation_digests(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Joins formatted turns to conversations, finds the turns in what is joined, and digests each conversation in the order of turn.

    Ties in turn are ordered by ord, then by the formatted text. A null conversation id
    is a conversation. Turns without a layout are left out. The digest of a
    conversation is one hash over its turns in order, so a conversation stays in one
    task, but it is streamed from a sorted shuffle: only the hash states are held,
    however many turns it has.
    """
    rows = formatted.filter("formatted IS NOT NULL").select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("__turn"), "ord", "formatted", "loss_start", "loss_end")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "__turn", "ord", "formatted").drop("__turn", "ord")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, joined = None, ""
        out: list[list] = []
        for batch in slices(batches):
            for conv_id, chunk, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv_id:
                    if state:
                        out.append(state)
                    state, joined = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], ""
                joined += chunk  # what isn't a whole turn yet stays for the next
                turns, joined = read_turns(joined)
                for role, text in turns:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(chunk[start:end])
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += len(chunk)
            if out:
                yield _digested(out, names)
                out = []
        if state:
            yield _digested([state], names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digested(states: list[list], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*((a, b, c.hexdigest(), d, e.hexdigest(), f) for a, b, c, d, e, f in states), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(cols)], names=names)
