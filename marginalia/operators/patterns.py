"""Patterns over typed spans and literal tokens, as `<last> (<stop>|',')* <last>`, matched in one ordered pass over a document.

A pattern is compiled to its position automaton: a state for each `<type>` or 'literal' in it, and
which may follow which. Spans, and those tokens that are literals of the pattern, are steps from
their start to their end. Sorted by start, they are taken one after the other, and for each place
it is known where matches that reach it began, and in which states. There is no join for a part
of the pattern, and what a task holds is what spans reach beyond the place where it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"""\s*(?:<(?P<type>[^<>]+)>|'(?P<one>[^']+)'|"(?P<two>[^"]+)"|(?P<sign>[()|?*+]))""")


@dataclass
class Automaton:
    """Sets of states are bits of a number. labels: the states of each label; types begin with "<", literals with "'"."""

    labels: dict[str, int] = field(default_factory=dict)
    follow: list[int] = field(default_factory=list)
    first: int = 0
    last: int = 0
    nullable: bool = False

    def literals(self) -> list[str]:
        return [k[1:] for k in self.labels if k[0] == "'"]

    def types(self) -> list[str]:
        return [k[1:] for k in self.labels if k[0] == "<"]


def compiled(pattern: str) -> Automaton:
    """The automaton of a pattern of <types>, 'literals', groups, alternatives (|), and the signs ?, * and +. One that matches nothing but emptiness is an error."""
    parts: list[tuple[str, str]] = []
    at = 0
    while pattern[at:].strip():
        m = _PART.match(pattern, at)
        if not m:
            raise ValueError(f"not a pattern from {pattern[at:]!r} on")
        parts.append(("sign", m["sign"]) if m["sign"] else ("label", f"<{m['type']}" if m["type"] else f"'{m['one'] or m['two']}"))
        at = m.end()
    made, place = Automaton(), 0

    def link(a: int, b: int) -> None:
        for q in range(len(made.follow)):
            if a >> q & 1:
                made.follow[q] |= b

    def either() -> tuple[int, int, bool]:
        nonlocal place
        first, last, empty = row()
        while place < len(parts) and parts[place] == ("sign", "|"):
            place += 1
            f, la, e = row()
            first, last, empty = first | f, last | la, empty or e
        return first, last, empty

    def row() -> tuple[int, int, bool]:
        first, last, empty = 0, 0, True
        while place < len(parts) and parts[place] not in (("sign", "|"), ("sign", ")")):
            f, la, e = repeated()
            link(last, f)
            first, last, empty = first | (f if empty else 0), la | (last if e else 0), empty and e
        return first, last, empty

    def repeated() -> tuple[int, int, bool]:
        nonlocal place
        kind, value = parts[place]
        place += 1
        if kind == "label":
            state = 1 << len(made.follow)
            made.follow.append(0)
            made.labels[value] = made.labels.get(value, 0) | state
            first, last, empty = state, state, False
        elif value == "(":
            first, last, empty = either()
            if place >= len(parts) or parts[place] != ("sign", ")"):
                raise ValueError("a group isn't closed")
            place += 1
        else:
            raise ValueError(f"nothing stands before {value!r}")
        while place < len(parts) and parts[place] in (("sign", "?"), ("sign", "*"), ("sign", "+")):
            sign = parts[place][1]
            place += 1
            if sign != "?":
                link(last, first)
            empty = empty or sign != "+"
        return first, last, empty

    made.first, made.last, made.nullable = either()
    if place < len(parts):
        raise ValueError("a group is closed that wasn't opened")
    if not made.first:
        raise ValueError("an empty pattern")
    return made


def steps_of(spans: DataFrame, tokens: DataFrame, automaton: Automaton, key: str = "doc_id") -> DataFrame:
    """(key, start, end, label): spans of the pattern's types, and tokens that are its literals."""
    typed = spans.filter(F.col("type").isin(automaton.types())).select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.concat(F.lit("<"), "type").alias("label"))
    said = tokens.filter(F.col("tok").isin(automaton.literals())).select(key, F.col("pos").cast("long").alias("start"), (F.col("pos") + 1).cast("long").alias("end"), F.concat(F.lit("'"), "tok").alias("label"))
    return typed.unionByName(said).filter("end > start")


def matches(spans: DataFrame, tokens: DataFrame, pattern: str, key: str = "doc_id", longest: bool = False) -> DataFrame:
    """(key, start, end): all different matches of the pattern, of spans (key, start, end, type) and tokens (key, pos, tok); or of those that begin at a place only the longest.

    A pattern that may be empty has no empty matches. Spans with a null in any of these columns, or
    without a token, take no part. Repeated spans count once. One shuffle, by document.
    """
    automaton = compiled(pattern)
    steps = steps_of(spans, tokens, automaton, key).dropna().repartition(key).sortWithinPartitions(key, "start")
    kind = spans.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, None
        for batch in batches:
            rows: list[tuple] = []
            for doc, start, end, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found is None or doc != now:
                    rows += _told(now, found, None, longest)
                    now, found = doc, _Pass(automaton)
                rows += _told(now, found, start, longest)
                found.step(start, end, automaton.labels[label])
            yield _batch(rows, batch.schema.field(0))
            schema = batch.schema.field(0)
        if found is not None:
            yield _batch(_told(now, found, None, longest), schema)

    return steps.select(key, "start", "end", "label").mapInArrow(run, f"`{key}` {kind.simpleString()}, start long, end long")


class _Pass:
    """One document: for each place that steps reach, where matches began that are there, and their states."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.active: dict[int, dict[int, int]] = {}
        self.ended: dict[int, set[int]] = {}

    def step(self, start: int, end: int, states: int) -> None:
        a = self.automaton
        here = self.active.get(start, {})
        reached = {}
        for begin, mask in here.items():
            after = 0
            while mask:
                low = mask & -mask
                after |= a.follow[low.bit_length() - 1]
                mask ^= low
            if after & states:
                reached[begin] = after & states
        if a.first & states:
            reached[start] = reached.get(start, 0) | a.first & states
        there = self.active.setdefault(end, {})
        for begin, mask in reached.items():
            there[begin] = there.get(begin, 0) | mask
            if mask & a.last:
                self.ended.setdefault(begin, set()).add(end)

    def leave(self, start: int | None, longest: bool) -> list[tuple[int, int]]:
        """The matches that no step from start on can add to; forgets the places before it."""
        if start is not None and not any(p < start for p in self.active):
            return []
        self.active = {p: x for p, x in self.active.items() if start is not None and p >= start}
        alive = {b for x in self.active.values() for b in x}
        done = [b for b in self.ended if b not in alive]
        return [(b, e) for b in done for ends in (self.ended.pop(b),) for e in ([max(ends)] if longest else sorted(ends))]


def _told(doc, found: _Pass | None, start: int | None, longest: bool) -> list[tuple]:  # noqa: ANN001
    return [(doc, *m) for m in found.leave(start, longest)] if found else []


def _batch(rows: list[tuple], first: pa.Field) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (first.type, pa.int64(), pa.int64()), strict=True)], names=[first.name, "start", "end"])
