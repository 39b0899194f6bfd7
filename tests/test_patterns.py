"""Patterns over spans, against all paths."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from marginalia.operators import patterns as pt


def brute(edges, pattern):
    """All (start, end) of paths whose labels, as letters, match the pattern as a regular expression."""
    letters = {k: chr(97 + i) for i, k in enumerate(sorted({x for _, _, x in edges} | set(re.findall(r"<(\w+)>|'(.)'", pattern) and [a and f"<{a}" or f"'{b}" for a, b in re.findall(r"<(\w+)>|'(.)'", pattern)])))}
    text = re.sub(r"<(\w+)>|'(.)'", lambda m: letters[f"<{m[1]}" if m[1] else f"'{m[2]}"], pattern).replace(" ", "")
    full = re.compile(text)
    out, todo = set(), [(s, e, letters[x]) for s, e, x in edges]
    seen = set(todo)
    while todo:
        s, e, said = todo.pop()
        if full.fullmatch(said):
            out.add((s, e))
        for a, b, x in edges:
            if a == e and len(said) < 7 and (new := (s, b, said + letters[x])) not in seen:
                seen.add(new)
                todo.append(new)
    return out


PATTERNS = ["<a> <b>? ',' <c>", "<a> (',' <c>)+", "<a>", "(<a>|<b> <c>)* ','", "<a> <b>* <a>", "(<a> ('.' <b>)?)+ <c>?", "','? <a>? <b>"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_against_all_paths(spark, pattern):
    rng = random.Random(pattern)
    spans, tokens, want, most = [], [], Counter(), {}
    for doc in range(12):
        toks = [rng.choice([",", ".", "w"]) for _ in range(7)]
        own = {(s, s + rng.choice([1, 1, 2]), rng.choice("abc")) for s in range(7) for _ in range(rng.randint(0, 2))}
        tokens += [(doc, i, t) for i, t in enumerate(toks)]
        spans += [(doc, *x) for x in own] + [(doc, *x) for x in list(own)[:1]]
        found = brute([(s, e, f"<{t}") for s, e, t in own] + [(i, i + 1, f"'{t}") for i, t in enumerate(toks)], pattern)
        want.update((doc, *x) for x in found)
        for s, e in found:
            most[doc, s] = max(e, most.get((doc, s), 0))
    spans += [(1, None, 3, "a"), (None, 1, 2, "a"), (1, 3, 3, "a"), (2, 1, 2, None)]
    df = spark.createDataFrame(spans, "doc_id int, start int, end int, type string").repartition(3)
    toks = spark.createDataFrame(tokens, "doc_id int, pos int, tok string")
    assert Counter(tuple(r) for r in pt.matches(df, toks, pattern).collect()) == want
    assert {((r.doc_id, r.start), r.end) for r in pt.matches(df, toks, pattern, longest=True).collect()} == set(most.items())


def test_what_is_no_pattern():
    for bad in ("", "<a> (", "<a> )", "? <a>", "a", "<a> | | *", "()"):
        with pytest.raises(ValueError, match="."):
            pt.compiled(bad)


def test_empty_tables(spark):
    spans, tokens = spark.createDataFrame([], "doc_id string, start int, end int, type string"), spark.createDataFrame([], "doc_id string, pos int, tok string")
    assert pt.matches(spans, tokens, "<a> ','").collect() == []
