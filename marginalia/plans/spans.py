"""Queries on patterns of typed spans, over the words of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as pt
from ..operators import tokens as tk
from ..session import table
from .text import CAP, LOW, SQL_TOKENS

C = F.col
#: An enumeration: a capitalised word, maybe a second one, a comma, and a word in lower case.
OPTIONAL = "<cap> <cap>? ',' <low>"
#: A list: a word in lower case, and words that follow by commas.
REPEATED = "<low> (',' <low>)+"


def typed(s, d):
    """(spans, tokens): capitalised and lower-case words of all documents, and their tokens."""
    toks = tk.tokens(table(s, d, "documents").select("doc_id", "text"))
    kind = F.when(C("tok").rlike(CAP), "cap").when(C("tok").rlike(LOW), "low")
    return toks.select("doc_id", C("pos").alias("start"), (C("pos") + 1).alias("end"), kind.alias("type")).filter("type IS NOT NULL"), toks


def found(pattern, longest=False):
    return lambda s, d: pt.matches(*typed(s, d), pattern, longest=longest)


W = f"{SQL_TOKENS}, k AS (SELECT doc_id, pos, CASE WHEN tok = ',' THEN ',' WHEN regexp_matches(tok, '{CAP}') THEN 'C' WHEN regexp_matches(tok, '{LOW}') THEN 'l' ELSE '.' END AS k FROM tok), w AS (SELECT *, lead(k) OVER o AS b, lead(k, 2) OVER o AS c, lead(k, 3) OVER o AS d FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"
#: A list goes on at every second token: runs of pairs of a comma and a word, told apart by the parity of their places.
RUNS = f"""{W}, p AS (SELECT doc_id, pos FROM w WHERE k = ',' AND b = 'l'), g AS (SELECT doc_id, pos, pos - 2 * row_number() OVER (PARTITION BY doc_id, pos % 2 ORDER BY pos) AS run FROM p),
f AS (SELECT doc_id, pos FROM w WHERE k = 'l' AND b = ',' AND c = 'l'), a AS (SELECT f.doc_id, f.pos, run FROM f JOIN g ON g.doc_id = f.doc_id AND g.pos = f.pos + 1)"""

QUERIES = {
    "k4_optional": (found(OPTIONAL), f"WITH {W} SELECT doc_id, pos AS start, pos + 3 AS \"end\" FROM w WHERE k = 'C' AND b = ',' AND c = 'l' UNION ALL SELECT doc_id, pos, pos + 4 FROM w WHERE k = 'C' AND b = 'C' AND c = ',' AND d = 'l'"),
    "k4_repeated": (found(REPEATED), f"WITH {RUNS} SELECT a.doc_id, a.pos AS start, g.pos + 2 AS \"end\" FROM a JOIN g ON g.doc_id = a.doc_id AND g.run = a.run AND g.pos % 2 = (a.pos + 1) % 2 AND g.pos > a.pos"),
    "k4_longest": (found(REPEATED, longest=True), f"WITH {RUNS} SELECT a.doc_id, a.pos AS start, max(g.pos) + 2 AS \"end\" FROM a JOIN g ON g.doc_id = a.doc_id AND g.run = a.run AND g.pos % 2 = (a.pos + 1) % 2 AND g.pos > a.pos GROUP BY ALL"),
}
