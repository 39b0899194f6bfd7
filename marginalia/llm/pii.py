"""Personal data: base patterns, and contextual extraction that is bootstrapped from them.

What the base patterns find are seeds. The words around the seeds are lexical patterns;
patterns and the strings that they surround, identifier-like strings that the base
patterns miss among them, form a graph, on which Spark scores both sides in turn: a
pattern by how much of what it surrounds is trusted, a string by the patterns that
surround it. Patterns of high confidence and support then mark further identifiers.

What is written between the steps holds no identifier: strings are kept as hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

KINDS = ("email", "ip", "card", "phone")
#: Least confidence and least number of different trusted strings of a pattern; most patterns that are told to all tasks, more are joined.
CONFIDENT, SUPPORT, MOST_PATTERNS = 0.9, 5, 100_000
#: Rounds go on until no confident pattern is new and no confidence grows by more than this. Scores only grow, so that comes.
GROWTH = 1e-6
#: Words of a context that are longer are told apart by a hash of the whole word.
LONG_WORD = 40
#: What a string that isn't a seed can be trusted at most.
TRUST = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match starts where a run of digits does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = ".,;:!?\"'`()[]{}<>|*#&$=_-"
_FOUR = re.compile(r"[0-9]{1,3}(?:[.,:-][0-9]{1,3}){3}")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by kind, then start; what fails its test is dropped without another try.

    An e-mail address is sought from each @, its local part reaching back as far as the
    last match or @, which finds what its pattern finds, in time linear in the text.
    """
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        local = text[free:at]
        start = free + len(local.rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _shape(word: str) -> int:
    """The kind that a string without a base match looks like; -1: another identifier; -2: none."""
    digits = len(_NOT_DIGIT.sub("", word))
    if "@" in word[1:-1]:
        return 0
    if _FOUR.fullmatch(word):
        return 1
    if digits < 4 or len(word) < 6:
        return -2
    if digits >= len(word) - 4:
        return 2 if 13 <= digits <= 19 else 3 if 7 <= digits <= 12 else -1
    return -1


def mentions(text: str, spans: list[Span]) -> list[tuple[int, int, int, bool, list[str]]]:
    """(kind, start, end, seed, contexts) of the seeds and of other identifier-like strings; kind -1: of no kind.

    Contexts are the one and two words before, and the word before with the one after.
    """
    found = [(k, a, b, True) for k, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    at = 0
    for a, b in words:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:
            continue
        raw = text[a:b]
        if any(c in "0123456789@" for c in raw):
            word = raw.strip(_TRIM)
            start = a + len(raw) - len(raw.lstrip(_TRIM))
            if (kind := _shape(word)) > -2:
                found.append((kind, start, start + len(word), False))
    starts, ends = [a for a, _ in words], [b for _, b in words]
    from bisect import bisect_left, bisect_right

    out = []
    for kind, a, b, seed in found:
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        glued = starts[i] < a and text[starts[i] : a].strip(_TRIM) if i < len(starts) else ""
        left = [text[x:y].lower().strip(_TRIM) for x, y in words[max(0, i - 2) : i]] + ([glued.lower()] if glued else [])
        right = text[slice(*words[j])].lower().strip(_TRIM) if j < len(words) else ""
        left = [_short(w) for w in left if w][-2:]
        contexts = []
        if left:
            contexts = [f"1 {left[-1]}", f"r {left[-1]} _ {_short(right)}"] + ([f"2 {' '.join(left)}"] if len(left) == 2 else [])
        out.append((kind, a, b, seed, contexts))
    return out


def _short(word: str) -> str:
    return word if len(word) <= LONG_WORD else f"{word[:8]}#{hashlib.sha256(word.encode('utf-8', 'surrogatepass')).hexdigest()[:24]}"


def _hash(surface: str) -> int:
    return int.from_bytes(hashlib.blake2b(surface.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("string", pa.int64()), ("contexts", pa.list_(pa.string()))])
_MENTION_SQL = "array<struct<kind:int,start:bigint,end:bigint,seed:boolean,string:bigint,contexts:array<string>>>"


def _found(column: pa.Array) -> Iterator[tuple[list[Span], list[dict]]]:
    """Base spans and mentions of each text; a text without a digit or @ has none."""
    texts = column.cast(pa.large_string())
    some = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False).to_pylist()
    for has, value in zip(some, texts, strict=True):
        if not has:
            yield [], []
            continue
        text = value.as_py()
        spans = base_spans(text)
        yield spans, [{"kind": k, "start": a, "end": b, "seed": s, "string": _hash(text[a:b]), "contexts": c} for k, a, b, s, c in mentions(text, spans)]


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, spans, mentions) for each whole text, and also these columns of longs; spans are base spans "kind:start:end"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = list(_found(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([told(s) for s, _ in pairs], pa.string()), pa.array([m for _, m in pairs], pa.list_(_MENTION)), *batch.columns[2:]], names=["doc_id", "spans", "mentions", *also])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *also).mapInArrow(run, ", ".join([f"doc_id long, spans string, mentions {_MENTION_SQL}", *(f"{c} long" for c in also)]))


def told(spans: list[Span]) -> str:
    """Spans as text, by kind, then start."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


@dataclass(frozen=True)
class Patterns:
    """Confident lexical patterns: which kind a context announces."""

    kinds: dict[str, frozenset[int]]

    def further(self, found: list[dict]) -> list[Span]:
        """Of a text's mentions, those that aren't seeds and stand in a context that announces their kind."""
        return [(m["kind"], m["start"], m["end"]) for m in found if not m["seed"] and m["kind"] >= 0 and any(m["kind"] in self.kinds.get(c, ()) for c in m["contexts"])]


def bootstrap(extracted: DataFrame) -> DataFrame:
    """Scores patterns and strings on their graph in rounds and returns all confident patterns (context, kind).

    A pattern's confidence for a kind is the trust in the strings of that kind that it
    surrounds, over their number and that of its strings of other kinds or none. Strings of
    the kind that nothing is known of yet don't count against it, or nothing new could be
    found, but they may not outnumber the trusted ones.

    Edges are distinct (context, string, kind); all rounds aggregate them by one side and
    join the few scored rows of the other, so a context that a third of all mentions share
    is pre-aggregated before each shuffle.
    """
    each = extracted.select(F.explode("mentions").alias("m")).select("m.*").select("kind", "seed", "string", F.explode("contexts").alias("context"))
    edges = materialise(each.groupBy("context", "string", "kind").agg(F.max("seed").alias("seed")), "edges")
    size = edges.groupBy("context").agg(F.count("*").alias("size"))
    own = edges.filter("kind >= 0")
    like = own.groupBy("context", "kind").agg(F.count("*").alias("alike"))
    seeds = own.filter("seed").select("string", "kind").distinct().withColumn("trust", F.lit(1.0))
    trusted, before = seeds, None
    while True:
        score = own.join(trusted, ["string", "kind"]).groupBy("context", "kind").agg(F.sum("trust").alias("trust"), F.count("*").alias("support"))
        scored = score.filter(F.col("support") >= SUPPORT).join(like, ["context", "kind"]).join(size, "context").filter(F.col("alike") <= 2 * F.col("support"))
        confidence = F.col("trust") / (F.col("support") + F.col("size") - F.col("alike"))
        confident = materialise(scored.withColumn("confidence", confidence).filter(F.col("confidence") >= CONFIDENT), "patterns")
        more = confident
        if before is not None:
            was = before.select("context", "kind", F.col("confidence").alias("was"))
            more = confident.join(was, ["context", "kind"], "left").filter(F.col("was").isNull() | (F.col("confidence") > F.col("was") + GROWTH))
        if not more.limit(1).count():
            return confident.select("context", "kind")
        before = confident
        doubt = F.exp(F.sum(F.log(1 - TRUST * F.col("confidence"))))
        found = own.filter("NOT seed").join(confident.select("context", "kind", "confidence"), ["context", "kind"]).groupBy("string", "kind").agg((1 - doubt).alias("trust"))
        trusted = materialise(seeds.unionByName(found).groupBy("string", "kind").agg(F.max("trust").alias("trust")), "trusted")


def told_patterns(patterns: DataFrame) -> Patterns | None:
    """The patterns, to tell all tasks; None if there are more than MOST_PATTERNS, which announced() joins."""
    rows = patterns.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        return None
    kinds: dict[str, set[int]] = {}
    for r in rows:
        kinds.setdefault(r.context, set()).add(r.kind)
    return Patterns({k: frozenset(v) for k, v in kinds.items()})


def announced(extracted: DataFrame, patterns: DataFrame, by: list[str]) -> DataFrame:
    """by and further: what Patterns.further gives, by a join of the mentions' contexts; only where there is something."""
    each = extracted.select(*by, F.explode("mentions").alias("m")).filter("NOT m.seed AND m.kind >= 0").select(*by, "m.kind", "m.start", "m.end", F.explode("m.contexts").alias("context"))
    return each.join(patterns, ["context", "kind"], "left_semi").groupBy(*by).agg(F.collect_set(F.struct("kind", "start", "end")).alias("further"))


def _spans(further: list[dict] | None) -> list[Span]:
    return [(m["kind"], m["start"], m["end"]) for m in further or ()]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base spans, spans has the further ones too. Null and
    empty texts have no spans. Each row is its own, whatever the ids. Positions are code
    points, ends exclusive.
    """
    extracted = materialise(extract(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "extracted")
    patterns = bootstrap(extracted)
    known = told_patterns(patterns)
    rest = _spans if known is None else known.further
    source = extracted.join(announced(extracted, patterns, ["row"]), "row", "left").select("doc_id", "spans", "further") if known is None else extracted.select("doc_id", "spans", "mentions")
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
                rows.append((*(sum(s[0] == k for s in spans) for k in range(len(KINDS))), hashlib.sha256(base.encode()).hexdigest(), told(spans + rest(found)) if found else base))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.int64() if i < len(KINDS) else pa.string()) for i, c in enumerate(zip(*rows, strict=True)))], names=names) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([(n, pa.string() if n in names[-2:] else pa.int64()) for n in names]))

    return source.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; nulls stay null. Reads the texts twice: to learn the patterns, and to apply them."""
    names = docs.columns
    ids = {"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)}  # spans depend on the text only
    extracted = materialise(extract(docs.select(F.lit(0).alias("doc_id"), text, *(c.alias(k) for k, c in ids.items())), text=text, also=tuple(ids)), "extracted")
    patterns = bootstrap(extracted)
    known = told_patterns(patterns)
    source = docs.withColumns(ids).join(materialise(announced(extracted, patterns, list(ids)), "announced"), list(ids), "left").select(*names, F.col("further").alias("__further")) if known is None else docs
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            more = batch.column(len(names)).to_pylist() if known is None else None
            for i, (base, found) in enumerate(_found(batch.column(at))):
                if spans := base + (known.further(found) if more is None else _spans(more[i])):
                    texts[i] = redacted(texts[i], spans)
            yield batch.select(range(len(names))).set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return source.mapInArrow(run, docs.schema)
