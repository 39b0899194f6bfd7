"""Alignment of two tokenizers over the same bytes: a static interval index, stabbing queries, groups between gaps that no token spans.

Both tokenizations of a text are sequences of byte intervals that cover it without gaps. The
intervals of B's tokens, sorted as they are, form a static index; for each token of A two
bisections find the first and the last interval that it stabs. A gap between two tokens of
B that no token of A spans is a place where both have a boundary, and it ends a group.

The tokens of a batch of texts are laid end to end, as all of A's and B's bytes of a text
have the same length, so one pair of bisections serves the batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices
from .packing import LONG_RUN, Encoder, _byte_of_character

#: So many of the most frequent pairs of ids, at most, are told to all tasks (16 bytes each); texts' other links are joined with their counts.
TOLD = 1 << 20
#: Tokens of a slice of texts that are aligned together.
TOKENS = 1 << 16


class _Plain(Encoder):
    """An encoder to which the texts of added tokens are plain text; cut says whether the last text was encoded piece by piece of its own bytes."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self._special = None

    @cached_property
    def _own(self):  # noqa: ANN202
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self._path)
        made.encode_special_tokens = True
        return made

    def __call__(self, text: str) -> np.ndarray:
        self.cut = self._fast is not None and (len(text) < LONG_RUN or not self._long.search(text))
        return self._fast.encode_to_numpy(text, disallowed_special=()) if self.cut else np.array(self._own.encode(text, add_special_tokens=False).ids, np.uint32)


class Tokenizers:
    """Ids of texts in two vocabularies, A of a byte-level tokenizers file and B of a sentencepiece model, and the bytes of their tokens."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece

        self.a, self.b = _Plain(a), sentencepiece.SentencePieceProcessor(model_file=b)
        with open(a, encoding="utf-8") as f:
            file = json.load(f)
        byte = _byte_of_character()
        entries = {i: bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode() for entry, i in file["model"]["vocab"].items()}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.stored = np.int16 if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else np.int32
        self.digits = _digits(max(len(self.bytes_a), len(self.bytes_b)))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A's ids, B's ids) of each text with a space before it; none of both where a text is empty or either doesn't spell it exactly."""
        none = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        out = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            if not text:
                out.append(none)
                continue
            raw, a = (" " + text).encode(), self.a(" " + text)
            same = b"".join(map(self.bytes_b.__getitem__, b)) == raw and a.max(initial=0) < len(self.bytes_a) and self._spells(a, raw)
            out.append((a, np.array(b, np.uint32)) if same else none)
        return out


    def _spells(self, a: np.ndarray, raw: bytes) -> bool:
        """Whether A's tokens spell raw. The fast encoder's are pieces of it in order, so it is enough that none is missing."""
        if self.a.cut:
            return int(self.length_a[a].sum()) == len(raw)
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Alignment:
    """Of tokens laid end to end: the first and the end of the tokens of B that each token of A overlaps, and the group of each token."""

    first: np.ndarray
    end: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(token of A, token of B) of all overlapping pairs, in order."""
        n = self.end - self.first
        at = np.repeat(np.arange(len(n)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first, n)


def overlaps(length_a: np.ndarray, length_b: np.ndarray) -> Alignment:
    """The alignment of tokens with these lengths in bytes, of the same sum, none of them empty."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    first = np.searchsorted(end_b, end_a - length_a, "right")  # the first token of B that ends behind the start
    end = np.searchsorted(end_b - length_b, end_a, "left")  # the first one that starts at the end or behind it
    n = len(length_b)
    # gap g is that behind token g of B; a token of A spans the gaps from first to end - 2
    spans = np.cumsum(np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(end - 1, minlength=n + 1)[: n + 1])[:n]
    boundary = spans == 0
    group_b = np.cumsum(boundary) - boundary
    return Alignment(first, end, group_b[first], group_b)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the numbers below n, their decimal digits and a place for a mark behind them, and which of these count."""
    width = len(str(n))
    powers = 10 ** np.arange(width - 1, -1, -1)
    table = np.zeros((n, width + 1), np.uint8)
    table[:, :width] = np.arange(n)[:, None] // powers % 10 + ord("0")
    keep = np.ones(table.shape, bool)
    keep[:, : width - 1] = np.arange(n)[:, None] >= powers[:-1]
    return table, keep


def spell(a: np.ndarray, b: np.ndarray, found: Alignment, texts_b: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): `a1,a2|b1;a3|b2,b3` of each text, laid end to end, and where each text's ends. texts_b: the text of each token of B, in order."""
    groups = int(found.group_b[-1]) + 1
    n_a, n_b = np.bincount(found.group_a, minlength=groups), np.bincount(found.group_b, minlength=groups)
    place_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[found.group_a]
    place_b = np.arange(len(b)) + np.cumsum(n_a)[found.group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[np.cumsum(n_a) + np.cumsum(n_b) - n_b - 1] = ord("|")
    ends = np.cumsum(n_a) + np.cumsum(n_b) - 1  # the last token of each group
    mark[ends] = ord(";")
    table, keep = digits[0][ids], digits[1][ids]
    table[:, -1] = mark
    last = place_b[np.flatnonzero(np.append(texts_b[1:] != texts_b[:-1], True))]  # the last token of each text: nothing behind it
    keep[last, -1] = False
    return table[keep], np.cumsum(keep.sum(axis=1))[last]


def encoded(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(no, doc_id, a, b): ids of each whole text with a space before it in both tokenizers, as a table; both empty where a text has no tokens. Ids of vocabularies of at most 65,536 are stored in 16 bits, the upper half as negative numbers.

    A text that is null or empty, or that either tokenizer doesn't spell byte by byte, has
    none. Repeated rows and ids are further rows with a number (no) of their own.
    """
    a, b = (x or y for x, y in zip((a, b), default_tokenizers(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a, b)
        for batch in slices(batches):
            ids = both.encode(batch.column(1).to_pylist())
            lists = []
            for k in range(2):
                offsets = np.cumsum([0, *(len(x[k]) for x in ids)])
                flat = np.concatenate([x[k] for x in ids]).astype(both.stored)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "a", "b"])

    kind = "short" if tokenizers(a, b).stored == np.int16 else "int"
    made = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, a array<{kind}>, b array<{kind}>")
    return materialise(made.select(F.monotonically_increasing_id().alias("no"), "*"), "tokens")


@dataclass
class _Texts:
    """Tokens of a slice of texts laid end to end: ids, the text of each token, and how they are aligned."""

    rows: int
    a: np.ndarray
    b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    found: Alignment


def _aligned(batches: Iterator[pa.RecordBatch], length_a: np.ndarray, length_b: np.ndarray) -> Iterator[tuple[pa.RecordBatch, _Texts]]:
    """Slices of batches whose columns end in a and b, of about TOKENS tokens or one text, with their alignments."""
    for batch in batches:
        a, b = batch.columns[-2:]
        sizes = [np.asarray(x.value_lengths()).astype(np.int64) for x in (a, b)]
        part = np.cumsum(sizes[0] + sizes[1]) // TOKENS
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                ids = [(x := c.slice(lo, hi - lo).flatten().to_numpy()).view(np.dtype(f"u{x.dtype}")).astype(np.int64) for c in (a, b)]
                text = [np.repeat(np.arange(hi - lo), n[lo:hi]) for n in sizes]
                yield batch.slice(lo, hi - lo), _Texts(hi - lo, *ids, *text, overlaps(length_a[ids[0]], length_b[ids[1]]))


def pair_counts(tokens: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(pair, n, best) as a table: how many links of all texts hold a pair of ids (A's times 2^32 plus B's), and whether no id of A has more with this id of B.

    Links are counted by slice in the tasks and by Spark before and behind one shuffle.
    """
    a, b = (x or y for x, y in zip((a, b), default_tokenizers(), strict=True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a, b)
        for _, x in _aligned(batches, both.length_a, both.length_b):
            u, v = x.found.links()
            pair, n = np.unique(x.a[u] << 32 | x.b[v], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    counts = materialise(tokens.select("a", "b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    own = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(own.alias("id")).agg(F.max("n").alias("most"))
    return materialise(counts.join(most, own == F.col("id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def groups(tokens: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(no, doc_id, group, start, end, a, b): the smallest runs of tokens of both that cover the same bytes, start to end, of the text with its space."""
    a, b = (x or y for x, y in zip((a, b), default_tokenizers(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a, b)
        for batch, x in _aligned(batches, both.length_a, both.length_b):
            if not len(x.b):
                continue
            size = int(x.found.group_b[-1]) + 1
            row = x.text_b[np.searchsorted(x.found.group_b, np.arange(size))]
            end = np.cumsum(np.bincount(x.found.group_b, both.length_b[x.b], size)).astype(np.int64)
            start = np.append(0, end[:-1])
            first = np.searchsorted(row, row)  # the first group of the text
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(g, np.arange(size + 1)), pa.int32()), pa.array(ids.astype(np.int32))) for g, ids in ((x.found.group_a, x.a), (x.found.group_b, x.b))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.arange(size) - first), pa.array(start - start[first]), pa.array(end - start[first]), *lists], names=["no", "doc_id", "group", "start", "end", "a", "b"])

    return tokens.select("no", "doc_id", "a", "b").mapInArrow(run, "no long, doc_id long, group long, start long, end long, a array<int>, b array<int>")


def _shape(kept: bool) -> str:
    return "no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", other array<long>" if kept else "")


def summaries(tokens: DataFrame, counts: DataFrame, a: str | None = None, b: str | None = None, told: int = TOLD) -> DataFrame:
    """One row per text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The counts of the `told` most frequent pairs are told to all tasks; links with others, if
    there are any, are joined with the table of counts, so the result doesn't depend on told.
    """
    a, b = (x or y for x, y in zip((a, b), default_tokenizers(), strict=True))
    kept = counts.count() > told
    table = counts.orderBy(F.desc("n"), "pair").limit(told).toArrow() if kept else counts.toArrow()
    pair = table.column("pair").to_numpy()
    order = np.argsort(pair)
    context = tokens.sparkSession.sparkContext
    shared = context.broadcast((pair[order], table.column("n").to_numpy()[order], np.asarray(table.column("best").to_numpy(zero_copy_only=False), bool)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a, b)
        known, n, best = shared.value
        for batch, x in _aligned(batches, both.length_a, both.length_b):
            u, v = x.found.links()
            codes, text = x.a[u] << 32 | x.b[v], x.text_a[u]
            at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
            hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            cuts = np.searchsorted(text, np.arange(x.rows + 1))  # links are in the texts' order
            sums = [np.diff(np.append(0, np.cumsum(np.where(hit, of[at], 0) if len(known) else np.zeros(len(codes), np.int64)))[cuts]) for of in (best.astype(np.int64), n)]
            digests, start = [""] * x.rows, 0
            if len(x.b):
                spelled, ends = spell(x.a, x.b, x.found, x.text_b, both.digits)
                for row, end in zip(np.unique(x.text_b).tolist(), ends.tolist(), strict=True):
                    digests[row] = hashlib.sha256(spelled[start:end]).hexdigest()
                    start = end
            boundary = np.flatnonzero(np.append(x.found.group_b[1:] != x.found.group_b[:-1], True)) if len(x.b) else []
            columns = [np.bincount(k, minlength=x.rows) for k in (x.text_a, x.text_b, x.text_b[boundary], text)]
            columns = [*batch.columns[:2], *(pa.array(c.astype(np.int64)) for c in (*columns, *sums)), pa.array(digests)]
            names = ["no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            if kept:
                offsets = np.append(0, np.cumsum(np.bincount(text[~hit], minlength=x.rows)))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes[~hit])))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(["other"] if kept else [])])

    made = tokens.select("no", "doc_id", "a", "b").mapInArrow(run, _shape(kept))
    if not kept:
        return made.drop("no")
    made = materialise(made, "summaries")
    other = made.select("no", F.explode("other").alias("pair")).groupBy("no", "pair").agg(F.count("*").alias("times"))
    more = other.join(counts, "pair").groupBy("no").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("n") * F.col("times")).alias("__sum"))
    full = made.join(more, "no", "left")
    added = {"n_best": "__best", "count_sum": "__sum"}
    return full.select("doc_id", *((F.col(c) + F.coalesce(added[c], F.lit(0))).alias(c) if c in added else F.col(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")))


def align(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: how the tokens of its whole text in two tokenizers are aligned, and how usual its links are in the corpus.

    n_a, n_b: tokens; n_groups: groups; n_links: overlapping pairs; n_best: links whose pair
    is the most frequent one of its id of B, ties included; count_sum: the pairs' counts over
    all texts, summed over links; groups_sha256: of `a1,a2|b1;a3|b2,b3`, empty without tokens.

    Texts that are null or empty, or whose tokens of A or B don't spell a space and the text,
    have no tokens: zeros. Repeated rows are further rows and count as such; a null id stays.
    Texts are encoded whole, however long they are. An empty table gives no rows. Texts of
    added tokens are plain text.
    """
    tokens = encoded(docs, a, b, key, text)
    return summaries(tokens, pair_counts(tokens, a, b), a, b)
