"""Packing documents into few sequences: dominance reduction, then best fit, on a histogram of lengths.

Lengths are at most a sequence's size, so their histogram is bounded whatever the corpus
is. The plan is made on it: small sets of lengths that provably dominate every other way
to fill a sequence are fixed for good; the shrunken instance is packed by best fit in
decreasing order. Each piece then finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import from_driver, materialise, slices

SIZE, END = 1024, 2
#: Pieces of one length are ranked in buckets, of so many pieces of any length on average; numbers of buckets there are at least and at most.
PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 64, 1024
#: Texts with a longer run of letters, digits, signs or blanks are encoded by the tokenizers library itself, whose merging isn't quadratic.
LONG_RUN = 4096

Group = tuple[tuple[int, ...], int]  # lengths in a sequence, how many such sequences


def reduce_by_dominance(counts: dict[int, int], size: int = SIZE) -> tuple[list[Group], dict[int, int]]:
    """(fixed groups, what is left). A set with length a is fixed if it dominates all sets with a that fit.

    A set dominates another if that other's lengths can be put into some of its own without
    exceeding any: whatever stands beside a elsewhere can then be swapped for the set. With k
    the largest length that fits beside a, and q the largest that fits beside both:

    * {a} dominates if nothing fits beside a;
    * {a, k} if k fills the sequence, or if no two or more of the lengths that fit beside a
      have together more than k;
    * {a, k, q} if no three others fit beside a, and no two do that are both longer than q,
      or such two have no more than k together: of any other two the shorter goes into q and
      the longer into k.

    It stays so while copies of the set are taken, so they are fixed in bulk. Passes end when
    one fixes nothing.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: list[Group] = []
    changed = True
    while changed:
        changed = False
        for a in sorted(left, reverse=True):
            while left.get(a, 0) and (found := _dominating(a, left, size)):
                n = min(left[x] // found.count(x) for x in found)
                fixed.append((found, n))
                for x in found:
                    left[x] -= n
                left = {x: c for x, c in left.items() if c}
                changed = True
    return fixed, left


def _dominating(a: int, left: dict[int, int], size: int) -> tuple[int, ...] | None:
    """A set with a that dominates all others with it, of one, two or three lengths."""
    room = size - a
    spare = {k: n - (k == a) for k, n in left.items() if k <= room and n > (k == a)}
    if not spare:
        return (a,)
    beside = sorted(spare)
    k = beside[-1]
    if k == room or 2 * beside[0] > room or _most(beside, room) <= k:
        return (a, k)
    least = [x for x in beside for _ in range(min(3, spare[x]))][:3]
    if len(least) == 3 and sum(least) <= room:
        return None
    spare[k] -= 1
    q = max((x for x in beside if spare[x] and x <= room - k), default=0)
    spare[k] += 1
    longer = [x for x in beside if x > q]
    pairs = [x + y for x in longer for y in longer if x <= y and x + y <= room and (x < y or spare[x] > 1)]
    return (a, k, q) if q and all(x <= k for x in pairs) else None


def _most(lengths: list[int], room: int) -> int:
    """The largest sum within room of two or more of the lengths, each as often as wanted."""
    one = sum(1 << k for k in lengths)
    full = (1 << (room + 1)) - 1
    sums = 0
    grown = one
    while grown:
        more = 0
        for k in lengths:
            more |= grown << k
        more &= full
        grown = more & ~sums
        sums |= more
    return sums.bit_length() - 1


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[Group]:
    """Best fit in decreasing order, on multiplicities: equal sequences are handled as one group."""
    groups: dict[int, list[list]] = {}  # by room left: [lengths, number]
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append([lengths, n])

    for a in sorted(counts, reverse=True):
        n = counts[a]
        while n:
            at = bisect_left(rooms, a)
            if at == len(rooms):
                per = size // a
                put(size - per * a, (a,) * per, n // per)
                put(size - n % per * a, (a,) * (n % per), 1 if n % per else 0)
                break
            room = rooms[at]
            lengths, m = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            use = min(n, m)
            n -= use
            put(room, lengths, m - use)
            put(room - a, (*lengths, a), use)
    return [(tuple(lengths), n) for room in groups.values() for lengths, n in room]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) for all ranks of all lengths."""
    fixed, left = reduce_by_dominance(counts, size)
    merged: dict[tuple[int, ...], int] = {}
    for lengths, n in [*fixed, *best_fit(left, size)]:
        merged[lengths] = merged.get(lengths, 0) + n
    used = dict.fromkeys(counts, 0)
    out, sequence = [], 0
    for lengths, n in merged.items():
        offset = 0
        for k in lengths:
            out.append((k, used[k], used[k] + n, sequence, offset))
            used[k] += n
            offset += k
        sequence += n
    return out


class Encoder:
    """Token ids that the tokenizers library gives for a vocabulary file, with its own settings.

    Where the file's pre-tokenisation is plain byte-level and nothing is normalised, merges
    are run by tiktoken on the same vocabulary, which gives the same ids several times as
    fast. What has a very long run or holds an added token's text goes to the library
    itself, as does every text with a file of another kind.
    """

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        self._path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model.get("added_tokens", ())}
        self._fast = None
        if _plain(model):
            byte = _byte_of_character()
            ranks = {bytes(byte[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of byte-level pre-tokenisation, a fixed value
            self._fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._long = regex.compile(rf"\p{{L}}{{{LONG_RUN}}}|\p{{N}}{{{LONG_RUN}}}|[^\s\p{{L}}\p{{N}}]{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")
        self._special = regex.compile("|".join(map(regex.escape, sorted(special)))) if special else None

    @cached_property
    def _own(self):  # noqa: ANN202
        """The library's tokenizer, loaded only where it is needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def __call__(self, text: str) -> np.ndarray:
        if self._fast is None or (self._special and self._special.search(text)) or (len(text) >= LONG_RUN and self._long.search(text)):
            return np.array(self._own.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._fast.encode_ordinary(text), np.uint32)


def _plain(file: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE without normalisation and with the usual splitting, and no added token takes more than its own text."""
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return bool(level and merges and not file.get("normalizer") and not any(x.get("normalized") and not x["content"].isascii() for x in file.get("added_tokens", ())))


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each whole text's ids and END, cut only if longer than size, the first piece being the shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(value.as_py() or ""), np.uint32(END)).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else ([] for _ in types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty: one piece, the END id. Repeated rows and ids are packed like any
    others. An empty table gives no sequences. Sequences are numbered from 0 without gaps.

    Pieces are ranked within (length, bucket), and the buckets' counts, at most
    size * MOST_BUCKETS numbers, are summed on the driver; so a length that a third of all
    pieces have is dealt over all buckets. The plan has a few intervals of ranks for each
    length, whatever the corpus, and is broadcast.
    """
    spark = docs.sparkSession
    made = materialise(pieces(docs, tokenizer or default_tokenizer(), key, text, size), "pieces")
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, made.count() // PER_BUCKET))
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(buckets)).cast("int"))
    sizes = sorted((r.length, r.bucket, r.n) for r in dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = {}
    before = []
    for length, bucket, n in sizes:
        before.append((length, bucket, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    first = from_driver(spark, before, pa.schema([("length", pa.int64()), ("bucket", pa.int32()), ("before", pa.int64())]))
    places = from_driver(spark, plan(counts, size), pa.schema([(c, pa.int64()) for c in ("length", "lo", "hi", "sequence", "offset")]))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(first), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(places), "length").filter("rank >= lo AND rank < hi")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
