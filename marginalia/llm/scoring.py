"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is predicted byte by byte, each byte bit by bit. For each of ORDERS, a predictor
knows how often a bit was 0 and 1 after the hash of the last so many bytes and of the
byte's bits so far, over all training texts. A mixer adds the predictors' logits with
weights that a gate selects (the bit's place and how many orders know the context),
learned online by gradient steps; an adaptive map then corrects the mixed probability
from what was seen at it.

All of this depends on a text's windows only, a byte and the CONTEXT bytes before it. So
Spark counts the distinct windows of the whole corpus, a table that grows with it, and
predictors, mixer and map learn from every window of every training text, as often as it
occurs there. While they learn, a window's own occurrence is taken out of the counts, or
the mixer would trust these too much. Windows are dealt out by their last three bytes, so
that whatever the longer orders count is together, and no table of contexts has a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices
from .jaccard import _mix, _text_buffers, words

#: Orders up to SHORT have at most 2**24 nodes, whatever the corpus, and are told to all tasks; longer ones are counted where their windows meet.
ORDERS, CONTEXT, SHORT = (1, 2, 3, 5), 5, 2
#: Windows of a chunk, and of a part of the table of windows, on average.
CHUNK, PART = 1 << 16, 1 << 17
#: Rounds over all windows, after each of which the tasks' weights are averaged; step of AdaGrad; windows of a step.
ROUNDS, RATE, STEP = 2, 0.1, 512
#: Probabilities are kept from 0 and 1 by this much.
LEAST = 1.0 / 4096
GATES = 8 * (len(ORDERS) + 1)
STEPS = 24  # places of the adaptive map, on the logit from -8 to 8
#: The most frequent tokens' and windows' values, so many at most, are told to all tasks; the others are joined.
FREQUENT = 1 << 18
FREQUENT_WINDOWS = 1 << 20
_END = -1
_TOKEN, _WINDOW = 0, 1
_SALT = _mix(np.arange(1, len(ORDERS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): for each byte of each text and a final 0 byte, the last CONTEXT bytes before it (0 before the start) and the byte, as a number; and where each text's keys start."""
    n, docs = len(data), len(offsets) - 1
    lengths = np.diff(offsets)
    pad = CONTEXT + 1
    whole = np.zeros(n + pad * docs, np.uint64)
    owner = np.repeat(np.arange(docs), lengths)
    whole[np.arange(n) + owner * pad + CONTEXT] = data
    at = np.arange(n + docs) + np.repeat(np.arange(docs) * CONTEXT, lengths + 1) + CONTEXT
    keys = whole[at]
    for k in range(1, CONTEXT + 1):
        keys |= whole[at - k] << np.uint64(8 * k)
    return keys, offsets + np.arange(docs + 1)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' lower-cased words, and where each text's start."""
    hashed, first = words(data, offsets)
    hashed = (hashed >> np.uint64(1)).astype(np.int64)  # never negative, so _END is no word's
    return hashed, first


class _Tally:
    """How often each key was added; keys of a kind, as a task tells them."""

    def __init__(self, kind: int) -> None:
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray, times: int = 1) -> None:
        keys = np.sort(keys.view(np.int64))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.parts.append((keys[at], np.diff(np.concatenate([at, [len(keys)]])) * times))
        self.size += len(at)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return keys[at], np.add.reduceat(n, at) if len(at) else n

    def told(self, most: int) -> Iterator[pa.RecordBatch]:
        """What there is, once more than ``most`` keys are pending even when merged."""
        if self.parts and self.size > most:
            keys, n = self.merged()
            if len(keys) > most // 2:
                self.parts, self.size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), self.kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])
            else:
                self.parts, self.size = [(keys, n)], len(keys)


def gather(rows: DataFrame) -> DataFrame:
    """(kind, key, n): how often each token and each window occurs in all training rows of (text, held_out); windows of other rows are in it with 0.

    One pass over the texts; tasks add up what they see, Spark sums it by key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = _Tally(_TOKEN), _Tally(_WINDOW)
        for batch in slices(batches):
            for part, times in ((batch.filter(pa.array(~np.asarray(batch.column(1)))), 1), (batch.filter(batch.column(1)), 0)):
                if part.num_rows:
                    buffers = _text_buffers(part.column(0))
                    seen.add(windows(*buffers)[0], times)
                    if times:
                        tokens.add(_tokens(*buffers)[0])
                        tokens.add(np.full(part.num_rows, _END))
            yield from tokens.told(1 << 21)
            yield from seen.told(1 << 21)
        yield from tokens.told(0)
        yield from seen.told(0)

    return rows.select("text", "held_out").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _codes(keys: np.ndarray, order: int, so_far: np.ndarray) -> np.ndarray:
    """The node of each key in a predictor: its context and the byte's bits so far, hashed where they are long."""
    context = (keys >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    plain = context * np.uint64(256) + so_far
    return plain + np.uint64(order << 24) if order <= SHORT else _mix(plain + _SALT[ORDERS.index(order)])


def _bits(keys: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte's bits so far with a leading 1, and the bit, at a place (7 first)."""
    byte = keys & np.uint64(255)
    return (byte | np.uint64(256)) >> np.uint64(place + 1), ((byte >> np.uint64(place)) & np.uint64(1)).astype(np.int64)


def _by_node(codes: np.ndarray, n: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, which of them each key has, counts[bit, code])."""
    found, at = np.unique(codes, return_inverse=True)
    return found, at, np.stack([np.bincount(at, weights=n * (bit == b), minlength=len(found)) for b in (0, 1)])


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    """Weights by gate, the adaptive map, and the counts of the short orders' nodes: sorted codes and counts[bit, code]."""

    codes: np.ndarray
    counts: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, len(ORDERS) + 1), 0.3))
    refine: np.ndarray = field(default_factory=lambda: np.repeat(_squash(np.linspace(-8, 8, STEPS + 1))[None], 256, axis=0))

    def inputs(self, keys: np.ndarray, n: np.ndarray, place: int, without: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(logits and a constant, gate, bits so far, bit) of a chunk's windows that occur n times; without one occurrence of each, if so asked."""
        so_far, bit = _bits(keys, place)
        x = np.empty((len(keys), len(ORDERS) + 1))
        gate = np.full(len(keys), place * (len(ORDERS) + 1))
        own = np.stack([(bit == b) & (n > 0) for b in (0, 1)]) if without else 0.0
        for i, order in enumerate(ORDERS):
            codes = _codes(keys, order, so_far)
            if order <= SHORT:
                at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
                seen = np.where(self.codes[at] == codes, self.counts[:, at], 0.0) if len(self.codes) else np.zeros((2, len(keys)))
            else:
                _, at, counts = _by_node(codes, n, bit)
                seen = counts[:, at]
            zero, one = seen - own
            x[:, i] = np.log((one + 0.4) / (zero + 0.4))
            gate += zero + one > 0
        limit = math.log((1 - LEAST) / LEAST)
        np.clip(x, -limit, limit, out=x)
        x[:, -1] = 0.3
        return x, gate, so_far.astype(np.int64), bit

    def learn(self, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Online gradient steps over the windows of the chunks, STEP at a time and as often as they occur; changes weights and returns how much each gate saw."""
        mass, slope = np.zeros(GATES), np.full(self.weights.shape, 1e-6)
        for keys, n in chunks:
            use = np.flatnonzero(n)
            order = use[np.random.default_rng(3).permutation(len(use))]
            for place in range(7, -1, -1):
                x, gate, _, bit = self.inputs(keys, n, place, True)
                for k in range(0, len(order), STEP):
                    part = order[k : k + STEP]
                    push = (n[part] * (bit[part] - _squash((x[part] * self.weights[gate[part]]).sum(axis=1))))[:, None] * x[part]
                    step, seen = np.zeros_like(slope), np.bincount(gate[part], weights=n[part], minlength=GATES)
                    np.add.at(step, gate[part], push)
                    step /= np.maximum(1, seen)[:, None]
                    slope += step * step
                    self.weights = self.weights + RATE * step / np.sqrt(slope)
                    mass += seen
        return mass

    def seen(self, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(hits, ones) of the adaptive map: how much was mixed to each of its places, and how much of that was a 1."""
        hits, ones = np.zeros((256, STEPS + 1)), np.zeros((256, STEPS + 1))
        for keys, n in chunks:
            for place in range(7, -1, -1):
                x, gate, so_far, bit = self.inputs(keys, n, place, True)
                low, part = _place((x * self.weights[gate]).sum(axis=1))
                for step, share in ((low, 1 - part), (low + 1, part)):
                    at = so_far * (STEPS + 1) + step
                    hits += np.bincount(at, weights=share * n, minlength=hits.size).reshape(hits.shape)
                    ones += np.bincount(at, weights=share * n * bit, minlength=hits.size).reshape(hits.shape)
        return hits, ones

    def log2(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log2 of the probability of each window's byte after its context; the windows are all those with their last three bytes."""
        total = np.zeros(len(keys))
        for place in range(7, -1, -1):
            x, gate, so_far, bit = self.inputs(keys, n, place, False)
            logit = (x * self.weights[gate]).sum(axis=1)
            low, part = _place(logit)
            refined = self.refine[so_far, low] * (1 - part) + self.refine[so_far, low + 1] * part
            p = np.clip(0.5 * _squash(logit) + 0.5 * refined, LEAST / 16, 1 - LEAST / 16)
            total += np.log2(np.where(bit == 1, p, 1 - p))
        return total


def _place(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower place of the adaptive map at a logit, and how far it is to the next."""
    at = (np.clip(logit, -7.999, 7.999) + 8) * (STEPS / 16)
    low = at.astype(np.int64)
    return low, at - low


def _chunked(table: DataFrame, total: int) -> DataFrame:
    """(keys, n), both packed: the table of windows (key, n) in chunks of about CHUNK, all windows with the same last three bytes in one."""

    def chunk(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (keys, n)], names=["keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys, n = np.concatenate([keys, batch.column(1).to_numpy()]), np.concatenate([n, batch.column(2).to_numpy()])
            if len(keys) >= CHUNK:
                last = (keys >> 8) & 0xFFFFFF
                cut = len(keys) - int(np.argmax(last[::-1] != last[-1]) if (last != last[-1]).any() else len(keys))  # the last group may go on
                if cut:
                    yield chunk(keys[:cut], n[:cut])
                    keys, n = keys[cut:], n[cut:]
        if len(keys):
            yield chunk(keys, n)

    group = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("group")
    dealt = table.select(group, "key", "n").repartition(max(1, -(-total // PART)), "group").sortWithinPartitions("group", "key")
    return materialise(dealt.mapInArrow(run, "keys binary, n binary"), "windows")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for keys, n in zip(batch.column(0), batch.column(1), strict=True):
            yield np.frombuffer(keys.as_buffer(), "<u8"), np.frombuffer(n.as_buffer(), "<i8").astype(np.float64)


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def fit(chunks: DataFrame) -> Model:
    """A model of all windows of the chunks, each as often as it occurs in training texts."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _chunks(batches):
            for order in ORDERS:
                if order <= SHORT:
                    for place in range(7, -1, -1):
                        so_far, bit = _bits(keys, place)
                        codes, _, (zero, one) = _by_node(_codes(keys, order, so_far), n, bit)
                        yield _rows(code=codes.astype(np.int64), zero=zero, one=one)

    nodes = chunks.mapInArrow(short, "code long, zero double, one double").groupBy("code").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    nodes = nodes.filter("zero + one > 0").toArrow().sort_by("code")  # at most 2**24 and 2**16 rows
    model = Model(nodes.column("code").to_numpy().astype(np.uint64), np.stack([nodes.column(k).to_numpy() for k in ("zero", "one")]))
    for _ in range(ROUNDS):

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(model.codes, model.counts, model.weights, model.refine)
            mass = own.learn(_chunks(batches))
            at = np.arange(own.weights.size)
            wide = np.repeat(mass, own.weights.shape[1])
            yield _rows(at=at, weighted=own.weights.ravel() * wide, mass=wide)

        told = chunks.mapInArrow(learn, "at long, weighted double, mass double").groupBy("at").agg(F.sum("weighted").alias("w"), F.sum("mass").alias("m")).filter("m > 0").collect()
        weights = model.weights.copy().ravel()
        for r in told:
            weights[r["at"]] = r.w / r.m
        model.weights = weights.reshape(model.weights.shape)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, ones = model.seen(_chunks(batches))
        at = np.flatnonzero(hits)
        yield _rows(at=at, hits=hits.ravel()[at], ones=ones.ravel()[at])

    hits = np.full(model.refine.size, 8.0)
    ones = hits * model.refine.ravel()
    for r in chunks.mapInArrow(refine, "at long, hits double, ones double").groupBy("at").agg(F.sum("hits").alias("h"), F.sum("ones").alias("o")).collect():
        hits[r["at"]] += r.h
        ones[r["at"]] += r.o
    model.refine = (ones / hits).reshape(model.refine.shape)
    return model


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of (key, n, ...) with the largest n, at most so many: all those above a number that a histogram of n gives, without a sort."""
    level = F.when(F.col("n") > 0, F.floor(4 * F.log2("n"))).otherwise(-1)
    room, least = most, None
    for r in sorted(table.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # a few hundred rows
        room -= r["count"]
        if room < 0:
            break
        least = r.level
    return table.filter(level >= least) if least is not None else table.limit(0)


def _hashed(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class _Lookup:
    """Values of sorted keys: by one probe of a table in which one key of each place is, else by bisection."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.table = np.full(1 << self.bits, -1, np.int64)
        self.table[_hashed(keys, self.bits)] = np.arange(len(keys))

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; which keys are known)."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = self.table[_hashed(keys, self.bits)]
        known = self.keys[at] == keys
        miss = np.flatnonzero(~known)
        at[miss] = np.minimum(np.searchsorted(self.keys, keys[miss]), len(self.keys) - 1)
        known[miss] = self.keys[at[miss]] == keys[miss]
        return np.where(known, self.values[at], 0.0), known


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    held says which rows nothing is learned from. score is log10 of the model's probability
    of the whole text in UTF-8 and a final 0 byte; bits_per_byte is its negative in bits over
    the number of bytes, that last one included. base_score is by token counts with one
    added. A null text is empty: only its end is predicted. Rows with repeated or null ids or
    repeated texts count and are scored like any others. Without training rows, all counts
    are 0 and every bit is even odds but for the map's start.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"))
    gathered = materialise(gather(rows), "gathered")
    vocabulary = gathered.filter(F.col("kind") == _TOKEN).select("key", "n")
    sums = vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    table = gathered.filter(F.col("kind") == _WINDOW)
    chunks = _chunked(table, table.count())
    model = fit(chunks)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _chunks(batches):
            yield _rows(key=keys.view(np.int64), n=n.astype(np.int64), log2=model.log2(keys, n))

    predicted = materialise(chunks.mapInArrow(predict, "key long, n long, log2 double"), "predicted")
    top = _frequent(vocabulary, FREQUENT).toArrow().sort_by("key")
    known, logs = top.column("key").to_numpy(), np.log10(top.column("n").to_numpy() + 1.0)
    top = _frequent(predicted, FREQUENT_WINDOWS).select("key", "log2").toArrow().sort_by("key")
    window, value = top.column("key").to_numpy(), top.column("log2").to_numpy()
    divisor = math.log10(float(sums.n + sums.v + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "log", "log2", "rest", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = _Lookup(known, logs), _Lookup(window, value)

        def others(keys: np.ndarray, hit: np.ndarray, first: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~hit)])[first].astype(np.int32)), pa.array(keys[~hit]))

        for batch in slices(batches):
            data, offsets = _text_buffers(batch.column(1))
            token, first = _tokens(data, offsets)
            keys, starts = windows(data, offsets)
            keys = keys.view(np.int64)
            (log, hit), (log2, near) = tokens(token), seen(keys)
            gained, found, bits = (np.concatenate([[0.0], np.cumsum(x)]) for x in (log, hit, log2))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(np.diff(first) + 1), pa.array(np.diff(starts)), pa.array(np.diff(found[first]).astype(np.int64)),
                pa.array(np.diff(gained[first])), pa.array(np.diff(bits[starts])), others(token, hit, first), others(keys, near, starts),
            ], names=names)

    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, log double, log2 double, rest array<long>, far array<long>")
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # what isn't among the frequent ones is joined; a text's end is a token that all texts have
    end = vocabulary.filter(F.col("key") == _END).select("n").first()
    tokens = scored.select("row", F.explode("rest").alias("key")).join(vocabulary, "key").select("row", F.lit(1).alias("more"), F.log10(F.col("n") + 1).alias("gain"), F.lit(0.0).alias("bits"))
    bits = scored.select("row", F.explode("far").alias("key")).join(predicted.select("key", "log2"), "key").select("row", F.lit(0).alias("more"), F.lit(0.0).alias("gain"), F.col("log2").alias("bits"))
    more = tokens.unionByName(bits).groupBy("row").agg(*(F.sum(k).alias(k) for k in ("more", "gain", "bits")))
    log2 = F.col("log2") + F.coalesce("bits", F.lit(0.0))
    return scored.drop("rest", "far").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(int(end is not None))).alias("n_known"), F.lit(int(sums.n)).cast("long").alias("train_tokens"),
        (F.col("log") + F.coalesce("gain", F.lit(0.0)) + F.lit(math.log10(end.n + 1) if end else 0.0) - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        (log2 * math.log10(2)).alias("score"), (-log2 / F.col("n_bytes")).alias("bits_per_byte"),
    )
