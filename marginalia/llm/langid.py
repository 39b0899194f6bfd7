"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams, which don't reach
over a word's borders; a linear layer gives a score for each language. Both are trained
by stochastic gradient descent in numpy, on a bounded sample. The softmax's temperature
is calibrated on a part of the sample that isn't trained on. So is the confidence below
which a text is rejected: the least at which, of the held whole texts that are kept, no
more than RISK are wrong, and never less than EVEN, under which a language is more
likely wrong than right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices

#: Rows that the classifier is fitted on, for each language and in all at most, but one of each language at least.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 300, 20_000
BUCKETS, DIMS, ORDERS = 1 << 13, 16, (2, 3, 4)
EPOCHS, RATE, BATCH = 10, 4.0, 16
#: Of each text, as many words are a further, short text, so that the confidence in short ones is learned too.
SNIPPETS = (1, 2, 4)
#: Every CALIBRATION-th row of the sample calibrates; share of kept texts that may be wrong; least confidence.
CALIBRATION, RISK, EVEN = 5, 0.01, 0.5
UNKNOWN = "und"
_MIX = np.uint32(0x9E3779B1)


def ngram_counts(data: np.ndarray) -> np.ndarray:
    """How many n-grams of a text's UTF-8 bytes fall into each bucket; white space is a word's border and no n-gram has it inside."""
    counts = np.zeros(BUCKETS, np.float32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    codes = np.where(space, 32, data).astype(np.uint32)
    h = np.zeros(len(data), np.uint32)
    clean = np.ones(len(data), bool)
    for n in range(1, max(ORDERS) + 1):
        if len(data) < n:
            break
        last = len(data) - n + 1
        h = (h[:last] + codes[n - 1 :] + np.uint32(1)) * _MIX
        h ^= h >> np.uint32(15)
        if n > 2:
            clean = clean[:last] & ~space[n - 2 : n - 2 + last]  # a byte that was last before is inside now
        if n in ORDERS:
            at = ((h + np.uint32(n * 7919)) * _MIX) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            use = clean[:last] & ~space[:last] if n == 1 else clean[:last]
            counts += np.bincount(at[use], minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class Model:
    """logits = the mean of table's rows over a text's n-grams + bias; table is embeddings times weights."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, data: np.ndarray) -> tuple[str, float]:
        """(language, calibrated probability) of a lower-cased UTF-8 text."""
        p = self._probabilities(_features(data[None] if data.ndim == 2 else [data]))[0]
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])

    def _probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax((x @ self.table + self.bias) / self.temperature)


def _features(texts: list[np.ndarray]) -> np.ndarray:
    x = np.empty((len(texts), BUCKETS), np.float32)
    for k, t in enumerate(texts):
        counts = ngram_counts(t)
        x[k] = counts / max(1.0, float(counts.sum()))
    return x


Counts = tuple[np.ndarray, np.ndarray]  # buckets that n-grams of a text fall into, rising, and how many do


class _Sparse:
    """Features of many texts; x[rows] are those of some of them."""

    def __init__(self, texts: list[Counts]) -> None:
        self.rows = [(at, n / max(np.float32(1), n.sum(dtype=np.float32))) for at, n in texts]

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows):
            out[k, self.rows[r][0]] = self.rows[r][1]
        return out


@dataclass(frozen=True)
class Example:
    """A labelled text: n-gram counts of the whole text, and of a few words of it, if these have a letter."""

    lang: str
    whole: Counts
    short: Counts | None


def _counted(text: str) -> Counts:
    counts = ngram_counts(np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8))
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), counts[at]


def example(text: str, lang: str, h: int) -> Example:
    """The example of a whole text; its hash h says which words are the short one."""
    words, draw = text.split(), h % (1 << 62)
    n = SNIPPETS[draw % len(SNIPPETS)]
    short = words[draw // len(SNIPPETS) % max(1, len(words)) :][:n]
    return Example(lang, _counted(text), _counted(" ".join(short)) if any(c.isalpha() for w in short for c in w) else None)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(examples: list[Example], seed: int = 5) -> Model:
    """Fits a model; the same examples in the same order give the same model. Raises ValueError without any."""
    if not examples:
        raise ValueError("no labelled texts to learn from")
    languages = tuple(sorted({e.lang for e in examples}))
    place = {k: i for i, k in enumerate(languages)}
    rng = np.random.default_rng(seed)
    of = np.array([*range(len(examples)), *(k for k, e in enumerate(examples) if e.short)])
    x = _Sparse([*(e.whole for e in examples), *(e.short for e in examples if e.short)])
    y = np.array([place[examples[k].lang] for k in of])
    held = of % CALIBRATION == CALIBRATION - 1
    embed = rng.uniform(-1, 1, (BUCKETS, DIMS)).astype(np.float32) / DIMS
    weights = np.zeros((DIMS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    rows = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    for epoch in range(EPOCHS):
        step = np.float32(RATE * (1 - epoch / EPOCHS))
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // BATCH)):
            rows_ = x[part]
            used = np.flatnonzero(rows_.any(axis=0))
            hidden = rows_[:, used] @ embed[used]
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(part)), y[part]] -= 1
            error /= len(part)
            push = error @ weights.T
            weights -= step * hidden.T @ error
            bias -= step * error.sum(axis=0)
            embed[used] -= step * len(part) * rows_[:, used].T @ push
    table = embed @ weights
    test = held if held.any() else ~held
    logits = np.concatenate([x[k] @ table for k in np.array_split(np.flatnonzero(test), -(-int(test.sum()) // 1024))]) + bias
    temperature = min(np.geomspace(0.05, 20, 120), key=lambda t: float(-np.log(_softmax(logits / t)[np.arange(test.sum()), y[test]] + 1e-12).mean()))
    p = _softmax(logits / temperature)
    whole = (np.arange(len(of)) < len(examples))[test]
    return Model(languages, table, bias, float(temperature), threshold(p.max(axis=1)[whole], (p.argmax(axis=1) == y[test])[whole]))


def threshold(confidence: np.ndarray, right: np.ndarray) -> float:
    """The least confidence at which, of the texts that have it or more, no more than RISK, or one, are wrong; EVEN at least, and EVEN where all of them may be kept."""
    order = np.argsort(-confidence, kind="stable")
    few = np.cumsum(~right[order]) <= np.maximum(1, RISK * np.arange(1, len(order) + 1))
    last = np.append(confidence[order][1:] != confidence[order][:-1], True) if len(order) else few  # equal ones are kept together
    kept = np.flatnonzero(few & last)
    if not len(kept):
        return 1.0 if len(order) else EVEN
    return EVEN if kept[-1] == len(order) - 1 else max(EVEN, float(confidence[order][kept[-1]]))


_COUNTS = "at array<int>, n array<float>, short_at array<int>, short_n array<float>"


def labelled_sample(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[Example]:
    """At most SAMPLE_PER_LANGUAGE different (text, language) rows of each language, and SAMPLE_ROWS in all if there aren't more languages, drawn evenly by a hash of key and text, in its order.

    N-grams of whole texts are counted in the tasks that draw them, and only counts travel: a row
    has at most BUCKETS of them, however long its text is.
    """
    h = F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(11))
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), h.alias("h"))
    sizes = materialise(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("size")), "languages")
    languages = sizes.count()
    if not languages:
        return []
    most = min(SAMPLE_PER_LANGUAGE, max(1, SAMPLE_ROWS // languages))
    share = F.least(F.lit(1 << 30), (F.lit(3 * most << 29) / F.greatest(F.lit(1), "size")).cast("long") + 8)
    drawn = rows.join(sizes.select("lang", share.alias("share")), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share")).select("h", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [example(t, la, k) for k, la, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            none = np.empty(0, np.uint16), np.empty(0, np.float32)
            lists = [[pa.array(np.asarray(c), t) for c in column] for column, t in zip(zip(*((*e.whole, *(e.short or none)) for e in found), strict=True), (pa.int32(), pa.float32()) * 2, strict=True)]
            packed = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.concat_arrays(c)) for c in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["h", "lang", "at", "n", "short_at", "short_n"])

    counted = drawn.mapInArrow(run, f"h long, lang string, {_COUNTS}").dropDuplicates(["lang", "h"])
    first = Window.partitionBy("lang").orderBy("h")  # of about 1.5 times most rows each
    found = counted.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most).toArrow()
    columns = [found.column(c) for c in ("h", "lang", "at", "n", "short_at", "short_n")]
    made = [(k, la, tuple(x.values.to_numpy() for x in (a, n)), tuple(x.values.to_numpy() for x in (b, m))) for k, la, a, n, b, m in zip(columns[0].to_pylist(), columns[1].to_pylist(), *columns[2:], strict=True)]
    return [Example(la, whole, short if len(short[0]) else None) for _, la, whole, short in sorted(made, key=lambda r: (r[0], r[1]))]


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """keep plus lang_pred, score (calibrated, 0 to 1) and rejected, for each whole text; no shuffle.

    A text that is null or has no letter is UNKNOWN with score 0, and rejected. Others get
    a learned language, and are rejected where the score is under the model's threshold.
    Columns of docs named like the results are replaced. Without a model (nothing is
    labelled), all are UNKNOWN with score 0, and rejected.
    """
    kept = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(*kept) if text in kept else docs.select(*kept, F.col(text).alias("__text"))  # a text travels once
    at = kept.index(text) if text in kept else len(kept)
    names = [*kept, "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.large_string())
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_pylist()
            lower = pc.utf8_lower(pc.fill_null(texts, ""))
            offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
            data = np.frombuffer(lower.buffers()[2] or b"", np.uint8)
            lang, score = [], []
            for has, a, b in zip(letter, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found = model.predict(data[a:b]) if has and model else (UNKNOWN, 0.0)
                lang.append(found[0])
                score.append(round(found[1], 9))
            low = [x == UNKNOWN or s < model.threshold for x, s in zip(lang, score, strict=True)] if model else [True] * len(lang)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())], names=names)

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double, rejected boolean"]))


def learn(docs: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the labelled rows that usable admits; None if there are none."""
    examples = labelled_sample(docs, F.lit(True) if usable is None else usable, key, text, lang)
    return train(examples) if examples else None
