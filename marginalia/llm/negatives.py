"""Hard negatives: blocked dense products of anchors with all candidates, in two passes.

Anchors come in blocks of a fixed most size. A block is broadcast, and Spark streams the
table of candidates past it: each task multiplies chunks of candidates with the block (GEMM in
double precision) and keeps, for each anchor, the best five rows of its label. These lists
merge, so Spark takes the best five of all tasks' lists. The second pass multiplies again and
keeps for each anchor and positive the best rows of other labels whose score lies in the
window that the positive's score opens.

The components are floored multiples, whole numbers, so products are exact below 2^53 in
any order of summation, and ties are real.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Anchors of a block, at most, and bytes of their components; the only thing that is broadcast, with as many scores.
BLOCK, BLOCK_BYTES = 1 << 15, 1 << 24
#: Anchors and candidates of a product; the first products of a task are smaller, until its lists are full.
ROWS, FIRST, COLUMNS = 512, 256, 4096
#: The largest double below 2^63.
_LARGEST = 2.0**63 - 1024


@dataclass
class _Block:
    """Anchors: row numbers, labels and floored components, all of one length; with the positives' scores in the second pass (anchors, positives; NaN: none)."""

    no: np.ndarray
    label: np.ndarray
    x: np.ndarray
    scores: np.ndarray | None = None


class _Best:
    """For each of n lists the `most` best (score, id, row), higher scores first, then smaller ids. Rows must come with rising ids in each call."""

    def __init__(self, n: int, most: int) -> None:
        self.score = np.full((n, most), -np.inf)
        self.id = np.full((n, most), np.iinfo(np.int64).max)
        self.most = most

    def least(self, lists: slice) -> np.ndarray:
        """What a score must reach to enter."""
        return self.score[lists, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Candidates of lists, in any order of lists."""
        touched = np.unique(at)
        at = np.concatenate([at, np.repeat(touched, self.most)])
        score = np.concatenate([score, self.score[touched].ravel()])
        ident = np.concatenate([ident, self.id[touched].ravel()])
        order = np.lexsort((ident, -score, at))
        at, score, ident = at[order], score[order], ident[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.most
        self.score[at[keep], rank[keep]] = score[keep]
        self.id[at[keep], rank[keep]] = ident[keep]


def _components(column: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(rows, floored multiples of their components) by length."""
    lengths = np.asarray(column.value_lengths())
    out = {}
    for dims in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dims)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[dims] = rows, np.floor(scale * flat.reshape(len(rows), dims))
    return out


def _chunks(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(no, id, label, components) of candidates of this length, with rising ids in each chunk; few at first."""
    size = FIRST
    for batch in batches:
        found = _components(batch.column(3), scale).get(dims)
        if found is None:
            continue
        rows, x = found
        columns = [batch.column(k).to_numpy()[rows] for k in range(3)]
        at = 0
        while at < len(rows):
            part = np.arange(at, min(at + size, len(rows)))
            part = part[np.argsort(columns[1][part], kind="stable")]
            yield *(c[part] for c in columns), x[part]
            at, size = at + size, min(2 * size, COLUMNS)


def _products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(a @ c.T)


def _positives(candidates: DataFrame, block: _Block, most: int, scale: float) -> DataFrame:
    """(anchor, rank, score, id): the first `most` other rows of each anchor's label; anchor is its place in the block."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        best = _Best(len(b.no), most)
        for no, ident, label, x in _chunks(batches, b.x.shape[1], scale):
            for lo in range(0, len(b.no), ROWS):
                part = slice(lo, lo + ROWS)
                score = _products(b.x[part], x)
                fits = (b.label[part, None] == label) & (score >= best.least(part)[:, None]) & (b.no[part, None] != no)
                u, v = np.nonzero(fits)
                if len(u):
                    best.add(lo + u, score[u, v], ident[v])
        yield _told(best)

    merged = candidates.mapInArrow(run, "list int, score double, id long")
    return _merge(merged, most).withColumnRenamed("list", "anchor")


def _negatives(candidates: DataFrame, block: _Block, most: int, low: int, high: int, scale: float) -> DataFrame:
    """(list, rank, score, id): the first `most` rows of other labels in each positive's window; list is anchor times positives plus positive, in the block."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        n, k = b.scores.shape
        some = ~np.isnan(b.scores)
        exact = np.abs(b.scores) < 2**53
        whole = np.where(exact, b.scores, 0).astype(np.int64)
        # low * positive <= 100 * score <= high * positive, for whole scores; without a positive nothing fits
        least = np.where(exact, -(-low * whole // 100), np.where(some, b.scores * (low / 100), np.inf))
        largest = np.where(exact, high * whole // 100, np.where(some, b.scores * (high / 100), -np.inf))
        best = _Best(n * k, most)
        for _, ident, label, x in _chunks(batches, b.x.shape[1], scale):
            for lo in range(0, n, ROWS):
                part = slice(lo, lo + ROWS)
                score = _products(b.x[part], x)
                score[b.label[part, None] == label] = -np.inf  # below every window
                for p in range(k):
                    at = np.arange(lo, min(lo + ROWS, n)) * k + p
                    bound = np.maximum(least[part, p], best.score[at, -1])
                    u, v = np.nonzero((score >= bound[:, None]) & (score <= largest[part, p][:, None]) & (score > -np.inf))
                    if len(u):
                        best.add(at[u], score[u, v], ident[v])
        yield _told(best)

    return _merge(candidates.mapInArrow(run, "list int, score double, id long"), most)


def _long(score: str) -> Column:
    """A double as a long, at whose ends it ends."""
    return F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), score)).cast("long")


def _told(best: _Best) -> pa.RecordBatch:
    at, rank = np.nonzero(best.score > -np.inf)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best.score[at, rank]), pa.array(best.id[at, rank])], names=["list", "score", "id"])


def _merge(lists: DataFrame, most: int) -> DataFrame:
    """The best of all tasks' lists, `most` rows from each task at most."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = (LOW, HIGH),
    scale: float = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per mined triple: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors: which rows are anchors, a condition over the columns of vectors. A score is the
    inner product of floor(scale * component), both whole. An anchor's positives are its first
    other rows of the same label, in the order of higher score, then smaller id; a positive's
    negatives are the first rows of another label with low * positive_score <= 100 *
    negative_score <= high * positive_score.

    Rows with a null id, label or vector, or a null or non-finite component take no part. A
    vector is compared with those of its own length. Repeated rows are further rows: a copy of
    an anchor is one of its positives, and a repeated anchor gives its triples again. Scores
    from 2^53 on are rounded as doubles are, and end at the ends of a long. An empty table, no
    anchor, or one label give no rows. Columns of vectors named otherwise are ignored.

    Anchors are read in blocks of at most `block` rows and BLOCK_BYTES of components; each is
    one broadcast and two passes over the candidates, whatever their number.
    """
    spark = vectors.sparkSession
    given = vectors.schema[vector].dataType.simpleString()
    kind = "float" if given == "array<float>" else "double"
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast(f"array<{kind}>").alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)))
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("no"), "*"), "vectors")
    candidates = rows.select("no", "id", "label", "x")
    # blocks are of one length of vectors each, and hold fewer rows than they may by chance
    sizes = rows.filter("anchor").groupBy(F.size("x").alias("dims")).count().collect()  # one row a length
    found = []
    for r in sizes:
        room = max(1, min(block, BLOCK_BYTES // (8 * max(1, r.dims))))
        parts = -(-r["count"] // room)
        own = rows.filter(F.col("anchor") & (F.size("x") == r.dims))
        for part in range(parts):
            held = own.filter(F.pmod(F.xxhash64("no"), F.lit(parts)) == part).select("no", "id", "label", "x").toArrow().combine_chunks()
            for at in range(0, held.num_rows, room):  # a part that is larger than the room by chance is cut
                piece = held.slice(at, room)
                x = _components(piece.column("x").combine_chunks(), scale)[r.dims][1]
                found.append(_triples(candidates, _Block(piece.column("no").to_numpy(), piece.column("label").to_numpy(), x), piece.column("id").to_numpy(), positives, negatives, window, scale))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _triples(candidates: DataFrame, block: _Block, ids: np.ndarray, positives: int, negatives: int, window: tuple[int, int], scale: float) -> DataFrame:
    """The triples of a block's anchors, as a table. What comes to the driver are the block's positives, at most `positives` an anchor."""
    spark = candidates.sparkSession
    told = _positives(candidates, block, positives, scale).toArrow()
    at, rank = told.column("anchor").to_numpy(), told.column("rank").to_numpy() - 1
    block.scores = np.full((len(ids), positives), np.nan)
    block.scores[at, rank] = told.column("score").to_numpy()
    own = np.zeros((len(ids), positives), np.int64)
    own[at, rank] = told.column("id").to_numpy()
    names = spark.createDataFrame(pa.table({"list": (at * positives + rank).astype(np.int32), "anchor_id": ids[at], "positive_id": own[at, rank], "positive_score": told.column("score").to_numpy()}))
    mined = _negatives(candidates, block, negatives, *window, scale).join(F.broadcast(names), "list")  # as many rows as the block has positives
    return materialise(
        mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), _long("positive_score").alias("positive_score"), _long("score").alias("negative_score")),
        "triples",
    )


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, len(embedding) AS dims
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.no, a.vec_id AS anchor_id, a.label = c.label AS same, c.no AS other, c.vec_id AS id, CASE WHEN a.dims = 0 THEN 0 ELSE list_inner_product(a.q, c.q) END::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.dims = c.dims AND (a.label <> c.label OR a.no <> c.no)),
p AS (SELECT no, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY no ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.no, place ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON s.no = p.no AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n
"""
