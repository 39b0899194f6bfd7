"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .graph import components, forest

COSINE = 0.9
#: Vectors that k-means is fitted on, at most; a bounded sample in the order of a hash of the vector.
SAMPLE = 20_000
#: Vectors of a cell on average, and most cells there are; each block of a cell has cells of its own, of SUB vectors on average, so they grow with the table.
PER_CELL, MOST_CELLS, SUB = 1000, 2048, 256
ROUNDS = 8
#: Home vectors of a block, and members that it is compared with in one tile.
BLOCK, CHUNK = 8192, 32768
#: By how much a bound is relaxed against rounding.
_SLACK = 1e-9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """(k, dims) unit centres that locally maximise the sum of cosines of the unit rows of x with their nearest centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        full = norm > 1e-9
        centres[full] = sums[full] / norm[full, None]
    return centres


def _unit(column: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Double-precision unit rows, and which rows are usable: of dims components, all finite and not null, not all zero."""
    n = len(column)
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    dims = dims if dims is not None else int(lengths.max(initial=0))
    ok = lengths == dims if dims > 0 else np.zeros(n, bool)
    out = np.zeros((n, max(dims, 1)))
    if ok.any():
        flat = column.filter(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
        rows = flat.reshape(-1, dims)
        largest = np.abs(rows).max(axis=1)
        fine = np.isfinite(rows).all(axis=1) & (largest > 0)
        rows = rows[fine] / largest[fine, None]
        ok[np.flatnonzero(ok)[~fine]] = False
        out[ok] = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return out, ok


def _visits(x: np.ndarray, centres: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home, visits[row, cell]): the cell of the nearest centre, and the cells in which linked vectors may have their home.

    Let x have its home at centre c and a linked y at d. As y isn't nearer to c than to d,
    (c - d).x <= (c - d).(x - y) <= |c - d| |x - y|, which apart[c, d] holds. So no link is lost.
    """
    dots = x @ centres.T
    home = np.argmax(dots, axis=1)
    return home, dots[np.arange(len(x)), home][:, None] - dots <= apart[home]


def _groups(centres: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each cell, number of blocks of each group): cells one after the other along their nearest neighbours, so many together as fill a block."""
    group, blocks = np.zeros(len(centres), np.int64), []
    left, now, room = np.ones(len(centres), bool), 0, 0
    for _ in range(len(centres)):
        left[now] = False
        if not blocks or sizes[now] > room:
            blocks.append(max(1, -(-int(sizes[now]) // BLOCK)))
            room = blocks[-1] * BLOCK
        group[now] = len(blocks) - 1
        room -= int(sizes[now])
        if left.any():
            now = int(np.argmax(np.where(left, centres @ centres[now], -2.0)))
    return group, np.array(blocks)


class _Tile:
    """A block of home vectors in cells of about SUB, with which members are compared."""

    def __init__(self, x: np.ndarray, no: np.ndarray, copies: np.ndarray, cosine: float) -> None:
        self.cosine = cosine
        self.centres = spherical_kmeans(x, max(1, len(x) // SUB), rounds=3)
        near = np.argmax(x @ self.centres.T, axis=1)
        order = np.argsort(near, kind="stable")
        self.x, self.no, self.copies = x[order], no[order], copies[order]
        self.small = self.x.astype(np.float32)
        self.cuts = np.searchsorted(near[order], np.arange(len(self.centres) + 1))
        # a member linked with a vector at this angle from its centre is at most so much farther from it
        reach = math.acos(max(-1.0, min(1.0, cosine)))
        self.least = np.array([math.cos(min(math.pi, math.acos(max(-1.0, min(1.0, float((self.x[a:b] @ c).min())))) + reach)) - 1e-7 if b > a else 2.0 for c, a, b in zip(self.centres, self.cuts[:-1], self.cuts[1:], strict=True)])
        #: Single precision is off by less than this, so what passes is tested in double precision.
        self.loose = np.float32(cosine - 1e-6 - x.shape[1] * 1.2e-7)

    def links(self, x: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, links, b) of all linked vectors: with how many home vectors a member links, copies counted (0 for others), and the root among these links."""
        links, us, vs = np.zeros(len(no), np.int64), [no[:0]], [no[:0]]
        visits = x @ self.centres.T >= self.least
        small = x.astype(np.float32)
        for k in np.flatnonzero(visits.any(axis=0)):
            rows, a, b = np.flatnonzero(visits[:, k]), self.cuts[k], self.cuts[k + 1]
            for part in np.array_split(rows, -(-len(rows) // 4096)):
                u, v = np.nonzero(small[part] @ self.small[a:b].T >= self.loose)
                u, v = part[u], a + v
                other = no[u] != self.no[v]
                u, v = u[other], v[other]
                if len(u):
                    exact = np.concatenate([np.einsum("ij,ij->i", x[u[p : p + 65536]], self.x[v[p : p + 65536]]) for p in range(0, len(u), 65536)])
                    u, v = u[exact >= self.cosine], v[exact >= self.cosine]
                    np.add.at(links, u, self.copies[v])
                    nodes, root = forest(no[u], self.no[v])
                    us.append(nodes)
                    vs.append(root)
        linked = np.flatnonzero(links)
        nodes, root = forest(np.concatenate(us), np.concatenate(vs))
        most = np.zeros(len(nodes), np.int64)
        most[np.searchsorted(nodes, no[linked])] = links[linked]
        return nodes, most, root


def _products(dealt: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(a, links, b) for each linked vector of a tile: with how many of the tile's home vectors it links as a member, and its root among the tile's links.

    dealt: g, i, j, build, no, copies, vector; rows of a tile (g, i, j) one after the other: those
    of a block of the group's home vectors (build), then a chunk of its members, which stream by.
    A linked vector has one home, so each link of a member counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                *key, build = keys[a].tolist()
                rows = batch.slice(a, b - a)
                if key != now:
                    now, tile, held = key, None, []
                if build:
                    held.append(rows)
                    continue
                if tile is None and held:
                    home = pa.Table.from_batches(held).combine_chunks()
                    tile = _Tile(_unit(home.column(6).combine_chunks(), dims)[0], *(home.column(k).to_numpy() for k in (4, 5)), cosine)
                    held = []
                if tile is not None:
                    found = tile.links(_unit(rows.column(6), dims)[0], rows.column(4).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "links", "b"])

    return dealt.mapInArrow(run, "a long, links long, b long")


def _linked(vectors: DataFrame, dims: int, total: int, cosine: float) -> DataFrame:
    """(a, links, b) of all links among the distinct vectors (no, h1, h2, copies, vector) of one length."""
    spark = vectors.sparkSession
    share = min(1 << 20, math.ceil((1 << 20) * 2.0 * SAMPLE / total))
    sample = vectors.filter(F.pmod("h1", F.lit(1 << 20)) < share).orderBy("h1", "h2").limit(SAMPLE).select("vector").toArrow()
    if not sample.num_rows:  # a few vectors, none of which was drawn
        sample = vectors.limit(1).select("vector").toArrow()
    centres = spherical_kmeans(_unit(sample.column("vector").combine_chunks(), dims)[0], max(1, min(MOST_CELLS, total // PER_CELL)))
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) * math.sqrt(2 - 2 * cosine) + _SLACK
    rows = vectors.select("no", "copies", "vector")
    kind = rows.schema["vector"].dataType.simpleString()

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(centres), np.int64)
        for batch in batches:
            sizes += np.bincount(_visits(_unit(batch.column(2), dims)[0], centres, apart)[0], minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(sizes)], names=["cell", "n"])

    sizes = np.zeros(len(centres), np.int64)
    for r in rows.mapInArrow(homes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most MOST_CELLS rows
        sizes[r.cell] = r.n
    group, blocks = _groups(centres, sizes)

    def groups(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home group, row and group of each visit), a group once a row."""
        home, visits = _visits(_unit(batch.column(2), dims)[0], centres, apart)
        row, cell = np.nonzero(visits)
        row, g = np.divmod(np.unique(row * len(blocks) + group[cell]), len(blocks))
        return group[home], row, g

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(blocks), np.int64)
        for batch in batches:
            sizes += np.bincount(groups(batch)[2], minlength=len(blocks))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array(sizes)], names=["g", "n"])

    chunks = np.ones(len(blocks), np.int64)
    for r in rows.mapInArrow(members, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        chunks[r.g] = max(1, -(-r.n // CHUNK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, row, g = groups(batch)
            number = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            block = (number % blocks[home].astype(np.uint64)).astype(np.int64)
            own = np.repeat(np.arange(batch.num_rows), chunks[home])  # a home vector is in its block's tiles with all chunks
            j = np.arange(len(own)) - np.repeat(np.cumsum(chunks[home]) - chunks[home], chunks[home])
            at = np.repeat(row, blocks[g])  # a member is in its chunk's tiles with all blocks
            gs = np.repeat(g, blocks[g])
            i = np.arange(len(at)) - np.repeat(np.cumsum(blocks[g]) - blocks[g], blocks[g])
            chunk = ((number >> np.uint64(8))[at] % chunks[gs].astype(np.uint64)).astype(np.int64)
            for take, key, build in ((own, (home[own], block[own], j), True), (at, (gs, i, chunk), False)):
                for p in range(0, len(take), 20_000):
                    part = pa.array(take[p : p + 20_000])
                    keys = [pa.array(k[p : p + 20_000].astype(np.int32)) for k in key]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(part), build)), *(c.take(part) for c in batch.columns)], names=["g", "i", "j", "build", "no", "copies", "vector"])

    dealt = rows.mapInArrow(deal, f"g int, i int, j int, build boolean, no long, copies long, vector {kind}")
    tiles = dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", F.desc("build"))
    return materialise(_products(tiles, dims, cosine), "links")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with at least this cosine), component_id (smallest id that links reach), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are kept. Others are compared with all of their own length, each length by
    itself. Equal vectors are one row of the comparison, which knows their number, so copies
    cost nothing; rows with a repeated id are further vectors. A null id is ignored as the
    smallest, unless all ids of a component are null. Cosines are computed in double
    precision from the components as they are given. No link is lost, and each counts at
    both ends. Where the data have no cells to speak of, all pairs of blocks are compared.
    """
    given = vectors.schema[vector].dataType.simpleString()
    kind = "float" if given == "array<float>" else "double"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.transform(F.col(vector).cast(f"array<{kind}>"), lambda v: v + F.lit(0.0).cast(kind)).alias("vector"))  # -0.0 becomes 0.0
    usable = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vector", lambda v: v != 0)
    hashed = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("h1", F.when(F.col("ok"), F.xxhash64("vector"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "vector")))
    distinct = hashed.filter("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    numbered = materialise(distinct.withColumn("no", F.monotonically_increasing_id()).withColumn("d", F.size("vector")), "vectors")
    found = numbered.select(F.col("no").alias("a"), F.lit(0).cast("long").alias("links"), F.col("no").alias("b")).limit(0)
    for r in numbered.groupBy("d").count().filter("count > 1").orderBy("d").collect():  # one row a length; a job each
        found = found.unionByName(_linked(numbered.filter(F.col("d") == r.d), r.d, r["count"], cosine))
    merged = components(found.select("a", "b")).withColumnRenamed("node", "no")
    links = found.groupBy(F.col("a").alias("no")).agg(F.sum("links").alias("links"))
    classes = numbered.select("no", "h1", "h2", "rep", "copies").join(merged, "no", "left").join(links, "no", "left").withColumn("comp", F.coalesce("component", "no"))
    least = classes.groupBy("comp").agg(F.min("rep").alias("least"))
    classes = classes.join(least, "comp").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    # the rows of a vector with many copies are split by AQE: the other side has one row for each vector
    out = hashed.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
