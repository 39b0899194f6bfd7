"""An exact Jaccard join of documents on word shingles.

Sets are held as sorted arrays of 64-bit hashes. Two linked sets share a shingle in
their prefixes (the first quarter of each in one global order), and their sizes are in
one size band or in adjacent ones, so candidates meet in tiles of (prefix shingle, size
band). Inside a tile, hashed bitmap signatures are compared bit by bit: the number of
differing bits bounds the overlap from above. What passes is intersected exactly.

Work is kept linear in a group of copies: sets that are equal are one class; then sets
next to each other in a tile, and components' nearest pairs, are tested and merged; and
of what is left, only pairs from different components need a test. Nothing is capped: a large tile is cut into
chunks, and pairs of chunks are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices
from .graph import components

WORDS = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Signatures have a power of two of bits in this range, four times the set's size or more; the larger of two is folded.
LEAST_BITS, MOST_BITS = 128, 16384
#: A shingle that so many prefixes share comes last in the global order; at most HEAVY_MOST of them, the most frequent.
#: The order decides how much work there is, never the result.
HEAVY, HEAVY_MOST = 64, 50_000
#: Bits of the map that keeps sets without a candidate out of a shuffle.
FILTER_BITS = 1 << 24
#: Members of a tile that are compared in one piece; in tiles of SMALL members, pairs are told first and their signatures looked up after.
TILE, SMALL = 4096, 16
#: Sets that a task remembers to have told; rows of a home's tiles that one task gets, about: each of these tasks may tell a pair again.
ONCE, HOME = 1 << 18, 32768
#: Nearest pairs are looked for in one of so many tiles: copies share many, and what isn't found there is tested in the end.
NEAREST = 4
#: Tiles of more members are compared band by band; in smaller ones the test of sizes does the same.
BANDED = 256
#: So many rows that go, at most, are broadcast (24 bytes each).
GONE = 1 << 19
#: Bytes of signatures that are compared in one step, and pairs that a task remembers to have told.
COMPARED, TOLD = 1 << 23, 1 << 21
#: Sizes and places in the prefix are shuffled as one number, size * PLACES + place.
PLACES = 1 << 24
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POSITION = _mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_LANE = 8
_REST = np.array([(1 << 64) - 1, *((1 << 8 * k) - 1 for k in range(1, _LANE))], np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in one byte array, text k between offsets k and k + 1: each word's 64-bit hash, and how many words come before each offset.

    A word is cut into lanes of eight bytes. What a lane adds is a mix of its bytes and its place,
    without any algebraic relation between lanes, so words of whatever pattern or length differ.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.zeros(n + 2, bool)
    edge[offsets + 1] = True  # a text starts
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge[1:]))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:]))
    size = end - start
    lanes = -(-size // _LANE)
    first = np.cumsum(lanes) - lanes
    within = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
    padded = np.zeros(n + _LANE, np.uint8)
    padded[:n] = _LOWER[data]
    value = np.ndarray(n + 1, "<u8", padded.data, strides=(1,))[np.repeat(start, lanes) + _LANE * within]
    value[first + lanes - 1] &= _REST[size % _LANE]
    value = _mix(value ^ _mix((within + 1).astype(np.uint64) * _BASE))
    total = np.add.reduceat(value, first) if len(first) else value
    return _mix(total + size.astype(np.uint64) * _BASE), np.searchsorted(start, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than WORDS words, its whole sequence is one; without words there are none."""
    hashed, first = words(data, offsets)
    if len(hashed) >= WORDS:
        count = len(hashed) - WORDS + 1
        mixed = np.zeros(count, np.uint64)
        for j in range(WORDS):
            mixed += hashed[j : j + count] * _POSITION[j]
        mixed = _mix(mixed)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            x = np.sort(mixed[a : b - WORDS + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            short = np.array([b - a], np.uint64) * _BASE + (hashed[a:b] * _POSITION[: b - a]).sum(keepdims=True)
            out.append(_mix(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def pack(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def prefix_length(n: int) -> int:
    """Two linked sets share one of so many first elements of each, in any common order."""
    return n - -(-n * PERCENT // 100) + 1


def signature(x: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(4 * len(x) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(x % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def text_hash(text: str) -> F.Column:
    """A hash of a text, by which rows with one id are told apart; null has one too."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def shingle_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, h, n, sid, more, sig, head, tail): each document's set, h being a hash of its text; sid and more, 64 bits each, identify equal sets, head and tail are the packed prefix and rest."""
    import xxhash

    names = ["doc_id", "h", "n", "sid", "more", "sig", "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sid, more, sig, head, tail = [], [], [], [], [], []
            for x in shingles(*_text_buffers(batch.column(2))):
                n.append(len(x))
                if not len(x):
                    sid.append(None), more.append(None), sig.append(None), head.append(None), tail.append(None)
                    continue
                cut = prefix_length(len(x))
                high, low = divmod(xxhash.xxh3_128_intdigest(x.tobytes()), 1 << 64)
                sid.append(low - (1 << 63)), more.append(high - (1 << 63))
                sig.append(signature(x))
                head.append(pack(x[:cut]))
                tail.append(pack(x[cut:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(more, pa.int64()), *(pa.array(c, pa.binary()) for c in (sig, head, tail))], names=names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_hash(text).alias("h"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, n long, sid long, more long, sig binary, head binary, tail binary")


def _heavy(sets: DataFrame) -> np.ndarray:
    """Shingles in HEAVY prefixes or more, at most HEAVY_MOST of them, sorted. Each task counts all its prefixes and tells what occurs there more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list[np.ndarray]) -> pa.RecordBatch:
            tok, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tok[n > 1].astype(np.int64)), pa.array(n[n > 1])], names=["tok", "n"])

        parts: list[np.ndarray] = []
        for batch in slices(batches):
            parts += [unpack(x) for x in batch.column(0).to_pylist()]
            if sum(map(len, parts)) > 1 << 20:
                yield told(parts)
                parts = []
        if parts:
            yield told(parts)

    distinct = sets.filter("head IS NOT NULL").select("head").mapInArrow(run, "tok long, n long")
    found = distinct.groupBy("tok").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY).orderBy(F.desc("n"), "tok").limit(HEAVY_MOST)
    return np.sort(np.array([r.tok for r in found.collect()], np.int64).view(np.uint64))


def _entries(sets: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(tok, sid, np): the prefix of each set in the order that puts heavy shingles last; np is the set's size and the shingle's place.

    A task tells equal sets once (again after ONCE sets), so copies are gone before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: set[int] = set()
        for batch in slices(batches):
            new = []
            for x in batch.column(0).to_pylist():
                new.append(x not in once)
                once.add(x)
            if len(once) > ONCE:
                once.clear()
            batch = batch.filter(pa.array(new))
            toks, lens = [], []
            for head, tail in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x = unpack(head)
                if len(heavy):
                    late = _member(heavy, x)
                    if late.any():
                        every = np.concatenate([x, unpack(tail)])
                        late = _member(heavy, every)
                        x = np.concatenate([every[~late], every[late]])[: len(x)]
                toks.append(x)
                lens.append(len(x))
            if toks:
                at = np.repeat(np.arange(len(lens)), lens)
                place = np.concatenate([np.arange(k) for k in lens])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).astype(np.int64)), batch.column(0).take(pa.array(at)), pa.array(batch.column(1).to_numpy()[at] * PLACES + place)], names=["tok", "sid", "np"])

    return sets.filter("sid IS NOT NULL").select("sid", "n", "head", "tail").mapInArrow(run, "tok long, sid long, np long")


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _only(sets: DataFrame, needed: DataFrame) -> DataFrame:
    """(sid, x): the sets whose sid is needed. A bit map of fixed size, of the needed sids' last bits, drops most others before the shuffle."""
    place = needed.select(F.expr(f"sid & {FILTER_BITS - 1}").alias("h"))
    filled = place.groupBy(F.expr("shiftright(h, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[[r.w for r in filled]] = [r.bits for r in filled]
    table = table.view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 22):
            h = batch.column(0).to_numpy() & (FILTER_BITS - 1)
            batch = batch.filter(pa.array((table[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_join_element_wise(batch.column(1), batch.column(2), b"")], names=["sid", "x"])

    rows = sets.filter("sid IS NOT NULL").select("sid", "head", "tail").mapInArrow(run, "sid long, x binary")
    return rows.join(needed, "sid", "left_semi").groupBy("sid").agg(F.first("x").alias("x"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sids whose sets link, by exact intersection. Only sets in a pair are shuffled, each once a side."""
    pairs = materialise(pairs.distinct(), "distinct")
    needed = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    arrays = materialise(_only(sets, needed), "arrays")
    both = pairs.join(arrays.select(F.col("sid").alias("a"), F.col("x").alias("xa")), "a").join(arrays.select(F.col("sid").alias("b"), F.col("x").alias("xb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpack(a.as_py()), unpack(b.as_py())
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= PERCENT * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _reachable(n_a, place_a, n_b, place_b):
    """Whether two sets may link whose first common shingle has these places: no more can be common than what follows the place in either. Takes columns, numbers or arrays."""
    least = F.least if isinstance(n_a, Column) else np.minimum
    return (100 + PERCENT) * least(n_a - place_a, n_b - place_b) >= PERCENT * (n_a + n_b)


def _band(n: F.Column) -> F.Column:
    """Sizes of linked sets differ by 4/3 at most, so their bands by one at most."""
    return F.floor(F.log(n.cast("double")) / np.log(100 / PERCENT) + 1e-9).cast("int")


def _tile_pairs(members: DataFrame, info: DataFrame, nearest: bool) -> DataFrame:
    """Candidate pairs (a, b) from different components, in tiles in which signatures bound the overlap; with nearest, only the nearest pair of each component in a tile.

    members: tok, sid, n, place, comp, m (members of the shingle), lo (the least component). Up
    to TILE members are one tile, compared by bands; the tiles of a group of copies share lo,
    their home, and are dealt over as many tasks as they need for HOME rows each, which tell
    each of their pairs once.
    More are cut into tiles of (tok, band): a set is a member of its own band's tile, and a
    guest in the next one's, guests not being compared with each other; and a tile of more
    than TILE members is dealt out by pairs of its chunks, drawn by a hash.
    """
    few = members.filter(F.col("m") <= TILE).select("tok", "sid", "n", "place", "comp", F.col("lo").alias("home"), *(F.lit(0).alias(k) for k in ("band", "i", "j", "c")), F.lit(False).alias("guest"))
    large = materialise(few.groupBy("home").agg(F.count("*").alias("rows")).filter(F.col("rows") > HOME), "homes")
    large = F.broadcast(large) if large.count() <= TOLD // 16 else large
    few = few.join(large, "home", "left").withColumn("part", F.when(F.col("rows").isNotNull(), F.pmod(F.xxhash64("tok"), F.ceil(F.col("rows") / HOME))).otherwise(0).cast("int")).drop("rows")
    own = members.filter(F.col("m") > TILE).withColumn("home", F.col("tok")).withColumn("part", F.lit(0)).withColumn("band", _band(F.col("n"))).withColumn("guest", F.lit(False))
    many = own.unionByName(own.withColumn("band", F.col("band") + 1).withColumn("guest", F.lit(True)))
    many = many.join(many.groupBy("tok", "band").agg((F.ceil(F.count("*") / TILE) - 1).cast("int").alias("last")), ["tok", "band"])
    many = many.withColumn("c", F.pmod(F.xxhash64("sid"), F.col("last") + 1).cast("int"))
    many = many.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("i", F.least("c", "k")).withColumn("j", F.greatest("c", "k"))
    keys = ["home", "part", "tok", "band", "i", "j"]
    tiles = few.unionByName(many.select(few.columns)).join(info.select("sid", "sig"), "sid")
    tiles = tiles.repartition("home", "part", "band", "i", "j").sortWithinPartitions(*keys).select(*keys, "c", "sid", "n", "place", "comp", "guest", "sig")

    def compare(t: tuple, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        *numbers, guest, sig = (list(x) for x in zip(*rows, strict=True))
        c, sid, n, place, comp = (np.array(x, np.int64) for x in numbers)
        guest = np.array(guest)
        width = min(map(len, sig))
        bits = np.stack([_fold(s, width) for s in sig])
        order = np.argsort(n, kind="stable")
        same = t[4] == t[5]
        left, right = (order, order) if same else (order[c[order] == t[4]], order[c[order] == t[5]])
        rank = np.empty(len(c), np.int64)
        rank[order] = np.arange(len(c))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for x, near in _bands(n[left], n[right], same) if len(c) > BANDED else [(slice(None), slice(None))]:
            out += list(products(left[x], right[near], n, place, comp, guest, bits, rank, sid, same))
        return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (sid[:0], sid[:0])

    def products(left, right, n, place, comp, guest, bits, rank, sid, same):  # noqa: ANN001, ANN202
        step = max(1, COMPARED // max(1, len(right) * bits.shape[1] * 8))
        for p in range(0, len(left), step):
            x = left[p : p + step]
            ok = (comp[x][:, None] != comp[right]) & ~(guest[x][:, None] & guest[right]) & _reachable(n[x][:, None], place[x][:, None], n[right], place[right])
            if same:
                ok &= rank[x][:, None] < rank[right]
            u, v = np.nonzero(ok)
            differ = np.bitwise_count(bits[x[u]] ^ bits[right[v]]).sum(axis=1, dtype=np.int64)
            total = n[x[u]] + n[right[v]]
            near = _possible(total, differ)
            u, v = x[u[near]], right[v[near]]
            if nearest and len(u):  # each component's best pair, from either side
                best = np.argsort(differ[near], kind="stable")
                u, v = u[best], v[best]
                first = np.union1d(np.unique(comp[u], return_index=True)[1], np.unique(comp[v], return_index=True)[1])
                u, v = u[first], v[first]
            yield np.minimum(sid[u], sid[v]), np.maximum(sid[u], sid[v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        rows: list[tuple] = []
        told = np.empty(0, np.uint64)  # hashes of the pairs of one home, up to TOLD; a pair that is told again costs a row, not a result

        def done() -> pa.RecordBatch:
            nonlocal told
            a, b = compare(now, rows)
            code = _mix(a.astype(np.uint64) * _BASE + b.astype(np.uint64))
            new = ~np.isin(code, told)
            told = np.concatenate([told, code[new]]) if len(told) < TOLD else code[new]
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

        for batch in slices(batches):
            for r in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if r[:6] != now:
                    if len(rows) > 1:
                        yield done()
                    if now is not None and r[:2] != now[:2]:
                        told = told[:0]
                    now, rows = r[:6], []
                rows.append(r[6:])
        if len(rows) > 1:
            yield done()

    return tiles.mapInArrow(run, "a long, b long")


def _bands(left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[slice, slice]]:
    """Which of the sorted sizes on either side may link, band by band: those of a band with those of its own and the next, and, unless both sides are the same, the one before."""
    band = lambda x: np.floor(np.log(np.maximum(x, 1)) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)
    left, right = band(left), band(right)
    for b in np.unique(left):
        yield slice(*np.searchsorted(left, [b, b + 1])), slice(*np.searchsorted(right, [b if same else b - 1, b + 2]))


def _fold(sig: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(sig, np.uint64)
    while len(x) * 8 > width:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def _bounded(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """(a, b, d): the distinct pairs that signatures don't rule out, with the number of differing bits."""
    pairs = materialise(pairs.select("a", "b").distinct(), "pairs")
    one, two = (info.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
    signed = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            differ, total = [], batch.column(2).to_numpy() + batch.column(3).to_numpy()
            for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                width = min(len(a), len(b))
                differ.append(int(np.bitwise_count(_fold(a, width) ^ _fold(b, width)).sum()))
            near = pa.array(_possible(total, np.array(differ, np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(near) for k in (0, 1)), pa.array(np.array(differ, np.int64)).filter(near)], names=["a", "b", "d"])

    return materialise(signed.mapInArrow(run, "a long, b long, d long"), "bounded")


def _nearest(bounded: DataFrame) -> DataFrame:
    """Of bounded pairs those in which one is the other's nearest by differing bits; at most two a set."""
    left = bounded.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    right = bounded.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a"))
    return left.unionByName(right)


def _small_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) from different components and of fitting sizes in tiles of at most SMALL members."""
    tiles = members.groupBy("tok").agg(F.collect_list(F.struct("sid", "n", "place", "comp")).alias("x")).select("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for x in batch.column(0).to_pylist():
                for k, one in enumerate(x):
                    for two in x[k + 1 :]:
                        if one["comp"] != two["comp"] and (100 + PERCENT) * min(one["n"] - one["place"], two["n"] - two["place"]) >= PERCENT * (one["n"] + two["n"]):
                            pairs.add((min(one["sid"], two["sid"]), max(one["sid"], two["sid"])))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def _possible(total: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether two sets with so many elements in all may link: each differing bit is an element of one only, so the overlap is at most (total - differ) / 2."""
    return (100 + PERCENT) * (total - differ) >= 2 * PERCENT * total


def _mixed(alive: DataFrame, merged: DataFrame) -> DataFrame:
    """(tok, sid, n, place, comp, m, lo): the members of tiles that have more than one component, with the tile's number of members and least component."""
    comps = alive.select("tok", "sid", "n", "place").join(merged.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
    across = Window.partitionBy("tok")
    marked = comps.withColumn("lo", F.min("comp").over(across)).withColumn("hi", F.max("comp").over(across)).withColumn("m", F.count("*").over(across))
    return materialise(marked.filter("lo < hi").drop("hi"), "mixed")


def _identified(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, (sid, n, sig) of the distinct ones). Where sets that differ in their further 64 bits share a sid, their sids are made anew from both."""
    while True:
        info = sets.filter("sid IS NOT NULL").groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("more").alias("lo"), F.max("more").alias("hi"))
        info = materialise(info, "signatures")
        shared = info.filter("lo <> hi").select("sid", F.lit(True).alias("shared"))
        if not shared.limit(1).count():
            return sets, info.select("sid", "n", "sig")
        sets = materialise(sets.join(shared, "sid", "left").withColumn("sid", F.when(F.col("shared"), F.xxhash64("sid", "more")).otherwise(F.col("sid"))).select(sets.columns), "sets")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, n, comp): each row's class by links; comp is any number of the class, null without shingles, and h the hash of the text."""
    sets, info = _identified(materialise(shingle_sets(docs, key, text), "sets"))
    entries = _entries(sets, _heavy(sets)).repartition("tok")
    by_size = Window.partitionBy("tok").orderBy("np", "sid")
    # equal sets are neighbours here, and only the first of them counts
    entries = entries.withColumn("prev", F.lag("sid").over(by_size)).withColumn("prev_np", F.lag("np").over(by_size)).filter("prev IS NULL OR prev <> sid")
    alive = entries.withColumn("members", F.count("*").over(Window.partitionBy("tok"))).filter("members > 1").drop("members")
    number, place = (lambda c: F.floor(F.col(c) / PLACES)), (lambda c: F.pmod(F.col(c), F.lit(PLACES)))
    alive = alive.select("tok", "sid", number("np").alias("n"), place("np").alias("place"), "prev", number("prev_np").alias("prev_n"), place("prev_np").alias("prev_place"))
    alive = materialise(alive, "alive")
    chain = alive.filter(F.col("prev").isNotNull() & _reachable(F.col("prev_n"), F.col("prev_place"), F.col("n"), F.col("place"))).select(F.least("prev", "sid").alias("a"), F.greatest("prev", "sid").alias("b"))
    links = materialise(_verified(_nearest(_bounded(chain, info)), sets), "links")
    merged = components(links)
    mixed = _mixed(alive, merged)
    # a large tile may be a group of copies: it is merged further by its components' nearest pairs before all pairs are tested
    near = _verified(_bounded(_tile_pairs(mixed.filter((F.col("m") > SMALL) & (F.pmod(F.xxhash64("tok"), F.lit(NEAREST)) == 0)), info, nearest=True), info).select("a", "b"), sets)
    links = materialise(links.unionByName(near), "links")
    mixed = _mixed(mixed, components(links))
    pairs = _small_pairs(mixed.filter(F.col("m") <= SMALL)).unionByName(_tile_pairs(mixed.filter(F.col("m") > SMALL), info, nearest=False))
    more = _verified(_bounded(pairs, info).select("a", "b"), sets)
    # written first, as everywhere: a task with two Python steps in a row would need two workers, and an executor keeps all that it ever had
    final = components(materialise(links.unionByName(more), "links"))
    told = sets.select("doc_id", "h", "n", "sid").join(final.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    return materialise(told.select("doc_id", "h", "n", "comp"), "classes")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).

    A null or blank text has no shingles and links with nothing, so its component is
    its own id. Repeated texts and repeated rows are linked; rows with a null id take
    part in links and are ignored as the smallest id, unless all ids are null. An empty
    table gives an empty table. Links are the same whatever the order or partitions.
    """
    told = classes(docs, key, text)
    least = told.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).filter("size > 1").drop("size")
    return told.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each class one row, that with the smallest key, or in a tie the smallest hash of its text.

    Null keys come last. Rows without shingles are classes of their own and all stay.
    Of rows that are the same in key and text, one stays, any if they differ elsewhere.
    """
    told = classes(docs, key, text)
    some = told.filter("comp IS NOT NULL")
    best = some.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("best"))
    gone = some.join(best, "comp").filter(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))))
    gone = materialise(gone.select(F.col("doc_id").alias("__id"), F.col("h").alias("__k")).distinct(), "gone")
    # the texts aren't shuffled if what goes is few enough to be told to all tasks; else both sides are
    gone = F.broadcast(gone) if gone.count() <= GONE else gone
    rows = docs.withColumn("__h", text_hash(text))
    kept = rows.join(gone, (F.col("__h") == F.col("__k")) & F.col(key).cast("long").eqNullSafe(F.col("__id")), "left_anti")
    if some.groupBy("doc_id", "h").count().filter("count > 1").limit(1).count():  # rows repeat, and one of each stays
        blank = ~F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
        kept = kept.filter(~blank).dropDuplicates(["__h", key]).unionByName(kept.filter(blank))
    return kept.select(*docs.columns)
