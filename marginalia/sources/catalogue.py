"""A taxon catalogue in tiles: look-ups that open only the tiles they need, and records as JSON with what they are linked to.

Data tiles hold ranges of ids, index tiles ranges of terms. Beside them a table names each
file with its least and its greatest key. Look-ups bisect the list of least keys, so they know
which files to open before reading any.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxa as tx
from ..operators.trees import stored
from .files import data_tile_lines, index_lines, parse_data_tile, parse_index_tile, shared_path, write_ranges

#: Rounds in which a line of parents is climbed, at most; a longer line, or a circle, is an error.
DEEPEST = 64


def _write_table(lines: DataFrame, key: Column, path: str, out: str) -> None:
    """(file, lo, hi) of the tiles under a path, as a table beside them."""
    of = lines.select(key.alias("key"), F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    of.coalesce(1).write.parquet(f"{path}/{out}.tiles")  # a row for each tile


def write(records: DataFrame, postings: DataFrame, path: str, tiles: int) -> None:
    """Data tiles of records (see data_tile_lines), index tiles of postings (term, kind, cap, id), and the tables of both."""
    spark = records.sparkSession
    write_ranges(data_tile_lines(records), "id", f"{path}/data", tiles)
    write_ranges(index_lines(postings), "term", f"{path}/index", tiles)
    own_id = F.conv(F.substring_index(F.substring_index("value", "\t", 1), "/", 1), 16, 10).cast("long")
    _write_table(spark.read.text(f"{path}/data"), own_id, path, "data")
    _write_table(spark.read.text(f"{path}/index"), F.substring_index("value", "\t", 1), path, "index")


class Tiles:
    """The table of the tiles of one kind: files, least and greatest keys, in order."""

    def __init__(self, spark: SparkSession, path: str, name: str, kind: str) -> None:
        self.spark, self.folder, self.kind = spark, f"{path}/{name}", kind
        rows = sorted((r.lo, r.hi, r.file) for r in spark.read.parquet(f"{path}/{name}.tiles").collect())  # a row for each tile
        for before, after in zip(rows[:-1], rows[1:], strict=True):
            if after[0] <= before[1]:
                raise ValueError(f"tiles overlap: {before[2]} ends at {before[1]}, {after[2]} starts at {after[0]}")
        self.lo, self.hi, self.files = ([r[k] for r in rows] for k in range(3))

    def _list(self, values: list) -> Column:
        return F.split(F.lit("\t".join(map(str, values))), "\t").cast(f"array<{self.kind}>")

    def _before(self, key: Column) -> Column:
        """How many tiles start at the key or before it, by bisection."""
        steps = [1 << k for k in reversed(range(len(self.lo).bit_length()))]
        lo = self._list(self.lo)
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when((n + step <= len(self.lo)) & (F.get(lo, n + step - 1) <= key), n + step).otherwise(n))

    def holding(self, keys: DataFrame, key: str) -> list[str]:
        """The files that may hold any of the keys."""
        if not self.lo:
            return []
        at = keys.select((self._before(F.col(key)) - 1).alias("tile"), F.col(key).alias("key"))
        inside = at.filter((F.col("tile") >= 0) & (F.col("key") <= F.get(self._list(self.hi), F.col("tile"))))
        return [self.files[r.tile] for r in inside.select("tile").distinct().collect()]  # at most a row for each tile

    def between(self, least: str, end: str) -> list[str]:
        """The files that may hold keys from least on and before end."""
        return [f for lo, hi, f in zip(self.lo, self.hi, self.files, strict=True) if lo < end and hi >= least]

    def lines(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema("value string").text([f"{self.folder}/{f}" for f in files]) if files else self.spark.createDataFrame([], "value string")


class Catalogue:
    """A catalogue that write() wrote under a path. Overlapping tiles are an error. get() keeps at most `resident` tiles in memory."""

    def __init__(self, spark: SparkSession, path: str, resident: int = 8) -> None:
        self.spark = spark
        self.data, self.index = Tiles(spark, path, "data", "bigint"), Tiles(spark, path, "index", "string")
        self.resident, self._held = resident, OrderedDict()

    def records(self, ids: DataFrame, key: str = "id") -> DataFrame:
        """The records with these ids, each once; reads the tiles that may hold them."""
        asked = ids.select(F.col(key).cast("long").alias("id")).distinct()
        return parse_data_tile(self.data.lines(self.data.holding(asked, "id"))).join(asked, "id", "left_semi")

    def get(self, number: int) -> dict | None:
        """One record; its tile stays in memory until `resident` others have been used since."""
        files = self.data.holding(self.spark.createDataFrame([(number,)], "id long"), "id")
        if not files:
            return None
        if files[0] not in self._held:
            self._held[files[0]] = parse_data_tile(self.data.lines(files)).persist()
        self._held.move_to_end(files[0])
        while len(self._held) > self.resident:
            self._held.popitem(last=False)[1].unpersist()
        found = self._held[files[0]].filter(F.col("id") == number).first()
        return found.asDict(recursive=True) if found else None

    def all_records(self) -> DataFrame:
        return parse_data_tile(self.data.lines(self.data.files))

    def postings(self, terms: DataFrame, term: str = "term") -> DataFrame:
        """(term, kind, cap, id) of these terms."""
        asked = terms.select(F.col(term).alias("term")).distinct()
        return parse_index_tile(self.index.lines(self.index.holding(asked, "term"))).join(asked, "term", "left_semi")

    def postings_from(self, prefix: str) -> DataFrame:
        """(term, kind, cap, id) of the terms that begin so."""
        return parse_index_tile(self.index.lines(self.index.between(prefix, prefix + "\U0010ffff"))).filter(F.col("term").startswith(prefix))

    def lineages(self, ids: DataFrame) -> DataFrame:
        """(id, dist, anc, rank, epithet) of these ids (dist 0) and all above them; a synonym's line is its own record only. Each round reads the tiles of the parents it is at."""
        at = ids.select("id", F.col("id").alias("anc")).distinct()
        out = None
        for dist in range(DEEPEST):
            known = self.records(at, "anc").select(F.col("id").alias("anc"), "rank", "epithet", F.when(F.col("valid").isNull(), F.col("parent")).alias("up"))
            folder = shared_path(self.spark, "lineage")
            at.join(known, "anc").withColumn("dist", F.lit(dist)).write.parquet(folder)
            step = self.spark.read.parquet(folder)
            out = step if out is None else out.unionByName(step)
            at = step.filter("up IS NOT NULL").select("id", F.col("up").alias("anc"))
            if not at.limit(1).count():
                return out.select("id", "dist", "anc", "rank", "epithet")
        raise ValueError(f"a line of more than {DEEPEST} parents")


def _shown(catalogue: Catalogue, ids: DataFrame) -> DataFrame:
    """(id, short, line): of these ids the fields that every record has, and all above them; a name below genus begins with those from genus on."""
    genus = tx.NAMES.index("genus") + 1
    records = catalogue.records(ids).select("id", "rank", "epithet", "authority", "valid")
    lines = catalogue.lineages(ids)
    line = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dist", "anc", "rank", "epithet"))).alias("line"))
    parts = F.transform(F.filter(F.reverse("line"), lambda x: (tx.level(x["rank"]) >= genus) | (x["dist"] == 0)), lambda x: x["epithet"])
    joined = records.join(line, "id")
    short = F.struct("id", F.array_join(parts, " ").alias("name"), "authority", F.col("valid").isNotNull().alias("isSynonym"), "rank")
    return joined.select("id", short.alias("short"), "line")


def _inner(value: Column) -> Column:
    """The members of a JSON object, null if it has none."""
    text = F.to_json(value)
    return F.nullif(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(""))


def to_json(catalogue: Catalogue, ids: DataFrame, higher: bool = True, expand: bool = False) -> DataFrame:
    """(id, json) of the records with these ids.

    A record has id, name, authority, isSynonym and rank; a valid one its parent, children and
    synonyms, a synonym its valid one: as ids (parentId, childIDs, synonymIDs, validId), or
    expanded as records without links (parent, children, synonyms, valid). With higher, it has
    the primary ranks above it (above its valid one) by name, or expanded. What there isn't is left
    out. Linked records that the catalogue doesn't hold are left out where they are expanded.
    """
    own = catalogue.records(ids)
    links = own.select("id", F.col("parent"), "valid", F.coalesce("children", F.array().cast("array<long>")).alias("children"), F.coalesce("synonyms", F.array().cast("array<long>")).alias("synonyms"))
    links = stored(links.withColumn("parent", F.when(F.col("valid").isNull(), F.col("parent"))), "links")  # else the tiles are parsed anew for each use
    start = links.select("id", F.coalesce("valid", "id").alias("base"))
    shown_ids = links.select("id").union(start.select("base"))
    many = links.select("id", F.posexplode(F.array(F.array("parent"), F.array("valid"), "children", "synonyms")).alias("role", "ids")).select("id", "role", F.posexplode("ids").alias("place", "to")).filter("to IS NOT NULL")
    if expand:
        shown_ids = shown_ids.union(many.select("to"))
    above = catalogue.lineages(start.select(F.col("base").alias("id"))).filter(F.col("dist") > 0) if higher else None
    above = above.filter(tx.is_primary(F.col("rank"))) if higher else None
    if higher and expand:
        shown_ids = shown_ids.union(above.select("anc"))
    shown = stored(_shown(catalogue, stored(shown_ids.toDF("id").distinct(), "shown-ids")), "shown")
    short = shown.select(F.col("id").alias("to"), "short")
    out = links.join(shown.select("id", "short"), "id")
    if expand:
        told = many.join(short, "to").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("role", "place", "short"))).alias("linked"))
        of = lambda role: F.transform(F.filter("linked", lambda x: x["role"] == role), lambda x: x["short"])
        out = out.join(told, "id", "left").withColumn("linked", F.coalesce("linked", F.array().cast(told.schema["linked"].dataType)))
        one = F.struct(F.get(of(0), F.lit(0)).alias("parent"), F.get(of(1), F.lit(0)).alias("valid"))
        lists = F.struct(*(F.when(F.size(of(k)) > 0, of(k)).alias(n) for k, n in ((2, "children"), (3, "synonyms"))))
    else:
        one = F.struct(F.col("parent").alias("parentId"), F.col("valid").alias("validId"))
        lists = F.struct(*(F.when(F.size(c) > 0, F.col(c)).alias(n) for c, n in (("children", "childIDs"), ("synonyms", "synonymIDs"))))
    ranks = F.lit(None).cast("string")
    if higher:
        if expand:
            above = above.join(shown.select(F.col("id").alias("anc"), F.to_json("short").alias("value")), "anc")
        else:
            above = above.withColumn("value", _quoted(F.col("epithet")))  # a primary rank from genus up has its epithet as its name
        member = F.concat(F.lit('"'), F.col("rank"), F.lit('":'), "value")
        line = above.groupBy(F.col("id").alias("base")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dist", member.alias("m")))), lambda x: x["m"]), ",").alias("higher"))
        out = out.join(start, "id").join(line, "base", "left")
        ranks = F.col("higher")
    base = _inner(F.struct("short.id", "short.name", "short.authority", "short.isSynonym"))
    return out.select("id", F.concat(F.lit("{"), F.concat_ws(",", base, _inner(one), ranks, _inner(lists), _inner(F.struct("short.rank"))), F.lit("}")).alias("json"))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def find_json(catalogue: Catalogue, query: str, from_rank: str = "kingdom", to_rank: str = tx.NAMES[-1], prefix: bool = False, match_case: bool = True, synonyms: bool = False, higher: bool = False, expand: bool = False) -> DataFrame:
    """(id, json) of the records whose epithet is the query's last word (or begins so), within ranks, and whose line bears the words before it, in order."""
    *before, last = query.split()
    term = "".join(c for c in last.lower() if c.isascii() and (c.isalnum() or c == "-"))
    asked = catalogue.postings_from(term) if prefix else catalogue.postings(catalogue.spark.createDataFrame([(term,)], "term string"))
    hit = asked.filter((F.col("kind") == "E") & (F.lit(not match_case) | (F.col("cap") == F.lit(last[:1].isupper()))))
    found = catalogue.records(hit).filter(tx.level(F.col("rank")).between(tx.NAMES.index(from_rank) + 1, tx.NAMES.index(to_rank) + 1))
    found = found.filter(tx.matches(F.col("epithet"), F.lit(last), prefix, match_case))
    if not synonyms:
        found = found.filter("valid IS NULL")
    return to_json(catalogue, _below(catalogue, found.select("id"), before, prefix, match_case), higher, expand)


def search_json(catalogue: Catalogue, query: str, prefix: bool = False, match_case: bool = True, synonyms: bool = False, higher: bool = False, expand: bool = False) -> DataFrame:
    """(id, json) of the records that the index has under the query's last word (or under terms that begin so), whatever their rank; with synonyms, also by words of their prefixes."""
    *before, last = query.split()
    term = last.lower()
    asked = catalogue.postings_from(term) if prefix else catalogue.postings(catalogue.spark.createDataFrame([(term,)], "term string"))
    lower = last == last.lower()
    hit = asked.filter(F.lit(not match_case) | (F.col("cap") == F.lit(not lower))).filter((F.col("kind") == "E") | F.lit(synonyms))
    return to_json(catalogue, _below(catalogue, hit.select("id").distinct(), before, prefix, match_case), higher, expand)


def _below(catalogue: Catalogue, ids: DataFrame, words: list[str], prefix: bool, match_case: bool) -> DataFrame:
    if not words:
        return ids
    from ..operators.trees import epithet_prefix_matches

    folder = shared_path(catalogue.spark, "lines")
    catalogue.lineages(ids).write.parquet(folder)
    lines = catalogue.spark.read.parquet(folder)
    tree = lines.select("anc", F.col("id").alias("desc"), "dist")
    records = lines.select(F.col("anc").alias("id"), "rank", "epithet").distinct()
    return epithet_prefix_matches(tree, records, words, "intermediate", prefix, match_case).join(ids, "id", "left_semi")
