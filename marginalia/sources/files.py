"""Files of the taxon catalogue and of references: readers, writers, loaders."""

from __future__ import annotations

import tempfile
import uuid
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    return _OWN[context.applicationId]


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/marginalia/{uuid.uuid4().hex}-{tag}"


def field_map(meta_xml: str) -> list[tuple[int, str]]:
    """(column index, field name) of an archive's meta.xml: the core's fields, each by the last segment of its term."""
    root = ET.fromstring(meta_xml)
    local = lambda e: e.tag.rpartition("}")[2]
    core = next(e for e in root.iter() if local(e) == "core")
    return sorted((int(e.attrib["index"]), e.attrib["term"].rstrip("/").rpartition("/")[2]) for e in core if local(e) in ("field", "id") and "index" in e.attrib and "term" in e.attrib)


def taxon_schema(fields: list[tuple[int, str]]) -> T.StructType:
    """All strings, in the order of columns; columns without a field are named by their index."""
    names = dict(fields)
    return T.StructType([T.StructField(names.get(k, f"_{k}"), T.StringType()) for k in range(max(names) + 1)])


def read_taxa(spark: SparkSession, path: str, fields: list[tuple[int, str]], header: bool = True) -> DataFrame:
    """A tab-separated taxon file, with a header unless it is said to have none; short rows end in nulls, empty values are null."""
    return spark.read.csv(path, sep="\t", header=header, quote="", schema=taxon_schema(fields), nullValue="", enforceSchema=True)


def mappings(lines: DataFrame) -> DataFrame:
    """(key, field, kind, value, replacement) of value mapping lines "key⇥field⇥value⇥replacement": kind remove, pattern (P:), literal, or of a key; // starts a comment."""
    p = lines.filter(~F.col("value").startswith("//")).select(F.split("value", "\t", -1).alias("p"))
    get = lambda k: F.get("p", F.lit(k))
    kind = F.when(get(2) == "REMOVE", "remove").when(get(2).startswith("P:"), "pattern").when(get(0) != "", "key").otherwise("literal")
    return p.filter(F.size("p") >= 3).select(get(0).alias("key"), get(1).alias("field"), kind.alias("kind"), F.regexp_replace(get(2), "^P:", "").alias("value"), get(3).alias("replacement"))


def _hex(c: Column) -> Column:
    return F.when(c != "", F.conv(c, 16, 10).cast("long"))


def _hex_list(c: Column) -> Column:
    return F.when(c != "", F.transform(F.split(c, ";"), lambda x: F.conv(x, 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))


def parse_data_tile(lines: DataFrame) -> DataFrame:
    """Records of data tile lines (value): id in hex, maybe with another id after a slash, rank, X or E, parent, valid, epithet, authority, children, synonyms."""
    p = lines.select(F.split("value", "\t", -1).alias("p"))
    get = lambda k: F.coalesce(F.get("p", F.lit(k)), F.lit(""))
    ids = F.split(get(0), "/")
    return p.select(_hex(ids[0]).alias("id"), F.get(ids, F.lit(1)).alias("col_id"), get(1).alias("rank"), (get(2) == "E").alias("extant"), _hex(get(3)).alias("parent"), _hex(get(4)).alias("valid"), get(5).alias("epithet"), F.nullif(get(6), F.lit("")).alias("authority"), _hex_list(get(7)).alias("children"), _hex_list(get(8)).alias("synonyms"))


def data_tile_lines(records: DataFrame) -> DataFrame:
    """The reverse: (value, id), a line per record."""
    x = lambda c: F.coalesce(F.lower(F.hex(c)), F.lit(""))
    many = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<long>")), lambda v: F.lower(F.hex(v))), ";")
    own = F.concat(x(F.col("id")), F.coalesce(F.concat(F.lit("/"), F.col("col_id")), F.lit("")))
    return records.select(F.concat_ws("\t", own, "rank", F.when(F.col("extant"), "E").otherwise("X"), x(F.col("parent")), x(F.col("valid")), "epithet", F.coalesce("authority", F.lit("")), many(F.col("children")), many(F.col("synonyms"))).alias("value"), "id")


#: An index line's classes of ids: whole epithets and prefixes, lower case and capitalised.
CLASSES = {"EL": ("E", False), "EC": ("E", True), "PL": ("P", False), "PC": ("P", True)}


def parse_index_tile(lines: DataFrame) -> DataFrame:
    """(term, kind, cap, id) of index lines "term⇥EL:1;2 PC:a", ids in hex."""
    p = lines.select(F.split("value", "\t", -1).alias("p")).select(F.col("p")[0].alias("term"), F.explode(F.split(F.col("p")[1], " ")).alias("x"))
    return p.filter("x <> ''").select("term", F.substring("x", 1, 1).alias("kind"), (F.substring("x", 2, 1) == "C").alias("cap"), F.explode(_hex_list(F.substring("x", F.lit(4), F.length("x")))).alias("id"))


def index_lines(postings: DataFrame) -> DataFrame:
    """(value, term): the reverse, a line per term, its classes and ids in order."""
    name = F.concat("kind", F.when(F.col("cap"), "C").otherwise("L"))
    ids = postings.groupBy("term", name.alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda v: F.lower(F.hex(v))), ";").alias("ids"))
    lines = ids.groupBy("term").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "k", "ids"))), " ").alias("x"))
    return lines.select(F.concat_ws("\t", "term", "x").alias("value"), "term")


def write_ranges(lines: DataFrame, by: str, path: str, tiles: int) -> None:
    """Lines as text files, each a range of by and sorted by it."""
    lines.repartitionByRange(tiles, by).sortWithinPartitions(by).select("value").write.text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, md5, bytes) of the files under a path; contents are hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("md5"), F.col("length").alias("bytes"))


def build_catalogue(records: DataFrame, postings: DataFrame, path: str, tiles: int = 8) -> DataFrame:
    """Writes data and index tiles under a path and returns their manifest."""
    write_ranges(data_tile_lines(records), "id", f"{path}/data", tiles)
    write_ranges(index_lines(postings), "term", f"{path}/index", tiles)
    return manifest(records.sparkSession, f"{path}/*/*.txt")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(region, type, name, normalized, languages) of region XML files, a row per name."""
    rows = spark.read.format("xml").option("rowTag", "region").schema("_name string, _type string, name array<struct<_VALUE:string,_normalized:string,_languages:string>>").load(path)
    return rows.select(F.col("_name").alias("region"), F.col("_type").alias("type"), F.explode("name").alias("n")).select("region", "type", F.col("n._VALUE").alias("name"), F.col("n._normalized").alias("normalized"), F.split("n._languages", ";").alias("languages"))


def rank_system(spark: SparkSession, xml: str) -> DataFrame:
    """(system, code, grp, ord, rank, abbreviations, synonyms) of a rank system's XML."""
    root = ET.fromstring(xml)
    several = lambda e, a: [x for x in e.attrib.get(a, "").split(";") if x]
    rows, k = [], 0
    for g in root.iter("rankGroup"):
        for r in g.iter("rank"):
            k += 1
            rows.append((root.attrib["name"], root.attrib.get("code"), g.attrib["name"], k, r.attrib["name"], several(r, "abbreviations"), several(r, "synonyms")))
    return spark.createDataFrame(rows, "system string, code string, grp string, ord int, rank string, abbreviations array<string>, synonyms array<string>")


def resolve_system(asked: Column, systems: dict[str, tuple[str, ...]], default: str = "generic") -> Column:
    """The system whose name or other name is asked for, in any case; else the default."""
    out = F.lit(default)
    for name, others in systems.items():
        out = F.when(F.lower(asked).isin(name.lower(), *(o.lower() for o in others)), name).otherwise(out)
    return out


def serialise(*fields: Column) -> Column:
    """Fields as one line, each URL-encoded."""
    return F.concat_ws(" ", *(F.url_encode(F.coalesce(f, F.lit(""))) for f in fields))


def deserialise(line: Column) -> Column:
    return F.transform(F.split(line, " ", -1), lambda x: F.url_decode(x))


def archive_metadata(xml: Column) -> Column:
    """struct(title, author, year) of an archive item's metadata XML; years and roles in the author are removed."""
    author = F.regexp_replace(F.xpath_string(xml, F.lit("metadata/creator")), r",?\s*([0-9]{4}-([0-9]{4})?|\[.*\])\.?", "")
    return F.struct(F.xpath_string(xml, F.lit("metadata/title")).alias("title"), author.alias("author"), F.regexp_extract(F.xpath_string(xml, F.lit("metadata/date")), "[12][0-9]{3}", 0).alias("year"))
