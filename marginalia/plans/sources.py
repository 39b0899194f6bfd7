"""Queries on files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees as tr
from ..session import table
from ..sources import files as fl
from ..sources import records as rs
from ..streaming import requests as rq

C = F.col
META = """<archive xmlns="http://rs.tdwg.org/dwc/text/"><core><id index="0"/><field index="0" term="http://rs.tdwg.org/dwc/terms/taxonID"/><field index="1" term="http://rs.tdwg.org/dwc/terms/scientificName"/><field index="3" term="http://purl.org/dc/terms/references"/></core></archive>"""
RANKS = """<rankSystem name="animals" code="ICZN"><rankGroup name="genus"><rank name="genus" abbreviations="gen."/><rank name="subGenus" abbreviations="subgen.;subg."/></rankGroup><rankGroup name="species"><rank name="species" abbreviations="sp." synonyms="spec"/></rankGroup></rankSystem>"""


def taxa_file(s, d):
    """Parts written as a tab-separated file with ragged rows and read back by its field map."""
    path = fl.shared_path(s, "taxa")
    line = F.concat_ws("\t", C("p_partkey").cast("string"), "p_name", F.when(C("p_size") % 2 == 0, F.lit("")), F.when(C("p_size") % 2 == 0, "http://x"))
    table(s, d, "part").select(line.alias("value")).write.option("header", "false").text(path)
    return fl.read_taxa(s, path, fl.field_map(META), header=False).select("taxonID", "scientificName", "references")


def tile_records(s, d):
    c = table(s, d, "customer")
    o = table(s, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("children"))
    return c.join(o, "c_custkey", "left").select(C("c_custkey").alias("id"), F.when(C("c_custkey") % 2 == 0, F.lit("X2")).alias("col_id"), F.lit("genus").alias("rank"), (C("c_custkey") % 3 > 0).alias("extant"), (C("c_nationkey").cast("long") + 1).alias("parent"), F.lit(None).cast("long").alias("valid"), F.lower("c_mktsegment").alias("epithet"), F.lit(None).cast("string").alias("authority"), "children", F.array().cast("array<long>").alias("synonyms"))


def tiles_back(s, d):
    path = fl.shared_path(s, "tiles")
    fl.write_ranges(fl.data_tile_lines(tile_records(s, d)), "id", path, 4)
    return fl.parse_data_tile(s.read.text(path))


def postings(s, d):
    return tr.postings(table(s, d, "part").select(C("p_partkey").alias("id"), "p_name"), "p_name")


def index_back(s, d):
    path = fl.shared_path(s, "index")
    fl.write_ranges(fl.index_lines(postings(s, d)), "term", path, 4)
    return fl.parse_index_tile(s.read.text(path))


def catalogue(s, d):
    return fl.build_catalogue(tile_records(s, d), postings(s, d), fl.shared_path(s, "catalogue"), 4).select("md5", "bytes")


def tagged(s, d):
    """References of a tagged file, through the Python data source."""
    rs.register(s)
    path = fl.shared_path(s, "tagged")
    line = F.concat(F.lit("TI  - "), "p_name", F.lit("\nAU  - A, B\nAU  - C, D\nPY  - 19"), F.lpad((C("p_size") % 100).cast("string"), 2, "0"), F.lit("\nER  - "))
    table(s, d, "part").select(line.alias("value")).coalesce(1).write.text(path)
    return s.read.format("tagged_references").option("path", f"{path}/*.txt").load().select("title", "author", "year", "error")


def stream(s, d):
    e = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    return e.select("user_id", "event_id", "event_type", (F.unix_micros(C("ts").cast("timestamp")) / 1e6).alias("seconds"))


def checkouts(s, d):
    kind = F.when(C("event_type") == "view", "checkout").when(C("event_type") == "click", "answer").when(C("event_type") == "error", "cancel")
    e = stream(s, d).withColumn("kind", kind).filter("kind IS NOT NULL")
    return rq.run_available(rq.stateful(e, "user_id", "event_id", ["user_id", "event_id", "kind", "seconds"], rq.checkout_fold(43200.0), "user_id long, event_id long, outcome string"), "checkouts")


def queue(s, d):
    kind = F.when(C("event_type") == "view", "add").when(C("event_type") == "click", "take").when(C("event_type") == "error", "cancel").when(C("event_id") % 50 == 0, "flush").otherwise("add")
    e = stream(s, d).withColumn("kind", kind).withColumn("queue", C("user_id") % 20)
    return rq.run_available(rq.stateful(e, "queue", "event_id", ["queue", "event_id", "kind"], rq.queue_fold, "queue long, event_id long, request long, outcome string"), "queue")


def counts(s, d):
    e = stream(s, d).withColumn("change", F.when(C("event_id") % 3 == 0, -1).otherwise(1).cast("long"))
    return rq.run_available(rq.stateful(e, "user_id", "event_id", ["user_id", "event_id", "event_type", "change"], rq.count_fold, "user_id long, event_id long, term string, outcome string"), "counts")


def metadata(s, d):
    x = F.concat(F.lit("<metadata><title>"), "p_name", F.lit("</title><creator>Doe, J, 1850-1910.</creator><date>c19"), F.lpad((C("p_size") % 100).cast("string"), 2, "0"), F.lit("</date></metadata>"))
    return table(s, d, "part").select("p_partkey", fl.archive_metadata(x).alias("m")).select("p_partkey", "m.*")


def regions(s, d):
    """Regions written as XML and loaded by name."""
    path = fl.shared_path(s, "regions")
    x = F.concat(F.lit("<region name=\""), "r_name", F.lit("\" type=\"part\"><name normalized=\""), F.lower("r_name"), F.lit("\" languages=\"English;official\">"), "r_name", F.lit("</name></region>"))
    table(s, d, "region").agg(F.concat(F.lit("<regions>"), F.array_join(F.collect_list(x), ""), F.lit("</regions>")).alias("value")).write.text(path)
    return fl.read_regions(s, path).select("region", "type", "name", "normalized", F.array_join("languages", ",").alias("languages"))


MAPS = "concat_ws('\t', CASE WHEN p_size % 4 = 0 THEN '//' ELSE '' END || CASE WHEN p_size % 4 = 1 THEN CAST(p_partkey AS VARCHAR(20)) ELSE '' END, 'name', CASE p_size % 4 WHEN 2 THEN 'P:a+' WHEN 3 THEN 'REMOVE' ELSE p_name END, 'x')"

QUERIES = {
    "s2_s3_taxon_file": (taxa_file, "SELECT p_partkey::VARCHAR AS taxonID, p_name AS scientificName, CASE WHEN p_size % 2 = 0 THEN 'http://x' END AS \"references\" FROM part"),
    "s4_mappings": (lambda s, d: fl.mappings(table(s, d, "part").select(F.expr(MAPS).alias("value"))), "SELECT CASE WHEN p_size % 4 = 1 THEN p_partkey::VARCHAR ELSE '' END AS key, 'name' AS field, (['', 'key', 'pattern', 'remove'])[p_size % 4 + 1] AS kind, CASE p_size % 4 WHEN 2 THEN 'a+' WHEN 3 THEN 'REMOVE' ELSE p_name END AS value, 'x' AS replacement FROM part WHERE p_size % 4 > 0"),
    "s5_s8_data_tiles": (lambda s, d: tiles_back(s, d).select("id", "col_id", "extant", "parent", "epithet", "authority", F.size("children").alias("n"), F.aggregate("children", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")), "WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS t FROM orders GROUP BY 1) SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'X2' END AS col_id, c_custkey % 3 > 0 AS extant, c_nationkey::BIGINT + 1 AS parent, lower(c_mktsegment) AS epithet, NULL::VARCHAR AS authority, coalesce(n, 0)::INT AS n, coalesce(t, 0) AS total FROM customer LEFT JOIN o ON o_custkey = c_custkey"),
    "s6_s9_index_tiles": (index_back, "SELECT DISTINCT term, kind, cap, id FROM (SELECT regexp_replace(lower(p_name), '[^a-z0-9-]', '', 'g') AS term, 'E' AS kind, false AS cap, p_partkey AS id FROM part UNION ALL SELECT term, 'P', false, id FROM (SELECT unnest(str_split(p_name, ' ')) AS term, p_partkey AS id FROM part) WHERE length(term) >= 3)"),
    "s10_s11_catalogue": (catalogue, None),
    "s14_s15_tagged_references": (tagged, "SELECT p_name AS title, 'A, B & C, D' AS author, '19' || lpad((p_size % 100)::VARCHAR, 2, '0') AS year, NULL::VARCHAR AS error FROM part"),
    "s18_archive_metadata": (metadata, "SELECT p_partkey, p_name AS title, 'Doe, J' AS author, '19' || lpad((p_size % 100)::VARCHAR, 2, '0') AS year FROM part"),
    "s19_regions": (regions, "SELECT r_name AS region, 'part' AS type, r_name AS name, lower(r_name) AS normalized, 'English,official' AS languages FROM region"),
    "s20_rank_systems": (lambda s, d: fl.rank_system(s, RANKS).join(table(s, d, "nation").select("n_nationkey", fl.resolve_system(F.when(C("n_nationkey") % 2 == 0, "iczn").otherwise("what"), {"animals": ("ICZN", "zoology")}).alias("system")), "system").select("n_nationkey", "ord", "rank", F.array_join("abbreviations", ",").alias("abbr")), "SELECT n_nationkey, ord::INT AS ord, rank, abbr FROM nation, (VALUES (1, 'genus', 'gen.'), (2, 'subGenus', 'subgen.,subg.'), (3, 'species', 'sp.')) AS v(ord, rank, abbr) WHERE n_nationkey % 2 = 0"),
    "s21_serialise": (lambda s, d: table(s, d, "events").select("event_id", fl.serialise(C("event_type"), C("props"), F.lit("a b")).alias("line")).select("event_id", fl.deserialise(C("line"))[1].alias("props"), F.size(fl.deserialise(C("line"))).alias("n")), "SELECT event_id, props, 3 AS n FROM events"),
    "v9_queue": (queue, None),
    "v10_checkouts": (checkouts, "WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'checkout' WHEN 'click' THEN 'answer' WHEN 'error' THEN 'cancel' END AS kind, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type IN ('view', 'click', 'error')), w AS (SELECT *, lag(kind) OVER o = 'checkout' AS opened, t - lag(t) OVER o > 43200 AS old FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, 'timeout' AS outcome FROM w WHERE opened AND old UNION ALL SELECT user_id, event_id, CASE WHEN opened AND NOT old THEN 'answered' ELSE 'late' END FROM w WHERE kind = 'answer' UNION ALL SELECT user_id, event_id, 'cancelled' FROM w WHERE kind = 'cancel' AND opened AND NOT old"),
    "a12_incremental": (counts, None),
    "v21_life_cycle": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.count("*").alias("n")).select("user_id", F.when(C("last") == "purchase", 100).otherwise(F.least(F.lit(95), 5 + C("n"))).cast("long").alias("percent")), "SELECT user_id, CASE WHEN max_by(event_type, event_id) = 'purchase' THEN 100 ELSE least(95, 5 + count(*)) END::BIGINT AS percent FROM events GROUP BY 1"),
}
