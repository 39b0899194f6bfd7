"""Cleaning of taxon rows: replacement rules as tables, and a cascade of rules by rank.

Replacement rules of a key or a value are joined, so there may be any number of them; those by
pattern are an array for each field, folded over the value. Rows that rules change without
end are told by a value that comes back, whatever the number of steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxa as tx
from ..functions import values as vl
from ..sources.files import shared_path

#: Steps of the patterns that are folded in one expression; values that still change go on in a further round.
STEPS = 8
RULES = "ord long, key string, field string, kind string, value string, replacement string"


def read_rules(spark: SparkSession, values: str | None = None, characters: str | None = None) -> DataFrame:
    """RULES of files of value mappings (key, field, value, replacement) and of character mappings (pattern, replacement), tab-separated, // beginning a comment.

    kind: pattern (value begins with P:), literal (no key), remove (REMOVE), key, or character, which holds for all fields. ord is the order in the files.
    """
    parts = []
    at = lambda k: F.get("p", F.lit(k))
    for path, least in ((values, 3), (characters, 2)):
        if path is None:
            continue
        lines = spark.read.text(path).filter(~F.col("value").startswith("//")).select(F.monotonically_increasing_id().alias("ord"), F.split("value", "\t", -1).alias("p")).filter(F.size("p") >= least)
        if least == 3:
            kind = F.when(at(2).startswith("P:"), "pattern").when(at(0) == "", "literal").when(at(2) == "REMOVE", "remove").otherwise("key")
            parts.append(lines.select("ord", at(0).alias("key"), at(1).alias("field"), kind.alias("kind"), F.regexp_replace(at(2), "^P:", "").alias("value"), F.coalesce(at(3), F.lit("")).alias("replacement")))
        else:
            parts.append(lines.select("ord", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("field"), F.lit("character").alias("kind"), at(0).alias("value"), at(1).alias("replacement")))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], RULES)


def _folded(rules: DataFrame, fields: list[str]) -> DataFrame:
    """(field, characters, patterns): the rules of each field that are folded over values, in order."""
    r = F.col("replacement")
    both = r == "$_$"
    head = F.when(both | r.startswith("$_"), "").otherwise("^")
    tail = F.when(both | r.endswith("_$"), "").otherwise("$")
    plain = F.when(both, "").otherwise(F.regexp_replace(F.regexp_replace(r, r"^\$_", ""), r"_\$$", ""))
    patterns = rules.filter("kind = 'pattern'").select("field", "ord", F.concat(head, F.lit("(?:"), "value", F.lit(")"), tail).alias("value"), plain.alias("replacement"), F.lit(True).alias("p"))
    characters = rules.filter("kind = 'character'").select(F.explode(F.array(*map(F.lit, fields))).alias("field"), "ord", "value", "replacement", F.lit(False).alias("p"))
    every = patterns.unionByName(characters).groupBy("field").agg(F.array_sort(F.collect_list(F.struct("ord", "value", "replacement", "p"))).alias("all"))
    return every.select("field", F.filter("all", lambda x: ~x["p"]).alias("characters"), F.filter("all", lambda x: x["p"]).alias("patterns"))


def _step(value: Column, patterns: Column) -> Column:
    """The value after the first pattern that changes it."""

    def apply(a: Column, p: Column) -> Column:
        parts = F.split(value, p["value"], 2)
        new = F.trim(F.concat(F.get(parts, F.lit(0)), p["replacement"], F.get(parts, F.lit(1))))
        return F.when((a == value) & F.regexp_like(value, p["value"]), new).otherwise(a)

    return F.aggregate(patterns, value, apply)


def normalised(rows: DataFrame, fields: list[str], rules: DataFrame, key: str = "id") -> DataFrame:
    """rows with each of the fields, strings, normalised: by the rule of its key, else by that of its value, else by characters, blanks, and patterns, of which the first that changes it counts, until none does or a value comes back.

    Of several rules of a key and field, or of a field and value, the last counts. Null stays null, and an empty replacement is an empty value. Repeated rows stay.
    """
    spark = rows.sparkSession
    folder = shared_path(spark, "rows")
    rows.withColumn("__row", F.monotonically_increasing_id()).write.parquet(folder)
    base = spark.read.parquet(folder)
    each = base.select("__row", F.col(key).cast("string").alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("__row", "key", "x.field", "x.value").filter("value IS NOT NULL")
    last = F.max_by("replacement", "ord")
    by_key = rules.filter("kind = 'key'").groupBy("key", "field").agg(last.alias("of_key"))
    by_value = rules.filter("kind = 'literal'").groupBy("field", "value").agg(last.alias("of_value"))
    told = each.join(by_key, ["key", "field"], "left").join(by_value, ["field", "value"], "left").withColumn("known", F.coalesce("of_key", "of_value"))
    none = F.array().cast("array<struct<ord:bigint,value:string,replacement:string,p:boolean>>")
    folded = told.join(_folded(rules, fields), "field", "left").select("__row", "field", "known", "value", F.coalesce("characters", none).alias("characters"), F.coalesce("patterns", none).alias("patterns"))
    start = vl.normal_spaces(F.aggregate("characters", F.col("value"), lambda v, c: F.regexp_replace(v, c["value"], c["replacement"])))
    todo = folded.select("__row", "field", "known", "patterns", F.array(F.when(F.col("known").isNull(), start)).alias("seen"))
    over = lambda s: (F.element_at(s, -1).isNull()) | ((F.size(s) > 1) & (F.array_position(s, F.element_at(s, -1)) < F.size(s)))
    done = None
    while True:
        on = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("seen"), lambda s, _: F.when(over(s), s).otherwise(F.concat(s, F.array(_step(F.element_at(s, -1), F.col("patterns"))))))
        folder = shared_path(spark, "values")
        todo.withColumn("seen", on).withColumn("__over", over(F.col("seen"))).write.parquet(folder)
        at = spark.read.parquet(folder)
        ended = at.filter("__over").select("__row", "field", F.coalesce("known", vl.normal_spaces(F.element_at("seen", -1))).alias("value"))
        done = ended if done is None else done.unionByName(ended)
        todo = at.filter("NOT __over").drop("__over")
        if not todo.limit(1).count():
            break
    wide = done.groupBy("__row").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"__n_{f}") for f in fields))
    return base.join(wide, "__row", "left").select(*((F.col(f"__n_{c}").alias(c) if c in fields else F.col(c)) for c in rows.columns))


#: What epithets look like, by the ranks they are checked from and to (the last one's included), and the column they are in; the first that fails is the problem.
EPITHETS = (
    ("epithet", "kingdom", "tribe", r"^[A-Z][a-z]{2,}(-[A-Z][a-z]{2,})?$"),
    ("genus", "genus", "form", r"^[A-Z][a-z]{2,}(-[A-Za-z][a-z]{2,})?$"),
    ("species", "species", "form", r"^(([a-z]+')?[a-z]{3,}(-[a-z]{3,})?|[a-z]+-[a-z]+(-[a-z]{3,}){0,2}|[1-9][0-9]?-[a-z]{3,}(-[a-z]{3,})?)$"),
    ("below", "subSpecies", "form", r"^([a-z]{3,}(-[a-z]{3,})?|[a-z]+-[a-z]{3,}(-[a-z]{3,})?|[1-9][0-9]?-[a-z]{3,}(-[a-z]{3,})?)$"),
)
#: Forms of ranks that aren't the rank's own name, in lower case without blanks and signs.
RANK_FORMS = {"subsp": "subSpecies", "ssp": "subSpecies", "var": "variety", "f": "form", "forma": "form", "sect": "section", "ser": "series", "infraspecificname": "subSpecies", "regnum": "kingdom", "genushybrid": "genus"}
#: Names of ranks from genus to species in brackets: the mark before the epithet.
BRACKETED = {"subGenus": "", "section": "sect. ", "series": "ser. "}
#: An authority begins with a capital, maybe after a bracket and small words such as de, van der, d', ex or hort. ex.
AUTHORITY = r"^\(?((ex|hort\.|[a-z]{1,7}|'[a-z]|[a-z]{1,2}'|v\.)\s*)*[A-Z]"
FIELDS = ["name", "rank", "genus", "species", "below"]


def _level(name: str) -> int:
    return tx.NAMES.index(name) + 1


def clean(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Taxon rows (id, parent, valid, status, code, rank, name, genus, species, below, published, remarks, references; all strings) cleaned, with authority and problems.

    Removed are rows of the virus code, misapplied names, rows that a rule removes, those without a
    name or a known rank, those that hold other than ASCII characters when rules have been
    applied, and those below species without an epithet, or from species on without one that the name
    shows. A removed row keeps id, parent and valid; its status is REMOVED TAXON, all else is null.

    Of the others, published, remarks and references are emptied; texts read in the wrong
    encoding are repaired; rank is in its normal form; a missing genus is taken from the name, as is a
    missing species; epithets that don't look as EPITHETS say are told as problems and stripped of
    foreign characters; a lower-case name with a year as authority is capitalised; and the name is
    built from its parts again.
    """
    text = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    start = rows.withColumns({c: text(c) for c in rows.columns if c not in ("id", "parent", "valid")})
    misread = lambda c: F.when(F.col(c).rlike("[Â-ô][\u0080-¿]"), vl.repair_mojibake(F.col(c))).otherwise(F.col(c))
    start = start.withColumns({c: misread(c) for c in FIELDS}).withColumns({c: F.lit(None).cast("string") for c in ("published", "remarks", "references")})
    told = normalised(start, FIELDS, rules)
    told = told.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in FIELDS})
    removed = rules.filter("kind = 'remove'").select(F.col("key").alias("__gone")).distinct()
    told = told.join(removed, F.col("id").cast("string") == F.col("__gone"), "left")
    form = F.lower(F.regexp_replace("rank", r"[\s.\-]", ""))
    known = F.create_map(*(F.lit(x) for k, v in ({n.lower(): n for n in tx.NAMES} | RANK_FORMS).items() for x in (k, v)))
    told = told.withColumn("rank", F.try_element_at(known, form)).withColumn("__level", tx.level(F.col("rank")))
    level = F.col("__level")
    segmented = _segments(told)
    told = told.withColumns(segmented).withColumn("genus", F.coalesce("genus", F.when(level == _level("genus"), F.col("__epithet")).when(level > _level("genus"), F.nullif(F.substring_index("__prefix", " ", 1), F.lit("")))))
    in_name = F.nullif(F.trim(F.regexp_extract("name", r"\s([a-z0-9][a-z'-]{2,})(\s|$)", 1)), F.lit(""))
    told = told.withColumn("species", F.when(level >= _level("species"), F.coalesce("species", in_name)).otherwise(F.col("species")))
    foreign = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).rlike("[^\\x00-\\x7e]"), F.lit(False)) for c in FIELDS if c != "rank"))
    gone = (
        F.coalesce((F.col("code") == "ICVCN") | (F.lower("status") == "misapplied"), F.lit(False)) | F.col("__gone").isNotNull() | F.col("name").isNull() | F.col("rank").isNull() | foreign
        | ((level >= _level("species")) & F.col("species").isNull()) | ((level > _level("species")) & F.col("below").isNull())
    )
    told = normalised(told.withColumn("__removed", gone).withColumn("authority", F.nullif(F.trim("__authority"), F.lit(""))).drop("__gone"), ["authority"], rules)
    told = told.withColumn("authority", F.nullif(F.trim("authority"), F.lit("")))
    told = told.withColumn("authority", F.when(F.col("authority").rlike(r"^[a-z]{2,},\s*[12][0-9]{3}$"), F.concat(F.upper(F.substring("authority", 1, 1)), F.substring("authority", 2, 1 << 30))).otherwise(F.col("authority")))
    problems, bad = [], {}
    for column, least, most, pattern in EPITHETS:
        source = "__epithet" if column == "epithet" else column
        wrong = level.between(_level(least), _level(most)) & F.col(source).isNotNull() & ~F.col(source).rlike(pattern)
        bad[column] = F.coalesce(wrong, F.lit(False))
        problems.append(F.when(bad[column], F.concat(F.lit("invalid "), F.col("rank") if column in ("epithet", "below") else F.lit(column), F.lit(" '"), source, F.lit("'"))))
        if column != "epithet":
            problems.append(F.when(level.between(_level(least), _level(most)) & ~F.contains("name", source), F.concat(F.lit(f"unmatched {column} '"), source, F.lit("'"))))
    years = F.exists(F.regexp_extract_all("authority", F.lit("[0-9]+"), F.lit(0)), lambda y: F.length(y) != 4)
    problems += [F.when(years, F.concat(F.lit("broken year '"), "authority", F.lit("'"))), F.when(~F.col("authority").rlike(AUTHORITY), F.concat(F.lit("strange start '"), "authority", F.lit("'")))]
    told = told.withColumn("problems", F.filter(F.array(*problems), lambda x: x.isNotNull())).withColumns({f"__bad_{c}": x for c, x in bad.items() if c != "epithet"})
    told = told.withColumn("name", _rebuilt())
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[^A-Za-z0-9\-\s]", ""))), r"\s+", "-"), "-{2,}", "-"), r"^([1-9][0-9]?)(?=[a-z])", "$1-")
    marked = F.regexp_extract("below", r"^(?:.*\s)?(var|f)\.\s*(.+)$", 1)
    told = told.withColumn("__mark", F.when(F.col("__bad_below"), marked).otherwise("")).withColumn("rank", F.when(F.col("__mark") == "var", "variety").when(F.col("__mark") == "f", "form").otherwise(F.col("rank")))
    inner = F.when(F.col("__mark") != "", F.regexp_extract("below", r"^(?:.*\s)?(?:var|f)\.\s*(.+)$", 1)).otherwise(F.col("below"))
    better = {"genus": capital(F.regexp_replace("genus", r"[^A-Za-z\-\s]", "")), "species": plain(F.col("species")), "below": plain(inner)}
    for c, new in better.items():
        told = told.withColumn("__new", F.when(F.col(f"__bad_{c}"), new).otherwise(F.col(c))).withColumn("name", F.when(F.col(f"__bad_{c}") & F.contains("name", c), F.replace(F.col("name"), F.col(c), F.col("__new"))).otherwise(F.col("name"))).withColumn(c, F.col("__new"))
    kept = [c for c in rows.columns if c not in ("id", "parent", "valid", "status")]
    out = {c: F.when(~F.col("__removed"), F.col(c)) for c in [*kept, "authority", "problems"]}
    return told.select("id", "parent", "valid", F.when(F.col("__removed"), "REMOVED TAXON").otherwise(F.col("status")).alias("status"), *(x.alias(c) for c, x in out.items()))


def _segments(told: DataFrame) -> dict[str, Column]:
    """__prefix, __epithet and __authority of the names: what stands before the row's own epithet, the epithet, and what is behind it."""
    name, level = F.col("name"), F.col("__level")
    own = F.when(level > _level("species"), F.col("below")).when(level == _level("species"), F.col("species"))
    found = F.position(F.reverse(F.concat(F.lit(" "), own)), F.reverse(name))  # of the last one, from the end
    at = F.when(found > 0, F.length(name) - found - F.length(own) + 1)
    bracket = r"^(\S+)\s+\((?:sect\. |ser\. )?([^() ]+)\)\s*(.*)$"
    one = level <= _level("genus")
    inside = (level > _level("genus")) & (level < _level("species")) & name.rlike(bracket)
    word = r"^(\S+)\s*(.*)$"
    several = r"^(.*?)\s*\b([a-z0-9][a-z0-9'-]+)(?:\s+((?:\(|[A-Z]|ex ).*))?$"
    pick = lambda k, known, w, s: F.when(inside, F.regexp_extract(name, bracket, k)).when(one, w).when(at.isNotNull(), known).when(name.rlike(several), s).otherwise(w)
    return {
        "__prefix": pick(1, F.trim(F.substring(name, F.lit(1), at - 1)), F.lit(""), F.regexp_extract(name, several, 1)),
        "__epithet": pick(2, own, F.regexp_extract(name, word, 1), F.regexp_extract(name, several, 2)),
        "__authority": pick(3, F.trim(F.substring(name, at + F.length(own) + 1, F.length(name))), F.regexp_extract(name, word, 2), F.coalesce(F.regexp_extract(name, several, 3), F.lit(""))),
    }


def _rebuilt() -> Column:
    """The name of its parts, if it has an authority."""
    shown = F.col("__epithet")
    for rank, mark in BRACKETED.items():
        shown = F.when((F.col("rank") == rank) & (F.col("__prefix") != ""), F.concat(F.lit(f"({mark}"), F.col("__epithet"), F.lit(")"))).otherwise(shown)
    whole = F.trim(F.concat_ws(" ", F.nullif("__prefix", F.lit("")), shown, "authority"))
    return F.when(F.col("authority").isNotNull(), whole).otherwise(F.col("name"))
