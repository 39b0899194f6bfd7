"""Term statistics: frequencies, positions, successors, stop words, abbreviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .trees import paths


def _share(df: DataFrame, count: str, total: str, name: str) -> DataFrame:
    """Adds name_norm = count / total and name_smooth, in which 0 counts as a half; total 0 gives 0."""
    norm = F.when(F.col(total) > 0, F.col(count) / F.col(total)).otherwise(0.0)
    return df.withColumn(f"{name}_norm", norm).withColumn(f"{name}_smooth", F.when(F.col(count) > 0, norm).when(F.col(total) > 0, 0.5 / F.col(total)).otherwise(0.0))


def with_positions(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens with term (lower case), size of the sequence, following term, depth of brackets and whether a comma precedes; one window a sequence."""
    w = Window.partitionBy(key).orderBy("pos")
    depth = F.sum(F.when(F.col("tok").isin("(", "["), 1).when(F.col("tok").isin(")", "]"), -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tokens.select("*", F.lower("tok").alias("term"), F.lead(F.lower("tok")).over(w).alias("next"), depth.alias("depth"), (F.lag("tok").over(w) == ",").alias("after_comma"))


def successions(sequences: DataFrame, terms: str) -> DataFrame:
    """sequences with a row for each of their terms, an array in one column: pos, term and next, the following one. Nothing is shuffled."""
    each = F.transform(terms, lambda x, i: F.struct(i.alias("pos"), x.alias("term"), F.get(F.col(terms), i + 1).alias("next")))
    return sequences.select("*", F.inline(each)).drop(terms)


def frequencies(tokens: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """(term, n, total, freq_norm, freq_smooth); the total is a window over the grouped terms' sum, one row."""
    counts = tokens.groupBy(F.lower("tok").alias("term")).agg(F.count("*").alias("n"))
    whole = tokens.agg(F.count("*").alias("total")).first()["total"]
    return _share(counts.withColumn("total", F.lit(whole).cast("long")), "n", "total", "freq")


def position_family(positions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, n, n_start, n_end, n_bracket, n_comma) and each family's norm, its share of the term's own count, and smooth."""
    counts = positions.groupBy("term").agg(
        F.count("*").alias("n"),
        F.sum((F.col("pos") == 0).cast("long")).alias("n_start"),
        F.sum(F.col("next").isNull().cast("long")).alias("n_end"),
        F.sum((F.col("depth") > 0).cast("long")).alias("n_bracket"),
        F.sum(F.coalesce(F.col("after_comma"), F.lit(False)).cast("long")).alias("n_comma"),
    )
    for name in ("start", "end", "bracket", "comma"):
        counts = _share(counts, f"n_{name}", "n", name)
    return counts


def successors(positions: DataFrame) -> DataFrame:
    """(term, next, n, distinct_next, succ_norm): norm is by the number of different successors, so it can exceed 1."""
    pairs = positions.filter("next IS NOT NULL").groupBy("term", "next").agg(F.count("*").alias("n"))
    return pairs.withColumn("distinct_next", F.count("*").over(Window.partitionBy("term"))).withColumn("succ_norm", F.col("n") / F.col("distinct_next"))


def stop_words(counts: DataFrame) -> DataFrame:
    """counts (term, n, stop) with is_stop (stop is over half of n), only_stop and stop_norm over all stop counts."""
    whole = counts.agg(F.sum("stop").alias("s")).first()["s"] or 0
    return counts.withColumn("is_stop", F.col("n") < 2 * F.col("stop")).withColumn("only_stop", F.col("n") == F.col("stop")).withColumn("stop_norm", F.col("stop") / F.lit(max(1, whole)))


def merge_counts(*frames: DataFrame) -> DataFrame:
    """(term, n): counts of several loads, added."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("term").agg(F.sum("n").alias("n"))


def to_lines(counts: DataFrame, successors_: DataFrame) -> DataFrame:
    """A line per term: term, n, successors as "next:count" by falling count, then name; tab separated."""
    lists = successors_.groupBy("term").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "next", "n"))).alias("s"))
    told = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["next"], x["n"].cast("string"))), " ")
    return counts.join(lists, "term", "left").select("term", F.concat_ws("\t", "term", F.col("n").cast("string"), F.coalesce(told, F.lit(""))).alias("line"))


def from_lines(lines: DataFrame) -> DataFrame:
    """(term, n, successors map) of to_lines()."""
    parts = lines.select(F.split("line", "\t", -1).alias("p"))
    return parts.select(F.col("p")[0].alias("term"), F.col("p")[1].cast("long").alias("n"), F.when(F.col("p")[2] != "", F.str_to_map(F.col("p")[2], F.lit(" "), F.lit(":"))).alias("successors"))


def closure(edges: DataFrame) -> DataFrame:
    """(short, form, dist): what each term abbreviates directly or over others, however many, by edges (short, form)."""
    found = paths(edges.select(F.col("short").alias("desc"), F.col("form").alias("anc")))
    return found.select(F.col("desc").alias("short"), F.col("anc").alias("form"), "dist")


def best_full_form(edges: DataFrame) -> DataFrame:
    """(short, form): the most frequent edge of each term (short, form, n); ties by name."""
    return edges.groupBy("short").agg(F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("form"))
