"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation finds how far to trust them.

A rule is a ratio of what is measured on a text, with a range in which it votes for the
text, ranges in which it votes against it, and abstains between. Which texts are good
isn't known; it is a hidden class. Given the class, votes count as independent, and each rule
has two accuracies: how often its vote is right on good texts, and how often on bad ones.
They differ much, as a rule that finds one kind of junk rightly votes for most texts. EM
finds accuracies and the share of good texts from how often each pattern of votes occurs.
There are at most 3^rules patterns, whatever the corpus is.

The main path is DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLANKS = " \t\n\x0b\x0c\r"
#: Fewer words fail, as does a text of which more than so many hundredths of the words are in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rounds of EM.
ROUNDS = 30
#: What EM starts from and is drawn to: the share of good texts, and how often votes are right on good and on bad ones.
SHARE, ON_GOOD, ON_BAD = 0.85, 0.999, 0.3
#: Weights of these priors, in numbers of all texts, so that a corpus of any size is treated alike. That a vote against a good text
#: is rare is what tells the classes apart, so its weight is large; or kinds of junk that only one rule finds would count as good.
PRIOR, PRIOR_ON_GOOD = 0.05, 5


@dataclass(frozen=True)
class Rule:
    """value: SQL over the measured columns, null abstains. Outside [least, most] the vote is bad, within [good_from, good_to] good; None is no bound."""

    name: str
    value: str
    good_to: float | None = None
    most: float | None = None
    good_from: float | None = None
    least: float | None = None

    def sql(self) -> str:
        """The vote: -1, 0 or 1."""
        bad = " OR ".join(f"{self.value} {op} {x}" for op, x in (("<", self.least), (">", self.most)) if x is not None)
        good = " AND ".join(f"{self.value} {op} {x}" for op, x in ((">=", self.good_from), ("<=", self.good_to)) if x is not None)
        return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


RULES = (
    Rule("no_letter", "(n_words - n_letter_words) / nullif(n_words, 0)", 0.2, 0.5),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", 0.02, 0.1),
    Rule("word_length", "word_chars / nullif(n_words, 0)", 12, 20, 3, 2),
    Rule("repeated_lines", "CASE WHEN n_lines >= 10 THEN n_dup_lines / n_lines END", 0.1, 0.3),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", 0.2, 0.4),
    Rule("shouting", "greatest(n_upper / nullif(n_upper + n_lower, 0), 5 * n_exclaimed / nullif(n_words, 0))", 0.25, 0.5),
)


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are compared by 64-bit hashes, sorted within the text."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        found = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return _let(F.sort_array(windows), twice)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and what rules are made of, of its whole text; each in one pass over the text.

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines (those equal to an
    earlier one), n_repeat_words, n_letter_words (words with a letter), n_upper, n_lower
    (letters by case), n_exclaimed (runs of two or more of ! and ?). A null text has none of all.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), t.alias("__t"))
    of = F.col("__t")
    body = F.btrim(of, F.lit(BLANKS))
    split = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"))
    words = _let(split, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("repeated")))
    lines = _let(F.filter(F.split(of, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))

    def count(pattern: str) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("long")

    return rows.select("doc_id", words.alias("__w"), lines.alias("__l"), F.length(F.regexp_replace(of, "[ \\t\\n\\x0B\\f\\r]", "")).cast("long").alias("word_chars"), count("[#*$%&|<>]").alias("n_symbols"), count("\\p{L}[^ \\t\\n\\x0B\\f\\r]*").alias("n_letter_words"), count("\\p{Lu}").alias("n_upper"), count("\\p{Ll}").alias("n_lower"), count("[!?]{2,}").alias("n_exclaimed")).select(
        "doc_id", F.col("__w.n").alias("n_words"), "word_chars", "n_symbols", F.col("__l.n").alias("n_lines"), F.col("__l.again").alias("n_dup_lines"), F.col("__w.repeated").alias("n_repeat_words"), "n_letter_words", "n_upper", "n_lower", "n_exclaimed"
    )


def _quality(votes: Column, model: Column) -> Column:
    """The probability that a text with this array of votes is good; model: share, on_good, on_bad."""

    def likelihood(start: Column, if_good: Column, if_bad: Column) -> Column:
        factors = F.zip_with(votes, F.arrays_zip(if_good.alias("g"), if_bad.alias("b")), lambda v, x: F.when(v == 1, x["g"]).when(v == -1, x["b"]).otherwise(1.0))
        return F.aggregate(factors, start, lambda product, x: product * x)

    def rest(rates: Column) -> Column:
        return F.transform(rates, lambda x: 1 - x)

    good = likelihood(model["share"], model["on_good"], rest(model["on_good"]))
    return _let(F.struct(good.alias("g"), likelihood(1 - model["share"], rest(model["on_bad"]), model["on_bad"]).alias("b")), lambda x: x["g"] / (x["g"] + x["b"]))


def _sum(rows: Column, value) -> Column:  # noqa: ANN001
    return F.aggregate(rows, F.lit(0.0), lambda total, x: total + value(x))


def _model(share: Column, on_good: Column, on_bad: Column) -> Column:
    return F.struct(share.alias("share"), on_good.alias("on_good"), on_bad.alias("on_bad"))


def fit(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """(share, on_good, on_bad), one row: the share of good texts, and each rule's accuracies on good and on bad ones.

    patterns: (votes, n), an array of the rules' votes and how often it occurs; at most 3^rules
    rows, which are folded over the rounds of EM as one array. Without texts it is the prior.
    """
    total, rows = F.col("total"), F.col("rows")

    def step(model: Column, _: Column) -> Column:
        weighed = F.transform(rows, lambda r: _let(r["n"] * _quality(r["votes"], model), lambda g: F.struct(r["votes"].alias("votes"), g.alias("good"), (r["n"] - g).alias("bad"))))

        def rates(weighed: Column, weight: str, right: int, start: float, own: float) -> Column:
            def rate(j: Column) -> Column:
                hit = _sum(weighed, lambda r: F.when(F.get(r["votes"], j) == right, r[weight]).otherwise(0.0))
                voted = _sum(weighed, lambda r: F.when(F.get(r["votes"], j) != 0, r[weight]).otherwise(0.0))
                return (hit + own * total * start) / (voted + own * total)

            return F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), rate)

        share = lambda w: (_sum(w, lambda r: r["good"]) + PRIOR * total * SHARE) / (total + PRIOR * total)
        return _let(weighed, lambda w: _model(share(w), rates(w, "good", 1, ON_GOOD, PRIOR_ON_GOOD), rates(w, "bad", -1, ON_BAD, PRIOR)))

    start = _model(F.lit(SHARE), F.array_repeat(F.lit(ON_GOOD), rules), F.array_repeat(F.lit(ON_BAD), rules))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"))
    folded = F.when(total > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)).otherwise(start)
    return one.select(folded.alias("model")).select("model.*")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, what is measured, base_failed, the votes (vote_<rule>), quality (probability, 6 digits) and kept.

    base_failed: fewer than LEAST_WORDS words, or over MOST_REPEATED hundredths of them in
    repeated windows of three. kept: not base_failed, and quality is at least one half.

    A null or empty text, or one of blanks only, has no words and fails. Repeated rows are
    further rows; a null id stays. Very long texts are measured whole. An empty table gives no
    rows. Columns of docs other than key and text are ignored. A text on which all rules
    abstain has the share of good texts as its quality.
    """
    votes = [f"vote_{r.name}" for r in rules]
    rows = materialise(measured(docs, key, text).withColumns({v: F.expr(r.sql()) for v, r in zip(votes, rules, strict=True)}), "votes")
    patterns = rows.groupBy(F.array(*votes).alias("votes")).agg(F.count("*").alias("n"))
    found = fit(patterns, len(rules), rounds).first()  # one row of 2 * rules + 1 numbers
    model = _model(F.lit(found["share"]), *(F.array(*map(F.lit, found[c])) for c in ("on_good", "on_bad")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = rows.withColumn("base_failed", failed).withColumn("quality", _quality(F.array(*votes), model))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).withColumn("quality", F.round("quality", 6))


def oracle(rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL: each round of EM is a table of one row."""
    votes = [f"vote_{r.name}" for r in rules]

    def quality(table: str) -> str:
        good = " * ".join([f"{table}.share", *(f"CASE WHEN {v} = 1 THEN {table}.g{k} WHEN {v} = -1 THEN 1 - {table}.g{k} ELSE 1 END" for k, v in enumerate(votes))])
        bad = " * ".join([f"(1 - {table}.share)", *(f"CASE WHEN {v} = 1 THEN 1 - {table}.b{k} WHEN {v} = -1 THEN {table}.b{k} ELSE 1 END" for k, v in enumerate(votes))])
        return f"{good} / ({good} + {bad})"

    start = ", ".join([f"{SHARE}::DOUBLE AS share", *(f"{p}::DOUBLE AS {x}{k}" for k in range(len(rules)) for x, p in (("g", ON_GOOD), ("b", ON_BAD)))])
    steps = [f"m0 AS MATERIALIZED (SELECT {start})"]
    for i in range(rounds):
        rates = [f"(sum(CASE WHEN {v} = {right} THEN {w} ELSE 0 END) + {own} * sum(n) * {p}) / (sum(CASE WHEN {v} <> 0 THEN {w} ELSE 0 END) + {own} * sum(n)) AS {x}{k}" for k, v in enumerate(votes) for x, w, right, p, own in (("g", "good", 1, ON_GOOD, PRIOR_ON_GOOD), ("b", "n - good", -1, ON_BAD, PRIOR))]
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT (sum(good) + {PRIOR} * sum(n) * {SHARE}) / (sum(n) * (1 + {PRIOR})) AS share, {', '.join(rates)} FROM (SELECT p.*, n * ({quality('m')}) AS good FROM p, m{i} m))")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS no, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT no, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT no, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
r AS (SELECT no, count(DISTINCT i + k) AS n FROM (SELECT no, i, count(*) OVER (PARTITION BY no, a, b, c) AS n FROM g) x, unnest([0, 1, 2]) AS u(k) WHERE x.n > 1 GROUP BY no),
f AS (SELECT w.no, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(list_filter(words, lambda x: regexp_matches(x, '\\p{{L}}')))::BIGINT AS n_letter_words,
  len(regexp_extract_all(t, '\\p{{Lu}}'))::BIGINT AS n_upper, len(regexp_extract_all(t, '\\p{{Ll}}'))::BIGINT AS n_lower, len(regexp_extract_all(t, '[!?]{{2,}}'))::BIGINT AS n_exclaimed
  FROM w LEFT JOIN r ON r.no = w.no),
v AS MATERIALIZED (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {", ".join(f"{r.sql()} AS {v}" for r, v in zip(rules, votes, strict=True))} FROM f),
p AS MATERIALIZED (SELECT {", ".join(votes)}, count(*) AS n FROM v GROUP BY ALL),
{", ".join(steps)}
SELECT v.* EXCLUDE (no), round({quality("m")}, 6) AS quality, NOT base_failed AND {quality("m")} >= 0.5 AS kept FROM v, m{rounds} m
"""
