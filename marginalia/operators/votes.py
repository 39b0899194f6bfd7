"""Vote aggregation, request choice, scoring, and decisions over lines or tokens.

A vote frame has (request, param, value, user, ord): ord orders votes, a null value is a
vote for null. Voters of a request who name no value of a parameter vote null for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def support(votes: DataFrame) -> DataFrame:
    """(request, param, value, n, reached_at): distinct users of each value and when the last of them first voted for it."""
    first = votes.filter("value IS NOT NULL").groupBy("request", "param", "value", "user").agg(F.min("ord").alias("since"))
    return first.groupBy("request", "param", "value").agg(F.count("*").alias("n"), F.max("since").alias("reached_at"))


def agreed(votes: DataFrame, threshold: int) -> DataFrame:
    """(request, param, value, n, n_null, complete): the best supported value, the first to reach its support in a tie.

    complete holds if the value or null has the threshold; value is null if only null has it.
    """
    best = support(votes).groupBy("request", "param").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("reached_at"), F.col("value"))).alias("b"))
    voters = votes.groupBy("request").agg(F.count_distinct("user").alias("voters"))
    named = votes.groupBy("request", "param").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("user"))).alias("named"))
    all_ = named.join(voters, "request").join(best, ["request", "param"], "left")
    n, null = F.coalesce(F.col("b.n"), F.lit(0)), F.col("voters") - F.col("named")
    return all_.select("request", "param", F.when(n >= threshold, F.col("b.value")).alias("value"), n.alias("n"), null.alias("n_null"), ((n >= threshold) | (null >= threshold)).alias("complete"))


def complete_requests(agreed_: DataFrame) -> DataFrame:
    return agreed_.groupBy("request").agg(F.bool_and("complete").alias("complete"), F.sum((~F.col("complete")).cast("long")).alias("ambiguous"))


def null_voters(votes: DataFrame) -> DataFrame:
    """(request, param, user): voters of the request who named no value of the parameter."""
    users = votes.select("request", "user").distinct()
    params = votes.select("request", "param").distinct()
    named = votes.filter("value IS NOT NULL").select("request", "param", "user").distinct()
    return params.join(users, "request").join(named, ["request", "param", "user"], "left_anti")


def correct_answers(votes: DataFrame, agreed_: DataFrame) -> DataFrame:
    """(user, correct): agreed parameters whose value the user voted for."""
    right = votes.join(agreed_.filter("value IS NOT NULL").select("request", "param", "value"), ["request", "param", "value"], "left_semi")
    return right.select("user", "request", "param").distinct().groupBy("user").agg(F.count("*").alias("correct"))


def redundancy(least: int, most: int, complexity: Column) -> Column:
    return F.least(F.lit(least), F.ceil(F.lit(most) / complexity)).cast("long")


def next_request(requests: DataFrame, answered: DataFrame, users: DataFrame) -> DataFrame:
    """(user, request): each user's first request by number that the user hasn't answered; else the first that was cancelled; users without one are left out.

    answered: (user, request, cancelled). The first gap in a user's answered requests is
    found by comparing their places in the list of requests with their own numbering, so
    users and requests are never paired.
    """
    places = numbered(requests.select("request"), ["request"]).select("request", (F.col("number") + 1).cast("int").alias("place"))
    mine = answered.groupBy("user", "request").agg(F.bool_and("cancelled").alias("cancelled")).join(places, "request")
    own = mine.withColumn("k", F.row_number().over(Window.partitionBy("user").orderBy("place")))
    state = own.groupBy("user").agg(F.min(F.when(F.col("k") != F.col("place"), F.col("k"))).alias("gap"), F.count("*").alias("n"), F.min(F.when(F.col("cancelled"), F.col("place"))).alias("late"))
    whole = places.agg(F.count("*").alias("n")).first()["n"]
    after = F.when(F.coalesce(F.col("n"), F.lit(0)) < whole, F.coalesce(F.col("n"), F.lit(0)) + 1)
    choice = users.join(state, "user", "left").select("user", F.coalesce("gap", after, "late").cast("int").alias("place"))
    return choice.join(places, "place").select("user", "request")


def quiz_scores(answers: DataFrame, score: int, penalty: int) -> DataFrame:
    """(user, score, penalty, net) of (user, outcome, complexity): right scales up with complexity, wrong costs nothing at complexity 1, cancel and timeout cost the flat penalty."""
    right = F.when(F.col("outcome") == "right", F.greatest(F.lit(1), "complexity") * score).otherwise(0)
    cost = F.when(F.col("outcome") == "wrong", F.least(F.lit(1), F.col("complexity") - 1) * penalty).when(F.col("outcome").isin("cancel", "timeout"), penalty).otherwise(0)
    out = answers.groupBy("user").agg(F.sum(right).cast("long").alias("score"), F.sum(cost).cast("long").alias("penalty"))
    return out.withColumn("net", F.col("score") - F.col("penalty"))


def ranking(scores: DataFrame) -> DataFrame:
    """scores with rank by falling net score; ties share a rank. Users are first summed by score, so that only distinct scores are ranked in one task."""
    levels = scores.groupBy("net").agg(F.count("*").alias("k"))
    over = Window.orderBy(F.desc("net")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.select("net", (F.coalesce(F.sum("k").over(over), F.lit(0)) + 1).cast("long").alias("rank"))
    return scores.join(ranks, "net")


def sections(lines: DataFrame, key: str, order: str, state: Column) -> DataFrame:
    """(key, section, first, last) from start/continue/other decisions: a missing one continues, or is other while nothing is open; section numbers from 1."""
    w = Window.partitionBy(key).orderBy(order)
    number = F.sum(F.when(F.col("__state") == "S", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.last(F.when(F.col("__state").isin("S", "O"), F.col("__state")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("__state", F.coalesce(state, F.lit("C"))).withColumn("section", number).withColumn("__in", closed)
    return marked.filter("section > 0 AND __in = 'S'").groupBy(key, "section").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def decisions(lines: DataFrame, given: Column, default: str, options: list[str]) -> DataFrame:
    """lines with decision: the given one if it is an option, else the default."""
    return lines.withColumn("decision", F.when(given.isin(options), given).otherwise(default))


def dispatch(requests: DataFrame, services: DataFrame) -> DataFrame:
    """(request, service): of services (service, priority, kind), the one with the highest priority, then the first name, that accepts the request's kind."""
    return requests.join(services, "kind").groupBy("request").agg(F.min_by("service", F.struct(-F.col("priority"), F.col("service"))).alias("service"))


def lifecycle(events: DataFrame, redundancy_: int = 2) -> DataFrame:
    """(quiz, state) after all events (quiz, ord, event, users): a fold over each quiz's ordered events.

    start needs 2 * redundancy - 1 users; running and paused alternate; stop finishes, close ends a finished quiz.
    """

    def step(s: Column, e: Column) -> Column:
        able = e["users"] >= 2 * redundancy_ - 1
        return (
            F.when((s == "INITIALIZING") & (e["event"] == "start") & able, "RUNNING")
            .when((s == "RUNNING") & (e["event"] == "pause"), "PAUSED")
            .when((s == "PAUSED") & (e["event"] == "start"), "RUNNING")
            .when(s.isin("RUNNING", "PAUSED") & (e["event"] == "stop"), "FINISHED")
            .when((s == "FINISHED") & (e["event"] == "close"), "CLOSED")
            .otherwise(s)
        )

    ordered = events.groupBy("quiz").agg(F.array_sort(F.collect_list(F.struct("ord", "event", "users"))).alias("e"))
    return ordered.select("quiz", F.aggregate("e", F.lit("INITIALIZING"), step).alias("state"))
