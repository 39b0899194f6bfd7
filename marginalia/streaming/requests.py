"""Request handling as streams: check-out with timeout, first-in first-out queues, incremental counts.

Each operator is a fold over a key's ordered events with a small state, run by
applyInPandasWithState on a stream; run_available() drains what a source holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import shared_path

Fold = Callable[[dict, tuple], list[tuple]]


def stateful(events: DataFrame, key: str, order: str, columns: list[str], fold: Fold, schema: str) -> DataFrame:
    """Streams events through fold(state, row of columns), by key, in the order of a batch's column; rows returned are appended. state is a dict that lasts."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(order)
        out = [r for row in zip(*(rows[c].tolist() for c in columns), strict=True) for r in fold(now, row)]
        state.update((json.dumps(now),))
        names = [f.split()[0] for f in schema.split(", ")]
        yield pd.DataFrame(out, columns=names)

    return events.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def checkout_fold(timeout: float) -> Fold:
    """Events (key, id, kind, seconds): a check-out is answered in time, cancelled, or times out when a later event finds it expired; an answer without one is late."""

    def fold(state: dict, row: tuple) -> list[tuple]:
        key, at, kind, now = row
        out = []
        opened = state.pop("opened", None)
        if opened is not None and now - opened > timeout:
            out.append((key, at, "timeout"))
            opened = None
        if kind == "answer":
            out.append((key, at, "late" if opened is None else "answered"))
        elif kind == "cancel" and opened is not None:
            out.append((key, at, "cancelled"))
        elif kind == "checkout":
            state["opened"] = now
        return out

    return fold


def queue_fold(state: dict, row: tuple) -> list[tuple]:
    """Events (queue, id, kind): add puts the event's id at the end; take hands out the first; cancel puts what was handed out last back at the end; flush fails all that wait."""
    queue, at, kind = row
    waiting, out = state.setdefault("waiting", []), state.setdefault("out", [])
    if kind == "add":
        waiting.append(at)
    elif kind == "take" and waiting:
        out.append(waiting.pop(0))
        return [(queue, at, out[-1], "taken")]
    elif kind == "cancel" and out:
        waiting.append(out.pop())
        return [(queue, at, waiting[-1], "requeued")]
    elif kind == "flush":
        failed = [(queue, at, w, "failed") for w in waiting]
        waiting.clear()
        return failed
    return []


def count_fold(state: dict, row: tuple) -> list[tuple]:
    """Events (key, id, term, change): reference counts of terms; a term appears when its count leaves 0 and disappears when it returns to it."""
    key, at, term, change = row
    was = state.get(term, 0)
    now = max(0, was + change)
    if now:
        state[term] = now
    else:
        state.pop(term, None)
    return [(key, at, term, "added" if now else "removed")] if bool(was) != bool(now) else []


def run_available(stream: DataFrame, tag: str) -> DataFrame:
    """Runs a stream over what its source holds now and returns the appended rows, by a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    path, log = shared_path(spark, tag), shared_path(spark, f"{tag}-log")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
