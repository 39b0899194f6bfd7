"""Streams with timers beside plain folds over the ordered log."""

from __future__ import annotations

import random
from collections import Counter, OrderedDict

import pytest

from marginalia.plans import streams
from marginalia.streaming import processors as pr


class Handle:
    """A state store in memory."""

    def __init__(self):
        self.maps = {}

    def getMapState(self, name, key, value):  # noqa: N802, ARG002
        return self.maps.setdefault(name, Map())


class Map(dict):
    containsKey = dict.__contains__  # noqa: N815
    getValue = dict.__getitem__  # noqa: N815
    updateValue = dict.__setitem__  # noqa: N815
    removeKey = dict.__delitem__  # noqa: N815

    def iterator(self):
        return iter(list(self.items()))


def test_multiset_keeps_its_ends():
    rng, handle = random.Random(1), Handle()
    held, found = Counter(), pr.Multiset(handle, "x")
    for step in range(4000):
        x = rng.choice([rng.randrange(40), rng.randrange(5000), rng.randrange(1 << 36)]) if rng.random() < 0.6 or not held else rng.choice(list(held))
        if rng.random() < (0.55 if step < 2500 else 0.3):
            found.add(x)
            held[x] += 1
        elif held[x] > 0:
            found.remove(x)
            held[x] -= 1
        else:
            found.remove(x)
        held = +held
        if step % 7 == 0:
            found.flush()
            found = pr.Multiset(handle, "x")
        assert (found.least(), found.greatest()) == ((min(held), max(held)) if held else (None, None))
    for x in list(held.elements()):
        found.remove(x)
    found.flush()
    assert found.least() is None and not handle.maps["x_counts"] and not handle.maps["x_masks"]
    with pytest.raises(ValueError):
        found.add(1 << 36)


def fold_queue(rows, last):
    """One queue's ordered log; last: where the clock stands in the end."""
    waiting, pending, groups, out = OrderedDict(), {}, {}, []

    def over(group, at, outcome, seconds):
        groups.pop(group)
        for p in [p for p, g in waiting.items() if g == group]:
            waiting.pop(p)
        out.append((at, group, outcome, round(seconds, 3)))

    def expire(now):
        for g in [g for g, (_, end) in groups.items() if end and end < now]:
            over(g, None, "timeout", groups[g][1])

    for r in rows:
        expire(r.seconds)
        if r.kind == "add":
            groups[r.group] = (len(r.panels), r.seconds + r.timeout if r.timeout else 0)
            waiting.update((p, r.group) for p in r.panels)
        elif r.kind == "take" and waiting:
            p, g = waiting.popitem(last=False)
            pending[p] = g
            out.append((r.at, p, "taken", round(r.seconds, 3)))
        elif r.kind in ("answer", "cancel") and r.panel in pending:
            g = pending.pop(r.panel)
            out.append((r.at, r.panel, "answered" if r.kind == "answer" else "requeued" if g in groups else "dropped", round(r.seconds, 3)))
            if g in groups and r.kind == "cancel":
                waiting[r.panel] = g
            elif g in groups:
                groups[g] = (groups[g][0] - 1, groups[g][1])
                if not groups[g][0]:
                    over(g, r.at, "group answered", r.seconds)
        elif r.kind in ("flush", "clear"):
            gone = list(waiting.values()) + (list(pending.values()) if r.kind == "clear" else [])
            if r.kind == "clear":
                pending.clear()
            for g in dict.fromkeys(gone):
                if g in groups:
                    over(g, r.at, "failed", r.seconds)
    expire(last)
    return out


def test_queue_against_a_fold(spark, small):
    rows = streams.queue_log(spark, small).collect()
    last = max(r.seconds for r in rows)
    want = Counter()
    for q in {r.queue for r in rows}:
        want.update((q, *x) for x in fold_queue(sorted((r for r in rows if r.queue == q), key=lambda r: (r.seconds, r.at)), last))
    got = Counter(tuple(r) for r in streams.queues(spark, small).collect())
    assert got == want
    assert set(Counter(x[3] for x in want)) == {"taken", "answered", "requeued", "dropped", "group answered", "timeout", "failed"}


def run(spark, tmp_path, processor, keys, shape, *batches):
    """What a processor tells of batches that come one after the other, each as a file, in a query that is stopped and started again between them."""
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        events = pr.timed(spark.readStream.schema(spark.createDataFrame([], shape).schema).parquet(source))
        stream = pr.process(events, keys, processor)
        spark.conf.set(pr._STORE, pr._ROCKS)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        spark.conf.unset(pr._STORE)
    return [tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()]


def test_an_expiry_needs_no_further_event(spark, tmp_path):
    shape = "request string, user string, at long, kind string, seconds double"
    first = [("r", "u", 1, "checkout", 1000.0), ("r", "w", 2, "checkout", 1000.0), ("s", "u", 3, "checkout", 1050.0)]
    second = [("r", "w", 4, "answer", 1100.4), ("other", "x", 5, "answer", 1500.0)]
    got = run(spark, tmp_path, pr.Checkouts(120.0), ["request", "user"], shape, first, second)
    assert sorted(got, key=str) == sorted([("r", "u", 1, None, "timeout", 1120.0, None), ("s", "u", 3, None, "timeout", 1170.0, None), ("r", "w", 2, 4, "answered", 1100.4, 100), ("other", "x", None, 5, "late", 1500.0, None)], key=str)


def test_a_group_is_answered_when_all_its_panels_are(spark, tmp_path):
    shape = "queue long, at long, kind string, group string, panels array<string>, panel string, timeout double, seconds double"
    say = lambda at, kind, group=None, panels=None, panel=None, timeout=0.0: (1, at, kind, group, panels, panel, timeout, 1000.0 + at)
    first = [say(1, "add", "g", ["a", "b"]), say(2, "add", "h", ["c"], timeout=50.0), say(3, "take"), say(4, "take"), say(5, "answer", panel="b"), say(6, "cancel", panel="a"), say(7, "cancel", panel="c")]
    second = [say(8, "take"), say(9, "take"), say(10, "answer", panel="a"), say(11, "take"), say(99, "answer", panel="c"), (2, 100, "take", None, None, None, 0.0, 1200.0)]
    got = sorted(run(spark, tmp_path, pr.Queue(), ["queue"], shape, first, second), key=lambda r: (r[4], r[3]))
    assert [r[1:4] for r in got] == [(3, "a", "taken"), (4, "b", "taken"), (5, "b", "answered"), (6, "a", "requeued"), (8, "c", "taken"), (9, "a", "taken"), (10, "a", "answered"), (10, "g", "group answered"), (None, "h", "timeout"), (99, "c", "answered")]


def fold_life(rows, last, retain):
    out, now = [], None

    def discard(t):
        nonlocal now
        if now and now["state"] == 4 and now["touched"] + retain < t:
            out.append((None, "Discarded", 100, now["error"], round(now["touched"] + retain, 3)))
            now = None

    for r in rows:
        discard(r.seconds)
        if r.kind == "start" and now is None:
            now = {"state": 1, "own": -1, "error": False}
        elif now is None or now["state"] == 4:
            if now and r.kind == "access":
                now["touched"] = r.seconds
            continue
        elif r.kind == "status":
            now["own"] = max(0, min(100, int(r.value)))
        elif r.kind == "error":
            now["error"], now["state"] = True, 4 if now["state"] == 3 else 3
        elif r.kind == "cancel":
            now["state"] = 3
        elif {"init": 1, "process": 2, "clean": 3}.get(r.kind) == now["state"]:
            now["state"] += 1
        else:
            continue
        now["touched"] = r.seconds
        percent = (0, 0, 5, 95, 100)[now["state"]]
        out.append((r.at, ("Started", "Initializing", "Running", "Finishing", "Finished")[now["state"]], percent if now["own"] < 0 or now["state"] == 4 else now["own"], now["error"], round(r.seconds, 3)))
    discard(last)
    return out


def test_life_cycles_against_a_fold(spark, small):
    rows = streams.life_log(spark, small).collect()
    last, want = max(r.seconds for r in rows), Counter()
    for q in {r.request for r in rows}:
        want.update((q, *x) for x in fold_life(sorted((r for r in rows if r.request == q), key=lambda r: (r.seconds, r.at)), last, 5 * streams.DAY))
    assert Counter(tuple(r) for r in streams.life_cycles(spark, small).collect()) == want
    assert {x[2] for x in want} == {"Initializing", "Running", "Finishing", "Finished", "Discarded"}


def test_empty_stream(spark, tmp_path):
    assert run(spark, tmp_path, pr.NumberRange(), ["prefix"], "prefix long, at long, kind string, number long, source string, seconds double", []) == []
