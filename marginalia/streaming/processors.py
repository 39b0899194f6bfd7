"""Keyed state with timers: queues of request groups, check-outs, request life cycles, and an ordered multiset.

Each processor runs by transformWithState: its state is in keyed maps of the state store, of
which an event reads and writes a few entries, however much is outstanding. Deadlines are
timers, so an expiry appears when the clock passes it, without a further event of the key. The
clock is the watermark of the events' own time, or processing time.

Within a micro-batch, the events of a key are taken in the order of their time and number; they
are in memory together, so the source's rate options (maxFilesPerTrigger) bound that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.files import shared_path

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Entries:
    """A map of the state store whose entries are read once and written once a micro-batch."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str, value: str) -> None:
        self.state = handle.getMapState(name, key, value)
        self.read: dict[tuple, tuple | None] = {}
        self.changed: set[tuple] = set()

    def get(self, *key) -> tuple | None:  # noqa: ANN002
        if key not in self.read:
            self.read[key] = tuple(self.state.getValue(key)) if self.state.containsKey(key) else None
        return self.read[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        """None removes the entry."""
        self.get(*key)
        self.read[key] = value
        self.changed.add(key)

    def items(self) -> list[tuple[tuple, tuple]]:
        """All entries; for what concerns a whole queue only."""
        stored = {tuple(k): tuple(v) for k, v in self.state.iterator()}
        return [(k, v) for k, v in (stored | self.read).items() if v is not None]

    def flush(self) -> None:
        for key in self.changed:
            if (value := self.read[key]) is not None:
                self.state.updateValue(key, value)
            elif self.state.containsKey(key):
                self.state.removeKey(key)
        self.read.clear()
        self.changed.clear()


class Multiset:
    """An ordered multiset of whole numbers from 0 to 2^36 - 1: how often each is in it, and a tree of 64-bit masks that finds the least and the greatest in LEVELS reads."""

    LEVELS, BITS = 6, 6

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.counts = Entries(handle, f"{name}_counts", "number long", "n long")
        self.masks = Entries(handle, f"{name}_masks", "level int, at long", "mask long")

    def add(self, number: int) -> None:
        if not 0 <= number < 1 << self.LEVELS * self.BITS:
            raise ValueError(f"{number} is out of range")
        n = (self.counts.get(number) or (0,))[0]
        self.counts.put((number,), (n + 1,))
        if not n:
            self._mark(number, True)

    def remove(self, number: int) -> None:
        n = (self.counts.get(number) or (0,))[0]
        if n:
            self.counts.put((number,), (n - 1,) if n > 1 else None)
            if n == 1:
                self._mark(number, False)

    def _mask(self, level: int, at: int) -> int:
        return (self.masks.get(level, at) or (0,))[0] & (1 << 64) - 1

    def _mark(self, number: int, there: bool) -> None:
        at = number
        for level in range(self.LEVELS):
            bit = 1 << (at & 63)
            at >>= self.BITS
            mask = self._mask(level, at)
            new = mask | bit if there else mask & ~bit
            self.masks.put((level, at), ((new ^ 1 << 63) - (1 << 63),) if new else None)
            if bool(mask) == bool(new):
                return

    def _end(self, pick) -> int | None:  # noqa: ANN001
        at = 0
        for level in reversed(range(self.LEVELS)):
            mask = self._mask(level, at)
            if not mask:
                return None
            at = at << self.BITS | pick(mask)
        return at

    def least(self) -> int | None:
        return self._end(lambda mask: (mask & -mask).bit_length() - 1)

    def greatest(self) -> int | None:
        return self._end(lambda mask: mask.bit_length() - 1)

    def flush(self) -> None:
        self.counts.flush()
        self.masks.flush()


class Processor(StatefulProcessor):
    """A key's events in order. A subclass names its results' schema, opens its state, and takes events and due timers; both return rows of that schema.

    Events have the columns seconds (a double) and at (their number), and those that the subclass reads.
    """

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state: list[Entries | Multiset] = []
        self.open()

    def map(self, name: str, key: str, value: str) -> Entries:
        self.state.append(Entries(self.handle, name, key, value))
        return self.state[-1]

    def remind(self, seconds: float) -> None:
        """A timer for a time; once it has passed, due is called with it."""
        self.handle.registerTimer(int(seconds * 1000) + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        frame = pd.concat(list(rows)).sort_values(["seconds", "at"])
        yield self._told([r for e in frame.itertuples(index=False) for r in self.event(key, e)])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield self._told(list(self.due(key, expiredTimerInfo.getExpiryTimeInMs() / 1000)))

    def _told(self, rows: list[tuple]) -> pd.DataFrame:
        for s in self.state:
            s.flush()
        return pd.DataFrame(rows, columns=[f.split()[0] for f in self.schema.split(", ")])

    def close(self) -> None:
        pass

    def open(self) -> None:
        raise NotImplementedError

    def event(self, key: tuple, e) -> Iterator[tuple]:  # noqa: ANN001
        raise NotImplementedError

    def due(self, key: tuple, now: float) -> Iterator[tuple]:
        return iter(())


class Checkouts(Processor):
    """Of one request and user (the key): a check-out is answered, cancelled, or times out; an answer without one is late.

    kind: checkout, answer, cancel. A further check-out takes the place of the one before. Rows
    tell the number of the check-out, that of the event that ended it (null for a time-out), the
    outcome, when it came, and after how many whole seconds (for an answer).
    """

    schema = "request string, user string, checkout long, at long, outcome string, seconds double, took long"

    def __init__(self, timeout: float = 120.0) -> None:
        self.timeout = timeout

    def open(self) -> None:
        self.showing = self.map("showing", "one int", "at long, seconds double")

    def _expired(self, key: tuple, now: float) -> Iterator[tuple]:
        if (shown := self.showing.get(0)) and shown[1] + self.timeout < now:
            self.showing.put((0,), None)
            yield (*key, shown[0], None, "timeout", shown[1] + self.timeout, None)

    def due(self, key: tuple, now: float) -> Iterator[tuple]:
        yield from self._expired(key, now)

    def event(self, key: tuple, e) -> Iterator[tuple]:  # noqa: ANN001
        yield from self._expired(key, e.seconds)
        shown = self.showing.get(0)
        if e.kind == "checkout":
            self.showing.put((0,), (e.at, e.seconds))
            self.remind(e.seconds + self.timeout)
        elif shown:
            self.showing.put((0,), None)
            yield (*key, shown[0], e.at, "answered" if e.kind == "answer" else "cancelled", e.seconds, int(e.seconds - shown[1] + 0.5) if e.kind == "answer" else None)
        elif e.kind == "answer":
            yield (*key, None, e.at, "late", e.seconds, None)


class Queue(Processor):
    """A first-in, first-out queue (the key) of panels that are asked for in groups; a group is answered when all its panels are.

    kind and what it reads:
    add: group, panels (their names, at least one), timeout (seconds; 0 is none): puts all panels at the end.
    take: hands out the first panel.
    cancel: panel: puts a panel that is handed out back at the end.
    answer: panel: ends a panel that is handed out.
    flush: fails the groups of all waiting panels, which leave; those handed out stay.
    clear: fails the groups of waiting and handed-out panels, all of which leave.

    A group that times out or fails is over: its waiting panels leave the queue, and answers to
    those handed out end them alone. Panels' and groups' names are of one use. Rows tell the
    event (null for a time-out), the panel or the group, and its outcome.
    """

    schema = "queue long, at long, name string, outcome string, seconds double"

    def open(self) -> None:
        self.ends = self.map("ends", "one int", "head long, tail long")
        self.waiting = self.map("waiting", "place long", "panel string, group string")
        self.pending = self.map("pending", "panel string", "group string")
        self.groups = self.map("groups", "group string", "open long, deadline double")
        self.deadlines = self.map("deadlines", "second long", "groups string")

    def _expire(self, group: str, now: float) -> Iterator[tuple]:
        """A row if this group's time has passed."""
        found = self.groups.get(group)
        if found and found[1] and found[1] < now:
            self.groups.put((group,), None)
            yield None, group, "timeout", found[1]

    def due(self, key: tuple, now: float) -> Iterator[tuple]:
        place = (round(now * 1000),)
        for group in ((self.deadlines.get(*place) or ("",))[0]).split("\n"):
            for r in self._expire(group, now):
                yield (*key, *r)
        self.deadlines.put(place, None)

    def _append(self, panel: str, group: str) -> None:
        head, tail = self.ends.get(0) or (0, 0)
        self.waiting.put((tail,), (panel, group))
        self.ends.put((0,), (head, tail + 1))

    def _add(self, e) -> None:  # noqa: ANN001
        deadline = e.seconds + e.timeout if e.timeout else 0.0
        self.groups.put((e.group,), (len(e.panels), deadline))
        for panel in e.panels:
            self._append(panel, e.group)
        if deadline:
            self.remind(deadline)
            place = (int(deadline * 1000) + 1,)
            before = self.deadlines.get(*place)
            self.deadlines.put(place, (f"{before[0]}\n{e.group}" if before else e.group,))

    def _take(self, now: float) -> Iterator[tuple]:
        head, tail = self.ends.get(0) or (0, 0)
        while head < tail:
            panel, group = self.waiting.get(head)
            self.waiting.put((head,), None)
            head += 1
            yield from self._expire(group, now)
            if self.groups.get(group):  # panels of groups that are over leave
                self.pending.put((panel,), (group,))
                yield "at", panel, "taken", now
                break
        self.ends.put((0,), (head, tail))

    def _return(self, e) -> Iterator[tuple]:  # noqa: ANN001
        found = self.pending.get(e.panel)
        if not found:
            return
        self.pending.put((e.panel,), None)
        yield from self._expire(found[0], e.seconds)
        group = self.groups.get(found[0])
        yield "at", e.panel, "answered" if e.kind == "answer" else "requeued" if group else "dropped", e.seconds
        if e.kind == "cancel":
            if group:
                self._append(e.panel, found[0])
        elif group and group[0] > 1:
            self.groups.put((found[0],), (group[0] - 1, group[1]))
        elif group:
            self.groups.put((found[0],), None)
            yield "at", found[0], "group answered", e.seconds

    def _fail(self, e) -> Iterator[tuple]:  # noqa: ANN001
        groups = {v[1]: None for _, v in sorted(self.waiting.items())}
        for place, _ in self.waiting.items():
            self.waiting.put(place, None)
        head, tail = self.ends.get(0) or (0, 0)
        self.ends.put((0,), (tail, tail))
        if e.kind == "clear":
            for panel, (group,) in sorted(self.pending.items()):
                groups[group] = None
                self.pending.put(panel, None)
        for group in groups:
            yield from self._expire(group, e.seconds)
            if self.groups.get(group):
                self.groups.put((group,), None)
                yield "at", group, "failed", e.seconds

    def event(self, key: tuple, e) -> Iterator[tuple]:  # noqa: ANN001
        if e.kind == "add":
            self._add(e)
            return
        steps = self._take(e.seconds) if e.kind == "take" else self._return(e) if e.kind in ("cancel", "answer") else self._fail(e)
        for at, name, outcome, seconds in list(steps):
            yield (*key, e.at if at else None, name, outcome, seconds)


class NumberRange(Processor):
    """Of a prefix (the key): which numbers its sources define, and the least and the greatest of them, after each event.

    kind: add or remove of a number by a source; adding twice, or removing what isn't there,
    changes nothing. Rows tell the event, how many sources define its number now, and the ends.
    """

    schema = "prefix long, at long, number long, sources long, least long, greatest long"

    def open(self) -> None:
        self.sources = self.map("sources", "number long, source string", "there boolean")
        self.numbers = Multiset(self.handle, "numbers")
        self.state.append(self.numbers)

    def event(self, key: tuple, e) -> Iterator[tuple]:  # noqa: ANN001
        there = self.sources.get(e.number, e.source) is not None
        if e.kind == "add" and not there:
            self.sources.put((e.number, e.source), (True,))
            self.numbers.add(e.number)
        elif e.kind == "remove" and there:
            self.sources.put((e.number, e.source), None)
            self.numbers.remove(e.number)
        yield (*key, e.at, e.number, (self.numbers.counts.get(e.number) or (0,))[0], self.numbers.least(), self.numbers.greatest())


class LifeCycle(Processor):
    """Of a request (the key): its state and progress through start, init, process, clean; errors, own progress, cancelling, and when it is forgotten.

    kind: start, init (ends initialising), status (value: own progress, in hundredths), process
    (ends processing), clean (ends), error (in what is being done, which it ends), cancel, and
    access. A request that has ended is kept for `retain` seconds since the end or the last
    access, then discarded; a cancelled one goes on to clean up. Others' events are ignored.
    """

    schema = "request string, at long, state string, percent int, error boolean, seconds double"
    STATES = ("Started", "Initializing", "Running", "Finishing", "Finished")
    PERCENT = (0, 0, 5, 95, 100)

    def __init__(self, retain: float = 600.0) -> None:
        self.retain = retain

    def open(self) -> None:
        self.now = self.map("now", "one int", "state int, own int, error boolean, touched double")

    def due(self, key: tuple, now: float) -> Iterator[tuple]:
        found = self.now.get(0)
        if found and found[0] == 4 and found[3] + self.retain < now:
            self.now.put((0,), None)
            yield (*key, None, "Discarded", 100, found[2], found[3] + self.retain)

    def event(self, key: tuple, e) -> Iterator[tuple]:  # noqa: ANN001
        yield from self.due(key, e.seconds)
        found = self.now.get(0)
        if e.kind == "start" and not found:
            state, own, error = 1, -1, False
        elif not found or (found[0] == 4 and e.kind != "access"):
            return
        else:
            state, own, error, _ = found
            if e.kind == "access":
                if state == 4:
                    self.now.put((0,), (state, own, error, e.seconds))
                    self.remind(e.seconds + self.retain)
                return
            step = {"init": 1, "process": 2, "clean": 3}.get(e.kind)
            if e.kind == "status":
                own = max(0, min(100, int(e.value)))
            elif e.kind == "error":
                error, state = True, min(4, 3 if state < 3 else 4)  # whatever fails, cleaning up follows
            elif e.kind == "cancel":
                state = max(state, 3)
            elif step == state:
                state += 1
            else:
                return
        self.now.put((0,), (state, own, error, e.seconds))
        if state == 4:
            self.remind(e.seconds + self.retain)
        yield (*key, e.at, self.STATES[state], self.PERCENT[state] if own < 0 or state == 4 else own, error, e.seconds)


def process(events: DataFrame, keys: list[str], processor: Processor, clock: str = "event") -> DataFrame:
    """The rows that a processor tells of a stream of events, by key. With the clock "event", events have a column time with a watermark; events behind it are dropped."""
    mode = {"event": "EventTime", "processing": "ProcessingTime"}[clock]
    return events.groupBy(*keys).transformWithStateInPandas(processor, processor.schema, "append", mode)


def timed(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """events with time, from seconds, and its watermark."""
    return events.withColumn("time", F.timestamp_micros((F.col("seconds") * 1e6).cast("long"))).withWatermark("time", delay)


def run_available(stream: DataFrame, tag: str) -> DataFrame:
    """Runs a stream over what its source holds now, and returns the rows told, by a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    path, log = shared_path(spark, tag), shared_path(spark, f"{tag}-log")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # maps and timers need it; a query keeps what it starts with
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
