"""State by key that follows event time: rows wait until the watermark has passed them, are taken in order, and fold into a small state.

So a row that comes late, but within the watermark, counts at its place. Timers take the rows up and forget states that no longer matter. Needs the
RocksDB state store (see `with_state_store`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: (state, ts in microseconds, id, what) to (state, result); a null result gives no row, a null state is forgotten.
Step = Callable[[tuple | None, int, int, str], tuple[tuple | None, str | None]]


def with_state_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that timers and lists need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class _InOrder(StatefulProcessor):
    def __init__(self, step: Step, state: str, forget: float | None):
        self.step, self.state, self.forget = step, state, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, id bigint, what string")
        self.held = handle.getValueState("held", f"last bigint, {self.state}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            found = list(zip((frame["ts"].astype("datetime64[us]").astype("int64")).tolist(), frame["id"].tolist(), frame["what"].tolist(), strict=True))
            if found:
                self.waiting.appendList(found)
                first = min(first or found[0][0], *(f[0] for f in found))
        if first is not None:  # one timer a call: it takes up all that the watermark has passed, and sets the next
            self.handle.registerTimer(first // 1000 + 1)
        yield _rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        passed, left = [w for w in waiting if w[0] < now], [w for w in waiting if w[0] >= now]
        before = tuple(self.held.get()) if self.held.exists() else None
        state, last, out = (before[1:], before[0], []) if before else (None, None, [])
        for ts, i, what in passed:
            state, result = self.step(state, ts, i, what)
            last = ts
            if result is not None:
                out.append((ts, i, result))
        if passed:
            self.waiting.put(left) if left else self.waiting.clear()
        if left:
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        over = last is not None and self.forget is not None and not left and last + self.forget * 1e6 < now
        if state is None or over:
            if before:
                self.held.clear()
        elif passed:
            self.held.update((last, *state))
            if self.forget is not None:
                self.handle.registerTimer(int(last / 1000 + self.forget * 1000) + 2)
        yield _rows(key, out)

    def close(self) -> None:
        pass


def _rows(key: tuple, out: list[tuple]) -> pd.DataFrame:
    ts, ids, results = zip(*out, strict=True) if out else ((), (), ())
    return pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object), "ts": pd.Series(pd.to_datetime(list(ts), unit="us"), dtype="datetime64[us]"), "id": pd.Series(ids, dtype="int64"), "result": pd.Series(results, dtype=object)})


def folded(rows: DataFrame, step: Step, state: str, lateness: str, forget: float | None = None) -> DataFrame:
    """key, ts, id, result of a stream of rows (key string, ts, id bigint, what string), taken by key in order of ts, id and what.

    state: columns of the state; forget: seconds after which, without further rows, it doesn't matter any more."""
    timed = rows.select(F.col("key").cast("string").alias("key"), "ts", F.col("id").cast("bigint").alias("id"), "what").withWatermark("ts", lateness)
    return timed.groupBy("key").transformWithStateInPandas(_InOrder(step, state, forget), "key string, ts timestamp, id bigint, result string", "Append", "EventTime")


def suppressed(notes: DataFrame, seconds: float = 3.0, lateness: str = "1 minute") -> DataFrame:
    """key, ts, id, result (the message) of notes (key, ts, id, what) that don't repeat the note shown last within `seconds`.

    The state is that note; it is forgotten once nothing can repeat it."""
    wait = int(seconds * 1e6)

    def step(state, ts, _, what):
        if state is not None and state[0] == what and ts - state[1] < wait:
            return state, None
        return (what, ts), what

    return folded(notes, step, "message string, shown bigint", lateness, seconds)


def open_set(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """key, ts, id, result of events (key: a path, ts, id, what: open or close): what each does to the set of open documents.

    `opened`: the path wasn't open; `shown`: it was, and its document comes to the front; `closed`. A close of what isn't open does nothing. The
    state of a path lasts as long as it is open."""

    def step(state, _, __, what):
        if what == "open":
            return (True,), "opened" if state is None else "shown"
        return None, "closed" if what == "close" and state is not None else None

    return folded(events, step, "is_open boolean", lateness)


def open_set_batch(events: DataFrame) -> DataFrame:
    """The same over a table: an open is `opened` if the event of its path before it is none or a close."""
    before = F.lag("what").over(W.partitionBy("key").orderBy("ts", "id", "what"))
    known = events.where(F.col("what").isin("open", "close")).withColumn("_before", before)
    was_open = F.coalesce(F.col("_before") == "open", F.lit(False))
    result = F.when(F.col("what") == "open", F.when(was_open, "shown").otherwise("opened")).when(was_open, "closed")
    return known.select("key", "ts", "id", result.alias("result")).where("result is not null")


def to_open(paths: DataFrame, now_open: DataFrame) -> DataFrame:
    """Of paths (path, ...) those that aren't in the set of open ones."""
    return paths.join(now_open.select("path").distinct(), "path", "left_anti")


class _Queue(StatefulProcessor):
    """Pending requests of a key; each call hands out the most urgent ones."""

    def __init__(self, at_once: int):
        self.at_once = at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "page_no int, type int", "id bigint")

    def _handed(self, key) -> pd.DataFrame:
        todo = sorted((tuple(k), v[0]) for k, v in self.pending.iterator()) if self.pending.exists() else []
        for k, _ in todo[: self.at_once]:
            self.pending.removeKey(k)
        out = [(key[0], *k, i, n) for n, (k, i) in enumerate(todo[: self.at_once], 1)]
        return pd.DataFrame(out, columns=["key", "page_no", "type", "id", "turn"]).astype({"page_no": "int32", "type": "int32", "id": "int64", "turn": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = sorted(r for f in rows for r in zip(f["id"].tolist(), f["page_no"].tolist(), f["type"].tolist(), f["cancelled"].tolist(), strict=True))
        for i, page, kind, cancelled in found:  # in order of ids: a request may be cancelled and asked for again
            if page < 0:
                continue
            if cancelled:
                self.pending.removeKey((page, kind))
            elif not self.pending.containsKey((page, kind)):
                self.pending.updateValue((page, kind), (i,))
        yield self._handed(key)

    def close(self) -> None:
        pass


def queue(requests: DataFrame, at_once: int = 4) -> DataFrame:
    """key, page_no, type, id, turn: at most `at_once` requests of a key each batch with rows of it, most urgent first (by page, then type).

    requests: key, id bigint, page_no, type, cancelled (true: takes back what was asked for). What isn't handed out waits in the state, where a later
    batch may cancel it, add to it, or come before it; a request that waits already isn't asked for twice. A row without a page asks for
    nothing but the key's next turn: whoever works on the requests sends it when done."""
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("page_no").cast("int"), F.lit(-1)).alias("page_no"), F.coalesce(F.col("type").cast("int"), F.lit(0)).alias("type"), F.coalesce("cancelled", F.lit(False)).alias("cancelled"))
    return rows.groupBy("key").transformWithStateInPandas(_Queue(at_once), "key string, page_no int, type int, id bigint, turn int", "Append", "None")


def suppressed_batch(notes: DataFrame, seconds: float = 3.0, span: float = 86400.0) -> DataFrame:
    """key and id of a table's notes (key, ts, id, message) that don't repeat the note shown last within `seconds`.

    What is held back has the message of the note before it, which came less than `seconds` earlier; so a note with another message, or after
    a longer silence, is shown for sure and starts a burst. Bursts are told from rows by spans of time (a key's rows aren't one group), with one row
    a span for what reaches over its start; only the notes of a burst are folded together."""
    order = ["ts", "id"]
    own = notes.select("key", F.col("ts").cast("timestamp").alias("ts"), "id", "message").withColumn("_span", F.floor(F.col("ts").cast("double") / span))
    inner = W.partitionBy("key", "_span").orderBy(*order)
    near = ["ts", "message"]
    ends = own.groupBy("key", "_span").agg(F.max(F.struct(*order, "message")).alias("_end"))
    last = ends.withColumn("_last", F.lag("_end").over(W.partitionBy("key").orderBy("_span"))).select("key", "_span", F.struct(*(F.col(f"_last.{c}").alias(c) for c in near)).alias("_last"))
    on = ["key", "_span"]
    before = F.lag(F.struct(*near)).over(inner)
    rows = own.withColumn("_before", before).join(last.withColumnRenamed("key", "_key").withColumnRenamed("_span", "_at"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_at"))).drop("_key", "_at")
    rows = rows.withColumn("_before", F.coalesce("_before", "_last"))
    gap = F.col("ts").cast("double") - F.col("_before.ts").cast("double")
    rows = rows.withColumn("_sure", ~F.coalesce((F.col("message") == F.col("_before.message")) & (gap < seconds), F.lit(False)))
    start = F.when(F.col("_sure"), F.struct(*order))
    rows = rows.withColumn("_start", F.last(start, ignorenulls=True).over(inner))
    carried = rows.groupBy(*on).agg(F.max(start).alias("_start")).withColumn("_carried", F.last("_start", ignorenulls=True).over(W.partitionBy("key").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)))
    carried = carried.select(F.col("key").alias("_key"), F.col("_span").alias("_at"), "_carried")
    rows = rows.join(carried, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_at"))).withColumn("_start", F.coalesce("_start", "_carried"))
    # a burst: the first is shown, then the first that comes `seconds` or more after the one shown last
    note = F.struct("ts", "id")
    zero = F.struct(F.lit(None).cast("timestamp").alias("ts"), F.array().cast("array<bigint>").alias("shown"))

    def step(a, n):
        held = F.coalesce(n["ts"].cast("double") - a["ts"].cast("double") < seconds, F.lit(False))
        return F.when(held, a).otherwise(F.struct(n["ts"].alias("ts"), F.concat(a["shown"], F.array(n["id"])).alias("shown")))

    bursts = rows.groupBy("key", "_start").agg(F.array_sort(F.collect_list(note)).alias("_notes"))
    return bursts.select("key", F.explode(F.aggregate("_notes", zero, step)["shown"]).alias("id"))
