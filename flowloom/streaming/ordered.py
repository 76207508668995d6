"""Stream operators that see the rows of a key in event order.

Rows may come in any order within the watermark delay. ``Ordered`` appends them to a list state without reading it, as Arrow
batches, and keeps one event-time timer per grouping key, at the earliest moment that matters. When the watermark has passed that
moment the rows that are due are handed on as one table; the others stay in the list. What a subclass keeps
between two calls is its own state. ``asof`` and ``bounded_cache`` are two such operators, the flow tracker is a third.

A call to the state takes as long as the work on hundreds of rows, so operators with many small keys group by a share of the keys
(``in_groups``) and work on all of its rows at once; the number of calls then follows the groups and not the keys.

Rows behind the watermark are dropped by Spark and counted in the query progress. All rows of a group meet in one task,
as keyed state requires; the source's rate limit bounds what a micro-batch brings, the delay what waits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_AT = T.StructType([T.StructField("at_ms", T.LongType())])
_CHUNK = T.StructType([T.StructField("low_us", T.LongType()), T.StructField("high_us", T.LongType()), T.StructField("rows", T.BinaryType())])
# Spark takes the moment 0 as behind a watermark that has not moved yet; tables that hold it are streamed a second later.
LATER = 1_000_000
#: Shares that keys are dealt into; with state partitions by the hundred, take several for each.
GROUPS = 512


def with_event_time(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)


def in_groups(rows: DataFrame, key: str, groups: int = GROUPS) -> GroupedData:
    """Rows grouped by a share of the keys."""
    return rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups))).groupBy("_group")


class Ordered(StatefulProcessor):
    """schema: the columns kept of each row, microseconds first as ``ts_us``."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Takes the state that a subclass needs."""

    def due(self, key: tuple, rows: pa.Table, watermark_us: int) -> tuple[pd.DataFrame | None, int | None]:
        """Takes rows in any order; gives output rows, and when to be called again without any (microseconds)."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _CHUNK)
        self.wake = handle.getValueState("wake", _AT)
        self.opened(handle)

    def _wake_at(self, at_us: int) -> None:
        at = at_us // 1000 + 1
        self.handle.registerTimer(at)
        self.wake.update((at,))

    def _chunk(self, rows: pa.RecordBatch) -> tuple[int, int, bytes]:
        span = pc.min_max(rows.column(0)).as_py()
        return span["min"], span["max"], rows.serialize().to_pybytes()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = [self._chunk(pa.RecordBatch.from_pandas(b[self.schema.names], schema=self.schema, preserve_index=False)) for b in rows if len(b)]
        if chunks:
            self.waiting.appendList(chunks)
            first, known = min(c[0] for c in chunks), self.wake.get()
            if known is None or first // 1000 + 1 < known[0]:
                if known is not None:
                    self.handle.deleteTimer(known[0])
                self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for low, high, data in self.waiting.get():
            if low > watermark:
                rest.append((low, high, data))
                continue
            rows = pa.ipc.read_record_batch(pa.py_buffer(data), self.schema)
            if high > watermark:
                ready = pc.less_equal(rows.column(0), watermark)
                rest.append(self._chunk(rows.filter(pc.invert(ready))))
                rows = rows.filter(ready)
            due.append(rows)
        out, again = self.due(key, pa.Table.from_batches(due, self.schema), watermark)
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        wakes = [c[0] for c in rest] + ([] if again is None else [again])
        if wakes:
            self._wake_at(max(min(wakes), watermark))
        else:
            self.wake.clear()
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


_TEXT = T.StringType()
_ASOF_ROWS = pa.schema([("ts_us", pa.int64()), ("side", pa.int64()), ("tie", pa.int64()), ("key", pa.string()), ("body", pa.string())])
_ASOF_OUT = T.StructType([T.StructField("key", _TEXT), T.StructField("body", _TEXT), T.StructField("value", _TEXT)])
_VALUES = T.StructType([T.StructField("keys", T.ArrayType(_TEXT)), T.StructField("bodies", T.ArrayType(_TEXT))])


class _AsOf(Ordered):
    """The value that is valid now is all that is kept of a key's past; values to come wait with the rows that ask."""

    def __init__(self) -> None:
        super().__init__(_ASOF_ROWS)

    def opened(self, handle):
        self.values = handle.getValueState("values", _VALUES)

    def due(self, key, rows, watermark_us):
        if not rows.num_rows:
            return None, None
        state = self.values.get()
        held = dict(zip(*state, strict=True)) if state is not None else {}
        ts, side, names, bodies = (rows[c].to_numpy() for c in ("ts_us", "side", "key", "body"))
        tie = rows["tie"].combine_chunks().fill_null(0).to_numpy()
        code, known = pd.factorize(names, use_na_sentinel=False)
        order = np.lexsort((tie, side, ts, code))
        code, side, names, bodies = code[order], side[order], names[order], bodies[order]
        at = np.arange(len(code))
        first = np.maximum.accumulate(np.where(np.diff(code, prepend=-1) != 0, at, 0))
        told = np.maximum.accumulate(np.where(side == 0, at, -1))
        asks = np.flatnonzero(side == 1)
        before = np.array([held.get(k) if isinstance(k, str) else held.get(None) for k in known], dtype=object)
        value = np.where(told[asks] >= first[asks], bodies[told[asks]], before[code[asks]])
        ends = np.flatnonzero(np.diff(code, append=-1))
        changed = {names[i]: bodies[told[i]] for i in ends[told[ends] >= first[ends]].tolist() if bodies[told[i]] != before[code[i]]}
        if changed:
            held |= changed
            self.values.update((list(held), list(held.values())))
        return pd.DataFrame({"key": names[asks], "body": bodies[asks], "value": value}, columns=_ASOF_OUT.names), None


def asof(left: DataFrame, right: DataFrame, by: str, tie: str, values: Sequence[str], delay: str, valid: Column | None = None, groups: int = GROUPS) -> DataFrame:
    """Stream form of ``timeline.asof_latest``: each left row with the ``values`` of the latest right row at or before its time.

    Both are streams with ``by`` and ``ts_us``; of right rows of one time the one with the largest ``tie`` counts. A row is given
    out once both streams' watermarks have passed it. Right rows that are not ``valid`` only move the watermark; a
    filter in front of it would hold time back while nothing valid comes. ``groups`` has to stay the same for a checkpoint.
    """
    taken = [c for c in left.columns if c != by]

    def rows(df: DataFrame, side: Column, key: Column, tied: Column, columns: Sequence[str]) -> DataFrame:
        body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        timed = with_event_time(df, delay)
        return timed.select(key.alias("key"), "ts", "ts_us", side.cast("bigint").alias("side"), tied.cast("bigint").alias("tie"), body.alias("body"))

    valid = F.lit(True) if valid is None else valid
    told = rows(right, F.when(valid, 0).otherwise(2), F.when(valid, F.col(by)), F.col(tie), values)
    both = told.unionByName(rows(left, F.lit(1), F.col(by), F.lit(0), taken))
    found = in_groups(both, "key", groups).transformWithStateInPandas(_AsOf(), _ASOF_OUT, "append", "EventTime")
    asked = F.from_json("body", T.StructType([left.schema[c] for c in taken]))
    value = F.from_json("value", T.StructType([right.schema[c] for c in values]))
    return found.select(F.col("key").alias(by), asked.alias("_l"), value.alias("_v")).select(by, "_l.*", "_v.*").select(*left.columns, *values)


_CACHE_ROWS = pa.schema([("ts_us", pa.int64()), ("id", pa.int64()), ("name", pa.string())])
_CACHE_OUT = T.StructType(
    [T.StructField("cache", _TEXT), T.StructField("step", T.LongType()), T.StructField("op", _TEXT), T.StructField("name", _TEXT), T.StructField("ts_us", T.LongType())]
)


class _Cache(Ordered):
    def __init__(self, most: int, evict: int) -> None:
        super().__init__(_CACHE_ROWS)
        self.most, self.evict = most, evict

    def opened(self, handle):
        # at most ``most`` names, in the order in which they came in
        self.names = handle.getValueState("names", T.StructType([T.StructField("step", T.LongType()), T.StructField("names", T.ArrayType(_TEXT))]))

    def due(self, key, rows, watermark_us):
        held = self.names.get()
        step, names = (held[0], dict.fromkeys(held[1])) if held is not None else (0, {})
        out = []
        rows = rows.sort_by([("ts_us", "ascending"), ("id", "ascending")])
        for ts, name in zip(rows["ts_us"].to_pylist(), rows["name"].to_pylist(), strict=True):
            step += 1
            if len(names) >= self.most:
                for old in list(names)[: self.evict]:
                    del names[old]
                    out.append((key[0], step, "evict", old, ts))
            if name not in names:
                names[name] = None
                out.append((key[0], step, "put", name, ts))
        if rows.num_rows:
            self.names.update((step, list(names)))
        return pd.DataFrame(out, columns=_CACHE_OUT.names), None


def bounded_cache(rows: DataFrame, most: int, evict: int, delay: str) -> DataFrame:
    """A cache of names with an eviction order, as a stream of what enters and leaves it.

    rows: ``cache`` (its name; each is replayed on its own), ``ts_us``, ``id`` and ``name``. Whenever a row meets a cache of ``most`` names, the
    ``evict`` that came in first go, whether or not its own name is among them; a name that is there keeps its place.
    ``step`` counts the rows of a cache.
    """
    timed = with_event_time(rows, delay).select("cache", "ts", "ts_us", "id", "name")
    return timed.groupBy("cache").transformWithStateInPandas(_Cache(most, evict), _CACHE_OUT, "append", "EventTime")


_SILENCE_ROWS = T.StructType([T.StructField("since_us", T.LongType()), T.StructField("at_ms", T.LongType())])
_SILENCE_OUT = T.StructType([T.StructField("key", _TEXT), T.StructField("window_us", T.LongType()), T.StructField("packets", T.LongType())])


class _Silence(StatefulProcessor):
    """Per key the first window that is not reported yet; a timer at its end reports it if no count has come."""

    def __init__(self, width_us: int) -> None:
        self.width = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _SILENCE_ROWS)

    def _expect(self, since_us: int, known_ms: int | None) -> None:
        # counts of a window come with the watermark that ends it; silence is certain one window later
        at = (since_us + 2 * self.width) // 1000
        if at != known_ms:
            if known_ms is not None:
                self.handle.deleteTimer(known_ms)
            self.handle.registerTimer(at)
        self.state.update((since_us, at))

    def _zeros(self, key: tuple, first_us: int, end_us: int) -> list[tuple]:
        return [(key[0], w, 0) for w in range(first_us, end_us, self.width)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for batch in rows:
            for window, n in zip(batch["window_us"].tolist(), batch["packets"].tolist(), strict=True):
                counts[window] = counts.get(window, 0) + n
        held = self.state.get()
        since, known = (held[0], held[1]) if held is not None else (min(counts), None)
        newest = max(counts)
        out = [(key[0], w, n) for w, n in counts.items()]
        out += [z for z in self._zeros(key, since, newest) if z[1] not in counts]
        self._expect(max(since, newest + self.width), known)
        yield pd.DataFrame(out, columns=_SILENCE_OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        since = self.state.get()[0]
        end = max(since + self.width, (watermark - self.width) // self.width * self.width)
        self._expect(end, None)
        yield pd.DataFrame(self._zeros(key, since, end), columns=_SILENCE_OUT.names)

    def close(self) -> None:
        pass


def with_silence(counts: DataFrame, by: str, width_us: int) -> DataFrame:
    """Windows without packets as rows of 0, found by timers; counts: ``by``, ``w`` (a window), ``packets``, as a windowed aggregation gives them.

    Event time has to go on when every key is silent: rows without key are a clock and give no result. They must not
    be filtered out before, as Spark would do that in front of the watermark.
    """
    rows = counts.select(F.col(by).alias("key"), F.window_time("w").alias("ts"), F.unix_micros("w.start").alias("window_us"), "packets")
    found = rows.groupBy("key").transformWithStateInPandas(_Silence(width_us), _SILENCE_OUT, "append", "EventTime")
    return found.where("key IS NOT NULL").withColumnRenamed("key", by)
