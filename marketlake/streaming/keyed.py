"""Operators with state per key: change-only snapshots and trading halts.

Snapshots wait in a reorder buffer until the watermark has passed them; polls of a micro-batch
reach the state in (time, sequence) order. A micro-batch is bounded by the source's file limit.

Keys share ``GROUPS`` state groups by their hash. A group keeps the states of its keys as one
table and works on the rows of all of them at once, so the calls to the state store depend on the
number of groups and micro-batches, not on rows or keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .run import WATERMARK_SECONDS, use_rocksdb


# The state classes travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: State groups of a stream; a group's table of key states is read and written whole.
GROUPS = 512
_GROUP = "__group"

_LONG_AGO = -1 << 62


def _grouped(df: DataFrame, keys: list[str], groups: int) -> DataFrame:
    return df.withColumn(_GROUP, F.pmod(F.xxhash64(*keys), F.lit(groups)))


class _Table:
    """A table in a group's state, as one Arrow stream."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema) -> None:
        self.state, self.schema = handle.getValueState(name, "rows binary"), schema

    def get(self) -> pd.DataFrame:
        if not self.state.exists():
            return self.frame(self.schema.empty_table().to_pandas())
        with pa.ipc.open_stream(bytes(self.state.get()[0])) as reader:
            return reader.read_all().to_pandas(integer_object_nulls=True)

    def frame(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[self.schema.names].astype(object)

    def put(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.state.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as writer:
            writer.write_table(pa.Table.from_pandas(rows[self.schema.names], self.schema, preserve_index=False))
        self.state.update((sink.getvalue().to_pybytes(),))


def _codes(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """A number for each distinct key; NULL is a key."""
    return rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()


def _longs(column: pd.Series) -> np.ndarray:
    return pd.array(column, dtype="Int64").fillna(_LONG_AGO).to_numpy("int64")


class _ChangeOnly(StatefulProcessor):
    """A reorder buffer and the last values of a group's keys.

    Rows wait in the buffer; a timer for the earliest waiting second fires once the watermark
    has passed it, and all rows the watermark has passed then leave in order.
    """

    def __init__(self, keys: list[str], order: list[str], value: str, schema: pa.Schema) -> None:
        self.keys, self.order, self.value, self.schema = keys, order, value, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [*[self.schema.field(k) for k in self.keys], pa.field("value", self.schema.field(self.value).type), pa.field("newest", pa.int64())]
        self.last = _Table(handle, "last", pa.schema(fields))
        self.waiting = _Table(handle, "waiting", self.schema)
        self.timer = handle.getValueState("timer", "at bigint")

    def _released(self, last: pd.DataFrame, rows: pd.DataFrame, watermark: int) -> np.ndarray:
        """Up to when the rows' keys have been released."""
        code = _codes(pd.concat([last[self.keys], rows[self.keys].astype(object)], ignore_index=True), self.keys)
        newest = np.full(code.max() + 1, _LONG_AGO)
        newest[code[: len(last)]] = _longs(last["newest"])
        return np.maximum(newest[code[len(last):]], watermark)

    def _wake(self, waiting: pd.DataFrame) -> None:
        """One timer, at the earliest waiting second."""
        old = self.timer.get()[0] if self.timer.exists() else None
        at = int(waiting[self.order[0]].min() // 1_000_000 + 1) * 1_000 if len(waiting) else None
        if at == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.timer.clear()
        else:
            self.timer.update((at,))
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, last, waiting = timerValues.getCurrentWatermarkInMs() * 1_000, self.last.get(), [self.waiting.get()]
        for batch in rows:
            late = _longs(batch[self.order[0]]) <= self._released(last, batch, watermark)  # without a time: late
            if late.any():
                yield batch.loc[late, self.schema.names].assign(late=True)
            on_time = self.waiting.frame(batch[~late])
            waiting.append(on_time.where(on_time.notna(), None))
        kept = pd.concat(waiting, ignore_index=True).drop_duplicates([*self.keys, *self.order], keep="last")
        self.waiting.put(kept)
        self._wake(kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.timer.exists() and self.timer.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.timer.clear()
        waiting, last = self.waiting.get(), self.last.get()
        time = _longs(waiting[self.order[0]])
        passed = time <= timerValues.getCurrentWatermarkInMs() * 1_000
        if passed.any():
            ready = waiting[passed].reset_index(drop=True)
            place = [ready[c].infer_objects() for c in self.order]
            # The last values come before the rows of their keys.
            rows = pd.concat([last[[*self.keys, "value", "newest"]],
                              ready[self.keys].assign(value=ready[self.value], newest=ready[self.order[0]])], ignore_index=True)
            order = pd.concat([pd.DataFrame({"code": _codes(rows, self.keys), "row": np.arange(len(rows)) - len(last)}),
                               pd.DataFrame(dict(enumerate(place))).set_axis(range(len(last), len(rows)))], axis=1)
            order["new"] = order["row"] >= 0
            order = order.sort_values(["code", "new", *range(len(place))], kind="stable")
            code, row = order["code"].to_numpy(), order["row"].to_numpy()
            value = rows["value"].iloc[order.index].reset_index(drop=True)
            before = value.shift(1)
            same = np.r_[False, code[1:] == code[:-1]]
            changed = ~(same & ((value == before) | (value.isna() & before.isna())).to_numpy())
            end = np.r_[code[1:] != code[:-1], True]
            self.last.put(rows.iloc[order.index[end]])
            waiting = waiting[~passed]
            self.waiting.put(waiting)
            yield ready.iloc[row[changed & (row >= 0)]].assign(late=False)
        self._wake(waiting)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = pd.concat([self.last.get(), self.last.frame(initialState)], ignore_index=True)
        self.last.put(rows.where(rows.notna(), None).drop_duplicates(self.keys, keep="last"))

    def close(self) -> None:
        pass


def stream_change_only(books: DataFrame, keys: list[str], order: list[str], value: str,
                       seed: DataFrame | None = None, hold_seconds: int = WATERMARK_SECONDS, groups: int = GROUPS) -> DataFrame:
    """Stream rows whose text value differs from the previous one of their key, in event-time order.

    ``order[0]`` is the capture time in microseconds, the others order rows of one time. Rows wait
    until the watermark, ``hold_seconds`` behind the newest row of the stream, has passed them,
    so rows that arrive out of order inside that span are compared in order. Older ones come
    out at once with ``late = true``, so that they can be counted, as do rows not newer than the
    ``seed`` (keys, ``value``, ``newest`` time or NULL), which starts from what is already stored.
    A row of the same order values replaces a waiting one, so a repeated row counts once. The
    last ``hold_seconds`` of a stream stay in the buffer until newer rows come.
    """
    use_rocksdb(books.sparkSession)
    out = T.StructType([*books.schema.fields, T.StructField("late", T.BooleanType())])
    # The watermark's own column is left out again: Spark would drop late rows by it instead of reporting them.
    timed = books.withColumn("__at", F.timestamp_micros(order[0])).withWatermark("__at", f"{hold_seconds} seconds")
    initial = _grouped(seed.select(*keys, "value", "newest"), keys, groups).groupBy(_GROUP) if seed is not None else None
    return _grouped(timed.select(*books.columns), keys, groups).groupBy(_GROUP).transformWithStateInPandas(
        statefulProcessor=_ChangeOnly(keys, order, value, to_arrow_schema(books.schema)), outputStructType=out, outputMode="Append",
        timeMode="EventTime", initialState=initial)


class _Halts(StatefulProcessor):
    """Open start, newest poll and its sequence of a group's keys."""

    def __init__(self, keys: list[str], time: str, active: str, seq: str | None, schema: pa.Schema) -> None:
        self.keys, self.time, self.active, self.seq, self.schema = keys, time, active, seq, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [*[self.schema.field(k) for k in self.keys], *[pa.field(c, pa.int64()) for c in ("start", "newest", "seq")]]
        self.last = _Table(handle, "last", pa.schema(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, batch = self.last.get(), pd.concat(list(rows), ignore_index=True)
        n = len(last)
        both = pd.concat([last[self.keys], batch[self.keys].astype(object)], ignore_index=True)
        code = _codes(both, self.keys)
        old, code = code[:n], code[n:]
        size = int(max(old.max(initial=-1), code.max(initial=-1))) + 1
        # By key: the start of an open halt, the newest poll and its sequence, and a row of the key's columns.
        start, newest, seq, at = (np.full(size, _LONG_AGO) for _ in range(4))
        start[old], newest[old], seq[old] = (_longs(last[c]) for c in ("start", "newest", "seq"))
        at[code], at[old] = n + np.arange(len(code)), np.arange(n)
        time = batch[self.time].to_numpy("int64")
        number = batch[self.seq].to_numpy("int64") if self.seq else np.zeros(len(batch), np.int64)
        late = time < newest[code]
        if self.seq:
            late |= (time == newest[code]) & (number <= seq[code])
        on_time = np.flatnonzero(~late)
        on_time = on_time[np.lexsort((number[on_time], time[on_time], code[on_time]))]
        c, when, active = code[on_time], time[on_time], batch[self.active].to_numpy(bool)[on_time]
        first, end = np.r_[True, c[1:] != c[:-1]][: len(c)], np.r_[c[1:] != c[:-1], True][: len(c)]
        # Before its first poll a key counts as active.
        before = np.where(first, start[c] == _LONG_AGO, np.r_[True, active[:-1]][: len(c)])
        turned = active != before
        who, turn, to = c[turned], when[turned], active[turned]
        # Turns of a key alternate, so each opening is closed by the turn after it.
        follows = np.r_[who[1:] == who[:-1], False][: len(who)]
        closed = np.where(follows, np.r_[turn[1:], 0][: len(who)], _LONG_AGO)
        ends_open = to & ~np.r_[False, who[1:] == who[:-1]][: len(who)]
        key_at = np.concatenate([at[code[late]], at[who[~to]], at[who[ends_open]]])
        begun = np.concatenate([time[late], turn[~to], start[who[ends_open]]])
        ended = np.concatenate([np.full(late.sum(), _LONG_AGO), closed[~to], turn[ends_open]])
        out = both.iloc[key_at].reset_index(drop=True)
        out["start_ts"] = begun
        out["end_ts"] = pd.array(ended, dtype="Int64")
        out.loc[ended == _LONG_AGO, "end_ts"] = pd.NA
        out["late"] = np.arange(len(out)) < late.sum()
        start[who[~follows]] = np.where(to, _LONG_AGO, turn)[~follows]
        newest[c[end]], seq[c[end]] = when[end], number[on_time][end]
        state = both.iloc[at].reset_index(drop=True)
        for name, values in (("start", start), ("newest", newest), ("seq", seq)):
            state[name] = [None if v == _LONG_AGO else v for v in values.tolist()]
        self.last.put(state)
        yield out[[*self.keys, "start_ts", "end_ts", "late"]]

    def close(self) -> None:
        pass


def stream_halts(polls: DataFrame, keys: list[str], time: str, active: str, seq: str | None = None, groups: int = GROUPS) -> DataFrame:
    """Stream of halt events: (start, NULL) for one still open, (start, end) once it closes.

    Failed (NULL) polls are dropped first. ``seq`` orders polls of one time. A poll that is not
    newer than the last one seen of its key changes nothing; it comes out as (time, NULL) with
    ``late = true``. :func:`halt_table` folds the events.
    """
    use_rocksdb(polls.sparkSession)
    known = polls.filter(F.col(active).isNotNull()).select(*keys, time, active, *([seq] if seq else []))
    out = T.StructType([*[polls.schema[k] for k in keys], T.StructField("start_ts", T.LongType()),
                        T.StructField("end_ts", T.LongType()), T.StructField("late", T.BooleanType())])
    return _grouped(known, keys, groups).groupBy(_GROUP).transformWithStateInPandas(
        statefulProcessor=_Halts(keys, time, active, seq, to_arrow_schema(known.schema)), outputStructType=out, outputMode="Append",
        timeMode="None")


def halt_table(events: DataFrame, keys: list[str]) -> DataFrame:
    """Halts from their events: the end where it is known, else NULL; late polls are no halts."""
    return events.filter(~F.col("late")).groupBy(*keys, "start_ts").agg(F.max("end_ts").alias("end_ts"))
