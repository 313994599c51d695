"""Stateful operators on streams of one row per event or frame, keyed by sequence.

The state of a sequence is small and does not grow with its length: queue fronts, the last
keyframe, ages, window members.  It is kept in typed columns, a value, list or map each, and only
what a micro-batch changed is written.  A micro-batch brings a sequence's rows in any order;
they are sorted by ``order`` first, so trigger limits (files per trigger) bound what one task
holds.  A row that is not later than one already processed stops its sequence: late data is
an error, not something to wait for (:mod:`replay` restores order).  Each row that is not taken
comes out with its place and a ``fault``: ``late``, or ``stopped`` after a late one.  A row that ends
the sequence is taken all the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from posequery.streaming.rules import (
    AgeHandler,
    EvictableHandler,
    Handler,
    KeyframeHandler,
    KeyframeRule,
    SeedHandler,
    SkipDropHandler,
    SyncHandler,
    WindowHandler,
)

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed_state(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB, which typed state needs."""
    spark.conf.set(_PROVIDER, _ROCKS)


class _Sequence(StatefulProcessor):
    """One handler per key over rows in order."""

    def __init__(self, make: Callable[[], Handler], names: list[str], order: str, packed: bool = False) -> None:
        self.make, self.names, self.order, self.packed = make, names, order, packed

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"value": handle.getValueState, "list": handle.getListState, "map": handle.getMapState}
        self.place = handle.getValueState("place", "last long, stopped boolean")
        self.held = {name: (kind, kinds[kind](name, *columns)) for name, (kind, *columns) in self.make().state.items()}

    def _read(self) -> dict:
        out = {}
        for name, (kind, held) in self.held.items():
            if kind == "value":
                out[name] = tuple(held.get()) if held.exists() else None
            elif kind == "list":
                out[name] = [tuple(row) for row in held.get()] if held.exists() else []
            else:
                out[name] = {tuple(key): tuple(value) for key, value in held.iterator()} if held.exists() else {}
        return out

    def _write(self, before: dict, after: dict) -> None:
        for name, (kind, held) in self.held.items():
            old, new = before[name], after[name]
            if old == new:
                continue
            if kind == "value":
                held.update(new)
            elif kind == "list":
                held.put(new) if new else held.clear()
            else:
                for key in old.keys() - new.keys():
                    held.removeKey(key)
                for key, value in new.items():
                    if old.get(key) != value:
                        held.updateValue(key, value)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        handler = self.make()
        for row in initialState.itertuples(index=False):
            handler.begin(row)
            self.place.update((int(row.last), False))
        self._write(self._read(), handler.dump())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        handler, before = self.make(), self._read()
        handler.load(before)
        last, stopped = self.place.get() if self.place.exists() else (None, False)
        batch = pd.concat(list(rows), ignore_index=True)
        lists = {}
        if self.packed and len(batch):
            batch, lists = _unpacked(batch)
        batch = batch.sort_values(self.order, kind="stable")
        blank, out, at_once = [None] * (len(self.names) - 3), [], {}
        places = batch[self.order].to_numpy()
        if len(places) and not stopped and (last is None or places[0] > last) and (places[1:] > places[:-1]).all():
            taken, at_once = handler.take(batch, lists)
            if taken:
                last, batch = int(places[taken - 1]), batch.iloc[taken:]
        for name, values in lists.items():
            held = [values[at : at + n] for at, n in zip(batch[f"{name}_at"], batch[f"{name}_n"])]
            batch = batch.assign(**{name: pd.Series(held, batch.index, object)})
        for row in batch.itertuples(index=False):
            place = int(getattr(row, self.order))
            late = last is not None and place <= last
            if (late or stopped) and not handler.ends(row):
                stopped = True
                handler.stop("late")
                out.append((key[0], *blank, "late" if late else "stopped", place))
                continue
            last = place if last is None else max(last, place)
            out += [(key[0], *values, None, None) for values in handler.feed(row)]
        self.place.update((last, stopped))
        self._write(before, handler.dump())
        if at_once:
            found = pd.DataFrame({"seq": key[0], **at_once})
            rest = [name for name in self.names if name not in found]
            none = pd.Series([None] * len(found), dtype=object)
            yield found.assign(**dict.fromkeys(rest, none))[self.names]
        # Object columns keep 64-bit stamps exact beside nulls.
        yield pd.DataFrame(out, columns=self.names, dtype=object)


def _packed(stream: DataFrame) -> DataFrame:
    """A row per ``seq`` and Arrow batch, other columns as arrays: Spark hands rows to a state handler one by one.

    A column of lists becomes one array of all their values and one, ``<name>_n``, of their lengths; null lists come as empty ones.
    """
    rest = [f for f in stream.schema if f.name != "seq"]
    fields = [stream.schema["seq"]]
    for f in rest:
        fields.append(StructField(f.name, f.dataType if isinstance(f.dataType, ArrayType) else ArrayType(f.dataType)))
        if isinstance(f.dataType, ArrayType):
            fields.append(StructField(f"{f.name}_n", ArrayType(LongType())))
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("seq").dictionary_encode(null_encoding="encode")
            codes = found.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(found.dictionary) + 1))
            columns = [found.dictionary]
            for f in rest:
                values = batch.column(f.name).take(pa.array(order))
                if not isinstance(f.dataType, ArrayType):
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values))
                    continue
                lengths = pc.fill_null(pc.list_value_length(values), 0).cast(pa.int64())
                ends = np.concatenate([[0], np.cumsum(lengths.to_numpy())])
                columns.append(pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), values.flatten()))
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lengths))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return stream.mapInArrow(run, schema)


def _unpacked(rows: pd.DataFrame) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """The rows that :func:`_packed` put together; of a column of lists their values, and ``<name>_at`` and ``<name>_n`` in the rows."""
    joined = {c: np.concatenate(rows[c].tolist()) for c in rows.columns if c != "seq"}
    lists = {c: joined.pop(c) for c in list(joined) if f"{c}_n" in joined}
    batch = pd.DataFrame(joined)
    for c in lists:
        batch[f"{c}_at"] = batch[f"{c}_n"].cumsum() - batch[f"{c}_n"]
    return batch, lists


def per_sequence(
    stream: DataFrame, make: Callable[[], Handler], output: str, order: str, initial: DataFrame | None = None, packed: bool = False
) -> DataFrame:
    """Run one handler per ``seq`` over rows in ``order``; works on streams.

    To the handler's ``output`` come ``fault`` and ``fault_place``, null beside its own rows.  ``initial``
    holds a row for each sequence that a batch run has begun: ``seq``, the ``last`` place, and
    what the handler's ``begin`` takes.  ``packed`` is for plain columns, lists of them and handlers that take rows at once.
    """
    typed_state(stream.sparkSession)
    output += ", fault string, fault_place long"
    processor = _Sequence(make, StructType.fromDDL(output).names, order, packed)
    start = None if initial is None else initial.groupBy("seq")
    return (_packed(stream) if packed else stream).groupBy("seq").transformWithStateInPandas(processor, output, "Append", "none", start)


def stereo_sync(
    events: DataFrame, tolerance_ns: int = 0, max_queue: int | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """Pairs, faults and final reports of ``seq, camera, ts_ns, arrival`` events.

    ``camera`` is ``left``, ``right`` or ``end``; ``arrival`` is the order of the pushes.  A stream that
    goes on from a batch run takes its ``initial`` from ``timejoin.sync_state``.
    """
    SyncHandler(tolerance_ns, max_queue)  # rejects bad options before the stream starts
    return per_sequence(
        events, lambda: SyncHandler(tolerance_ns, max_queue), SyncHandler.output, "arrival", initial, packed=True
    )


def keyframe_select(frames: DataFrame, rule: KeyframeRule) -> DataFrame:
    """Keyframe decision of every frame.

    Rows hold ``seq, frame, ts_ns, accepted, own_rotation, ids, us, vs``.
    """
    return per_sequence(frames, lambda: KeyframeHandler(rule), KeyframeHandler.output, "ts_ns")


def zombie_age(frames: DataFrame, max_age: int = 5) -> DataFrame:
    """Ages of marked ids; rows hold ``seq, frame, ids, marks``."""
    return per_sequence(frames, lambda: AgeHandler(max_age), AgeHandler.output, "frame")


def window_eviction(
    frames: DataFrame, max_frames: int = 10, max_keyframes: int = 7
) -> DataFrame:
    """Window members after each accepted frame."""
    return per_sequence(
        frames, lambda: WindowHandler(max_frames, max_keyframes), WindowHandler.output, "frame"
    )


def skip_drop(frames: DataFrame, min_culled: int = 4, defer_topk: int = 0) -> DataFrame:
    """Actions on culled ids, with the flush of deferred ones at the next frame; rows hold ``seq, frame, culled``."""
    rows = frames.select("seq", "frame", "culled")
    return per_sequence(rows, lambda: SkipDropHandler(min_culled, defer_topk), SkipDropHandler.output, "frame", packed=True)


def evictable(frames: DataFrame, min_culled: int = 4) -> DataFrame:
    """Tracks that may be evicted in each frame; rows hold ``seq, frame, ids, culled``."""
    rows = frames.select("seq", "frame", "ids", "culled")
    return per_sequence(rows, lambda: EvictableHandler(min_culled), EvictableHandler.output, "frame", packed=True)


def accumulate_seed(frames: DataFrame, min_ids: int = 10) -> DataFrame:
    """Seed observations; rows hold ``seq, frame, ids, us, disparities``."""
    return per_sequence(frames, lambda: SeedHandler(min_ids), SeedHandler.output, "frame")


def running_counts(frames: DataFrame) -> DataFrame:
    """Frame counters kept live; run with output mode ``update`` or ``complete``."""
    return frames.groupBy("run", "seq").agg(
        F.count(F.lit(1)).alias("image_frames"),
        *[
            F.count_if(F.col("status") == s).alias(s) for s in ("ok", "rejected", "failed")
        ],
        F.count_if("low_connectivity").alias("low_connectivity"),
        F.count_if("is_keyframe").alias("total_keyframes"),
        F.sum("outliers_culled").cast("long").alias("outliers_culled"),
    )


class _LiveCounters(StatefulProcessor):
    """Counters of a run and sequence that need a memory of ids and of the last good segment."""

    NAMES = ("image_frames", "outliers_culled_unique", "outlier_reopts", "pnp_fallbacks")

    def __init__(self, pnp_init: bool) -> None:
        self.pnp_init = pnp_init

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.culled = handle.getMapState("culled", "id long", "frame long")
        self.at = handle.getValueState("at", "segment long, frames long, unique long, reopts long, fallbacks long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        segment, *counts = self.at.get() if self.at.exists() else (None, 0, 0, 0, 0)
        batch = pd.concat(list(rows), ignore_index=True).sort_values("frame", kind="stable")
        for row in batch.itertuples(index=False):
            counts[0] += 1
            for i in [] if row.culled is None else row.culled:
                if not self.culled.containsKey((int(i),)):
                    self.culled.updateValue((int(i),), (int(row.frame),))
                    counts[1] += 1
            counts[2] += int(row.outlier_reopt_rounds or 0)
            if row.status == "ok":
                grew = segment is not None and row.segment_id > segment
                counts[3] += bool(self.pnp_init and row.num_shared > 0 and not row.pnp_success and not grew)
                segment = int(row.segment_id)
        self.at.update((segment, *counts))
        yield pd.DataFrame([(*key, *counts)], columns=["run", "seq", *self.NAMES])


def live_counters(frames: DataFrame, pnp_init: bool = True) -> DataFrame:
    """``run, seq, image_frames, outliers_culled_unique, outlier_reopts, pnp_fallbacks`` after each trigger.

    The twin of ``ledger.frame_counts`` for what a plain running sum cannot count: an id counts when a
    run culls it first, a fallback unless its segment is new.  Rows hold ``run, seq, frame, status,
    segment_id, num_shared, pnp_success, culled, outlier_reopt_rounds``; the row with most
    ``image_frames`` is the latest.
    """
    typed_state(frames.sparkSession)
    output = "run string, seq long, " + ", ".join(f"{n} long" for n in _LiveCounters.NAMES)
    return frames.groupBy("run", "seq").transformWithStateInPandas(_LiveCounters(pnp_init), output, "Append", "none")


def first_warnings(frames: DataFrame) -> DataFrame:
    """Each kind of warning of a sequence once, whenever it first appears."""
    warned = frames.where(F.length("message") > 0)
    return warned.select("run", "seq", "message").dropDuplicates(["run", "seq", "message"])


def stream_associate(
    est: DataFrame, gt: DataFrame, max_dt_ns: int, lateness: str = "10 seconds"
) -> DataFrame:
    """Nearest ground truth of each estimate row on live streams; ties go to the earlier one.

    Both sides need watermarks, so the interval join can forget rows that no later row can
    match.  Stamps are compared in nanoseconds; the event times only bound the state.
    """

    def timed(df: DataFrame, name: str) -> DataFrame:
        micros = F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000)))
        return df.withColumn(name, micros).withWatermark(name, lateness)

    # A bucket of twice the tolerance in the key keeps the state of a join key to a few
    # rows however dense or long a sequence is; estimates look into the bucket on either side.
    width = 2 * max_dt_ns + 1

    def bucket(stamp: Column) -> Column:
        return stamp - F.pmod(stamp, F.lit(width))

    stamp = F.col("ts_ns")
    near_buckets = F.array_distinct(F.array(bucket(stamp - max_dt_ns), bucket(stamp + max_dt_ns)))
    left = timed(
        est.select("run", "seq", "ts_ns", F.explode(near_buckets).alias("bucket")), "est_time"
    ).alias("e")
    right = timed(gt.select("seq", "ts_ns", bucket(stamp).alias("bucket")), "gt_time").alias("g")
    slack = F.make_dt_interval(secs=F.lit((max_dt_ns // 1000 + 2) / 1e6))
    close = (
        (F.col("e.seq") == F.col("g.seq"))
        & (F.col("e.bucket") == F.col("g.bucket"))
        & (F.col("g.gt_time") >= F.col("e.est_time") - slack)
        & (F.col("g.gt_time") <= F.col("e.est_time") + slack)
        & (F.abs(F.col("e.ts_ns") - F.col("g.ts_ns")) <= max_dt_ns)
    )
    gap = F.abs(F.col("e.ts_ns") - F.col("g.ts_ns"))
    near = left.join(right, close).select(
        "e.run", "e.seq", "e.ts_ns", "e.est_time", F.struct(gap.alias("gap"), F.col("g.ts_ns").alias("gt_ts_ns")).alias("c")
    )
    return (
        near.groupBy("run", "seq", "ts_ns", "est_time")
        .agg(F.min("c").alias("c"))
        .select("run", "seq", "ts_ns", "c.gt_ts_ns")
    )
