"""Putting the events of a recording's sensors back in order while they arrive.

Rows come in any order, up to ``lateness`` behind the latest.  Each sequence keeps what has arrived in
a typed list and lets go, with each trigger and by event-time timers, of everything that no later row can precede: by
stamp, and at equal stamps inertial first, then left, then right.  A row of kind ``end`` closes
its sequence cleanly; one of kind ``error`` says that its sensor could not be read at that place.
Either is the last row of a sequence that counts, and they stay apart: what comes after is
answered with which of them it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from posequery.streaming.stateful import typed_state

#: Order of kinds at equal stamps.
RANKS = {"imu": 0, "left": 1, "right": 2, "end": 3}
OUTPUT = "seq long, position long, ts_ns long, kind string, sensor string, state string, cause string"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_WAITING = ["ts_ns", "rank", "kind", "sensor", "cause"]


def replay_events(imu: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One stream of typed events from three sensor streams (``seq, ts_ns``), for :func:`ordered_replay`."""

    def tag(df: DataFrame, kind: str) -> DataFrame:
        return df.select("seq", "ts_ns", F.lit(kind).alias("kind"), F.lit(kind).alias("sensor"), F.lit(None).cast("string").alias("cause"))

    return tag(imu, "imu").unionByName(tag(left, "left")).unionByName(tag(right, "right"))


class _Replay(StatefulProcessor):
    """The reorder buffer of a sequence."""

    def __init__(self, lateness_ms: int) -> None:
        self.lateness_ms = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_ns long, rank int, kind string, sensor string, cause string")
        self.at = handle.getValueState("at", "position long, ts_ns long, rank int, closed string")

    def _place(self) -> tuple:
        return tuple(self.at.get()) if self.at.exists() else (0, None, None, None)

    def _let_go(self, seq: int, held: pd.DataFrame, upto_ns: int | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What of ``held`` comes out before ``upto_ns``, all of it for None, and what still waits."""
        position, last_ns, last_rank, closed = self._place()
        held = held.sort_values(["ts_ns", "rank"], kind="stable", ignore_index=True)
        n = len(held) if upto_ns is None else int(held["ts_ns"].searchsorted(upto_ns))
        stops = held["kind"].isin(("end", "error")).to_numpy()
        first = 0 if closed else int(stops[:n].argmax()) + 1 if stops[:n].any() else None
        if first is not None:  # the sequence closes, so all that waits is answered
            n = len(held)
        kept = n if first is None else first
        out = held.iloc[:n].assign(seq=seq, position=None, state="event")
        out["position"] = pd.Series([*range(position, position + kept), *[None] * (n - kept)], dtype=object, index=out.index)
        if first is not None:
            if first:
                closed = held["kind"].iat[first - 1]
                out.iloc[first - 1, out.columns.get_loc("state")] = closed
            out.iloc[first:, out.columns.get_loc("state")] = f"after {closed}"
        if kept:
            last_ns, last_rank = int(held["ts_ns"].iat[kept - 1]), int(held["rank"].iat[kept - 1])
        self.at.update((position + kept, last_ns, last_rank, closed))
        return out[_NAMES], held.iloc[n:]

    def _held(self) -> pd.DataFrame:
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        return pd.DataFrame(rows, columns=_WAITING).astype({"ts_ns": "int64", "rank": "int64"})

    def _keep(self, rest: pd.DataFrame) -> None:
        """Let ``rest``, in order, wait in place of what waited before."""
        if len(rest):
            self.waiting.put(list(rest[_WAITING].itertuples(index=False, name=None)))
            self._wake(int(rest["ts_ns"].iat[0]))
        else:
            self.waiting.clear()

    def _wake(self, ts_ns: int) -> None:
        """Ask for a timer that fires once rows up to ``ts_ns`` may go."""
        self.handle.registerTimer(max(1, ts_ns // 1_000_000 - self.lateness_ms + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, last_ns, last_rank, closed = self._place()
        new = pd.concat(list(rows), ignore_index=True)[["ts_ns", "kind", "sensor", "cause"]]
        new["cause"] = new["cause"].astype(object).where(new["cause"].notna(), None)
        rank = new["kind"].where(new["kind"] != "error", new["sensor"]).map(RANKS)
        place, state = rank.fillna(3), pd.Series(None, index=new.index, dtype=object)
        state[rank.isna()] = "unknown"
        if last_ns is not None:
            state[(new["ts_ns"] < last_ns) | ((new["ts_ns"] == last_ns) & (place <= last_rank))] = "late"
        if closed:
            state[:] = f"after {closed}"
        faulty = state.notna()
        told = new[faulty].assign(seq=key[0], position=None, state=state[faulty])[_NAMES]
        if len(told):
            yield told.astype({"position": object})
        new = new.assign(rank=place.astype("int64"))[~faulty]
        if not len(new):
            return
        # Nothing that comes later is more than the lateness behind what the sequence has brought by now, so only
        # the rows of that span go through the state.
        ended = (new["kind"] == "end").any()
        held = pd.concat([self._held(), new], ignore_index=True)
        out, rest = self._let_go(key[0], held, None if ended else int(held["ts_ns"].max()) - self.lateness_ms * 1_000_000)
        self._keep(rest)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()  # 0 as long as there is none
        held = self._held()
        if not len(held):
            return
        out, rest = self._let_go(key[0], held, (watermark + self.lateness_ms) * 1_000_000 if watermark > 0 else -(1 << 62))
        self._keep(rest)
        yield out


def ordered_replay(events: DataFrame, lateness_ms: int = 10_000) -> DataFrame:
    """``seq, position, ts_ns, kind, sensor, state, cause`` of ``seq, ts_ns, kind, sensor, cause`` events.

    ``state`` is ``event``, ``end`` or ``error`` for what is replayed, numbered by ``position`` from 0 per
    sequence.  Other rows have no position and say why: ``late`` behind something already
    replayed, ``after end``, ``after error``, or an ``unknown`` kind.  Rows wait ``lateness_ms`` at most;
    the watermark stays another ``lateness_ms`` behind, so that late rows are seen and told; those
    later still are dropped and counted by Spark.  State is what arrives in the span of the lateness.
    """
    if lateness_ms < 1:
        raise ValueError("lateness must be positive")
    typed_state(events.sparkSession)
    moment = F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000)))
    timed = events.withColumn("moment", moment).withWatermark("moment", f"{2 * lateness_ms} milliseconds")
    return timed.groupBy("seq").transformWithStateInPandas(_Replay(lateness_ms), OUTPUT, "Append", "eventTime")
