"""Per-sequence rules shared by the batch and the streaming forms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from posequery.plans.pairing import Waiting


def rotation_matrix(q: np.ndarray) -> np.ndarray:
    x, y, z, w = q
    return np.array(
        [
            [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
            [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
            [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
        ]
    )


@dataclass(frozen=True)
class KeyframeRule:
    """When a frame becomes a keyframe.

    A frame without observations never does.  Otherwise it does when fewer than two
    keyframes exist, when it has few tracks, when the last keyframe is old, when too few
    of its ids survive, or when the rotation-free parallax is large.
    """

    fx: float
    fy: float
    cx: float
    cy: float
    min_tracks: int = 10
    max_interval_ns: int = 500_000_000
    min_survival: float = 0.6
    max_parallax_px: float = 30.0

    def wants(self, row: dict, count: int, last: dict | None, old: bool = False) -> bool:
        """Decide for ``row`` given the number of keyframes and the last accepted one.

        Rows hold sorted ``ids``, their pixels ``uv`` and the rotation of the last
        accepted pose before them.  ``old`` says that the last keyframe is known to lie
        further back than ``max_interval_ns``.
        """
        if len(row["ids"]) == 0:
            return False
        if count < 2 or len(row["ids"]) < self.min_tracks or old:
            return True
        if row["ts_ns"] - last["ts_ns"] > self.max_interval_ns:
            return True
        _, here, there = np.intersect1d(
            row["ids"], last["ids"], assume_unique=True, return_indices=True
        )
        if len(here) / max(len(last["ids"]), 1) < self.min_survival:
            return True
        turn = row["rotation"].T @ last["rotation"]
        u, v = last["uv"][:, there]
        rays = turn @ np.stack(
            [(u - self.cx) / self.fx, (v - self.cy) / self.fy, np.ones_like(u)]
        )
        front = rays[2] > 1e-6
        if not front.any():
            return False
        x, y, z = rays[:, front]
        moved = row["uv"][:, here[front]] - np.stack(
            [x / z * self.fx + self.cx, y / z * self.fy + self.cy]
        )
        return bool(np.hypot(moved[0], moved[1]).mean() > self.max_parallax_px)


class Handler:
    """What the rules of a sequence share: none ends and none minds being stopped.

    ``state`` names what a rule remembers: a ``value`` (a row), a ``list`` of rows or a ``map`` of
    rows, with their columns.  ``dump`` gives it as tuples under those names, None for a value
    that is not there yet, and ``load`` takes the same.
    """

    state: dict[str, tuple[str, ...]] = {}

    def begin(self, row) -> None:
        """Take up what a batch run left of the sequence."""
        raise NotImplementedError

    def ends(self, row) -> bool:
        """Whether ``row`` closes the sequence and is taken even after a fault."""
        return False

    def stop(self, status: str) -> None:
        """Note that no further rows but the end will come."""

    def take(self, batch: pd.DataFrame, lists: dict[str, np.ndarray] | None = None) -> tuple[int, dict]:
        """Take rows from the front of ``batch`` at once, if the rule can: how many, and columns of what :meth:`feed` gives.

        ``lists`` has the values of columns of lists, of which a row has ``<name>_n`` from ``<name>_at`` on.
        """
        return 0, {}


def listed(batch: pd.DataFrame, lists: dict[str, np.ndarray], name: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``batch``, by place, and values of a column of lists of longs, ascending by both."""
    n, at = batch[f"{name}_n"].to_numpy(), batch[f"{name}_at"].to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    # Without any value an array has no type.
    value = lists[name].astype(np.int64)[np.arange(len(row)) + np.repeat(at - (np.cumsum(n) - n), n)]
    order = np.lexsort((value, row))
    return row[order], value[order]


#: Counters of a finished sequence.
SYNC_COUNTS = ["emitted"] + [f"{what}_{side}" for what in ("pushed", "dropped", "overflow", "longest") for side in ("left", "right")]


class SyncHandler(Handler):
    """Stereo pairing of one sequence; an ``end`` row gives up what waits and reports the counters.

    A side must rise and be known: after the first stamp that is not, each further one is
    answered with that fault.  Pairs made before stay valid.  ``max_queue`` bounds what
    waits, oldest first; without it nothing is given up but what the tolerance rules out.
    """

    output = "seq long, kind string, ts_ns long, right_ts_ns long, status string, counts map<string,long>"
    state = {
        "left": ("list", "ts_ns long"),
        "right": ("list", "ts_ns long"),
        "seen": ("value", "left long, right long, status string"),
        "counts": ("map", "name string", "n long"),
    }

    def __init__(self, tolerance_ns: int = 0, max_queue: int | None = None) -> None:
        if tolerance_ns < 0 or (max_queue is not None and max_queue < 1):
            raise ValueError("tolerance must not be negative and the queue hold at least one")
        self.max_queue = max_queue
        self.waiting = Waiting(tolerance_ns)
        self.latest: dict[str, int] = {}
        self.status: str | None = None
        self.counts = dict.fromkeys(SYNC_COUNTS, 0)

    def load(self, state: dict) -> None:
        side = "right" if state["right"] else "left"
        self.waiting = Waiting(self.waiting.tolerance_ns, [t for (t,) in state[side]], side)
        left, right, self.status = state["seen"] or (None, None, None)
        self.latest = {s: t for s, t in (("left", left), ("right", right)) if t is not None}
        self.counts |= {name: n for (name,), (n,) in state["counts"].items()}

    def dump(self) -> dict:
        waiting = [(t,) for t in self.waiting.stamps]
        return {
            "left": waiting if self.waiting.side == "left" else [],
            "right": waiting if self.waiting.side == "right" else [],
            "seen": (self.latest.get("left"), self.latest.get("right"), self.status),
            "counts": {(name,): (n,) for name, n in self.counts.items()},
        }

    def begin(self, row) -> None:
        self.waiting = Waiting(self.waiting.tolerance_ns, [int(t) for t in row.waiting], row.side)
        self.latest = {s: int(t) for s, t in (("left", row.left), ("right", row.right)) if t is not None and t == t}
        self.counts |= {name: int(getattr(row, name)) for name in self.counts}

    def ends(self, row) -> bool:
        return row.camera == "end"

    def stop(self, status: str) -> None:
        self.status = self.status or status

    def _fault(self, side: str, stamp: int) -> str | None:
        if side not in ("left", "right"):
            return "invalid"
        ahead = stamp - self.latest.get(side, stamp - 1)
        return None if ahead > 0 else "out_of_order" if ahead < 0 else "duplicate"

    def take(self, batch: pd.DataFrame, lists: dict[str, np.ndarray] | None = None) -> tuple[int, dict]:
        """All rows before the first fault or end."""
        stamp, side = batch["ts_ns"].to_numpy(), batch["camera"].to_numpy()
        if self.status or self.max_queue or stamp.dtype != np.int64:
            return 0, {}
        plain = np.isin(side, ["left", "right"])
        for name in ("left", "right"):
            at = np.flatnonzero(side == name)
            plain[at[1:]] &= stamp[at[1:]] > stamp[at[:-1]]
            if len(at) and name in self.latest:
                plain[at[0]] &= stamp[at[0]] > self.latest[name]
        n = len(plain) if plain.all() else int(np.argmin(plain))
        stamp, side = stamp[:n], side[:n]
        places, partners, gone, longest = self.waiting.offer_all(side.tolist(), stamp.tolist())
        for name in ("left", "right"):
            here = stamp[side == name]
            if len(here):
                self.latest[name] = int(here[-1])
            self.counts[f"pushed_{name}"] += len(here)
            self.counts[f"dropped_{name}"] += gone[name]
            self.counts[f"longest_{name}"] = max(self.counts[f"longest_{name}"], longest[name])
        self.counts["emitted"] += len(places)
        later, earlier = stamp[places], np.array(partners, np.int64)
        is_left = side[places] == "left"
        pairs = {"ts_ns": np.where(is_left, later, earlier), "right_ts_ns": np.where(is_left, earlier, later)}
        return n, {"kind": "pair", **pairs, "status": "ok"} if places else {}

    def feed(self, row) -> list[tuple]:
        counts, waiting = self.counts, self.waiting
        if self.ends(row):
            if waiting.stamps:
                counts[f"dropped_{waiting.side}"] += len(waiting.stamps)
                waiting.stamps.clear()
            return [("report", None, None, self.status, dict(counts))]
        side, stamp = row.camera, int(row.ts_ns)
        self.status = self.status or self._fault(side, stamp)
        if self.status:
            return [("fault", stamp, None, self.status, None)]
        self.latest[side] = stamp
        counts[f"pushed_{side}"] += 1
        partner, gone, waits = waiting.offer(side, stamp)
        if gone:
            counts["dropped_right" if side == "left" else "dropped_left"] += gone
        if waits and self.max_queue and len(waiting.stamps) > self.max_queue:
            waiting.stamps.popleft()
            counts[f"overflow_{side}"] += 1
        counts[f"longest_{side}"] = max(counts[f"longest_{side}"], len(waiting.stamps) if waits else 1)
        if partner is not None:
            counts["emitted"] += 1
            left, right = (stamp, partner) if side == "left" else (partner, stamp)
            return [("pair", left, right, "ok", None)]
        counts[f"dropped_{side}"] += not waits
        return []


class KeyframeHandler(Handler):
    """Keyframe decisions of one sequence; the state advances on accepted frames only."""

    output = "seq long, frame long, is_keyframe boolean"
    state = {
        "at": ("value", "count int, rotation array<double>, last_ns long, last_rotation array<double>"),
        "tracks": ("list", "id long, u double, v double"),
    }

    def __init__(self, rule: KeyframeRule) -> None:
        self.rule = rule
        self.count, self.last = 0, None
        self.rotation = [0.0, 0.0, 0.0, 1.0]

    def load(self, state: dict) -> None:
        if state["at"] is None:
            return
        self.count, self.rotation, last_ns, turned = state["at"]
        if last_ns is not None:
            ids, us, vs = (list(c) for c in zip(*state["tracks"])) if state["tracks"] else ([], [], [])
            self.last = {"ts_ns": last_ns, "ids": ids, "us": us, "vs": vs, "rotation": turned}

    def dump(self) -> dict:
        if self.last is None:
            return {"at": (self.count, self.rotation, None, None), "tracks": []}
        tracks = list(zip(*(self.last[c] for c in ("ids", "us", "vs"))))
        return {"at": (self.count, self.rotation, self.last["ts_ns"], self.last["rotation"]), "tracks": tracks}

    @staticmethod
    def _unpacked(held: dict) -> dict:
        return {
            "ts_ns": held["ts_ns"],
            "ids": np.asarray(held["ids"], dtype=np.int64),
            "uv": np.asarray([held["us"], held["vs"]], dtype=float),
            "rotation": rotation_matrix(np.asarray(held["rotation"])),
        }

    def feed(self, row) -> list[tuple]:
        empty = row.ids is None
        ids = np.asarray([] if empty else row.ids, dtype=np.int64)
        order = np.argsort(ids)
        held = {
            "ts_ns": int(row.ts_ns),
            "ids": ids[order].tolist(),
            "us": np.asarray([] if empty else row.us, dtype=float)[order].tolist(),
            "vs": np.asarray([] if empty else row.vs, dtype=float)[order].tolist(),
            "rotation": self.rotation,
        }
        last = self._unpacked(self.last) if self.last else None
        chosen = self.rule.wants(self._unpacked(held), self.count, last)
        if row.accepted:
            if chosen:
                self.count, self.last = min(self.count + 1, 2), held
            self.rotation = [float(v) for v in row.own_rotation]
        return [(int(row.frame), chosen)]


class AgeHandler(Handler):
    """Ages of marked ids of one sequence while they stay present in following frames."""

    output = "seq long, id long, frame long, age long, dropped boolean"
    state = {"at": ("value", "frame long"), "ages": ("map", "id long", "age long")}

    def __init__(self, max_age: int) -> None:
        self.max_age = max_age
        self.frame = None
        self.ages: dict[int, int] = {}

    def load(self, state: dict) -> None:
        (self.frame,) = state["at"] or (None,)
        self.ages = {i: age for (i,), (age,) in state["ages"].items()}

    def dump(self) -> dict:
        return {"at": (self.frame,), "ages": {(i,): (age,) for i, age in self.ages.items()}}

    def feed(self, row) -> list[tuple]:
        present = set() if row.ids is None else {int(i) for i in row.ids}
        marks = set() if row.marks is None else {int(i) for i in row.marks}
        if self.frame is None or row.frame != self.frame + 1:
            self.ages = {}
        self.frame = int(row.frame)
        # A dropped id keeps age zero until it has been absent, so it is not marked anew.
        self.ages = {i: a + (a > 0) for i, a in self.ages.items() if i in present}
        for i in marks & present:
            self.ages.setdefault(i, 1)
        out = []
        for i, age in sorted(self.ages.items()):
            if age > 0:
                dropped = age >= self.max_age
                out.append((i, self.frame, age, dropped))
                if dropped:
                    self.ages[i] = 0
        return out


class WindowHandler(Handler):
    """Window membership of one sequence after each accepted frame."""

    output = "seq long, segment_id long, frame long, member_frame long, is_keyframe boolean"
    state = {"at": ("value", "segment long"), "window": ("list", "frame long, is_keyframe boolean")}

    def __init__(self, max_frames: int = 10, max_keyframes: int = 7) -> None:
        self.max_frames, self.max_keyframes = max_frames, max_keyframes
        self.segment, self.window = None, []

    def load(self, state: dict) -> None:
        (self.segment,) = state["at"] or (None,)
        self.window = [list(member) for member in state["window"]]

    def dump(self) -> dict:
        return {"at": (self.segment,), "window": [tuple(member) for member in self.window]}

    def _evict(self, index: int | None) -> None:
        self.window.pop(0 if index is None else index)

    def feed(self, row) -> list[tuple]:
        if row.segment_id != self.segment:
            self.segment, self.window = int(row.segment_id), []
        self.window.append([int(row.frame), bool(row.is_keyframe)])
        keys = [i for i, (_, key) in enumerate(self.window) if key]
        if len(keys) > self.max_keyframes:
            self._evict(keys[0])
        if len(self.window) > self.max_frames:
            others = [i for i, (_, key) in enumerate(self.window[:-1]) if not key]
            self._evict(others[0] if others else None)
        return [(self.segment, int(row.frame), f, k) for f, k in self.window]


class SkipDropHandler(Handler):
    """Drop, skip and deferred flush of culled ids of one sequence."""

    output = "seq long, frame long, id long, action string"
    state = {"pending": ("list", "id long")}

    def __init__(self, min_culled: int = 4, defer_topk: int = 0) -> None:
        self.min_culled, self.defer_topk = min_culled, defer_topk
        self.pending: list[int] = []

    def load(self, state: dict) -> None:
        self.pending = [i for (i,) in state["pending"]]

    def dump(self) -> dict:
        return {"pending": [(i,) for i in self.pending]}

    def feed(self, row) -> list[tuple]:
        frame = int(row.frame)
        out = [(frame, i, "flush") for i in self.pending]
        self.pending = []
        culled = [] if row.culled is None else sorted(int(i) for i in row.culled)
        if self.min_culled > 0 and len(culled) >= self.min_culled:
            self.pending = culled[: max(self.defer_topk, 0)]
            out += [(frame, i, "defer") for i in self.pending]
            out += [(frame, i, "skip") for i in culled[len(self.pending) :]]
        else:
            out += [(frame, i, "drop") for i in culled]
        return out

    def take(self, batch: pd.DataFrame, lists: dict[str, np.ndarray] | None = None) -> tuple[int, dict]:
        frame = batch["frame"].to_numpy()
        row, ids = listed(batch, lists, "culled")
        n = np.bincount(row, minlength=len(frame))
        rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        many = (n >= self.min_culled)[row] if self.min_culled > 0 else np.zeros(len(row), bool)
        deferred = many & (rank < self.defer_topk)
        action = np.where(deferred, "defer", np.where(many, "skip", "drop")).astype(object)
        # What a frame defers, the next one flushes, before it acts.
        flushed = np.concatenate([np.zeros(len(self.pending), np.int64), row[deferred] + 1])
        ids_flushed = np.concatenate([np.array(self.pending, np.int64), ids[deferred]])
        here = flushed < len(frame)
        self.pending = ids_flushed[~here].tolist()
        row, ids = np.concatenate([flushed[here], row]), np.concatenate([ids_flushed[here], ids])
        action = np.concatenate([np.full(int(here.sum()), "flush", object), action])
        order = np.argsort(row, kind="stable")
        return len(frame), {"frame": frame[row[order]], "id": ids[order], "action": action[order]} if len(row) else {}


class EvictableHandler(Handler):
    """Tracks of one sequence that may be evicted: marked by a skipped cull and present ever since."""

    output = "seq long, frame long, id long"
    state = {"at": ("value", "frame long"), "marked": ("map", "id long", "since long")}

    def __init__(self, min_culled: int = 4) -> None:
        self.min_culled = min_culled
        self.frame: int | None = None
        self.marked: dict[int, int] = {}

    def load(self, state: dict) -> None:
        (self.frame,) = state["at"] or (None,)
        self.marked = {i: since for (i,), (since,) in state["marked"].items()}

    def dump(self) -> dict:
        return {"at": (self.frame,), "marked": {(i,): (since,) for i, since in self.marked.items()}}

    def feed(self, row) -> list[tuple]:
        present = set() if row.ids is None else {int(i) for i in row.ids}
        culled = set() if row.culled is None else {int(i) for i in row.culled}
        frame = int(row.frame)
        if self.frame is None or frame != self.frame + 1:
            self.marked = {}
        self.frame = frame
        self.marked = {i: since for i, since in self.marked.items() if i in present}
        out = [(frame, i) for i in sorted(self.marked)]
        if self.min_culled > 0 and len(culled) >= self.min_culled:
            for i in culled & present:
                self.marked.setdefault(i, frame)
        return out

    def take(self, batch: pd.DataFrame, lists: dict[str, np.ndarray] | None = None) -> tuple[int, dict]:
        frame = batch["frame"].to_numpy()
        (row, ids), (at, gone) = (_once(*listed(batch, lists, name)) for name in ("ids", "culled"))
        known, codes = np.unique(np.concatenate([ids, gone]), return_inverse=True)
        codes, gone = codes[: len(ids)], codes[len(ids) :]
        many = np.bincount(at, minlength=len(frame)) >= self.min_culled
        many = many[at] if self.min_culled > 0 else np.zeros(len(at), bool)
        marks = np.isin(row * len(known) + codes, (at * len(known) + gone)[many])
        # By id, then frame: an id is present since its run began, and may go once a frame before has marked it.
        order = np.lexsort((row, codes))
        row, codes, ids, marks = row[order], codes[order], ids[order], marks[order]
        place, now = np.arange(len(row)), frame[row]
        follows = np.zeros(len(row), bool)
        follows[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1] + 1) & (now[1:] == now[:-1] + 1)
        start = np.maximum.accumulate(np.where(follows, 0, place)) if len(row) else place
        held = np.zeros(len(row), bool)
        if self.marked and self.frame is not None and frame[0] == self.frame + 1:
            held = (row == 0) & np.isin(ids, list(self.marked))
        # Ranks of the first mark of a run: one that was held goes before any of its own.
        firsts = np.where(held | marks, place, len(place))
        runs = np.flatnonzero(~follows)
        first = np.minimum.reduceat(firsts, runs)[np.cumsum(~follows) - 1] if len(row) else firsts
        out = held | (first < place)
        last = (row == len(frame) - 1) & (first <= place)
        before, self.marked = self.marked, {}
        for i, mark, was in zip(ids[last].tolist(), first[last].tolist(), held[start[last]].tolist()):
            self.marked[i] = before[i] if was else int(now[mark])
        self.frame = int(frame[-1])
        row, ids = row[out], ids[out]
        order = np.lexsort((ids, row))
        return len(frame), {"frame": frame[row[order]], "id": ids[order]} if len(row) else {}


def _once(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs without repeats."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


class SeedHandler(Handler):
    """Latest stereo observation per id of one sequence until enough ids are known."""

    output = "seq long, seed_frame long, id long, frame long, u double"
    state = {"at": ("value", "seeded boolean"), "held": ("map", "id long", "frame long, u double")}

    def __init__(self, min_ids: int = 10) -> None:
        self.min_ids = min_ids
        self.seeded, self.held = False, {}

    def load(self, state: dict) -> None:
        (self.seeded,) = state["at"] or (False,)
        self.held = {i: seen for (i,), seen in state["held"].items()}

    def dump(self) -> dict:
        return {"at": (self.seeded,), "held": {(i,): seen for i, seen in self.held.items()}}

    def feed(self, row) -> list[tuple]:
        if self.seeded or row.ids is None:
            return []
        for i, u, disparity in zip(row.ids, row.us, row.disparities, strict=True):
            if disparity > 0:
                self.held[int(i)] = int(row.frame), float(u)
        if len(self.held) < self.min_ids:
            return []
        out = [(int(row.frame), i, f, u) for i, (f, u) in sorted(self.held.items())]
        self.seeded, self.held = True, {}
        return out
