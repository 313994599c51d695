"""One waiting queue that pairs two rising streams of stamps, for batches and for streams."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable


class Waiting:
    """Stamps of one side that wait for a partner, earliest first.

    Only one of two rising streams can have stamps waiting: a new stamp of the other side is
    paired, given up, or outlives all that wait and then waits itself.
    """

    def __init__(self, tolerance_ns: int, stamps: Iterable[int] = (), side=None) -> None:
        self.tolerance_ns, self.stamps, self.side = tolerance_ns, deque(stamps), side

    def pass_by(self, stamp: int) -> int:
        """Give up what is too old to meet ``stamp`` or a later one; how many that were."""
        gone = 0
        while self.stamps and self.stamps[0] < stamp - self.tolerance_ns:
            self.stamps.popleft()
            gone += 1
        return gone

    def offer(self, side, stamp: int) -> tuple[int | None, int, bool]:
        """Partner of ``stamp``, stamps of the other side given up, whether ``stamp`` waits."""
        gone = 0
        if side != self.side:
            gone = self.pass_by(stamp)
            if self.stamps:
                meets = self.stamps[0] <= stamp + self.tolerance_ns
                return self.stamps.popleft() if meets else None, gone, False
        self.stamps.append(stamp)
        self.side = side
        return None, gone, True

    def offer_all(self, sides: Iterable, stamps: Iterable[int]) -> tuple[list[int], list[int], Counter, Counter]:
        """:meth:`offer` for many: places and partners of those that met one, stamps given up and most that waited by side."""
        held, side, tolerance = self.stamps, self.side, self.tolerance_ns
        places, partners, gone, longest = [], [], Counter(), Counter()
        for place, (now, stamp) in enumerate(zip(sides, stamps)):
            if now != side:
                while held and held[0] < stamp - tolerance:
                    held.popleft()
                    gone[side] += 1
                if held:
                    if held[0] <= stamp + tolerance:
                        places.append(place)
                        partners.append(held.popleft())
                    else:
                        gone[now] += 1
                    longest[now] = longest[now] or 1
                    continue
                side = now
            held.append(stamp)
            if len(held) > longest[side]:
                longest[side] = len(held)
        self.side = side
        return places, partners, gone, longest
