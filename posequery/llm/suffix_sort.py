"""Two-stage suffix sorting of a byte string, for prefixes of a given length."""

from __future__ import annotations

import numpy as np


def types_of(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts a byte later; the last one is not."""
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    place = np.where(text[:-1] != text[1:], np.arange(n - 1), n)
    differs = np.minimum.accumulate(place[::-1])[::-1]  # where the run of equal bytes ends
    known = differs < n
    at = np.where(known, differs, 0)
    out = np.zeros(n, bool)
    out[:-1] = known & (text[at] < text[np.minimum(at + 1, n - 1)])
    return out


def _direct(raw: bytes, eight: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """``places`` in the order of their first ``size`` bytes."""
    keys = eight[places]
    order = np.argsort(keys, kind="stable")
    places, keys = places[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    stop = np.concatenate([first[1:], [len(keys)]])
    text = raw.decode("latin-1")  # one character a byte: slices of it compare like bytes, only faster
    for a, b in zip(first[stop - first > 1].tolist(), stop[stop - first > 1].tolist()):
        run = places[a:b].tolist()
        run.sort(key=lambda i: text[i + 8 : i + size])
        places[a:b] = run
    return places


def sort_suffixes(raw: bytes, starts: np.ndarray, size: int) -> np.ndarray:
    """``starts`` in the order of the first ``size`` bytes of their suffixes.

    Suffixes smaller than their successor are sorted directly.  The others are induced: buckets of
    first bytes are scanned in order, and a suffix's predecessor with a larger first byte, or
    the same one in a falling run, takes the next place of its bucket.
    """
    n = len(raw)
    text = np.frombuffer(raw, np.uint8)
    smaller = types_of(text)
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    eight = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    # An induced suffix needs all that follow it up to the next one that is sorted directly.
    anchor = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, anchor[starts] + 1, -1)
    needed = np.cumsum(edges[:n]) > 0
    sorted_ = smaller | (np.arange(n) == n - 1)  # the last suffix has no successor to be induced from
    direct = _direct(raw, eight, np.flatnonzero(needed & sorted_), size)
    byte = text[direct]
    cuts = np.searchsorted(byte, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    found = []
    empty = np.zeros(0, np.int64)

    def before(suffixes: np.ndarray) -> np.ndarray:
        places = suffixes[suffixes > 0] - 1
        return places[needed[places] & ~sorted_[places]]

    for value in range(256):
        level = np.concatenate(waiting[value]) if waiting[value] else empty
        part = []
        while len(level):
            part.append(level)
            level = before(level)
            level = level[text[level] == value]
        own = np.concatenate([*part, direct[cuts[value] : cuts[value + 1]]])
        if not len(own):
            continue
        found.append(own)
        places = before(own)
        first = text[places]
        places, first = places[first > value], first[first > value]
        order = np.argsort(first, kind="stable")
        places, first = places[order], first[order]
        for k, group in zip(*np.unique(first, return_index=True)):
            waiting[k].append(places[group : np.searchsorted(first, k, "right")])
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    order = np.concatenate(found) if found else empty
    return order[wanted[order]]


def common_prefixes(raw: bytes, ordered: np.ndarray, size: int) -> np.ndarray:
    """Common prefix of each suffix with the next in order: whole bytes, ``size`` at most."""
    if len(ordered) < 2:
        return np.zeros(0, np.int64)
    padded = np.frombuffer(raw + bytes(size + 8), np.uint8)
    eight = np.ndarray((len(raw) + size,), ">u8", padded, 0, (1,))
    a, b = ordered[:-1], ordered[1:]
    out = np.full(len(a), size, np.int64)
    live = np.arange(len(a))
    for at in range(0, size, 8):
        x, y = eight[a[live] + at], eight[b[live] + at]
        same = x == y
        gone = live[~same]
        differ = (x ^ y)[~same]
        lead = np.zeros(len(gone), np.int64)
        for byte in range(7):  # equal bytes before the first difference
            lead += (differ >> np.uint64(56 - 8 * byte) == 0).astype(np.int64)
        out[gone] = np.minimum(at + lead, size)
        live = live[same]
        if not len(live):
            break
    return out
