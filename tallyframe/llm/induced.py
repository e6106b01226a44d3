"""External induced sorting of suffixes around anchors, for one shard of any size.

Entries are places of a text that share an anchor: the bytes from the anchor on, and some bytes before it. They arrive
sorted by the former (level 0). Level o + 1 orders the suffixes that start one byte earlier: a suffix tuple moves to
the queue of the byte before it, in the order of level o, so the next level is the queues read in byte order. Common
prefixes are carried along: the longest one with the entry before is one more than the least seen since the last tuple
of the same queue. Queues keep their tuples in memory up to a bound and on disk beyond it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

from tallyframe.session import ship

ship(__name__)


def tuple_type(most: int) -> np.dtype:
    """lcp: with the entry before. least, most: first and last level at which the entry stands for a whole window."""
    return np.dtype([("lcp", "u2"), ("least", "u2"), ("most", "u2"), ("key", "i8"), ("at", "i8"), ("left", "u1", (most,))])


class Queues:
    """One first-in-first-out queue per byte, read in byte order; spilled to disk beyond ``limit`` bytes."""

    def __init__(self, kind: np.dtype, folder: str, limit: int):
        self.kind, self.folder, self.limit = kind, folder, limit
        self.held: dict[int, list[np.ndarray]] = {}
        self.size = 0
        self.files: set[int] = set()

    def push(self, byte: int, tuples: np.ndarray) -> None:
        self.held.setdefault(byte, []).append(tuples)
        self.size += tuples.nbytes
        if self.size > self.limit:
            for b, parts in self.held.items():
                with open(self.name(b), "ab") as out:
                    for part in parts:
                        out.write(part.tobytes())
                self.files.add(b)
            self.held, self.size = {}, 0

    def name(self, byte: int) -> str:
        return os.path.join(self.folder, f"queue-{id(self)}-{byte}")

    def read(self, block: int) -> Iterator[np.ndarray]:
        for byte in range(256):
            if byte in self.files:
                with open(self.name(byte), "rb") as stored:
                    while data := stored.read(block * self.kind.itemsize):
                        yield np.frombuffer(data, self.kind)
                os.remove(self.name(byte))
            if byte in self.held:
                joined = np.concatenate(self.held.pop(byte))
                for low in range(0, len(joined), block):
                    yield joined[low : low + block]


def repeated(
    first: Iterable[np.ndarray], window: int, most: int, limit: int = 64 << 20, block: int = 100_000
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, starts) of windows that also start earlier, from level 0 in order.

    Of equal windows the one with the smallest (key, start) stays; every other one is returned once.
    """
    kind = tuple_type(most)
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        level: Iterator[np.ndarray] = iter(first)
        for step in range(most + 1):
            queues = Queues(kind, folder, limit)
            since = np.zeros(256, np.int64)  # least common prefix since the last tuple of each queue; 0: none yet
            best: tuple[int, int] | None = None  # of the class that the last entry belongs to
            shared = window - most + step  # below this, no later level can reach a window
            pending: np.ndarray | None = None
            for tuples in blocks(level, kind):
                # the last entry waits for the common prefix with the next one
                tuples = tuples if pending is None else np.concatenate([pending, tuples])
                ready, pending = tuples[:-1], tuples[-1:]
                if len(ready):
                    following = np.append(ready["lcp"][1:], pending["lcp"])
                    best, out = classes(ready, step, window, best)
                    if len(out[0]):
                        yield out
                    induce(ready, following, step, shared, most, queues, since)
            if pending is not None:
                best, out = classes(pending, step, window, best)
                if len(out[0]):
                    yield out
                induce(pending, np.zeros(1, "u2"), step, shared, most, queues, since)
            level = queues.read(block)


def blocks(level: Iterator[np.ndarray], kind: np.dtype) -> Iterator[np.ndarray]:
    for tuples in level:
        if len(tuples):
            yield tuples


def classes(tuples: np.ndarray, step: int, window: int, best: tuple[int, int] | None):
    """All but the smallest of each class of equal windows, and the smallest of the class still open."""
    new = tuples["lcp"] < window
    number = np.cumsum(new)
    live = (tuples["least"] <= step) & (step <= tuples["most"])
    keys, starts, number = tuples["key"][live], tuples["at"][live] - step, number[live]
    order = np.lexsort((starts, keys, number))
    keys, starts, number = keys[order], starts[order], number[order]
    head = np.append(True, number[1:] != number[:-1]) if len(number) else np.zeros(0, bool)
    drop = ~head
    extra: tuple[list[int], list[int]] = ([], [])
    last = int(new.sum())  # classes are numbered from 1; 0 continues the one before this block
    if len(number) and number[0] == 0:
        here = (int(keys[0]), int(starts[0]))
        if best is not None:
            worse = max(best, here)
            extra = ([worse[0]], [worse[1]])
            here = min(best, here)
        best = here
    if last > 0:
        ends = np.flatnonzero(head & (number == last))
        best = (int(keys[ends[0]]), int(starts[ends[0]])) if len(ends) else None
    return best, (np.concatenate([keys[drop], np.array(extra[0], np.int64)]), np.concatenate([starts[drop], np.array(extra[1], np.int64)]))


def induce(tuples: np.ndarray, following: np.ndarray, step: int, shared: int, most: int, queues: Queues, since: np.ndarray) -> None:
    """Moves each tuple that has a byte before it, and may still match, to that byte's queue."""
    lcp = tuples["lcp"].astype(np.int64)
    goes = (tuples["most"] > step) & (np.maximum(lcp, following) >= shared)
    seen = np.zeros(256, bool)
    if goes.any():
        byte = tuples["left"][:, most - 1 - step]
        order = np.flatnonzero(goes)[np.argsort(byte[goes], kind="stable")]
        sorted_bytes = byte[order]
        heads = np.flatnonzero(np.append(True, sorted_bytes[1:] != sorted_bytes[:-1]))
        for low, high in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
            at, b = order[low:high], int(sorted_bytes[low])
            least = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))
            least[0] = min(least[0], since[b] - 1) if since[b] else -1
            moved = tuples[at]
            moved["lcp"] = least + 1
            queues.push(b, moved)
            tail = lcp[at[-1] + 1 :]
            since[b] = (tail.min() if len(tail) else 1 << 14) + 1
            seen[b] = True
    waiting = ~seen & (since > 0)
    since[waiting] = np.minimum(since[waiting], lcp.min() + 1)
