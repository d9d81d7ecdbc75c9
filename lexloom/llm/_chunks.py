"""A memo of the ids of text chunks, bounded in bytes and kept in flat arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import chain

import numpy as np

#: Bytes of a memo; characters of a chunk that may be kept; bytes that a kept chunk takes beside its characters and ids.
MOST_BYTES, LONGEST_KEPT, EACH = 160 << 20, 64, 200


class _Lists:
    """Lists of ids end to end, in arrays that double when full."""

    def __init__(self) -> None:
        self.ids, self.ends, self.n = np.zeros(1024, np.uint32), np.zeros(1025, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.ends[self.n])
        self.ids, self.ends = self._room(self.ids, used + len(ids)), self._room(self.ends, self.n + len(sizes) + 1)
        self.ids[used : used + len(ids)] = ids
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros(max(need, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def joined(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists at these places, and each one's size."""
        n = self.ends[at + 1] - self.ends[at]
        return self.ids[np.repeat(self.ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _missing(found: list[int | None]) -> Iterator[int]:
    """Places of None, looked for anew after each."""
    i = -1
    with suppress(ValueError):
        while True:
            i = found.index(None, i + 1)
            yield i


class ChunkMemo:
    """Joins the ids of chunks; ``fresh`` encodes chunks not met before and gives their flat ids and sizes, one pair for each of its ways to encode.

    Long chunks, and all new ones once the memo is full, are forgotten after their batch.
    """

    def __init__(self, fresh: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], most_bytes: int = MOST_BYTES, ways: int = 1):
        self.fresh, self.most, self.bytes = fresh, most_bytes, 0
        self.at: dict[str, int] = {}
        self.lists = [_Lists() for _ in range(ways)]

    def encode(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each way, the ids of all texts end to end, and each text's size."""
        at, kept = self.at, self.lists[0].n
        slots: list[int] = []
        short: list[str] = []
        long: list[str] = []
        for chunks in texts:
            found = list(map(at.get, chunks))
            for i in _missing(found):
                c = chunks[i]
                k = at.get(c)
                if k is None:
                    # Places of long chunks follow those of short ones.
                    (own := short if len(c) <= LONGEST_KEPT else long).append(c)
                    k = at[c] = kept + len(short) - 1 if own is short else -len(long)
                found[i] = k
            slots += found
        places = np.array(slots, np.int64)
        del slots
        places = np.where(places < 0, kept + len(short) - 1 - places, places)
        ends, out = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))), []
        if short or long:
            for lists, (ids, sizes) in zip(self.lists, self.fresh(short + long)):
                lists.add(ids, sizes)
        room = 0
        while room < len(short) and self.bytes < self.most:
            self.bytes += EACH + 4 * len(short[room])
            room += 1
        for c in chain(short[room:], long):
            del at[c]
        for lists in self.lists:
            ids, n = lists.joined(places)
            total = np.concatenate([[0], np.cumsum(n)])
            out.append((ids, np.diff(total[ends], prepend=0)))
            lists.n = kept + room
        return out
