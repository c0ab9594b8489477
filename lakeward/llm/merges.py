"""Byte-pair merges of many segments at once, in rounds over flat symbol arrays."""

from __future__ import annotations

import heapq

import numpy as np

NO_RANK = np.iinfo(np.int32).max
#: Longer segments are merged pair by pair from a queue: the rounds of one segment grow with its length.
LONG = 4096
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """Which piece two adjacent symbols form, and the rank at which they do (a lower one goes first).

    `pairs` maps (left, right) to (piece, rank); symbols are below 2^31. The pairs lie in an
    open-addressing table, so a lookup of a whole array takes a few gathers.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.bits = max(8, (8 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.value = np.zeros(size, dtype=np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        piece = np.array([p for p, _ in pairs.values()], dtype=np.int32)
        rank = np.array([r for _, r in pairs.values()], dtype=np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == -1
            place, first = np.unique(at[free], return_index=True)
            self.keys[place] = keys[left[free][first]]
            self.value[place] = left[free][first]
            over = self.keys[at] != keys[left]
            left, at = left[over], (at[over] + 1) & (size - 1)
        # The last entry stands for no pair.
        self.piece, self.rank = np.append(piece, 0).astype(np.int32), np.append(rank, NO_RANK).astype(np.int32)
        # A pair is steady if no pair that its piece takes part in goes before it; only then are all
        # its occurrences in a segment merged in one round.
        best = np.full(int(max(piece.max(), (keys >> 32).max(), (keys & 0xFFFFFFFF).max())) + 1, NO_RANK, dtype=np.int64)
        for part in (keys >> 32, keys & 0xFFFFFFFF):
            np.minimum.at(best, part, rank)
        self.steady = np.append(best[piece] > rank, True)
        self.pairs: dict[int, tuple[int, int]] = {}  # for long segments, made when the first one comes
        self._entries = keys, piece, rank

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of the pair in `piece`, `rank` and `steady`, or the last index."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.value[at], len(self.piece) - 1)
        left_over = np.flatnonzero((found != keys) & (found != -1))
        at = at[left_over]
        while len(left_over):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[left_over]
            out[left_over[hit]] = self.value[at[hit]]
            on = ~hit & (found != -1)
            left_over, at = left_over[on], at[on]
        return out

    def one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """Final symbols of one segment: a queue of its pairs by rank, then place, in n log n steps."""
        if not self.pairs:
            self.pairs = {k: (p, r) for k, p, r in zip(*(x.tolist() for x in self._entries), strict=True)}
        pairs, n, found = self.pairs, len(symbols), symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank[self.lookup(symbols[:-1], symbols[1:])].astype(np.int64)
        on = np.flatnonzero(rank != NO_RANK)
        queue = ((rank[on] << 32) | on).tolist()
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            at = top & 0xFFFFFFFF
            right = after[at]
            hit = pairs.get(found[at] << 32 | found[right]) if found[at] >= 0 and right < n else None
            if hit is None or hit[1] != top >> 32:  # the pair is gone
                continue
            found[at], found[right] = hit[0], -1
            end = after[at] = after[right]
            if end < n:
                before[end] = at
            for a, b in ((before[at], at), (at, end)):
                if a >= 0 and b < n:
                    new = pairs.get(found[a] << 32 | found[b])
                    if new is not None:
                        heapq.heappush(queue, new[1] << 32 | a)
        return np.array([x for x in found if x >= 0], dtype=symbols.dtype)

    def rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all segments, and their new lengths; each length is at least 1."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        name = np.arange(len(lengths))
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            ends, rest = np.cumsum(lengths), np.ones(len(symbols), dtype=bool)
            for k in long.tolist():
                part = slice(int(ends[k] - lengths[k]), int(ends[k]))
                merged = self.one_by_one(symbols[part])
                done.append((np.array([k]), merged, np.array([len(merged)])))
                rest[part] = False
            symbols, name = symbols[rest], np.delete(name, long)
            lengths = lengths[name]
        while len(lengths):
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            pair = np.full(len(symbols), len(self.piece) - 1, dtype=np.int64)
            pair[:-1] = self.lookup(symbols[:-1], symbols[1:])
            pair[first + lengths - 1] = len(self.piece) - 1
            rank = self.rank[pair]
            least = np.minimum.reduceat(rank, first)
            alive = least != NO_RANK
            segment = np.repeat(np.arange(len(lengths)), lengths)
            on = alive[segment]
            if not alive.all():
                done.append((name[~alive], symbols[~on], lengths[~alive]))
            hits = np.flatnonzero((rank == least[segment]) & on)
            if not len(hits):
                break
            # Of overlapping hits every second one merges, from the left.
            new_run = np.ones(len(hits), dtype=bool)
            new_run[1:] = hits[1:] - hits[:-1] != 1
            run_start = hits[np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))]
            lead = np.ones(len(hits), dtype=bool)
            lead[1:] = segment[hits[1:]] != segment[hits[:-1]]
            hits = hits[((hits - run_start) % 2 == 0) & (lead | self.steady[pair[hits]])]
            symbols[hits] = self.piece[pair[hits]]
            on[hits + 1] = False
            lengths = np.bincount(segment[on], minlength=len(lengths))[alive]
            symbols, name = symbols[on], name[alive]
        names, parts, sizes = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(names, kind="stable")
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order]
        sizes = sizes[order]
        into = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return parts[np.repeat(start - into, sizes) + np.arange(len(parts))], sizes
