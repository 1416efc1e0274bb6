"""Rank-synchronous pair merging over ragged numpy arrays.

Many short symbol sequences lie end to end in one array. In every step each unfinished sequence looks up its lowest-ranked
adjacent pair and all sequences apply theirs at once; a sequence leaves when none of its pairs has a rank.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int64(1) << 40


class PairTable:
    """Adjacent pairs of symbol ids with a rank and the id of the merged symbol.

    Ranks may repeat (ties go to the leftmost pair). ``every`` says that one step may apply all occurrences of a sequence's
    best pair; this equals one-at-a-time merging only where each merged symbol comes from exactly one pair, because then no
    pair that holds the new symbol can have a lower rank. Otherwise only the leftmost occurrence is applied in a step.
    """

    def __init__(self, left, right, rank, merged, every: bool):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.every = keys[order], every
        self.rank = np.append(np.asarray(rank, np.int64)[order], NONE)
        self.merged = np.append(np.asarray(merged, np.int64)[order], -1)
        self.dict: dict[int, int] | None = None

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair, or len(keys) if it has no rank."""
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every sequence to the end. Returns the surviving symbols and each sequence's number of them."""
        lengths = np.asarray(lengths, np.int64)
        symbols = np.asarray(symbols, np.int64)
        result: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sequence numbers, lengths, symbols
        number = np.arange(len(lengths))
        long = lengths > 96
        if long.any():
            owner = np.repeat(long, lengths)
            for k, part in zip(number[long], np.split(symbols[owner], np.cumsum(lengths[long])[:-1]), strict=True):
                out = np.asarray(self._merge_long(part.tolist()), np.int64)
                result.append((np.array([k]), np.array([len(out)]), out))
            symbols, number, lengths = symbols[~owner], number[~long], lengths[~long]
        keep = lengths > 0
        number, lengths = number[keep], lengths[keep]
        pair = self._pairs(symbols, lengths)
        while len(number):
            starts = np.cumsum(lengths) - lengths
            rank = self.rank[pair]
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                over = np.repeat(done, lengths)
                result.append((number[done], lengths[done], symbols[over]))
                symbols, pair, rank = symbols[~over], pair[~over], rank[~over]
                number, lengths, best = number[~done], lengths[~done], best[~done]
                if not len(number):
                    break
                starts = np.cumsum(lengths) - lengths
            hit = np.flatnonzero(rank == np.repeat(best, lengths))
            owner = np.searchsorted(starts, hit, side="right") - 1
            if self.every:
                first = np.empty(len(hit), bool)
                first[0] = True
                first[1:] = hit[1:] != hit[:-1] + 1  # a run of overlapping hits takes every other one from its left end
                run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
                chosen = (np.arange(len(hit)) - run) % 2 == 0
            else:
                chosen = np.empty(len(hit), bool)
                chosen[0] = True
                chosen[1:] = owner[1:] != owner[:-1]
            hit, owner = hit[chosen], owner[chosen]
            symbols[hit] = self.merged[pair[hit]]
            alive = np.ones(len(symbols), bool)
            alive[hit + 1] = False
            place = np.cumsum(alive) - 1
            symbols, pair = symbols[alive], pair[alive]
            lengths = lengths - np.bincount(owner, minlength=len(lengths))
            starts = np.cumsum(lengths) - lengths
            last = starts + lengths - 1
            changed = place[hit]
            before = changed[changed > starts[owner]] - 1
            changed = np.concatenate([changed, before])
            follows = changed + 1
            inside = np.ones(len(symbols), bool)
            inside[last] = False
            ok = inside[changed]
            pair[changed[~ok]] = len(self.keys)
            pair[changed[ok]] = self.find(symbols[changed[ok]], symbols[follows[ok]])
        if not result:
            return np.empty(0, np.int64), np.zeros(len(long), np.int64)
        count = np.zeros(len(long), np.int64)
        who = np.concatenate([r[0] for r in result])
        size = np.concatenate([r[1] for r in result])
        flat = np.concatenate([r[2] for r in result])
        count[who] = size
        begin = np.cumsum(count) - count
        target = np.repeat(begin[who] - (np.cumsum(size) - size), size) + np.arange(len(flat))
        out = np.empty(len(flat), np.int64)
        out[target] = flat
        return out, count

    def _pairs(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        pair = np.full(len(symbols), len(self.keys), np.int64)
        if len(symbols) > 1:
            inside = np.ones(len(symbols), bool)
            inside[np.cumsum(lengths) - 1] = False
            at = np.flatnonzero(inside)
            pair[at] = self.find(symbols[at], symbols[at + 1])
        return pair

    def _merge_long(self, s: list[int]) -> list[int]:
        """One long sequence: a heap of (rank, position) over a linked list, n log n instead of n steps over n symbols."""
        if self.dict is None:
            self.dict = {int(k): i for i, k in enumerate(self.keys)}
        find, rank, merged = self.dict.get, self.rank.tolist(), self.merged.tolist()
        n = len(s)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (k := find(s[i] << 20 | s[j])) is not None:
                heapq.heappush(heap, (rank[k], i, s[i], s[j], merged[k]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if s[i] == a else -1
            if j < 0 or s[j] != b:
                continue
            s[i], s[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in s if x >= 0]
