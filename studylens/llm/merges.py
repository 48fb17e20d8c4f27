"""Byte-pair merging with a score-ordered agenda, for many short strings at a time.

For each string the agenda holds one entry per adjacent pair of symbols that the vocabulary can
merge. The best entry (lowest rank, then leftmost) is taken, its symbols become one, and the
entries beside it are renewed, until no entry is left. ``merge_short`` keeps the agendas of all
strings in flat arrays and takes one entry of each string per step; ``merge_long`` is the same
with a heap, for strings where one step per merge would be slow. Both give the same symbols.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int32).max
SHORT = 40  # symbols; longer strings go through the heap


class PairTable:
    """(left, right) -> (rank, merged symbol), an open-addressed table in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.merged = np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        at, left_over, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left_over):  # every round, one key moves into each free slot that is asked for
            self.probes += 1
            slots = at[left_over]
            free = self.keys[slots] == -1
            taken, first = np.unique(slots[free], return_index=True)
            winners = left_over[free][first]
            self.keys[taken], self.rank[taken], self.merged[taken] = keys[winners], rank[winners], merged[winners]
            left_over = left_over[~np.isin(left_over, winners)]
            at[left_over] = (at[left_over] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such pair) and merged symbol of each pair."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys)
        rank, merged = self.rank[at], self.merged[at]
        wrong = np.flatnonzero(self.keys[at] != keys)
        rank[wrong] = NONE
        open_ = wrong[self.keys[at[wrong]] != -1]
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            slots = at[open_]
            hit = self.keys[slots] == keys[open_]
            rank[open_[hit]], merged[open_[hit]] = self.rank[slots[hit]], self.merged[slots[hit]]
            open_ = open_[~hit & (self.keys[slots] != -1)]
        return rank, merged


def merge_short(symbols: np.ndarray, offsets: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of many strings after all merges, and the strings' new offsets."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    final = np.full(len(symbols), -1, np.int64)
    place, sym = np.arange(len(symbols)), symbols.astype(np.int32)
    owner = np.repeat(np.arange(n), lengths)
    rank, merged = np.full(len(sym), NONE, np.int32), np.full(len(sym), -1, np.int32)
    inside = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
    rank[inside], merged[inside] = table.find(sym[inside], sym[inside + 1])
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(sym)))
        done = np.repeat(best == NONE, sizes)
        if done.any():
            final[place[done]] = sym[done]
            go = ~done
            sym, place, owner, rank, merged = sym[go], place[go], owner[go], rank[go], merged[go]
            keep = best != NONE
            best, sizes = best[keep], sizes[keep]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        own = owner[at]
        at = at[np.concatenate([[True], own[1:] != own[:-1]])]  # the leftmost of each string
        sym[at] = merged[at]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        at = at - np.arange(len(at))  # one symbol went from each string before
        sym, place, owner, rank, merged = sym[stay], place[stay], owner[stay], rank[stay], merged[stay]
        rank[at] = NONE
        near = np.concatenate([at, at[at > 0] - 1])
        near = near[near + 1 < len(sym)]
        near_in = near[owner[near] == owner[near + 1]]
        rank[near_in], merged[near_in] = table.find(sym[near_in], sym[near_in + 1])
    alive = final >= 0
    ends = np.concatenate([[0], np.cumsum(alive)])[offsets]
    return final[alive], ends


def merge_long(symbols: list[int], table: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same for one string of any length, with a heap."""
    sym, n = list(symbols), len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (found := table.get((sym[i], sym[j]))):
            heapq.heappush(agenda, (found[0], i, sym[i], sym[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, left, right, new = heapq.heappop(agenda)
        j = after[i]
        if sym[i] != left or j < 0 or sym[j] != right:
            continue  # one of the two has been merged meanwhile
        sym[i], sym[j] = new, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in sym if s >= 0]


def merge_strings(symbols: np.ndarray, offsets: np.ndarray, table: PairTable, pairs: dict) -> tuple[np.ndarray, np.ndarray]:
    """``merge_short`` where strings are short, ``merge_long`` for the others."""
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths > SHORT)
    if not len(long):
        return merge_short(symbols, offsets, table)
    short = np.repeat(lengths <= SHORT, lengths)
    kept = np.where(lengths <= SHORT, lengths, 0)
    done, ends = merge_short(symbols[short], np.concatenate([[0], np.cumsum(kept)]), table)
    parts = [done[ends[i] : ends[i + 1]] for i in range(len(lengths))]
    for i in long:
        parts[i] = np.array(merge_long(symbols[offsets[i] : offsets[i + 1]].tolist(), pairs), np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
