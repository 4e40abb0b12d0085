"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes, for one shard of texts."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the bytes of ``text``, sorted by their suffixes' first ``depth`` bytes or more.

    Groups are formed by the first eight bytes; then, as in Larsson and Sadakane's method, only groups of several suffixes are refined, by
    the ranks that lie as far ahead as the order is deep, which doubles the depth.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    array = np.argsort(key)
    ordered = key[array]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    group = np.repeat(first, np.diff(np.append(first, n)))
    rank[array] = group
    reach = 8
    while reach < depth:
        several = np.ones(n, bool)
        several[:-1] &= group[1:] != group[:-1]
        several[1:] &= group[1:] != group[:-1]
        at = np.flatnonzero(~several)
        if not len(at):
            break
        suffix = array[at]
        ahead = rank[np.minimum(suffix + reach, n)] + 1
        order = np.argsort((group[at].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64))
        array[at] = suffix = suffix[order]
        ahead, old = ahead[order], group[at]
        edge = np.ones(len(at), bool)
        edge[1:] = (old[1:] != old[:-1]) | (ahead[1:] != ahead[:-1])
        starts = np.flatnonzero(edge)
        group[at] = np.repeat(at[starts], np.diff(np.append(starts, len(at))))
        rank[suffix] = group[at]
        reach *= 2
    return array


#: Each so many positions, a common prefix is counted anew instead of being taken over from the position before.
ANEW = 1024


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """For each place in the suffix array the length of the prefix shared with the suffix before (counted to ``most``).

    Kasai's observation, for all positions at once: where the neighbour of position p is that of p - 1 moved on by one, the
    prefix is one byte shorter than at p - 1. Only the other positions, and every ANEW-th, are compared, eight bytes at a time.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    counted = np.ones(n, bool)
    # the byte before both must be equal, else the prefix at p - 1 is empty and says nothing
    counted[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (text[:-1] != text[before[1:] - 1])
    counted[::ANEW] = True
    counted &= before >= 0
    a = np.flatnonzero(counted)
    b = before[a]
    reach = most + ANEW
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = a[open_] + length[open_], b[open_] + length[open_]
        room = n - np.maximum(x, y)
        same = words[np.minimum(x, n)] == words[np.minimum(y, n)]
        run = np.where(same.all(1), 8, np.argmin(same, 1))
        run = np.minimum(run, np.maximum(room, 0))
        length[open_] += run
        open_ = open_[(run == 8) & (length[open_] < reach)]
    found = np.zeros(n, np.int64)
    found[a] = length
    # take over: the length at the last counted position, less the distance to it
    last = np.maximum.accumulate(np.where(counted | (before < 0), np.arange(n), 0))
    by_position = np.maximum(found[last] - (np.arange(n) - last), 0)
    by_position[before < 0] = 0
    return by_position[array]


def occurs(text: np.ndarray, places: np.ndarray, other: np.ndarray, ordered: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each place of the text are at one of the ``ordered`` places of the other, which are in the order of what follows them: by binary search for all places at once."""
    if not len(ordered):
        return np.zeros(len(places), bool)
    mine, theirs = (np.ndarray(len(t) + 1, ">u8", np.concatenate([t, np.zeros(8, np.uint8)]), strides=(1,)) for t in (text, other))
    chunks = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else []) if length >= 8 else None
    if chunks is None:
        raise ValueError("windows of under eight bytes")

    def compared(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the bytes at each of ``at`` are less, equal or more than those at ``to``."""
        sign, open_ = np.zeros(len(at), np.int8), np.arange(len(at))
        for k in chunks:
            x, y = mine[at[open_] + k].astype(np.uint64), theirs[to[open_] + k].astype(np.uint64)
            sign[open_] = (x > y).astype(np.int8) - (x < y)
            open_ = open_[x == y]
            if not len(open_):
                break
        return sign

    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(ordered), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) >> 1
        more = compared(places[open_], ordered[middle]) > 0
        low[open_] = np.where(more, middle + 1, low[open_])
        high[open_] = np.where(more, high[open_], middle)
    found = np.flatnonzero(low < len(ordered))
    out = np.zeros(len(places), bool)
    out[found] = compared(places[found], ordered[low[found]]) == 0
    return out
