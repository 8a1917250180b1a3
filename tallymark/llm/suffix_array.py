"""Suffix arrays in numpy: prefix doubling after Larsson and Sadakane, common prefixes after Kasai."""

from __future__ import annotations

import numpy as np

_FIRST = 7  # bytes in the first sort key, nine bits each
_STRIPE = 512
_BYTE_ENDS = np.array([1 << (8 * k) for k in range(1, 8)], np.uint64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (uint8) in the order of their suffixes.

    Suffixes sorted by h bytes are sorted by 2h bytes with the rank of the suffix
    h further on. Only groups that are still unsorted are refined.
    """
    n = len(text)
    codes = np.zeros(n + _FIRST, np.uint64)
    codes[:n] = text
    codes[:n] += np.uint64(1)  # 0 stands after the end
    key = np.zeros(n, np.uint64)
    for k in range(_FIRST):
        key = (key << np.uint64(9)) | codes[k:k + n]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    members, keys, h = order, key[order], _FIRST
    while True:
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.append(head, len(keys)))
        rank[members] = np.repeat(slots[head], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not slots.size:
            return order
        members = order[slots]
        ahead = members + h
        further = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        keys = (rank[members] << 32) | further
        by = np.argsort(keys)
        members, keys = members[by], keys[by]
        order[slots] = members
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of ``order`` the length of the common prefix with the place before it.

    From one position to the next the common prefix loses one byte at most. The
    text is walked in stripes side by side, so each step handles one position of
    every stripe.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    padded = np.zeros(n + 16, np.uint64)
    padded[:n] = text
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words |= padded[k:k + len(words)] << np.uint64(8 * k)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    found = np.zeros(n, np.int64)
    at = np.arange(0, n, _STRIPE)
    same = np.zeros(len(at), np.int64)
    for _ in range(_STRIPE):
        inside = at < n
        at, same = at[inside], np.maximum(same[inside] - 1, 0)
        other = before[at]
        open_ = np.flatnonzero(other >= 0)
        while open_.size:
            i, j, h = at[open_], other[open_], same[open_]
            differ = words[i + h] ^ words[j + h]
            lowest = differ & (~differ + np.uint64(1))
            h = h + np.where(differ == 0, 8, np.searchsorted(_BYTE_ENDS, lowest, "right"))
            most = n - np.maximum(i, j)
            same[open_] = np.minimum(h, most)
            open_ = open_[(differ == 0) & (h < most)]
        same[other < 0] = 0
        found[at] = same
        at = at + 1
    return found[order]
