"""Suffix arrays of byte arrays in numpy, refined as far as `depth`, and common prefixes up to a cap."""

from __future__ import annotations

import numpy as np

LANES = 4096


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of suffixes by their first `depth` bytes or more, rank of each: equal ranks agree that far).

    Larsson-Sadakane refinement: sorted by 8 bytes, then each round sorts only the groups that are not
    yet single by the rank of the suffix h further on, and doubles h.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text.astype(np.uint64) + np.uint64(1)  # the end sorts first
    key = np.zeros(n, np.uint64)
    for j in range(7):  # 9 bits a byte
        key = (key << np.uint64(9)) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    rank, single = _groups(key[order])
    ranks = np.empty(n, np.int64)
    ranks[order] = rank
    h = 7
    while h < depth:
        at = np.flatnonzero(~single)  # places in `order` of groups with several members
        if not len(at):
            break
        suffixes = order[at]
        further = suffixes + h
        second = np.where(further < n, ranks[np.minimum(further, n - 1)] + 1, 0)
        both = (rank[at].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        inner = np.argsort(both, kind="stable")
        order[at] = suffixes[inner]
        both = both[inner]
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(both[1:], both[:-1], out=new[1:])
        starts = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[at] = at[starts]
        last = np.append(new[1:], True)
        single[at] = new & last
        ranks[order[at]] = rank[at]
        h *= 2
    return order, ranks


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key's group's first member, and whether the group has one member."""
    n = len(sorted_keys)
    new = np.ones(n, bool)
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0)), new & np.append(new[1:], True)


def common_prefixes(text: np.ndarray, order: np.ndarray, ranks: np.ndarray, cap: int) -> np.ndarray:
    """Per place in `order`: bytes shared with the suffix before it, at most cap.

    Kasai's walk in text order, in many lanes at once: each lane takes a stretch of the text and carries
    its last length less one. Where the suffix before is equal as far as the array is refined, their order is not
    known, and the lane starts again from nothing.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    padded = np.zeros(n + cap + 16, np.uint64)
    padded[:n] = text
    eight = np.zeros(n + cap + 8, np.uint64)  # the eight bytes from each place on
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(eight)]
    bounds = np.array([1 << (8 * k) for k in range(1, 8)], np.uint64)
    step = max(1, -(-n // LANES))
    lanes = np.arange(0, n, step)
    carry = np.zeros(len(lanes), np.int64)
    for k in range(step):
        i = lanes + k
        if i[-1] >= n:
            i = i[i < n]
            carry = carry[: len(i)]
        j = before[i]
        length = np.where(j >= 0, np.maximum(carry - 1, 0), 0)
        going = np.flatnonzero((j >= 0) & (length < cap))
        while len(going):
            differ = eight[i[going] + length[going]] ^ eight[j[going] + length[going]]
            length[going] += 8 - np.searchsorted(bounds, differ, side="right") - (differ != 0)
            going = going[(differ == 0) & (length[going] < cap)]
        length = np.where(j >= 0, np.minimum(np.minimum(length, cap), n - np.maximum(i, j)), 0)
        out[place[i]] = length
        tied = (j >= 0) & (ranks[i] == ranks[np.maximum(j, 0)])
        carry = np.where(tied, 0, length)
    return out
