"""Repeated strings of a fixed length in a small text, by interval expansion on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of text (uint8) in order of their first ``depth`` bytes at least.

    Prefix doubling from 8 bytes on; only rotations that still tie are sorted again.
    """
    n = len(text)
    padded = np.concatenate([text, np.resize(text, 8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)  # the place of the first of a rotation's group
    done = 8
    while True:
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = first
        if done >= depth:
            return order
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        own = order[at].astype(np.int64)
        key = first[at] * n + rank[(own + done) % n]
        by = np.argsort(key, kind="stable")
        order[at] = order[at][by]
        key = key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head[at] |= new
        done *= 2


def equal_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rotations, and at each place whether its rotation and the one before share ``length`` bytes.

    Common prefixes are derived in increasing value: those of value v + 1 follow from those of value v by one
    step of backward extension. The value at p is one more than the least value between the places of the
    rotations that follow those at p - 1 and at p. Where these two are neighbours the step is a lookup; the rest
    asks whether a boundary lies between them. Values of ``length`` and more are never derived.
    """
    n = len(text)
    order = suffix_order(text, length + 1)
    transform = text[order - 1]
    after = np.argsort(transform, kind="stable").astype(np.int32)  # the place of the rotation one byte on
    to = np.empty(n, np.int32)
    to[after] = np.arange(n, dtype=np.int32)
    first = transform[after]
    known = np.empty(n, bool)
    known[0] = True
    known[1:] = first[1:] != first[:-1]
    single = np.zeros(n, bool)  # of q: the rotations that extend those at q - 1 and q are neighbours too
    single[1:] = transform[1:] == transform[:-1]
    fresh = np.flatnonzero(known)
    open_ = np.flatnonzero(~known)
    open_ = open_[after[open_ - 1] + 1 != after[open_]]
    low, high = after[open_ - 1], after[open_]
    for _ in range(1, length):
        if not len(fresh):
            break
        new = to[fresh[single[fresh]]]
        new = new[~known[new]]
        if len(open_):
            count = np.cumsum(known, dtype=np.int32)
            hit = count[low] != count[high]
            more = open_[hit]
            keep = ~hit
            open_, low, high = open_[keep], low[keep], high[keep]
            new = np.concatenate([new, more])
        known[new] = True
        fresh = new
    return order, ~known


def repeated(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of ``starts``: whether its string of ``length`` bytes also starts at another of them."""
    if len(text) == 0 or len(starts) == 0:
        return np.zeros(len(starts), bool)
    order, same = equal_prefixes(text, length)
    group = np.empty(len(text), np.int32)
    group[order] = np.cumsum(~same, dtype=np.int32)
    own = group[starts]
    return np.bincount(own)[own] > 1
