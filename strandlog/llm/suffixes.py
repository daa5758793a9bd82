"""Suffix arrays by induced sorting, and common prefixes by the permuted way, of integer strings."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is of the smaller type (less than the next one); the last character is the unique least."""
    n = len(s)
    later = np.full(n, n, np.int64)  # the next place where neighbours differ
    differ = np.flatnonzero(s[1:] != s[:-1])
    later[: n - 1] = np.append(differ, n - 1)[np.searchsorted(differ, np.arange(n - 1))]
    at = np.minimum(later, n - 2)
    smaller = s[at] < s[at + 1]
    smaller[-1] = True
    return smaller


def _induce_by_suffix(s: np.ndarray, order: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> list:
    """As _induce_by_bucket, one suffix at a time: for alphabets as large as the string.

    larger_before, smaller_before: the character before a place if its suffix is of that type, else -1; so too for the
    empty slot -1, by the last entry.
    """
    sa = [-1] * n
    chars, places = s[order].tolist(), order.tolist()
    tail = ends.tolist()
    for i, c in zip(reversed(places), reversed(chars)):
        sa[tail[c]] = i
        tail[c] -= 1
    none = np.array([-1])
    larger_before = np.concatenate((none, np.where(smaller[:-1], -1, s[:-1]), none)).tolist()
    smaller_before = np.concatenate((none, np.where(smaller[:-1], s[:-1], -1), none)).tolist()
    head = starts.tolist()
    for i in sa:
        c = larger_before[i]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for r in range(n - 1, -1, -1):
        i = sa[r]
        c = smaller_before[i]
        if c >= 0:
            sa[tail[c]] = i - 1
            tail[c] -= 1
    return sa


def _push(sa: np.ndarray, s: np.ndarray, batch: np.ndarray, wanted: np.ndarray, at: np.ndarray, step: int) -> None:
    """Puts the suffixes before those of ``batch``, if ``wanted``, into their buckets in order; ``at``: the next free slots."""
    before = batch[batch > 0] - 1
    before = before[wanted[before]]
    if not len(before):
        return
    chars = s[before]
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    first = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
    sizes = np.diff(np.append(first, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(first, sizes)
    sa[at[chars] + step * rank] = before[order]
    at[chars[first]] += step * sizes


def _induce_by_bucket(s: np.ndarray, order: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The suffix array that the sorted leftmost-smaller suffixes ``order`` lead to, in two linear sweeps.

    A bucket's suffixes are taken all at once, then those that they brought into their own bucket, until none comes. The
    leading buckets of one suffix each (separators) are one batch, as none of them brings another.
    """
    sa = np.full(n, -1, np.int64)
    sizes = ends - starts + 1
    lead = int(np.argmax(sizes > 1)) if (sizes > 1).any() else len(sizes)
    larger, free = ~smaller, ends.copy()
    if larger[s < lead].any():  # separators of empty texts bring others
        lead = 0
    chars = s[order]
    by = np.argsort(chars, kind="stable")
    held = np.bincount(chars, minlength=len(sizes))
    sa[ends[chars[by]] - (np.repeat(np.cumsum(held), held) - 1 - np.arange(len(by)))] = order[by]
    head = starts.copy()
    _push(sa, s, sa[:lead], larger, head, 1)
    for c in range(lead, len(sizes)):
        now = starts[c]
        while now < head[c]:
            batch, now = sa[now : head[c]], head[c]
            _push(sa, s, batch, larger, head, 1)
        if held[c]:
            _push(sa, s, sa[ends[c] - held[c] + 1 : ends[c] + 1], larger, head, 1)
    for c in range(len(sizes) - 1, lead - 1, -1):
        now = ends[c]
        while now > free[c]:
            batch, now = sa[free[c] + 1 : now + 1][::-1], free[c]
            _push(sa, s, batch, smaller, free, -1)
        if head[c] > starts[c]:
            _push(sa, s, sa[starts[c] : head[c]][::-1], smaller, free, -1)
    return sa


def _induce(s: np.ndarray, order: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    if (ends > starts).sum() * 128 < n:
        return _induce_by_bucket(s, order, smaller, starts, ends, n)
    return np.array(_induce_by_suffix(s, order, smaller, starts, ends, n))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order. ``s`` holds dense ranks, and its last one, 0, occurs only there."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _types(s)
    sizes = np.bincount(s)
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(leftmost) > 1:
        rough = _induce(s, leftmost, smaller, starts, ends, n)
        is_left = np.zeros(n + 1, bool)
        is_left[leftmost] = True
        found = rough[is_left[rough]]
        # names of the substrings between leftmost-smaller places: equal to the one before or one higher
        stop = np.full(n, n - 1, np.int64)
        stop[leftmost[:-1]] = leftmost[1:]
        stop[leftmost[-1]] = leftmost[-1]
        size = stop[found] - found + 1
        same = size[1:] == size[:-1]
        left, step = np.flatnonzero(same), 0
        while len(left):
            differ = s[found[left] + step] != s[found[left + 1] + step]
            same[left[differ]] = False
            step += 1
            left = left[~differ & (size[left] > step)]
        new = np.concatenate(([True], ~same))
        names = np.zeros(n, np.int64)
        names[found] = np.cumsum(new) - 1
        reduced = names[leftmost]
        if reduced.max() + 1 < len(reduced):
            order = leftmost[suffix_array(reduced)]
        else:
            order = np.empty(len(reduced), np.int64)
            order[reduced] = leftmost
    else:
        order = leftmost
    return _induce(s, order, smaller, starts, ends, n)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one string, each followed by a separator of its own, in dense ranks; and the text's starts.
    The last separator is the least, and separators are less than all bytes."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    ends = starts[1:] - 1
    inside = np.ones(len(data), bool)
    inside[ends] = False
    used = np.bincount(data[inside], minlength=256) > 0
    out = (n - 1 + np.cumsum(used))[data].astype(np.int64)
    out[ends] = np.arange(n - 1, -1, -1)
    return out, starts


def common_prefixes(s: np.ndarray, sa: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix and the suffix before it in the array, within their texts.

    left: bytes of the text from each place on. In text order a length is one less than the last one where the same
    character stands before both suffixes; so only the other places are compared, eight bytes at a time.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    both = np.flatnonzero((phi > 0) & (np.arange(n) > 0))
    own[both] = s[both - 1] != s[phi[both] - 1]
    low = np.concatenate((s & 255, np.zeros(8, np.int64))).astype(np.uint64)
    wide = np.zeros(n + 1, np.uint64)
    for k in range(8):
        wide |= low[k : k + n + 1] << np.uint64(8 * k)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(own & (phi >= 0) & (left > 0))
    limit = np.minimum(left[at], left[phi[at]])
    at, limit = at[limit > 0], limit[limit > 0]
    step = 0
    while len(at):
        x = wide[at + step] ^ wide[phi[at] + step]
        stop = x != 0
        equal = np.log2((x[stop] & (~x[stop] + np.uint64(1))).astype(np.float64)).astype(np.int64) // 8
        out[at[stop]] = np.minimum(step + equal, limit[stop])
        step += 8
        full = ~stop & (limit <= step)
        out[at[full]] = limit[full]
        go = ~stop & (limit > step)
        at, limit = at[go], limit[go]
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return out[last] - (np.arange(n) - last)


def repeated_starts(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text, the starts of its substrings of ``size`` bytes that also start anywhere else in these texts."""
    if not texts:
        return []
    s, starts = joined(texts)
    sa = suffix_array(s)
    left = np.repeat(starts[1:] - 1, np.diff(starts)) - np.arange(len(s))
    before = common_prefixes(s, sa, left)
    best = before.copy()
    best[sa[:-1]] = np.maximum(best[sa[:-1]], before[sa[1:]])
    found = best >= size
    return [np.flatnonzero(found[a:b]) for a, b in zip(starts, starts[1:])]
