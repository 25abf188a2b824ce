"""Suffix arrays of byte strings by induced sorting, and their permuted common prefixes, in array steps.

Suffixes are classified as smaller (S) or larger (L) than the next one. The substrings between leftmost S suffixes
are sorted by inducing and get names; unless all names differ, the string of names is sorted the same way. From the sorted
leftmost S suffixes all L suffixes are induced in one pass over the buckets from the left, and all S suffixes in one from
the right. Where the symbols are few, a bucket is worked on as a whole: what it induces is appended to the
other buckets in its order, and what it induces into itself is the next piece of the same bucket.
"""

from __future__ import annotations

import numpy as np

#: With fewer entries a symbol than this on average, entries are induced one by one, else bucket by bucket.
_CROWD = 64


def _smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last, a unique least symbol, counts as smaller."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        differs = np.append(t[:-1] != t[1:], True)
        less = np.append(t[:-1] < t[1:], True)
        at = np.where(differs, np.arange(n), n)
        out = less[np.minimum.accumulate(at[::-1])[::-1]]
    return out


def _by_bucket(t: np.ndarray, small: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    n = len(t)
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    start = end - size
    sa = np.zeros(n, np.int32)
    code = t.astype(np.int32) * 2 + small
    held = np.bincount(t[first], minlength=k)
    seeds = first[np.argsort(t[first], kind="stable")].astype(np.int32)
    seed_at = np.cumsum(held) - held
    used = np.flatnonzero(size)

    head = start.copy()
    for c in used:
        lo, last = start[c], False
        while True:
            if lo < head[c]:
                batch, lo = sa[lo : head[c]], head[c]
            elif not last and held[c]:
                batch, last = seeds[seed_at[c] : seed_at[c] + held[c]], True
            else:
                break
            before = batch[batch > 0] - 1
            symbol = code[before]
            larger = (symbol & 1) == 0
            _append(sa, head, before[larger], symbol[larger] >> 1, k, 1)
    tail = end.copy()
    for c in used[::-1]:
        hi, last = end[c], False
        while True:
            if tail[c] < hi:
                batch, hi = sa[tail[c] : hi][::-1], tail[c]
            elif not last and head[c] > start[c]:
                batch, last = sa[start[c] : head[c]][::-1], True
            else:
                break
            before = batch[batch > 0] - 1
            symbol = code[before]
            smaller = (symbol & 1) == 1
            _append(sa, tail, before[smaller], symbol[smaller] >> 1, k, -1)
    sa[0] = n - 1  # the last symbol is induced by none
    return sa


def _append(sa: np.ndarray, edge: np.ndarray, entry: np.ndarray, symbol: np.ndarray, k: int, step: int) -> None:
    """Entries appended to their symbols' buckets in their order, from the left (step 1) or from the right (-1)."""
    if not len(entry):
        return
    order = np.argsort(symbol.astype(np.uint16) if k <= 1 << 16 else symbol, kind="stable")
    entry, symbol = entry[order], symbol[order]
    new = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
    count = np.diff(np.append(new, len(symbol)))
    place = np.arange(len(symbol)) - np.repeat(new, count)
    names = symbol[new]
    sa[np.repeat(edge[names], count) + (place if step > 0 else -1 - place)] = entry
    edge[names] += step * count


def _one_by_one(t: np.ndarray, small: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    n = len(t)
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    sa = np.full(n, -1, np.int64)
    order = first[np.argsort(t[first], kind="stable")]
    held = np.bincount(t[first], minlength=k)
    sa[np.repeat(end - held, held) + np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)] = order
    sa, text, kind = sa.tolist(), t.tolist(), small.tolist()
    head = (end - size).tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not kind[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = end.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and kind[j]:
            c = text[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = n - 1
    return np.array(sa, np.int32)


def words_of(t: np.ndarray) -> np.ndarray:
    """Four symbols of 16 bits from each position on, as one number."""
    wide = np.concatenate([t.astype(np.uint64), np.zeros(3, np.uint64)])
    n = len(t)
    return wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Starts of the suffixes in order. ``t`` has symbols below ``k``; the last one is 0 and occurs once."""
    n = len(t)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    small = _smaller(t)
    first = np.flatnonzero(np.append(False, small[1:] & ~small[:-1]))
    induce = _by_bucket if n > _CROWD * k else _one_by_one
    sa = induce(t, small, first, k)
    if len(first) > 1:
        leftmost = np.zeros(n, bool)
        leftmost[first] = True
        place = np.zeros(n, np.int64)
        place[first] = np.arange(len(first))
        order = sa[leftmost[sa]].astype(np.int64)
        length = np.diff(np.append(first, n))[place[order]]  # to the next leftmost one
        new = np.append(True, ~_equal(t, order[:-1], order[1:], length[:-1], length[1:]))
        name = np.cumsum(new) - 1
        if name[-1] + 1 < len(first):
            short = np.zeros(len(first), np.int64)
            short[place[order]] = name
            order = first[suffix_array(short, int(name[-1]) + 1)]
        sa = induce(t, small, order, k)
    return sa


def _equal(t: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether t[a : a + size] and t[b : b + size] and the symbols after them are the same."""
    out = size_a == size_b
    left, at, n = np.flatnonzero(out), 0, len(t)
    while len(left):
        x, y = a[left] + at, b[left] + at
        inside = (x < n) & (y < n)
        same = inside & (t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)])
        out[left[~same]] = False
        at += 1
        left = left[same]
        left = left[size_a[left] >= at]
    return out


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's predecessor in order (-1: none) and the length of their common prefix, by text position.

    Only where the symbols before a suffix and its predecessor differ are the two compared; elsewhere the length is that
    of the position before, less one. What is compared adds up to no more than 2 n log n symbols.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    fresh = (phi <= 0) | (at == 0)
    fresh[~fresh] = t[at[~fresh] - 1] != t[phi[~fresh] - 1]
    i = np.flatnonzero(fresh & (phi >= 0))
    length = np.zeros(len(i), np.int64)
    words = words_of(t)
    left = np.arange(len(i))
    while len(left):
        x, y = i[left] + length[left], phi[i[left]] + length[left]
        differs = words[x] ^ words[y]
        alike = differs == 0
        low = differs & (~differs + np.uint64(1))
        length[left] += np.where(alike, 4, (np.log2(np.maximum(low, np.uint64(1)).astype(float)) // 16).astype(np.int64))
        left = left[alike]
    reach = np.full(n, -1, np.int64)
    reach[i] = length + i
    return phi, np.maximum(np.maximum.accumulate(reach) - at, 0) * (phi >= 0)


def repeated(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each text, whether the ``length`` bytes from each start on also start somewhere else in the texts."""
    size = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"\0".join(texts), np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    t = np.append(data.astype(np.uint16) + np.uint16(2), np.uint16(0))
    t[begin[1:] - 1] = 1
    phi, shared = common_prefixes(t, suffix_array(t, 258))
    found = np.zeros(len(t), bool)
    pair = np.flatnonzero(shared >= length)
    found[pair] = found[phi[pair]] = True
    return [found[a : a + max(0, n - length + 1)] for a, n in zip(begin.tolist(), size.tolist())]
