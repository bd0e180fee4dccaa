"""Suffix arrays by two-stage sorting, in numpy.

Only suffixes smaller than their successor are sorted directly (by eight bytes at a time, ties refined); all others are
induced by one scan over the first-byte buckets in ascending order, each bucket handled at once: an entry of the scan
puts the suffix before it, if that is larger than its successor, at the next place of that suffix's bucket. Order beyond
``depth`` bytes is left open, so equal strings of that length stand next to each other; at the end of the text, zero
bytes and the end itself are not told apart.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros beyond the end."""
    t = np.concatenate([text, np.zeros(pad + 8, np.uint8)]).astype(np.uint64)
    a = (t[:-1] << np.uint64(8)) | t[1:]
    b = (a[:-2] << np.uint64(16)) | a[2:]
    return (b[:-4] << np.uint64(32)) | b[4:]


def rising(text: np.ndarray) -> np.ndarray:
    """Is each suffix smaller than its successor (the last is not)."""
    n = len(text)
    differs = np.concatenate([text[1:] != text[:-1], [True]])
    nearest = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]  # where the run of equal bytes ends
    up = np.concatenate([text[1:] > text[:-1], [False]])
    return up[nearest]


def _sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    if not len(at):
        return at
    at = at[np.argsort(words[at])]
    new = np.concatenate([[True], words[at[1:]] != words[at[:-1]]])
    place = np.arange(len(at))  # of those that are tied with a neighbour, with the begins of their groups
    for step in range(8, depth, 8):
        tied = ~(new & np.concatenate([new[1:], [True]]))
        place, new = place[tied], new[tied]
        if not len(place):
            break
        own = at[place]
        w = words[own + step]
        differs = np.concatenate([[False], w[1:] != w[:-1]]) & ~new
        if differs.any():  # only groups that differ here are sorted
            group = np.cumsum(new) - 1
            apart = np.zeros(group[-1] + 1, bool)
            apart[group[differs]] = True
            some = np.flatnonzero(apart[group])
            order = np.lexsort((w[some], group[some]))
            at[place[some]], w[some] = own[some[order]], w[some[order]]
            new = new | np.concatenate([[False], w[1:] != w[:-1]])
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of the bytes ``text``, sorted by their first ``depth`` bytes at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    up = rising(text)
    direct = _sort_directly(words_at(text, depth + 8), np.flatnonzero(up), depth)
    edge = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[~up[before]]
        if not len(before):
            return
        c = text[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        for i, j in zip(cuts, [*cuts[1:], len(c)], strict=True):
            waiting[c[i]].append(before[i:j])

    waiting[text[-1]].append(np.array([n - 1]))  # the last suffix, induced by the end of the text
    for c in range(256):
        while waiting[c]:
            got, waiting[c] = np.concatenate(waiting[c]), []
            out.append(got)
            induce(got)
        own = direct[edge[c] : edge[c + 1]]
        out.append(own)
        induce(own)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix in order has in common with the one before it."""
    words = words_at(text, most + 8)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for step in range(0, most, 8):
        a, b = words[order[live] + step], words[order[live - 1] + step]
        differ = a != b
        x = (a ^ b)[differ]
        lead = np.zeros(len(x), np.int64)
        for k in range(7, -1, -1):
            lead = np.where((x >> np.uint64(8 * k)) & np.uint64(255), lead, np.where(lead == 7 - k, lead + 1, lead))
        out[live[differ]] += np.minimum(lead, most - step)
        live = live[~differ]
        out[live] += min(8, most - step)
    return np.minimum(out, most)
