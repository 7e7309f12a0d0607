"""Threshold-bounded interval expansion on a Burrows-Wheeler transform.

The suffixes of several texts are sorted (each text ends in a separator of its own). Common
prefixes of neighbours are then found by increasing value: boundaries of value 0 lie where first
symbols differ; extending the intervals they part backward by the symbols of the transform gives
the boundaries of value 1, those give value 2, and so on, stopping at the minimum length. What
has no boundary by then shares that many bytes. Of the parts of an interval all but the largest
are walked, so the work is n log n whatever the values.
"""

from __future__ import annotations

import numpy as np

from trawl.llm.common import spread


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SA, rank) of symbols ``x`` where each 0 is a separator, distinct by position."""
    n = len(x)
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    padded = np.concatenate([x, np.zeros(8, x.dtype)])
    for j in range(7):
        s = padded[j : j + n]
        key = (key << np.uint64(9)) | np.where(alive, s, 0).astype(np.uint64)
        alive &= s != 0
    sa = np.argsort(key)
    k = key[sa]
    del key
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    new |= ~alive[sa]  # a separator within the key: unlike any other suffix, in any order
    new[1:] |= ~alive[sa[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    h = 7
    at = np.flatnonzero(~new | np.append(~new[1:], False))
    first = first[at]
    while len(at):
        pos = sa[at]
        pair = (first << 32) | rank[np.minimum(pos + h, n - 1)]
        order = np.argsort(pair)
        pair, pos = pair[order], pos[order]
        sa[at] = pos
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[pos] = first
        tied = ~new | np.append(~new[1:], False)
        at, first = at[tied], first[tied]
        h *= 2
    return sa, rank


def shared_prefixes(x: np.ndarray, least: int) -> np.ndarray:
    """Which suffixes share a prefix of ``least`` symbols or more with another one."""
    n = len(x)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    sa, rank = suffix_array(x)
    sa, rank = sa.astype(np.int32), rank.astype(np.int32)
    lf = rank[sa - 1]  # where the suffix one symbol longer stands (position -1: the last separator)
    psi = rank[(sa + 1) % n]
    head = x[sa]
    done = np.ones(n + 1, bool)  # boundaries found so far
    done[1:n] = (head[1:] != head[:-1]) | (head[1:] == 0)
    interval = np.zeros(n, np.int32)
    lo, hi = np.zeros(2 * n + 1, np.int32), np.zeros(2 * n + 1, np.int32)
    hi[0] = n
    used = 1
    fresh = np.flatnonzero(done[1:n]) + 1
    for _ in range(least - 1):
        if not len(fresh):
            break
        # the parts into which fresh boundaries cut their intervals
        g = interval[fresh]
        head_of = np.ones(len(g), bool)
        head_of[1:] = g[1:] != g[:-1]
        which = np.cumsum(head_of) - 1
        ids = g[head_of]
        slot = np.arange(len(fresh)) + which + 1  # one more part than boundaries in each interval
        start = np.empty(len(fresh) + len(ids), np.int64)
        start[slot] = fresh
        lead = slot[head_of] - 1
        start[lead] = lo[ids]
        end = np.empty_like(start)
        end[:-1] = start[1:]
        end[np.append(lead[1:], len(start)) - 1] = hi[ids]
        size = end - start
        group = np.zeros(len(start), np.int64)
        group[lead[1:]] = 1
        group = np.cumsum(group)
        most = np.maximum.reduceat(size, lead)
        big = np.flatnonzero(size == most[group])
        big = big[np.unique(group[big], return_index=True)[1]]
        lo[ids], hi[ids] = start[big], end[big]
        rest = np.ones(len(start), bool)
        rest[big] = False
        start, size = start[rest], size[rest]
        mine = np.arange(used, used + len(start), dtype=np.int32)
        lo[mine], hi[mine] = start, start + size
        used += len(start)
        walk = np.repeat(start, size) + spread(size)
        interval[walk] = np.repeat(mine, size)
        # extend backward: neighbours that the same symbol precedes and a boundary now parts
        k = lf[walk]
        k = np.concatenate([k, k + 1])
        k = k[~done[k]]
        k = np.sort(k[interval[psi[k - 1]] != interval[psi[k]]])
        fresh = k[np.append(True, k[1:] != k[:-1])] if len(k) else k
        done[fresh] = True
    same = np.flatnonzero(~done[1:n]) + 1
    out[sa[same]] = True
    out[sa[same - 1]] = True
    return out


def repeated_starts(data: np.ndarray, off: np.ndarray, least: int) -> np.ndarray:
    """Positions of ``data`` whose next ``least`` bytes, within one text, also start elsewhere."""
    x = np.zeros(len(data) + len(off) - 1, np.int16)
    at = np.arange(len(data)) + np.repeat(np.arange(len(off) - 1), np.diff(off))
    x[at] = data.astype(np.int16) + 1
    return shared_prefixes(x, least)[at]
