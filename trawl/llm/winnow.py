"""Windows of a sequence grouped into segments by their least-hashed n-gram.

A window of ``width`` units holds ``width - gram + 1`` n-grams. Its anchor is the n-gram of least
hash, the leftmost of equals, so equal windows have equal anchors at equal offsets. Successive
windows with one anchor form a segment. Two facts make segments a lossless way to meet:
equal windows lie in segments of one anchor hash, and no window occurs twice in a segment.
"""

from __future__ import annotations

import numpy as np

from trawl.llm.common import U64, Powers, sliding_min, spread

_LOW = U64((1 << 20) - 1)


def segments(codes: np.ndarray, first: np.ndarray, width: int, gram: int, powers: Powers) -> dict[str, np.ndarray]:
    """Segments of all texts; units of text i are first[i]:first[i+1].

    Returns doc (index of text), start (unit in the text), count (windows), anchor (44 bits), hash
    (of all units the segment covers), prefix (for further hashes) and at (flat first unit).
    """
    n = np.diff(first)
    doc = np.flatnonzero(n >= width)
    none = np.zeros(0, np.int64)
    if not len(doc):
        return {"doc": none, "start": none, "count": none, "anchor": none, "hash": none.astype(U64), "prefix": none, "at": none}
    prefix = powers.prefix(codes)
    grams = powers.windows(prefix, gram, 3)
    in_doc = np.arange(len(codes)) - np.repeat(first[:-1], n)
    key = (grams & ~_LOW) | (in_doc[: len(grams)].astype(U64) & _LOW)
    least = sliding_min(key, width - gram + 1)
    starts = n[doc] - width + 1
    p = np.repeat(first[doc], starts) + spread(starts)
    k = least[p]
    new = np.ones(len(p), bool)
    new[1:] = k[1:] != k[:-1]
    new[np.cumsum(starts)[:-1]] = True
    s = np.flatnonzero(new)
    count = np.diff(np.append(s, len(p)))
    at = p[s]
    owner = np.repeat(doc, starts)[s]
    return {
        "doc": owner, "start": at - first[owner], "count": count, "anchor": (k[s] >> U64(20)).astype(np.int64),
        "hash": powers.ranges(prefix, at, at + count + width - 1, 5), "prefix": prefix, "at": at,
    }
