"""Self-joins of binary tries of fingerprints: pairs of nodes are traversed together within an error budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of trie nodes held at once.
PAIRS = 1 << 18
#: Depths of which the counts of one bits are kept.
CACHED = 32


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits of fingerprints, rows of unsigned 64-bit lanes."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int16)


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Adds the edges a-b to components given by their roots (smallest members), in place."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def _crossed(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of leaves of pairs of nodes, each once."""
    wide = bhi - blo
    n = (ahi - alo) * wide
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = np.repeat(alo, n) + k // np.repeat(wide, n), np.repeat(blo, n) + k % np.repeat(wide, n)
    return a[a != b], b[a != b]


def close_pairs(group: np.ndarray, fps: np.ndarray, budget: int, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, unlike in `known`, whose fingerprints differ in at most `budget` bits; in lots.

    Rows are sorted by (group, fps); fps has a row of 64-bit lanes for each. A node of a group's binary trie
    is a range of rows. Pairs of nodes of equal depth are traversed together from (root, root); a pair's children are the pairs
    of their children, the differing bit of an unlike pair is counted, and a pair over the budget is dropped. So is a
    pair of which all leaves are alike in `known`, which the caller may change in place as it learns from the lots.
    Pairs of nodes wait on a stack in lots, so memory stays bounded.
    """
    n, bits = len(fps), 64 * fps.shape[1]
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    lo, hi = starts[many].astype(np.int32), ends[many].astype(np.int32)
    ones: dict[int, np.ndarray] = {}
    changes = None
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int16))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > PAIRS:
            for k in range(0, len(alo), PAIRS):
                stack.append((depth, *(x[k : k + PAIRS] for x in (alo, ahi, blo, bhi, err))))
            continue
        if changes is None:
            changes = np.r_[0, np.cumsum(known[1:] != known[:-1])].astype(np.int32)
        alike = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (known[alo] == known[blo])
        leaves = (ahi - alo == 1) & (bhi - blo == 1)
        if (at := np.flatnonzero(leaves & ~alike)).size:
            a, b = alo[at], blo[at]
            close = differing(fps[a], fps[b]) <= budget
            if close.any():
                yield a[close], b[close]
                changes = None
        go = ~(leaves | alike)
        if not go.any():
            continue
        alo, ahi, blo, bhi, err = (x[go] for x in (alo, ahi, blo, bhi, err))
        if depth == bits:  # equal fingerprints
            for k in range(0, len(alo), 1024):
                a, b = _crossed(*(x[k : k + 1024] for x in (alo, ahi, blo, bhi)))
                if (unlike := known[a] != known[b]).any():
                    yield a[unlike], b[unlike]
                    changes = None
            continue
        if depth not in ones:
            if depth > CACHED:
                ones = {d: c for d, c in ones.items() if d <= CACHED}
            ones[depth] = np.r_[0, np.cumsum((fps[:, depth >> 6] >> np.uint64(63 - (depth & 63))) & np.uint64(1))].astype(np.int32)
        c = ones[depth]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = alo == blo  # nodes of equal depth are the same or disjoint
        kids = []
        for (pl, ph), (ql, qh), more, keep in (((alo, amid), (blo, bmid), 0, True), ((amid, ahi), (bmid, bhi), 0, True), ((alo, amid), (bmid, bhi), 1, True), ((amid, ahi), (blo, bmid), 1, ~same)):
            ok = (ph > pl) & (qh > ql) & (err + more <= budget) & keep & ~((pl == ql) & (ph - pl == 1))
            kids.append((pl[ok], ph[ok], ql[ok], qh[ok], err[ok] + np.int16(more)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*kids))))


def linking(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs a-b one for each two components that they link."""
    ra, rb = root[a], root[b]
    of = np.where(ra == rb, -1, np.minimum(ra, rb) * np.int64(len(root)) + np.maximum(ra, rb))
    key, first = np.unique(of, return_index=True)
    first = first[key >= 0]
    return a[first], b[first]


def forest(group: np.ndarray, fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of "same group, at most `budget` differing bits": each row's root (the component's first row), and the
    ends of links that make the components; few more than rows."""
    root = np.arange(len(fps))
    found = []
    if len(fps) > 1:
        near = np.flatnonzero((group[1:] == group[:-1]) & (differing(fps[1:], fps[:-1]) <= budget))
        joined(root, near, near + 1)
        found.append((near, near + 1))
    for a, b in close_pairs(group, fps, budget, root):
        a, b = linking(root, a, b)
        joined(root, a, b)
        found.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=int),) * 2
    return root, a, b
