"""Multisets with signed weights as dicts from row tuples to weights: what the engine's results are held against."""

from collections import defaultdict


def add(*parts):
    out = defaultdict(int)
    for p in parts:
        for x, w in p.items():
            out[x] += w
    return {x: w for x, w in out.items() if w}


def negate(a):
    return {x: -w for x, w in a.items()}


def flat_map(a, f):
    out = defaultdict(int)
    for x, w in a.items():
        for y in f(x):
            out[y] += w
    return {x: w for x, w in out.items() if w}


def join(a, b, ka, kb, make):
    out = defaultdict(int)
    for x, v in a.items():
        for y, w in b.items():
            if ka(x) == kb(y):
                out[make(x, y)] += v * w
    return {x: w for x, w in out.items() if w}


def antijoin(a, b, ka):
    return {x: w for x, w in a.items() if not b.get(ka(x), 0)}


def reduce(a, key, value, f):
    groups = defaultdict(dict)
    for x, w in a.items():
        groups[key(x)][value(x)] = w
    out = defaultdict(int)
    for k, g in groups.items():
        for v, w in f(g):
            out[(*k, *v)] += w
    return {x: w for x, w in out.items() if w}


def distinct(a):
    return {x: 1 for x in a}


def counts(a):
    return {(*x, w): 1 for x, w in a.items()}


def triangles(xy, xz, yz):
    out = defaultdict(int)
    for (x, y), a in xy.items():
        for (x2, z), b in xz.items():
            if x == x2 and (y, z) in yz:
                out[x, y, z] += a * b * yz[y, z]
    return {x: w for x, w in out.items() if w}
