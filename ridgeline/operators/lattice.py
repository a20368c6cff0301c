"""Small planar subdivisions in one task, on a lattice of whole numbers.

Coordinates have at most 24 binary digits, so that every test of sides is exact
in 64 bits.  Crossings move to the lattice and segments are cut again until none
is left, so that what is drawn is consistent at any angle.
"""

from __future__ import annotations

import math

import numpy as np

#: Binary digits of coordinates, and pairs of segments that are looked at together.
DIGITS, PAIRS = 24, 1 << 20


def _turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the signed area of a segment's ends (x1, y1, x2, y2) and a point."""
    return (a[2] - a[0]) * (b[1] - a[1]) - (a[3] - a[1]) * (b[0] - a[0])


def _band(e: np.ndarray, d: float, quarter: int) -> list[np.ndarray]:
    """The band along edges (x1, y1, x2, y2): a rectangle for every edge, and
    for every vertex the corners of a disc in the directions that none of its
    edges' rectangles has, as polygons, arrays of (x, y)."""
    dx, dy = e[2] - e[0], e[3] - e[1]
    long = np.hypot(dx, dy)
    out, around = [], {}
    for x1, y1, x2, y2, u, v, n in zip(*e.tolist(), dx.tolist(), dy.tolist(), long.tolist()):
        one, two = around.setdefault((x1, y1), set()), around.setdefault((x2, y2), set())
        if n > 0:
            nx, ny = -v / n * d, u / n * d
            out.append(np.array([(x1 + nx, y1 + ny), (x1 - nx, y1 - ny), (x2 - nx, y2 - ny), (x2 + nx, y2 + ny)]))
            one.add(math.atan2(v, u))
            two.add(math.atan2(-v, -u))
    step = math.pi / 2 / quarter
    for (x, y), ways in around.items():
        lo, hi, begin = 0, 4 * quarter - 1, True
        if ways:
            first = min(ways)
            turns = [math.remainder(w - first, 2 * math.pi) for w in ways]
            low, high = max(0.0, max(turns)), min(math.pi, min(turns) + math.pi)
            if low >= high:
                continue
            # the disc's corners from before to behind, so that nothing is left between
            lo, hi, begin = math.floor((first + math.pi / 2 + low) / step - 1e-9), math.ceil((first + math.pi / 2 + high) / step + 1e-9), False
        k = np.arange(lo, min(hi, lo + 4 * quarter - 1) + 1) * step
        arc = np.stack([x + d * np.cos(k), y + d * np.sin(k)], axis=1)
        out.append(arc if begin else np.concatenate([[(x, y)], arc]))
    return out


def _odd(segs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments (4, n) from their lower to their higher end and their owners,
    without points and without those that an owner has an even number of times."""
    swap = (segs[0] > segs[2]) | ((segs[0] == segs[2]) & (segs[1] > segs[3]))
    segs = np.where(swap, segs[[2, 3, 0, 1]], segs)
    some = (segs[0] != segs[2]) | (segs[1] != segs[3])
    rows, n = np.unique(np.concatenate([segs[:, some], owner[None, some]]), axis=1, return_counts=True)
    rows = rows[:, n % 2 == 1]
    return rows[:4], rows[4]


def _marks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (which, (x, y)) where distinct segments are cut by others."""
    low, high = np.minimum(s[1], s[3]), np.maximum(s[1], s[3])
    which, places = [np.zeros(0, np.int64)], [np.zeros((2, 0), np.int64)]
    n = s.shape[1]
    rows = max(1, PAIRS // max(n, 1))
    for at in range(0, n, rows):
        r = slice(at, at + rows)
        near = (s[0, r, None] <= s[2]) & (s[2, r, None] >= s[0]) & (low[r, None] <= high) & (high[r, None] >= low)
        i, j = np.nonzero(near)
        i += at
        i, j = i[i < j], j[i < j]
        a, b = s[:, i], s[:, j]
        d1, d2, d3, d4 = _turn(a, b[:2]), _turn(a, b[2:]), _turn(b, a[:2]), _turn(b, a[2:])
        cross = np.flatnonzero((np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0))
        t = d3[cross] / (d3[cross] - d4[cross])
        place = a[:2, cross] + np.rint(t * (a[2:, cross] - a[:2, cross])).astype(np.int64)
        which += [i[cross], j[cross]]
        places += [place, place]
        for d, own, p, k in ((d1, a, b[:2], i), (d2, a, b[2:], i), (d3, b, a[:2], j), (d4, b, a[2:], j)):
            on = np.flatnonzero((d == 0) & (own[0] <= p[0]) & (p[0] <= own[2]) & (np.minimum(own[1], own[3]) <= p[1]) & (p[1] <= np.maximum(own[1], own[3])))
            which.append(k[on])
            places.append(p[:, on])
    which, places = np.concatenate(which), np.concatenate(places, axis=1)
    inner = (places != s[:2, which]).any(axis=0) & (places != s[2:, which]).any(axis=0)
    return which[inner], places[:, inner]


def noded(segs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of segments (4, n) of whole numbers, which meet in their ends
    only, and their owners: a row for every owner."""
    while True:
        segs, owner = _odd(segs, owner)
        only, back = np.unique(segs, axis=1, return_inverse=True)
        back = back.reshape(-1)
        which, places = _marks(only)
        if not len(which):
            return segs, owner
        n = only.shape[1]
        at = np.concatenate([np.arange(n), np.arange(n), which])
        p = np.concatenate([only[:2], only[2:], places], axis=1)
        along = ((p - only[:2, at]) * (only[2:, at] - only[:2, at])).sum(axis=0)
        order = np.lexsort((p[1], p[0], along, at))
        at, p = at[order], p[:, order]
        follows = at[1:] == at[:-1]
        pieces, of = np.concatenate([p[:, :-1], p[:, 1:]])[:, follows], at[1:][follows]
        count = np.bincount(of, minlength=n)
        first = np.cumsum(count) - count
        many = count[back]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        segs, owner = pieces[:, np.repeat(first[back], many) + nth], np.repeat(owner, many)


def drawn(segs: np.ndarray, owner: np.ndarray, left: int, rule) -> list[np.ndarray]:
    """Rings, arrays (x, y, ax, ay) of their sides, of what ``rule`` keeps by the
    numbers of polygons on either side (``planar.RULES``): owners below ``left``
    are one set, the others the other one.  Each holds its inside by parity."""
    segs, owner = noded(segs, owner)
    only, back = np.unique(segs, axis=1, return_inverse=True)
    back = back.reshape(-1)
    n = only.shape[1]
    order = np.argsort(owner, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(owner[order]) > 0]))
    second = owner[order][first] >= left
    row = np.searchsorted(owner[order][first], owner)
    here, there = np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
    rows = max(1, PAIRS // max(len(owner), 1))
    twice, (mx, my) = 2 * only, (only[:2] + only[2:])
    rising = np.sign(twice[3] - twice[1])
    for at in range(0, n, rows):
        x, y = mx[at : at + rows, None], my[at : at + rows, None]
        across = (twice[1] > y) != (twice[3] > y)
        ahead = ((twice[2] - twice[0]) * (y - twice[1]) - (twice[3] - twice[1]) * (x - twice[0])) * rising > 0
        hit = (across & ahead)[:, back[order]]
        inside = np.bitwise_xor.reduceat(hit, first, axis=1)
        other = inside.copy()
        mine = np.flatnonzero((back >= at) & (back < at + rows))
        other[back[mine] - at, row[mine]] ^= True
        for out, m in ((here, inside), (there, other)):
            out[:, at : at + rows] = m[:, ~second].sum(axis=1), m[:, second].sum(axis=1)
    one, two = rule(*here), rule(*there)
    some = np.flatnonzero(one != two)
    s, one = only[:, some], one[some]
    forth = np.where(s[1] == s[3], one, one != (s[3] > s[1]))
    return _rings(np.where(forth, s, s[[2, 3, 0, 1]]))


def _rings(s: np.ndarray) -> list[np.ndarray]:
    """Directed sides (x, y, ax, ay) that have what they bound on one side, ring
    by ring, each from its lowest place."""
    n = s.shape[1]
    ends = np.concatenate([s, s[[2, 3, 0, 1]]], axis=1)  # outs, then ins
    angle = np.arctan2((ends[3] - ends[1]).astype(float), (ends[2] - ends[0]).astype(float))
    order = np.lexsort((angle, ends[1], ends[0]))
    node = (np.diff(ends[:2, order], axis=1) != 0).any(axis=0)
    first = np.flatnonzero(np.concatenate([[True], node])) if n else np.zeros(0, np.int64)
    turn = np.append(order[1:], -1)
    turn[np.append(first[1:], 2 * n)[: len(first)] - 1] = order[first]
    prev = np.empty(2 * n, np.int64)
    prev[order] = turn[: 2 * n]
    prev = prev[:n] - n
    if (prev < 0).any():
        raise ValueError("sides of one result follow each other both forth or back")
    after = np.empty(n, np.int64)
    after[prev] = np.arange(n)
    after, done, out = after.tolist(), [False] * n, []
    for i in np.lexsort((s[1], s[0])).tolist():
        ring = []
        while not done[i]:
            done[i] = True
            ring.append(i)
            i = after[i]
        if ring:
            out.append(s[:, ring])
    return out


def buffered(e: np.ndarray, distance: float, quarter: int) -> list[np.ndarray]:
    """Rings, arrays (x, y, ax, ay) of their sides, of a polygon's edges (x1, y1,
    x2, y2) widened by ``distance`` or, if it is negative, drawn in by it."""
    band = _band(e, abs(distance), quarter)
    wide = max(e[[0, 2]].max() - e[[0, 2]].min(), e[[1, 3]].max() - e[[1, 3]].min()) + 2 * abs(distance)
    unit = 2.0 ** (math.frexp(wide or 1.0)[1] - DIGITS)
    origin = np.floor(np.array([e[[0, 2]].min(), e[[1, 3]].min()]) / unit) * unit
    sides = [np.concatenate([v, np.roll(v, -1, axis=0)], axis=1).T for v in band]
    owner = np.repeat(np.arange(1 + len(band)), [e.shape[1], *(v.shape[1] for v in sides)])
    both = np.tile(origin, 2)[:, None]
    segs = np.rint((np.concatenate([e, *sides], axis=1) - both) / unit).astype(np.int64)
    rule = (lambda a, b: (a > 0) | (b > 0)) if distance >= 0 else (lambda a, b: (a > 0) & (b == 0))
    return [r * unit + both for r in drawn(segs, owner, 1, rule)]
