"""Union, intersection and difference of areas.

All rings are split where they meet. A piece belongs to the result's boundary if the result holds on one of its
sides only; such pieces, with the inside to their left, are walked into rings.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Callable

from . import geometry as g


def rings(shape) -> list[list]:
    return [[(p[0], p[1]) for p in ring] for kind, parts in g.singles(shape) if kind == "POLYGON" for ring in parts]


def split(lines: list[tuple], near: float) -> set[tuple]:
    """The segments cut at all points that they share with others; each piece once. Points nearer than `near` are one."""
    known: dict[tuple, tuple] = {}

    @functools.cache
    def snap(p: tuple) -> tuple:
        x, y = math.floor(p[0] / near), math.floor(p[1] / near)
        for cell in ((x + i, y + j) for i in (0, -1, 1) for j in (0, -1, 1)):
            if cell in known and g.flat(known[cell], p) <= near:
                return known[cell]
        return known.setdefault((x, y), (p[0], p[1]))

    lines = [(a, b) for a, b in ((snap(a), snap(b)) for a, b in lines) if a != b]
    found = set()
    for a, b in lines:
        cuts = {snap(a), snap(b)}
        low, high = (min(a[0], b[0]) - near, min(a[1], b[1]) - near), (max(a[0], b[0]) + near, max(a[1], b[1]) + near)
        for c, d in lines:
            if max(c[0], d[0]) < low[0] or max(c[1], d[1]) < low[1] or min(c[0], d[0]) > high[0] or min(c[1], d[1]) > high[1]:
                continue
            x = g.crossing(a, b, c, d)
            if x:
                cuts.add(snap(x))
            for p in (c, d):
                if low[0] <= p[0] <= high[0] and low[1] <= p[1] <= high[1] and g.flat(p, g.nearest(p, a, b)) <= near:
                    cuts.add(snap(p))
        order = sorted(cuts, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        found |= {tuple(sorted(pair)) for pair in zip(order, order[1:])}
    return found


def boundary_of(pieces: set[tuple], inside: Callable[[tuple], bool]) -> dict[tuple, list]:
    """For each vertex the vertices that pieces of the result's boundary lead to, the inside on their left."""
    onward = defaultdict(list)
    for p, q in pieces:
        dx, dy = (q[0] - p[0]) * 1e-5, (q[1] - p[1]) * 1e-5
        mx, my = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2
        left, right = inside((mx - dy, my + dx)), inside((mx + dy, my - dx))
        if left != right:
            onward[p if left else q].append(q if left else p)
    return onward


def walk(onward: dict[tuple, list]) -> list[list]:
    """Closed rings: at each vertex the first way on, clockwise from the one that led there."""
    found = []
    while onward:
        start = at = next(iter(onward))
        ring, before = [start], None
        while True:
            ways = onward[at]
            if before is None or len(ways) == 1:
                chosen = ways[0]
            else:
                back = math.atan2(before[1] - at[1], before[0] - at[0])
                chosen = min(ways, key=lambda w: (back - math.atan2(w[1] - at[1], w[0] - at[0])) % (2 * math.pi) or 2 * math.pi)
            ways.remove(chosen)
            if not ways:
                del onward[at]
            before, at = at, chosen
            ring.append(at)
            if at == start or at not in onward:
                break
        found.append(ring)
    return found


def straightened(ring: list, near: float) -> list:
    """The ring without points on a straight way."""
    body = ring[:-1]
    kept = [p for k, p in enumerate(body) if g.flat(p, g.nearest(p, body[k - 1], body[(k + 1) % len(body)])) > near]
    return [*kept, kept[0]] if len(kept) > 2 else []


def overlay(a, b, keep: Callable[[bool, bool], bool]):
    """The area in which `keep` holds of being inside a and inside b, as polygon or multipolygon; no parts if there is none."""
    lines = [s for shape in (a, b) for ring in rings(shape) for s in zip(ring, ring[1:]) if s[0] != s[1]]
    if not lines:
        return ("POLYGON", [])
    near = 2e-9 * max(1.0, *(abs(x) for s in lines for p in s for x in p))
    found = walk(boundary_of(split(lines, near), lambda p: keep(g.place(p, a) > 0, g.place(p, b) > 0)))
    closed = [r for ring in found if ring[0] == ring[-1] and (r := straightened(ring, 1e-3 * near))]
    shells = sorted(([r] for r in closed if g.ring_area(r) > 0), key=lambda s: g.ring_area(s[0]))
    for hole in (r for r in closed if g.ring_area(r) < 0):
        home = next((s for s in shells if all(g.place(p, ("POLYGON", [s[0]])) >= 0 for p in hole)), None)
        if home:
            home.append(hole)
    parts = [("POLYGON", s) for s in reversed(shells)]
    return g.collected(parts) if parts else ("POLYGON", [])
