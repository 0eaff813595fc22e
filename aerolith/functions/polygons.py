"""Polygons as lists of rings of points: cutting by a box into pieces, areas."""

from __future__ import annotations


def signed_area(ring: list) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring[-1:] + ring[:-1], ring, strict=True)) / 2


def _wound(rings: list) -> list:
    """Exterior counterclockwise, holes clockwise, without repeated points; empty where the exterior has no area."""
    out = []
    for i, ring in enumerate(rings):
        points = [(float(x), float(y)) for x, y in ring]
        points = [p for p, q in zip(points, points[-1:] + points[:-1], strict=True) if p != q] or points[:1]
        area = signed_area(points)
        if area:
            out.append(points if (area > 0) == (i == 0) else points[::-1])
        elif i == 0:
            return []
    return out


def _within(point: tuple, ring: list) -> bool:
    x, y = point
    inside = False
    for (ax, ay), (bx, by) in zip(ring[-1:] + ring[:-1], ring, strict=True):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            inside = not inside
    return inside


def cut_half(rings: list, axis: int, limit: float, sign: int) -> list[list]:
    """Of a wound polygon the pieces on one side of an axis-parallel line.

    The line crosses the rings an even number of times; between the first crossing along it and the second, the third and the
    fourth, and so on, it runs inside the polygon, and pieces are closed along those stretches.
    """
    whole, chains = [], []
    for ring in rings:
        side = [sign * (p[axis] - limit) for p in ring]
        if min(side) >= 0:
            whole.append(ring)
            continue
        if max(side) <= 0:
            continue
        start = next(i for i, d in enumerate(side) if d < 0)
        chain: list | None = None
        for k in range(1, len(ring) + 1):
            i, j = (start + k - 1) % len(ring), (start + k) % len(ring)
            if (side[i] < 0) != (side[j] < 0):
                t = side[i] / (side[i] - side[j])
                other = ring[i][1 - axis] + t * (ring[j][1 - axis] - ring[i][1 - axis])
                at = (limit, other) if axis == 0 else (other, limit)
                if side[j] >= 0:
                    chain = [at]
                else:
                    chains.append([*chain, at])
                    chain = None
            if side[j] >= 0:
                chain.append(ring[j])
    ends = sorted([(c[0][1 - axis], n, 0) for n, c in enumerate(chains)] + [(c[-1][1 - axis], n, 1) for n, c in enumerate(chains)])
    partner = {}
    for a, b in zip(ends[::2], ends[1::2], strict=True):
        partner[a[1:]], partner[b[1:]] = b[1:], a[1:]
    made, used = [], set()
    for first in range(len(chains)):
        if first in used:
            continue
        ring, n = [], first
        while n not in used:
            used.add(n)
            ring += chains[n]
            m, end = partner[n, 1]
            n = m if end == 0 else first  # rings that cross themselves can lead to an end
        made.append(ring)
    pieces = [[r] for r in [*whole, *made] if signed_area(r) > 0]
    for hole in (r for r in [*whole, *made] if signed_area(r) < 0):
        for piece in pieces:
            if _within(hole[0], piece[0]) or hole[0] in piece[0]:
                piece.append(hole)
                break
    return pieces


def clipped(rings: list, x0: float, y0: float, x1: float, y1: float) -> list[list]:
    """The pieces of a polygon (exterior, then holes) within a box."""
    wound = _wound(rings)
    pieces = [wound] if wound else []
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        pieces = [p for piece in pieces for p in cut_half(piece, axis, limit, sign)]
    return pieces


def area(rings: list) -> float:
    """Of a wound polygon."""
    return sum(map(signed_area, rings))
