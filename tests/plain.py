"""Plain-Python versions of shape operators, cell by cell, for the tests of what is built on them."""

import math

TURNS = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))


def disk(r):
    return [(x, y) for x in range(-r, r + 1) for y in range(-r, r + 1) if x * x + y * y <= r * r]


def dilate(cells, r):
    return {(x + dx, y + dy) for x, y in cells for dx, dy in disk(r)}


def erode(cells, r):
    return {(x, y) for x, y in cells if all((x + dx, y + dy) in cells for dx, dy in disk(r))}


def groups(cells, dist):
    """Lists of cells that lie within dist of one another, directly or through others."""
    left, out = set(cells), []
    reach = math.floor(dist)
    steps = [(x, y) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1) if x * x + y * y <= dist * dist]
    while left:
        found, todo = set(), [left.pop()]
        while todo:
            x, y = todo.pop()
            found.add((x, y))
            near = {(x + dx, y + dy) for dx, dy in steps} & left
            left -= near
            todo += near
        out.append(found)
    return out


def largest(cells, dist):
    every = groups(cells, dist)
    return max(every, key=lambda g: (len(g), [(-x, -y) for x, y in [min(g)]])) if every else set()


def area2(loop):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, loop[1:] + loop[:1]))


def trace(cells):
    edge = {(x, y) for x, y in cells if any((x + dx, y + dy) not in cells for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))}
    loops = []
    for part in groups(edge, 1.5):
        if len(part) < 4:
            continue
        at, way, seen, path = min(part, key=lambda p: (-p[1], p[0])), 0, set(), []
        while (at, way) not in seen:
            seen.add((at, way))
            path.append(at)
            for k in range(8):
                d = (way + 6 + k) % 8
                to = (at[0] + TURNS[d][0], at[1] + TURNS[d][1])
                if to in part:
                    at, way = to, d
                    break
        loop = []
        for p in path:
            if len(loop) > 1 and loop[-2] == p:
                loop.pop()
            elif not loop or loop[-1] != p:
                loop.append(p)
        loops.append(loop[:-1] if len(loop) > 1 and loop[0] == loop[-1] else loop)
    if not loops:
        return []
    best = max(loops, key=lambda p: (abs(area2(p)), len(p), p))
    best = best[::-1] if area2(best) < 0 else best
    first = best.index(min(best, key=lambda p: (-p[1], p[0])))
    return best[first:] + best[:first]


def edges(loop):
    return list(zip(loop, loop[1:] + loop[:1]))


def rasterize(loop):
    out = set(loop)
    for x in range(min((p[0] for p in loop), default=0), max((p[0] for p in loop), default=-1)):
        hits = sorted(a[1] + (b[1] - a[1]) * ((x + 0.5 - a[0]) / (b[0] - a[0])) for a, b in edges(loop) if min(a[0], b[0]) <= x < max(a[0], b[0]))
        for lo, hi in zip(hits[::2], hits[1::2]):
            out |= {(x, y) for y in range(math.ceil(lo - 0.5), math.floor(hi - 0.5) + 1)}
    return out


def inside(p, loop):
    """Even-odd, the edge counts."""
    x, y = p
    odd = False
    for (x0, y0), (x1, y1) in edges(loop):
        if (y1 - y0) * (x - x0) == (x1 - x0) * (y - y0) and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1):
            return True
        if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
            odd = not odd
    return odd


def fill_enclosed(cells):
    if not cells:
        return set()
    x0, x1 = min(x for x, _ in cells) - 1, max(x for x, _ in cells) + 1
    y0, y1 = min(y for _, y in cells) - 1, max(y for _, y in cells) + 1
    outside, todo = {(x0, y0)}, [(x0, y0)]
    while todo:
        x, y = todo.pop()
        for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if x0 <= n[0] <= x1 and y0 <= n[1] <= y1 and n not in cells and n not in outside:
                outside.add(n)
                todo.append(n)
    return {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} - outside


def outline_width(cells, loop, rays=64):
    cx, cy = (sum(p[i] for p in loop) / len(loop) for i in (0, 1))
    best = None
    for k in range(rays):
        t, near = k * 2 * math.pi / rays, []
        for x, y in cells:
            r = math.hypot(x - cx, y - cy)
            off = abs((math.atan2(y - cy, x - cx) - t + math.pi) % (2 * math.pi) - math.pi)
            if r == 0 or off <= 1.25 / r + 1e-12:
                near.append(r)
        if near:
            best = min(max(near) - min(near), best if best is not None else math.inf)
    return best


def perimeter(loop):
    done = 0.0
    for a, b in edges(loop):  # in order, as running sums are made
        done += math.dist(a, b)
    return done


def at_arc(loop, share):
    """(index of the last vertex before, interpolated place) at a share of the perimeter."""
    want, done = (share % 1) * perimeter(loop), 0.0
    for i, (a, b) in enumerate(edges(loop)):
        length = math.dist(a, b)
        if done <= want < done + length:
            t = (want - done) / length
            return i, (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
        done += length
    raise ValueError(share)
