"""Contour samples, measures, matches, halo and ordered look-ups against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import compare as CO
from rasterloom.operators import contours as K
from rasterloom.operators import groups as G
from rasterloom.operators import layers as L
from rasterloom.operators import model as M
from rasterloom.operators import ordered as O
from rasterloom.operators import points as T
from rasterloom.operators import stats as S

from . import plain as P


def disk(cx, cy, r):
    return {(x, y) for x in range(cx - r, cx + r + 1) for y in range(cy - r, cy + r + 1) if (x - cx) ** 2 + (y - cy) ** 2 <= r * r}


BLOBS = {
    1: disk(20, 20, 9) - disk(20, 20, 5),
    2: {(x, y) for x in range(30) for y in range(5)} | {(x, y) for x in range(6) for y in range(5, 22)},
    7: disk(12, 9, 6) | disk(22, 12, 5),
}
LOOPS = {i: P.trace(c) for i, c in BLOBS.items()}


def points(spark, shapes):
    return spark.createDataFrame([(i, x, y) for i, cells in shapes.items() for x, y in cells], "shape_id long, x int, y int").cache()


def contours(spark, loops=None):
    rows = [(i, k, *p) for i, loop in (loops or LOOPS).items() for k, p in enumerate(loop)]
    return spark.createDataFrame(rows, "shape_id long, ord int, x int, y int").cache()


def scan_of(spark, shapes=BLOBS):
    """Darkness that falls with the distance from a shape, with some texture."""
    rows = []
    for i, cells in shapes.items():
        for x in range(-4, 44):
            for y in range(-4, 44):
                d = min(math.dist((x, y), c) for c in cells)
                rows.append((i, x, y, max(0.0, 1 - d / 6) * (0.6 + 0.4 * ((x * 7 + y * 13) % 10) / 10)))
    return spark.createDataFrame(rows, "frame_id long, x int, y int, value double").cache()


# -- outlines


def test_traced_loops_equal_the_walk(spark):
    out = {}
    for r in K.trace(points(spark, BLOBS)).orderBy("ord").collect():
        out.setdefault(r.shape_id, []).append((r.x, r.y))
    assert out == LOOPS


@pytest.mark.parametrize("r", [1, 3])
def test_contours_expand_and_contract(spark, r):
    for op, plain in ((K.expand, P.dilate), (K.contract, P.erode)):
        out = {}
        for row in op(contours(spark), r).orderBy("ord").collect():
            out.setdefault(row.shape_id, []).append((row.x, row.y))
        want = {i: P.trace(plain(P.rasterize(loop), r)) for i, loop in LOOPS.items()}
        assert out == {i: loop for i, loop in want.items() if loop}


def test_places_by_arc_and_equal_distances(spark):
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.25, -0.25]
    asked = spark.createDataFrame([(i, s) for i in LOOPS for s in shares], "shape_id long, share double")
    out = {(r.shape_id, r.share): (r.ord, r.x, r.y) for r in K.at_arc(contours(spark), asked).collect()}
    for (i, s), (ord_, x, y) in out.items():
        k, place = P.at_arc(LOOPS[i], s)
        assert ord_ == k and (x, y) == pytest.approx(place)
    assert len(out) == len(LOOPS) * len(shares)
    even = {(r.shape_id, r.ord): (r.x, r.y) for r in K.resample(contours(spark), 12).collect()}
    assert even == {(i, k): pytest.approx(P.at_arc(LOOPS[i], k / 12)[1]) for i in LOOPS for k in range(12)}


def test_strokes_dab_at_equal_arcs(spark):
    out = {}
    for r in K.stroke(contours(spark), 4.0).collect():
        out.setdefault(r.shape_id, []).append((r.x, r.y))
    for i, loop in LOOPS.items():
        n = max(1, math.floor(P.perimeter(loop) / 4))
        want = [tuple(math.floor(v + 0.5) for v in P.at_arc(loop, k / n)[1]) for k in range(n)]
        assert sorted(out[i]) == sorted(want)
    brush = L.Brush(-16777216, 3)
    cells = {(r.shape_id, r.x, r.y) for r in L.stamp_points(K.stroke(contours(spark), 4.0), brush).collect()}
    assert cells == {(i, x + a, y + b) for i, dabs in out.items() for x, y in dabs for a in (-1, 0, 1) for b in (-1, 0, 1)}


def test_outline_width_and_missing_columns(spark):
    width = {r.shape_id: r.width for r in K.outline_width(points(spark, BLOBS), contours(spark)).collect()}
    assert width == {i: pytest.approx(P.outline_width(BLOBS[i], LOOPS[i])) for i in BLOBS}
    gone = {i: {c for c in cells if c[0] % 5} for i, cells in BLOBS.items()}
    filled = {i: set() for i in BLOBS}
    for r in K.fill_missing_columns(points(spark, gone), contours(spark), 3).collect():
        filled[r.shape_id].add((r.x, r.y))
    for i, loop in LOOPS.items():
        line = set()
        for (x0, y0), (x1, y1) in P.edges(loop):
            n = max(abs(x1 - x0), abs(y1 - y0))
            line |= {(math.floor(x0 + (x1 - x0) * k / max(n, 1) + 0.5), math.floor(y0 + (y1 - y0) * k / max(n, 1) + 0.5)) for k in range(n + 1)}
        assert filled[i] == gone[i] | P.dilate(line, 3) & P.rasterize(loop)


@pytest.mark.parametrize("diagonals", [True, False])
def test_the_magic_wand_stays_with_its_seed(spark, diagonals):
    rng = random.Random(3)
    grid = {(x, y): (rng.choice((10, 12, 90)), 5, rng.choice((0, 4))) for x in range(18) for y in range(18)}
    rows = [(f, x, y, *c) for f in (1, 4) for (x, y), c in grid.items()]
    pixels = spark.createDataFrame(rows, "frame_id long, x int, y int, r int, g int, b int")
    seeds = spark.createDataFrame([(1, 3, 3), (4, 17, 0)], "frame_id long, x int, y int")
    out = {}
    for r in G.magic_wand(pixels, seeds, 4, True, diagonals).collect():
        out.setdefault(r.shape_id, set()).add((r.x, r.y))
    for f, seed in ((1, (3, 3)), (4, (17, 0))):
        alike = {c for c, v in grid.items() if all(abs(a - b) <= 4 for a, b in zip(v, grid[seed]))}
        assert out[f] == next(g for g in P.groups(alike, 1.5 if diagonals else 1.0) if seed in g)


# -- samples and measures


@pytest.mark.parametrize("n", [1, 7, 40, 10_000])
def test_samples_move_past_taken_vertices(spark, n):
    loops = LOOPS | {9: [(0, 0), (50, 0), (50, 1), (50, 2), (51, 2), (52, 2), (0, 2)], 11: [(0, 0), (1, 0), (1, 1), (0, 40)]}
    out = {}
    for r in M.sample_vertices(contours(spark, loops), n).orderBy("sample").collect():
        out.setdefault(r.shape_id, []).append(r.ord)
    for i, loop in loops.items():
        size, taken = min(n, len(loop)), []
        for k in range(size):
            at = P.at_arc(loop, k / size)[0]
            while at in taken:
                at = (at + 1) % len(loop)
            taken.append(at)
        assert out[i] == taken
    f = M.build_features(contours(spark), n=n)
    every = {(r.shape_id, r.ord): r for r in M.build_features(contours(spark)).collect()}
    assert all(every[r.shape_id, r.ord].location == r.location for r in f.collect())


def test_every_third_vertex(spark):
    out = {(r.shape_id, r.sample, r.ord) for r in M.build_features(contours(spark), stride=3).collect()}
    assert out == {(i, k // 3, k) for i, loop in LOOPS.items() for k in range(0, len(loop), 3)}


def sign(v):
    v = round(v, 9)
    return (v > 0) - (v < 0)


def walk(cells, at, dx, dy):
    n = 0
    while (at[0] + dx * (n + 1), at[1] + dy * (n + 1)) in cells:
        n += 1
    return n * math.hypot(dx, dy)


def plain_measures(loop, cells, anchors, dark, ink):
    """(thickness, opacity, border_blend, blotch, end_stop) of every vertex."""
    n, out = len(loop), []
    inward, tangents = [], []
    for k in range(n):
        (px, py), (nx, ny) = loop[k - 1], loop[(k + 1) % n]
        length = math.hypot(nx - px, ny - py)
        t = ((nx - px) / length, (ny - py) / length) if length else (0.0, 0.0)
        tangents.append(t)
        inward.append((-t[1], t[0]))
    whole = lambda v: math.floor(v + 0.5)
    bound = lambda v, a, b: max(a, min(b, v))
    start = [min(cells, key=lambda c: ((c[0] - a[0]) ** 2 + (c[1] - a[1]) ** 2, c)) for a in anchors]
    for k in range(n):
        (ix, iy), (tx, ty), r = inward[k], tangents[k], 0 if ink else 4
        taps = [((k + d) % n, r + 1 - abs(d)) for d in range(-r, r + 1)]
        weight = sum(w for _, w in taps)
        thick = sum(w * bound(0.5 + 0.82 * (walk(cells, start[j], sign(ix), sign(iy)) + walk(cells, start[j], -sign(ix), -sign(iy))), 0.5, 64) for j, w in taps) / weight
        opacity = 0.0
        for j, w in taps:
            ax, ay = anchors[j]
            near = [dark.get((ax + a, ay + b), 0.0) for a, b in P.disk(2)] + [dark.get((whole(ax + ix * s), whole(ay + iy * s)), 0.0) for s in (1, 2)]
            opacity += w * sum(near) / len(near)
        opacity = bound(opacity / weight, 0, 1)
        x, y = loop[k]
        blend, edge = 0.0, dark.get((x, y), 0.0)
        if ink and opacity > 0.02 and edge > 1e-6:
            for side in (1, -1):
                seen = [(dark.get((whole(x + side * ix * s), whole(y + side * iy * s)), 0.0), 1 - (s - 1) / 15) for s in range(1, 16)]
                blend = max(blend, bound(sum(v * w for v, w in seen) / sum(w for _, w in seen) / edge, 0, 1))
        around = [loop[(k + d) % n] for d in range(-4, 5) if d]
        mx, my = (sum(p[c] for p in around) / 8 for c in (0, 1))
        out_ = lambda vx, vy: -(vx * ix + vy * iy)
        blotch = bound(out_(anchors[k][0] - x, anchors[k][1] - y) / 2 + out_(x - mx, y - my) / 2, -16, 16)
        ahead, behind = walk(cells, start[k], sign(tx), sign(ty)), walk(cells, start[k], -sign(tx), -sign(ty))
        span = ahead + behind
        stop = bound(0.55 * (1 - bound(span / max(2.0, thick * 2.75), 0, 1)) + 0.45 * (abs(ahead - behind) / span if span else 0), 0, 1)
        out.append((thick, opacity, blend, blotch, stop))
    return out


@pytest.mark.parametrize("ink", [False, True])
def test_measures_match_plain_probes(spark, ink):
    f, cells, scan = M.build_features(contours(spark)), points(spark, BLOBS), scan_of(spark)
    rows = M.measure(f, cells, scan, ink=ink).orderBy("ord").collect()
    dark = {i: {} for i in BLOBS}
    for r in scan.collect():
        dark[r.frame_id][(r.x, r.y)] = r.value
    for i, loop in LOOPS.items():
        own = [r for r in rows if r.shape_id == i]
        anchors = [(r.anchor_x, r.anchor_y) for r in own]
        if ink:
            assert anchors == [min(BLOBS[i], key=lambda c: ((c[0] - p[0]) ** 2 + (c[1] - p[1]) ** 2, c)) for p in loop]
        want = plain_measures(loop, BLOBS[i], anchors, dark[i], ink)
        assert len(own) == len(loop)
        for r, w in zip(own, want):
            assert (r.thickness, r.opacity, r.border_blend, r.blotch, r.end_stop) == pytest.approx(w, abs=1e-9), (i, r.ord)
    assert any(r.border_blend > 0 for r in rows) == ink


def test_measures_without_a_drawing(spark):
    rows = M.measure(M.build_features(contours(spark)), points(spark, {99: {(0, 0)}}), scan_of(spark)).collect()
    assert {(r.thickness, r.end_stop, r.anchor_x - r.x, r.anchor_y - r.y) for r in rows} == {(1.0, 0.0, 0, 0)}


def test_synthesis_bounds_every_measure(spark):
    rows = [(1.0, 5.0, 0.5, 0.5, 2.0), (-3.0, 0.6, 0.9, 0.1, -60.0), (float("inf"), 1.0, 0.2, 0.2, 1.0), (1e6, 63.0, 0.0, 1.0, 63.0)]
    df = spark.createDataFrame(rows, "u double, thickness double, border_blend double, opacity double, blotch double")
    weights = {"thickness": [1.0, 0.5], "border_blend": [0.1, 0.0], "opacity": [-0.2, 0.05], "blotch": [5.0, 0.0]}
    strength = {"thickness": (1.1, 0.5, 64.0), "border_blend": (1.85, 0.0, 1.0), "opacity": (1.2, 0.0, 1.0), "blotch": (0.18, -64.0, 64.0)}
    for r, got in zip(rows, M.synthesise(df, ("u",), weights).collect()):
        for name, own in zip(("thickness", "border_blend", "opacity", "blotch"), r[1:]):
            k, low, high = strength[name]
            v = own + k * (weights[name][0] * r[0] + weights[name][1])
            assert got[name] == pytest.approx(max(low, min(high, v if math.isfinite(v) else 0.0)))
    assert M.synthesise(df, ("u",), {}).columns == df.columns
    with pytest.raises(ValueError):
        M.synthesise(df, ("u",), {"colour": [1.0, 0.0]})


# -- matches


def test_nearest_by_location_goes_round_the_circle(spark):
    rng = random.Random(6)
    a = {i: sorted(round(rng.random(), 4) for _ in range(n)) for i, n in ((1, 30), (2, 1), (3, 12))}
    b = {i: sorted(round(rng.random(), 4) for _ in range(n)) for i, n in ((1, 7), (2, 5), (3, 1))}
    df = lambda d: spark.createDataFrame([(i, k, v) for i, vs in d.items() for k, v in enumerate(vs)], "shape_id long, ord int, location double")
    for op in (M.nearest_by_location, M.naive_match):
        for r in op(df(a), df(b)).collect():
            d = lambda k: round(min(abs(b[r.shape_id][k] - a[r.shape_id][r.ord] + t) for t in (-1, 0, 1)), 12)  # noqa: B023, E731
            assert d(r.other) == min(map(d, range(len(b[r.shape_id]))))
            assert r.other == min(range(len(b[r.shape_id])), key=lambda k: (d(k), k))  # noqa: B023
    assert {r.confidence for r in M.naive_match(df(a), df(b)).collect()} == {1.0}


def test_match_scores_by_hand(spark):
    cols = "u double, v double, tx double, ty double, derivative double, share double, location double"
    rows = [((0.1, 0.2, 1.0, 0.0, 0.3, 0.5, 0.05), (0.4, 0.6, 0.0, 1.0, -5.0, 0.2, 0.95)), ((0.5, 0.5, 0.6, -0.8, 0.0, 0.1, 0.2),) * 2]
    df = spark.createDataFrame(rows, f"a struct<{cols.replace(' ', ': ').replace(',:', ',')}>, b struct<{cols.replace(' ', ': ').replace(',:', ',')}>")
    got = [r.s for r in df.select(M.match_score(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([0.5 + 0.6 * 0.5 + 0.45 * 1.0 + 0.3 * 0.3 + 0.4 * 0.1, 0.0])


def test_a_session_learns_a_constant_offset(spark):
    loops = {i: loop for i, loop in LOOPS.items() if i != 2}
    wider = {i: P.trace(P.dilate(P.rasterize(loop), 2)) for i, loop in loops.items()}
    matches, weights = M.session(contours(spark, loops), contours(spark, wider))
    rows, w = matches.collect(), {r.term: r.weight for r in weights.collect()}
    assert {(r.shape_id, r.ord) for r in rows} == {(i, k) for i, loop in loops.items() for k in range(len(loop))}
    assert all(0.1 <= r.confidence <= 1 for r in rows) and set(w) == {*M.INPUTS, "bias"}
    assert w["bias"] == pytest.approx(2.0, abs=0.7)


# -- the halo


def plain_frame(loop, k, core):
    n = len(loop)
    window = max(2, min(10, n // 300))
    (px, py), (qx, qy) = loop[(k - window) % n], loop[(k + window) % n]
    length = math.hypot(qx - px, qy - py)
    t = ((qx - px) / length, (qy - py) / length) if length > 1e-8 else (1.0, 0.0)
    length = length if length > 1e-8 else 1.0
    x, y = loop[k]
    normals = [(-t[1], t[0]), (t[1], -t[0])]
    inside = [(math.floor(x + a * 1.5 + 0.5), math.floor(y + b * 1.5 + 0.5)) in core for a, b in normals]
    if inside[0] != inside[1]:
        o = normals[1] if inside[0] else normals[0]
    else:
        cx, cy = (sum(p[c] for p in loop) / n for c in (0, 1))
        o = normals[0] if normals[0][0] * (x - cx) + normals[0][1] * (y - cy) >= 0 else normals[1]
    return t, o, length / max(1.0, window * 2)


def test_halo_is_read_at_the_same_share_of_the_contour(spark):
    size, reach = 48, 5.0
    target, ink = {1: disk(22, 22, 9), 2: BLOBS[2], 3: disk(9, 9, 4), 4: {(3, 3)}}, {1: disk(24, 20, 12), 2: disk(20, 22, 8), 3: BLOBS[7], 4: disk(9, 9, 4)}
    tone = lambda x, y: ((x * 5 + y * 3) % 17) / 16

    def image(shapes):
        rows = []
        for i, core in shapes.items():
            far = np.array([[min(math.dist((x, y), c) for c in core) for y in range(size)] for x in range(size)])
            rows += [(i, x, y, (x, y) in core, float(far[x, y]), tone(x, y)) for x in range(size) for y in range(size)]
        return spark.createDataFrame(rows, "frame_id long, x int, y int, core boolean, far double, value double").cache()

    out = {(r.frame_id, r.x, r.y): r.halo for r in CO.warp_halo(image(target), image(ink), 0.8, reach).collect()}
    want = {}
    for i, core in target.items():
        loop, other = P.trace(core), P.trace(ink[i])
        if not loop or not other:
            continue
        wide = lambda c: (max(x for x, _ in c) - min(x for x, _ in c) + 1, max(y for _, y in c) - min(y for _, y in c) + 1)
        unit = lambda o, w: math.hypot(o[0] / w[0], o[1] / w[1])
        arcs = [0.0]
        for a, b in P.edges(loop):
            arcs.append(arcs[-1] + math.dist(a, b))
        for x in range(size):
            for y in range(size):
                if (x, y) in core or min(math.dist((x, y), c) for c in core) > reach:
                    continue
                at = min(set(loop), key=lambda p: ((p[0] - x) ** 2 + (p[1] - y) ** 2, p))
                k = max(j for j, p in enumerate(loop) if p == at)
                t, o, step = plain_frame(loop, k, core)
                out_, on = (x - at[0]) * o[0] + (y - at[1]) * o[1], (x - at[0]) * t[0] + (y - at[1]) * t[1]
                if out_ < -0.25:
                    continue
                j, _ = P.at_arc(other, arcs[k] / P.perimeter(loop))
                it, io, istep = plain_frame(other, j, ink[i])
                out_ = max(0.0, out_) * unit(o, wide(core)) / max(unit(io, wide(ink[i])), 1e-9)
                on = on * istep / max(step, 1e-9)
                u, v = other[j][0] + io[0] * out_ + it[0] * on, other[j][1] + io[1] * out_ + it[1] * on
                cell = (math.floor(u + 0.5), math.floor(v + 0.5))
                if not (0 <= cell[0] < size and 0 <= cell[1] < size) or cell in ink[i] or min(math.dist(cell, c) for c in ink[i]) > reach:
                    continue
                fu, fv, value = math.floor(u), math.floor(v), 0.0
                for a in (0, 1):
                    for b in (0, 1):
                        if 0 <= fu + a < size and 0 <= fv + b < size:
                            value += tone(fu + a, fv + b) * (u - fu if a else 1 - u + fu) * (v - fv if b else 1 - v + fv)
                want[(i, x, y)] = min(1.0, value * 0.8)
    assert set(out) == set(want) and {i for i, *_ in out} == {1, 2, 3}
    assert out == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


# -- ordered look-ups with a frequent key


def hot_series(rng, n=3000):
    return [(rng.choice((1, 1, 1, 2, 3, None)) if k % 3 else 1, rng.randrange(n), float(k % 97)) for k in range(n)]


@pytest.mark.parametrize("mode", O.MODES)
@pytest.mark.parametrize("ranges", [1, 7])
def test_asof_carries_on_from_range_to_range(spark, mode, ranges):
    rng = random.Random(8)
    right = {(k, p): v for k, p, v in hot_series(rng)}
    left = [(k, p) for k, p, _ in hot_series(rng, 800)] + [(1, -5), (1, 10**6), (77, 3)]
    r = spark.createDataFrame([(k, p, v) for (k, p), v in right.items()], "key long, pos long, value double")
    l = spark.createDataFrame([(k, p, i) for i, (k, p) in enumerate(left)], "key long, pos long, row long")
    by = {}
    for (k, p), v in right.items():
        by.setdefault(k, []).append(p)
    test = {"floor": lambda a, b: a <= b, "lower": lambda a, b: a < b, "ceiling": lambda a, b: a >= b, "higher": lambda a, b: a > b}[mode]
    got = O.asof(l, r, mode, ranges=ranges).collect()
    assert len(got) == len(left)
    for row in got:
        fits = [p for p in by.get(row.key, []) if test(p, row.pos)]
        at = None if not fits else max(fits) if mode in ("floor", "lower") else min(fits)
        assert (row.found_at, row.found) == (at, None if at is None else right[row.key, at])


def test_ranks_and_quantiles_of_a_frequent_key(spark):
    rows = [(k if k is not None else 9, i, v if i % 50 else None) for i, (k, _, v) in enumerate(hot_series(random.Random(9)))] + [(4, 1, 2.0), (5, 1, None)]
    df = spark.createDataFrame(rows, "key long, pos long, value double")
    seen = {}
    for r in O.rank_of(df).orderBy("key", "pos").collect():
        assert r["rank"] == seen.setdefault(r.key, -1) + 1
        seen[r.key] = r["rank"]
    for r in S.quantiles(df, {"low": 0.25, "mid": 0.5, "top": 1.0}).collect():
        own = [v for k, _, v in rows if k == r.key and v is not None]
        want = [None] * 3 if not own else [pytest.approx(float(np.quantile(own, q))) for q in (0.25, 0.5, 1.0)]
        assert [r.low, r.mid, r.top] == want and r.n == len(own)


def test_a_frequent_key_spreads_over_ranges(spark):
    from rasterloom.operators.ranges import RANGE, dealt

    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(1)).alias("key"), F.col("id").alias("pos"))
    most = dealt(df, "key", F.col("pos"), ranges=8).groupBy(RANGE).count().agg(F.max("count")).first()[0]
    assert most < 5000


def test_lagrange_uses_the_nearest_nodes_of_both_sides(spark):
    nodes = {1: [(1, 3.0), (2, 5.0), (4, -1.0), (7, 2.0), (11, 0.5), (12, 6.0)], 2: [(0, 1.0), (5, 2.0)]}
    asked = {1: [0, 1, 3, 4, 6, 10, 12, 20], 2: [2, 5]}
    df = lambda d, f: spark.createDataFrame([(k, *f(v)) for k, vs in d.items() for v in vs], "key long, x double" + (", y double" if d is nodes else ""))
    got = {(r.key, r.x): r.y for r in S.lagrange(df(nodes, lambda v: (float(v[0]), v[1])), df(asked, lambda v: (float(v),))).collect()}
    for k, at in asked.items():
        for q in at:
            sides = [sorted((abs(x - q), x, y) for x, y in nodes[k] if x != q and (x < q) == left) for left in (True, False)]
            near = sorted((i, d, x, y) for side in sides for i, (d, x, y) in enumerate(side))[:4]
            if len(near) > 1:
                assert got[k, q] == pytest.approx(sum(y * math.prod((q - o) / (x - o) for _, _, o, _ in near if o != x) for _, _, x, y in near))
