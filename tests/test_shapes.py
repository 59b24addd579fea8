"""Fixed shapes with results by hand, and set and morphology properties."""

import math

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import contours as K
from rasterloom.operators import groups as G
from rasterloom.operators import points as T
from rasterloom.operators import sets as S
from rasterloom.operators import stats as ST


def points(spark, cells, shape=1):
    return spark.createDataFrame([(shape, x, y) for x, y in cells], "shape_id long, x int, y int")


def as_set(df):
    return {(r.x, r.y) for r in df.collect()}


def disk(r, cx=0, cy=0):
    return {(cx + x, cy + y) for x in range(-r, r + 1) for y in range(-r, r + 1) if x * x + y * y <= r * r}


RECT = {(x, y) for x in range(10) for y in range(6)}
L_SHAPE = RECT | {(x, y) for x in range(4) for y in range(6, 12)}
RING = disk(8) - disk(5)
SHAPES = [RECT, L_SHAPE, RING, disk(8), {(3, 3)}, {(x, 0) for x in range(7)}, set()]


@pytest.mark.parametrize("shape", SHAPES, ids=["rect", "l", "ring", "disk", "pixel", "line", "empty"])
def test_runs_and_morphology(spark, shape):
    p = points(spark, shape)
    assert as_set(T.from_runs(T.to_runs(p))) == shape
    grown = {(x + dx, y + dy) for x, y in shape for dx, dy in disk(2)}
    assert as_set(T.dilate(p, 2)) == grown
    assert as_set(T.erode(p, 2)) == {(x, y) for x, y in shape if all((x + dx, y + dy) in shape for dx, dy in disk(2))}
    assert as_set(T.close(p, 2)) >= shape >= as_set(T.open_(p, 2))


def test_set_identities(spark):
    a, b = points(spark, RECT), points(spark, disk(5))
    both = S.subtract_points(a, b).unionAll(S.intersect_points(a, b))
    assert as_set(both) == RECT and both.count() == len(RECT)
    assert as_set(S.symmetric_difference(a, b)) == RECT ^ disk(5)
    with pytest.raises(ValueError):
        S.apply_mode(a, b, "paint")


def test_four_quarter_turns(spark):
    p = points(spark, L_SHAPE)
    for _ in range(4):
        p = T.rotate(p, 90)
    assert as_set(p) == L_SHAPE


def test_groups_and_holes(spark):
    two = points(spark, disk(3) | disk(3, 10, 0))
    assert G.group_points(two, 3.9).select("label").distinct().count() == 2
    assert G.group_points(two, 4.0).select("label").distinct().count() == 1
    ring = points(spark, RING)
    assert as_set(G.fill_enclosed(ring)) == disk(8)
    assert as_set(G.remove_holes(ring)) == RING
    assert as_set(G.fill_small_holes(ring, 10)) == RING and as_set(G.fill_small_holes(ring, 500)) == disk(8)
    chain = points(spark, {(x, 0) for x in range(80)})
    assert G.group_points(chain, 1.0).select("label").distinct().count() == 1


def test_contour_of_rectangle(spark):
    c = K.trace(points(spark, RECT)).cache()
    rows = c.orderBy("ord").collect()
    assert (rows[0].x, rows[0].y) == (0, 5) and len(rows) == 28
    m = K.measures(c).first()
    assert m.perimeter == pytest.approx(28) and abs(m.area) == 45 and m.orientation == "counter-clockwise"
    assert as_set(K.rasterize(c)) == RECT
    assert K.trace(points(spark, {(1, 1)})).count() == 0


def test_bridge_joins_parts(spark):
    p = K.bridge(points(spark, disk(3) | disk(3, 10, 0) | disk(3, 40, 0)), 5)
    assert G.group_connected(p, True).select("label").distinct().count() == 2


def test_thin_keeps_a_line(spark):
    thin = as_set(T.thin(points(spark, {(x, y) for x in range(20) for y in range(3)})))
    assert thin and all(y == 1 for _, y in thin)


LAGRANGE = [
    ([(8, 3703), (11, 9118), (16, 26823), (17, 31990)], [(13, 14718)]),
    ([(21, 62075), (23, 80459), (27, 127667), (32, 209222)], [(22, 70862)]),
]


@pytest.mark.parametrize("nodes,want", LAGRANGE)
def test_lagrange_known_values(spark, nodes, want):
    n = spark.createDataFrame([(1, float(x), float(y)) for x, y in nodes], "key int, x double, y double")
    q = spark.createDataFrame([(1, float(x)) for x, _ in want], "key int, x double")
    got = {r.x: r.y for r in ST.lagrange(n, q).collect()}
    assert all(abs(got[x] - y) <= 1 for x, y in want)


def test_lagrange_basis(spark):
    nodes = lambda v: F.array(*map(F.lit, map(float, v)))
    row = spark.range(1).select(ST.lagrange_basis(nodes([7, 19, 26, 53]), 0, 22.0), ST.lagrange_basis(nodes([8, 11, 16, 17]), 0, 13.0)).first()
    assert row[0] == pytest.approx(-0.035469107551487) and row[1] == pytest.approx(-0.1111111, abs=1e-6)
    with pytest.raises(ValueError):
        ST.step_count(F.lit(1), F.array(F.lit(1)), "other")


def test_chamfer_is_exact_within_reach(spark):
    cells = points(spark, {(x, y) for x in range(-6, 7) for y in range(-6, 7)})
    got = {(r.x, r.y): r.distance for r in T.chamfer_distance(cells, points(spark, {(0, 0)}), 5).collect()}
    for (x, y), d in got.items():
        want = 4 * min(abs(x), abs(y)) + 3 * abs(abs(x) - abs(y))
        assert d == (want if want <= 15 else None)
