"""What keeps queries within their memory on large tables: no exploded side is sent to the driver, nor are wide
rows dealt out in batches of thousands."""

import itertools

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import pixels as X


def nodes(plan):
    """The operators of a JVM plan, depth first, each with its subtree."""
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def exploded_joins(df):
    """Joins with an exploded side, in the logical plan."""
    found = [n for n in nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    return [j for j in found if any(n.nodeName() == "Generate" for n in itertools.islice(nodes(j), 1, None))]


def image(spark, cells):
    return spark.createDataFrame([(1, x, y, v) for (x, y), v in cells.items()], "frame_id long, x int, y int, argb int")


def sizes(spark, width, height):
    return spark.createDataFrame([(1, width, height)], "frame_id long, width int, height int")


CELLS = {(x, y): x * 1000 + y for x in range(7) for y in range(5) if (x, y) != (2, 2)}


@pytest.mark.parametrize("percent", [30, 100, 150, 333])
def test_upscale_sends_pixels_to_their_targets(spark, percent):
    got = X.upscale(image(spark, CELLS | {(9, 1): 5, (-1, 0): 6}), sizes(spark, 7, 5), percent)
    assert not exploded_joins(got)
    k = percent / 100
    wide, high = int(7 * k + 0.5), int(5 * k + 0.5)
    source = {(x, y): (min(int(x / k), 6), min(int(y / k), 4)) for x in range(wide) for y in range(high)}
    assert sorted((r.x, r.y, r.argb) for r in got.collect()) == sorted((*t, CELLS[s]) for t, s in source.items() if s in CELLS)


def test_mini_image_and_fit_send_pixels_to_their_targets(spark):
    p, frames = image(spark, CELLS), sizes(spark, 7, 5)
    mini = X.mini_image(p, frames)
    assert not exploded_joins(mini)
    at = lambda v, small, size: min(size - 1, int((v + 0.5) * size / small))
    want = {(x, y): (at(x, 320, 7), at(y, 240, 5)) for x in range(320) for y in range(240)}
    assert sorted((r.x, r.y, r.argb) for r in mini.collect()) == sorted((*t, CELLS[s]) for t, s in want.items() if s in CELLS)
    for width, height, source in ((14, 10, lambda x, y: (x // 2, y // 2)), (15, 21, lambda x, y: (y // 3, 4 - x // 3)), (5, 7, lambda x, y: (y, 4 - x)), (7, 5, lambda x, y: (x, y))):
        fit = X.fit_to_reference(p, frames, width, height)
        assert not exploded_joins(fit)
        want = {(x, y): source(x, y) for x in range(width) for y in range(height)}
        assert sorted((r.x, r.y, r.argb) for r in fit.collect()) == sorted((*t, CELLS[s]) for t, s in want.items() if s in CELLS)


@pytest.mark.parametrize("width, height", [(4, 3), (1, 2), (2, 1)])
@pytest.mark.parametrize("kernel", [X.SHARPEN, X.box_kernel(1), X.gaussian_kernel(2), [[0.0, 0.5, 0.0], [0.0, 0.0, 2.0], [-1.0, 0.0, 0.0]]])
def test_convolution_sends_pixels_to_their_targets(spark, width, height, kernel):
    cells = {(x, y): (x * 60 + y * 7) % 256 for x in range(width) for y in range(height) if (x, y) != (1, 1)}
    p = image(spark, {c: -16777216 | v for c, v in cells.items()})
    got = X.convolve(p, sizes(spark, width, height), kernel)
    assert not exploded_joins(got)
    r, want = len(kernel) // 2, {}
    for x, y in itertools.product(range(width), range(height)):
        taken = [(cells[s], kernel[j][i]) for i in range(2 * r + 1) for j in range(2 * r + 1) if kernel[j][i] and (s := (min(max(x + i - r, 0), width - 1), min(max(y + j - r, 0), height - 1))) in cells]
        if taken:
            want[x, y] = int(min(max(round(sum(v * w for v, w in taken), 9), 0), 255) + 0.5)
    assert {(r.x, r.y): r.argb & 255 for r in got.select("x", "y", F.col("argb")).collect()} == want


def test_registered_scans_leave_in_small_blocks(spark, monkeypatch):
    """The grid is far larger than these scans: what a task hands on at once is bounded by the grid's cells."""
    from rasterloom.operators import compare as CO

    rows = [(i, x, y, ((i + 3 * x + 5 * y) % 11) / 10) for i in range(90) for x in range(4) for y in range(4)]
    scan = spark.createDataFrame(rows, "frame_id long, x int, y int, value double").coalesce(1)
    blocks = CO.register_rasters(scan).mapInArrow(lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in blocks) == 90
    seen = spark.sparkContext.accumulator(0)
    largest = []
    work = CO._in_blocks

    def watched(rows, fn, schema, cells):
        def counted(part):
            seen.add(1)
            assert len(part) * CO.GRID * CO.GRID <= CO.BLOCK
            return fn(part)

        largest.append(fn)
        return work(rows, counted, schema, cells)

    monkeypatch.setattr(CO, "_in_blocks", watched)
    looks = {r.frame_id: r for r in CO.registered_looks(scan).drop("bits").collect()}
    assert len(largest) == 1 and seen.value >= 90 // (CO.BLOCK // CO.GRID**2)
    # The same as from rasters, column by column.
    for r in CO.appearances(CO.register_rasters(scan.where("frame_id < 5"))).drop("values", "core", "distance").collect():
        assert all(looks[r.frame_id][k] == r[k] for k in r.asDict() if k != "height")


def test_threshold_of_an_image_is_otsu(spark):
    import numpy as np

    from rasterloom.operators import compare as CO

    rng = np.random.default_rng(5)
    images = {0: np.zeros(16), 1: np.full(16, 0.4), 2: np.array([0.3] * 8 + [0.7] * 8)} | {i: rng.integers(0, 6, 16) / 5 for i in range(3, 40)} | {i: rng.random(16) for i in range(40, 60)}
    scan = spark.createDataFrame([(i, k % 4, k // 4, float(v)) for i, im in images.items() for k, v in enumerate(im)], "frame_id long, x int, y int, value double")
    want = {r.frame_id: max(r.threshold, CO.NOISE) for r in CO.otsu(scan, CO.NOISE).collect()}
    assert {i: CO._limit(im) for i, im in images.items()} == want


def test_tables_of_points_are_not_broadcast(spark):
    """Neither steps read back, whose files are small, nor copies to neighbouring cells go through the driver."""
    from rasterloom.operators import groups as G
    from rasterloom.operators import points as T
    from rasterloom.operators import sets as S
    from rasterloom.sources.tables import materialise

    rows = [(i, x, y) for i in range(3) for x, y in ((0, 0), (1, 1), (5, 5), (6, 5), (20, 3))]
    p = spark.createDataFrame(rows, "shape_id long, x int, y int")
    step = materialise(p)
    grouped = G.group_points(p, 2.0)
    joins = [p.join(step.where("x > 0"), S.POINT), T._near(p, p, 2), S.subtract_points(p, p.where("x > 1")), S.intersect_points(p, p), grouped]
    for df in joins:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan
    code = lambda x, y: grouped.where(f"shape_id = 1 and x = {x} and y = {y}").first().label
    assert code(0, 0) == code(1, 1) != code(5, 5) == code(6, 5) != code(20, 3)
