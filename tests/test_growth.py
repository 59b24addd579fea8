"""What a query makes of its rows must not grow faster than they do: what was listed cell by cell, pair by pair or
number by number."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom import registry
from rasterloom.operators import groups as G
from rasterloom.operators import layers as L
from rasterloom.operators import model as M
from rasterloom.operators import points as T
from rasterloom.plans import jobs as J
from rasterloom.sources import images, tables

registry.load()


def points(spark, cells, shape=1):
    return spark.createDataFrame([(shape, x, y) for x, y in cells], "shape_id long, x int, y int")


def as_set(df):
    rows = [(r.x, r.y) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_integers_between_are_counted(spark, tmp_path):
    """a list of a thousand million numbers fits nowhere."""
    spark.createDataFrame([(5, 1, 0.5), (1_000_000_004, 1, 0.5), (7, 2, 0.1)], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = registry.QUERIES["ord12_integers_between"](spark, str(tmp_path)).collect()
    assert sorted((r.key, r.low, r.n) for r in rows) == [(1, 5, 1_000_000_000), (2, 7, 1)]


def zhang_suen(cells):
    ring = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    while True:
        before = set(cells)
        for a, b in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            gone = set()
            for x, y in cells:
                p = [(x + dx, y + dy) in cells for dx, dy in ring]
                turns = sum(not p[i] and p[(i + 1) % 8] for i in range(8))
                if 2 <= sum(p) <= 6 and turns == 1 and not all(p[i] for i in a) and not all(p[i] for i in b):
                    gone.add((x, y))
            cells = cells - gone
        if cells == before:
            return cells


def test_thin_works_on_words(spark):
    """60 cells a row, also across the ends of words and below zero."""
    rng = random.Random(3)
    shapes = [{(x, y) for x in range(9) for y in range(-65, 66) if rng.random() < share} for share in (0.6, 0.9, 1.0)]
    rows = [(i, x, y) for i, s in enumerate(shapes) for x, y in s]
    p = spark.createDataFrame(rows + rows[:20], "shape_id long, x int, y int")
    words = T.to_words(p)
    assert words.count() <= 3 * 9 * 4 and sorted(map(tuple, T.from_words(words).select("shape_id", "x", "y").collect())) == sorted(rows)
    got = T.thin(p).collect()
    for i, s in enumerate(shapes):
        mine = [(r.x, r.y) for r in got if r.shape_id == i]
        assert set(mine) == zhang_suen(s) and len(mine) == len(set(mine))


def test_voids_are_runs(spark, monkeypatch):
    """Neither the empty cells of a bounding box nor those of its voids are written one by one."""
    square = {(x, y) for x in range(-20, 20) for y in range(-20, 20) if x in (-20, 19) or y in (-20, 19)}
    small = {(30 + x, y) for x, y in ((0, 0), (1, 1), (1, -1), (2, 0))}
    inside = {(x, y) for x in range(-19, 19) for y in range(-19, 19)}
    p, written = points(spark, square | small), []

    def watched(df):
        out = tables.materialise(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "materialise", watched)
    assert as_set(G.fill_enclosed(p)) == square | small | inside | {(31, 0)}
    assert as_set(G.remove_holes(p)) == square | small | {(31, 0)}
    # Eight neighbours lead out of the small one.
    assert as_set(G.fill_small_holes(p, len(inside))) == square | small | inside
    assert as_set(G.fill_small_holes(p, len(inside) - 1)) == square | small
    assert max(written) < 900


@pytest.mark.parametrize("dist", [0.5, 1.0, 1.5])
def test_short_distances_need_no_pairs(spark, monkeypatch, dist):
    """a mini image's enlarged pixels are groups of runs, with the labels that pairs of points give."""
    rng = random.Random(int(dist * 10))
    p = points(spark, {(x, y) for x in range(-4, 9) for y in range(-5, 6) if rng.random() < 0.45})
    want = {(r.x, r.y): r.label for r in G.group_points(p, dist).collect()}

    def never(*_):
        raise AssertionError("pairs of points")

    monkeypatch.setattr(G, "_near", never)
    got = G.group_points(p, spark.createDataFrame([(1, dist), (2, 7.0)], "shape_id long, dist double").where("shape_id = 1"))
    assert {(r.x, r.y): r.label for r in got.collect()} == want


def test_a_frame_is_one_file(spark, tmp_path):
    """however many tasks hold a frame's rows."""
    rows = [(f, x, y, x * y) for f in range(3) for x in range(20) for y in range(20)]
    pixels = spark.createDataFrame(rows, "frame_id long, x int, y int, argb int").repartition(4)
    tables.write_frames(pixels, f"{tmp_path}/frames")
    assert len(list((tmp_path / "frames").glob("frame_id=*/*.parquet"))) == 3
    got = tables.read_frames_table(spark, f"{tmp_path}/frames").select("frame_id", "x", "y", "argb").collect()
    assert sorted(map(tuple, got)) == rows


def test_bitmaps_are_encoded_at_once(spark, tmp_path, monkeypatch):
    """the driver reads what tasks have encoded, and does not wait for one partition after another."""
    steps, write = [], tables.materialise
    monkeypatch.setattr(tables, "materialise", lambda df: steps.append(df.columns) or write(df))
    pixels = spark.createDataFrame([(f, f, 1, -1) for f in range(3)], "frame_id long, x int, y int, argb int")
    images.write_bitmaps(pixels, str(tmp_path / "images"), 4, 3)
    assert steps == [["name", "data"]]
    got = images.read_frames(spark, str(tmp_path / "images"))[1].where("argb = -1").collect()
    assert sorted((r.x, r.y) for r in got) == [(0, 1), (1, 1), (2, 1)]


def test_features_read_their_contour_once(spark):
    """every measure of a contour came from the source anew."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    loop = [(1, i, x, y) for i, (x, y) in enumerate([(0, 0), (4, 0), (8, 1), (8, 5), (4, 6), (0, 5)])]
    contour = spark.createDataFrame(loop, "shape_id long, ord int, x int, y int").mapInPandas(counted, "shape_id long, ord int, x int, y int")
    assert M.build_features(contour).count() == 6 and seen.value == 6


def test_erosion_counts_ends(spark, monkeypatch):
    """closing and opening list no cells between their steps, whatever the length of the runs."""
    rng = random.Random(9)
    cells = {(x, y) for x in range(-4, 16) for y in range(-6, 18) if rng.random() < 0.35} | {(x, y) for x in range(20, 30) for y in range(-9, 9)}
    disk = lambda r: [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r]
    dilated = lambda s, r: {(x + i, y + j) for x, y in s for i, j in disk(r)}
    eroded = lambda s, r: {(x - i, y - j) for x, y in s for i, j in disk(r) if all((x - i + k, y - j + m) in s for k, m in disk(r))}
    p = points(spark, cells)
    for r in (0, 1, 2, 3):
        assert as_set(T.erode(p, r)) == eroded(cells, r)
        runs = T.erode_runs(T.to_runs(p), r)
        assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, T.to_runs(T.from_runs(runs)).collect()))
    assert as_set(T.open_(T.close(p, 3), 1)) == dilated(eroded(eroded(dilated(cells, 3), 3), 1), 1)

    def never(*_):
        raise AssertionError("a list of cells")

    long = spark.createDataFrame([(1, x, 0, 1_000_000_000) for x in range(9)], "shape_id long, x int, y_lo int, y_hi int")
    monkeypatch.setattr(T, "from_runs", never)
    got = T.open_runs(T.close_runs(long, 3), 1).collect()
    assert {(r.y_lo, r.y_hi) for r in got if 3 < r.x < 6} == {(0, 1_000_000_000)}


def test_nearest_points_are_not_broadcast(spark, monkeypatch):
    """neither side of a search for nearest points goes to the driver, and both are made once."""
    seen, plans, write = spark.sparkContext.accumulator(0), [], tables.materialise

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan())
        return write(df)

    for module in (G, tables):
        monkeypatch.setattr(module, "materialise", watched)
    made = lambda cells: points(spark, cells).mapInPandas(counted, "shape_id long, x int, y int")
    a, b = {(0, y) for y in range(40)}, {(x, 7) for x in range(30, 50)} | {(0, 39)}
    row = T.min_distance(made(a), made(b)).first()
    assert (row.shape_id, row.distance) == (1, 0.0) and seen.value == len(a) + len(b)
    groups = spark.createDataFrame([(1, x, y, x // 10) for x, y in ((0, 0), (10, 0), (20, 0))], "shape_id long, x int, y int, label long")
    found = G.nearest_group(groups, points(spark, {(19, 3), (40, 40)}))
    assert [(r.label, round(r.distance, 6)) for r in found.collect()] == [(2, 3.162278)]
    G.group_points(points(spark, {(x, x % 3) for x in range(30)}), 2.0).count()
    plans += [found._jdf.queryExecution().executedPlan()]
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p.toString()]


def test_colours_compile(spark, capsys):
    """a method of over 8,000 bytes is never compiled by the JVM."""
    from rasterloom.plans import jobs as J

    J.with_hsv(spark.createDataFrame([(1, 0, 0, -1)], "frame_id long, x int, y int, argb int")).explain("codegen")
    sizes = [int(part.split(";")[0]) for part in capsys.readouterr().out.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8000, sizes


def test_points_in_a_contour_meet_no_edges(spark, capsys):
    """a row of a drawing is sorted once, its points are not paired with its edges."""
    from rasterloom.operators import contours as K

    loops = {1: [(0, 0), (9, 0), (9, 6), (6, 6), (6, 2), (3, 2), (3, 6), (0, 6)], 2: [(-5, -4), (7, 3), (-2, 5), (1, 1)], 3: [(0, 0), (5, 0), (2, 0)]}
    contour = spark.createDataFrame([(i, n, x, y) for i, loop in loops.items() for n, (x, y) in enumerate(loop)], "shape_id long, ord int, x int, y int")
    asked = [(i, x, y) for i in (1, 2, 3, 4) for x in range(-6, 11) for y in range(-5, 8)]
    found = K.in_contour(spark.createDataFrame(asked + asked[:50], "shape_id long, x int, y int"), contour)
    found.explain()
    assert "Join" not in capsys.readouterr().out

    def inside(i, x, y):
        odd = False
        loop = loops.get(i, [])
        for (x0, y0), (x1, y1) in zip(loop, loop[1:] + loop[:1]):
            if (y1 - y0) * (x - x0) == (x1 - x0) * (y - y0) and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1):
                return True
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
        return odd

    assert sorted(map(tuple, found.select("shape_id", "x", "y", "inside").collect())) == sorted((*p, inside(*p)) for p in asked)


def test_contours_stay_runs(spark):
    """neither filling nor eroding by a shape's own radius lists cells, and a boundary lists no cell inside."""
    from rasterloom.operators import contours as K

    far = 1_000_000_000
    loop = spark.createDataFrame([(1, 0, 0, far), (1, 1, 0, 0), (1, 2, 8, 0), (1, 3, 8, far)], "shape_id long, ord int, x int, y int")
    filled = sorted(tuple(r) for r in K.rasterize_runs(loop).select("x", "y_lo", "y_hi").collect())
    assert filled[:8] == [(0, 0, far)] + [(x, 0, far - 1) for x in range(1, 8)] and len(filled) <= 10
    runs = spark.createDataFrame([(1, x, 0, far) for x in range(9)], "shape_id long, x int, y_lo int, y_hi int")
    radii = spark.createDataFrame([(1, 2)], "shape_id long, r int")
    assert sorted(tuple(r) for r in T.erode_runs_by(runs, radii).select("x", "y_lo", "y_hi").collect()) == [(x, 2, far - 2) for x in range(2, 7)]
    edge = T.boundary_runs(runs).where("x not in (0, 8)").select("x", "y_lo", "y_hi").collect()
    assert sorted(tuple(r) for r in edge) == sorted((x, y, y) for x in range(1, 8) for y in (0, far))
    rng = random.Random(5)
    cells = {(x, y) for x in range(-6, 6) for y in range(-7, 8) if rng.random() < 0.8}
    want = {(x, y) for x, y in cells if not {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} <= cells}
    assert as_set(K.boundary(points(spark, list(cells) + list(cells)[:9]))) == want


def grouped(cells, dist):
    """Groups of cells within a distance, each with its smallest code."""
    code = lambda c: (c[0] << 32) | (c[1] & 0xFFFFFFFF)
    left, out, reach = set(cells), {}, int(dist)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            near = {(x + i, y + j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= dist * dist} & left
            left -= near
            todo += near
        out[min(map(code, part))] = part
    return out


@pytest.mark.parametrize("dist", [0.5, 1.42, 3.7])
def test_groups_are_found_on_runs(spark, monkeypatch, dist):
    """no cell is copied to its neighbours; a solid frame is a run a column."""
    from rasterloom.operators import points as P

    monkeypatch.setattr(P, "_near", None)
    rng = random.Random(5)
    shapes = [{(x, y) for x in range(-9, 9) for y in range(-80, 80) if rng.random() < share} for share in (0.02, 0.1, 0.4, 1.0)]
    p = spark.createDataFrame([(i, x, y) for i, s in enumerate(shapes) for x, y in s], "shape_id long, x int, y int")
    want = {(i, *c, label) for i, s in enumerate(shapes) for label, part in grouped(s, dist).items() for c in part}
    got = [tuple(r) for r in G.group_points(p, dist).select("shape_id", "x", "y", "label").collect()]
    assert set(got) == want and len(got) == len(want)
    given = spark.createDataFrame([(i, float(dist)) for i in range(1, 4)], "shape_id long, dist double")
    assert {tuple(r) for r in G.group_points(p, given).select("shape_id", "x", "y", "label").collect()} == {r for r in want if r[0]}


def test_mini_images_are_not_drawn_for_their_anchors(spark, monkeypatch):
    """a pixel is one block of mini cells, however many show it; frames larger and smaller than the mini
    image, and both at once."""
    from rasterloom.operators import pixels as X

    monkeypatch.setattr(X, "mini_image", None)
    rng, sizes = random.Random(8), {1: (64, 48), 2: (700, 120), 3: (470, 500), 4: (320, 240), 5: (90, 900), 6: (3300, 30)}
    cells = {f: {(rng.randrange(w), rng.randrange(h)): rng.randrange(3) for _ in range(min(w * h // 12, 900))} for f, (w, h) in sizes.items()}
    p = spark.createDataFrame([(f, x, y, v) for f, s in cells.items() for (x, y), v in s.items()], "frame_id long, x int, y int, argb int")
    p = p.unionAll(spark.createDataFrame([(1, 64, 3, 1), (1, -1, 0, 1)], p.schema))
    frames = spark.createDataFrame([(f, *s) for f, s in sizes.items()], "frame_id long, width int, height int")
    got = G.mini_anchors(p, frames, 1.5, lambda m: (m, [F.col("argb") >= 1, F.col("argb") == 2, F.col("argb") == 9]), 3).collect()
    want = set()
    for f, (w, h) in sizes.items():
        wide, high = max(320, int(w / 10 + 0.5)), max(240, int(h / 10 + 0.5))
        at = lambda v, small, size: min(size - 1, int((v + 0.5) * size / small))
        mini = {(x, y): cells[f][c] for x in range(wide) for y in range(high) if (c := (at(x, wide, w), at(y, high, h))) in cells[f]}
        for which, least in enumerate((1, 2)):
            groups = grouped({c for c, v in mini.items() if v >= least}, max(1.0, max(wide / w, high / h) * 1.5))
            part = min(groups.items(), key=lambda g: (-len(g[1]), g[0]))[1]
            cx, cy = (sum(c[i] for c in part) / len(part) for i in (0, 1))
            x, y = min(part, key=lambda c: (round((c[0] - cx) ** 2 + (c[1] - cy) ** 2, 9), c))
            want.add((f, which, at(x, wide, w), at(y, high, h)))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_chamfer_closing_is_on_runs(spark):
    """the cells of the padded box were joined with copies of the mask; now nothing is joined."""
    step = lambda i, j: 4 * min(i, j) + 3 * (max(i, j) - min(i, j))
    rng = random.Random(2)
    cells = {(x, y) for x in range(-14, 14) for y in range(-12, 12) if rng.random() < 0.12}
    for r in (1, 2, 3, 5):
        ball = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if step(abs(i), abs(j)) <= 3 * r]
        wide = {(x + i, y + j) for x, y in cells for i, j in ball}
        closed = T.chamfer_close(points(spark, cells), r)
        assert "Join" not in closed._jdf.queryExecution().executedPlan().toString()
        assert as_set(closed) == {(x, y) for x, y in wide if all((x + i, y + j) in wide for i, j in ball)}


def test_hard_stamps_are_on_runs(spark):
    """a dab that is opaque throughout is not listed cell by cell; what it covers is covered wholly."""
    cells = {(x, y) for x in range(40) for y in range(40) if (x * x + y) % 7 < 2}
    for brush in (L.Brush(-1, 5), L.Brush(-1, 9.5, roundness=0.3, angle=35.0)):
        stamped = L.stamp_points(points(spark, cells), brush)
        assert "product" not in stamped._jdf.queryExecution().executedPlan().toString()
        assert {r.coverage for r in stamped.collect()} == {1.0}
        assert as_set(stamped) == {(x + i, y + j) for x, y in cells for i, j, _ in brush.dab()}


def test_comparing_drawings_renders_nothing_and_takes_pairs_together(spark, monkeypatch):
    """the comparison was made behind a rendering that it does not need, pair by pair, in as few tasks as bytes make."""
    import numpy as np
    import pandas as pd

    from rasterloom.operators import compare as CO

    rng, calls = np.random.default_rng(4), []
    cores = [rng.random((n, n)) < 0.4 for n in (16, 16, 16, 16, 9, 9, 16, 16)]
    field = CO._field
    monkeypatch.setattr(CO, "_field", lambda m: calls.append(len(m)) or field(m))
    packed = [np.packbits(c).tobytes() for c in cores]
    got = CO._apart.func(pd.Series(packed[::2]), pd.Series(packed[1::2]), pd.Series([16, 16, 9, 16]))
    far = lambda a, b: field(b)[a].mean() / 3
    assert got.tolist() == [(far(a, b) + far(b, a)) / 2 for a, b in zip(cores[::2], cores[1::2])] and calls == [4, 2, 2]

    scan = spark.createDataFrame([(f, x, y, float((x * 7 + y * 3 + f) % 5 < 3)) for f in (1, 2) for x in range(8) for y in range(8)], "frame_id long, x int, y int, value double")
    monkeypatch.setattr(CO, "generate", None)
    compared = J.compare_drawings(scan, scan, least=None)
    assert {r.frame_id: r.shape for r in compared.collect()} == {1: 1.0, 2: 1.0}


def test_paint_fill_joins_a_specimen_by_broadcast(spark, monkeypatch):
    """the cells of all frames met by their place in the specimen, in as few tasks as it has cells; the parts of all
    specimens are grouped at once, and nothing looks for the nearest of a frame's cells by a grid."""
    drawn = {(1, x, y): -16777216 if x in (0, 19) or y in (0, 15) else -1 for x in range(20) for y in range(16)}
    p = spark.createDataFrame([(*k, v) for k, v in drawn.items()], "frame_id long, x int, y int, argb int")
    frames = spark.createDataFrame([(1, 20, 16)], "frame_id long, width int, height int")
    seeds = spark.createDataFrame([(1, 0, 5, 5), (1, 1, 6, 6)], "frame_id long, which int, x int, y int")
    cells = spark.createDataFrame([(x, y, 40 * x, 50 * y, 7) for x in range(3) for y in range(3)], "x int, y int, r int, g int, b int")
    specimens = [J.Specimen((10, 200, 30), cells, (3, 3)), J.Specimen((250, 20, 30), cells, (3, 3))]
    groupings, group, textures = [], G.group_points, J._textures
    monkeypatch.setattr(G, "group_points", lambda *a: groupings.append(a) or group(*a))
    monkeypatch.setattr(T, "nearest", None)
    plans = []

    def watched(*a):
        out = textures(*a)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(J, "_textures", watched)
    out = {(r.x, r.y): r.argb for r in J.paint_fill(p, frames, specimens, 2.0, seeds=seeds).collect()}
    assert len(groupings) == 2 and "BroadcastHashJoin [tx" in plans[0]
    assert out[(5, 5)] != -1 and len(out) == len(drawn)
