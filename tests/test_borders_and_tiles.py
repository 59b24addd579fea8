"""Border interpolation, distances at any reach, tile covers and per-shape erosion against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import contours as K
from rasterloom.operators import groups as G
from rasterloom.operators import model as M
from rasterloom.operators import pixels as X
from rasterloom.operators import points as T
from rasterloom.sources import images

POINTS = "shape_id long, x int, y int"


def shape(spark, cells, shape_id=1):
    return spark.createDataFrame([(shape_id, x, y) for x, y in cells], POINTS)


def cells_of(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_missing_columns_of_two_straight_strands_are_filled(spark):
    given = [(x, y) for x in range(0, 41) if x % 5 < 2 for y in (10 + x, 100 - x)]
    got = cells_of(T.fill_border(shape(spark, given)), "x", "y")
    assert {(x, y) for x in range(0, 41) for y in (10 + x, 100 - x)} <= got
    assert got == {(x, y) for x in range(0, 41) for y in (10 + x, 100 - x)}


def test_curves_are_interpolated_by_cubics_and_short_strands_left_alone(spark):
    curve = lambda x: 0.01 * x**3 - 0.3 * x**2 + 2 * x + 50
    doubles = spark.createDataFrame([(1, float(x), curve(x)) for x in range(0, 31, 3)] + [(2, 0.0, 1.0), (2, 3.0, 4.0)], "shape_id long, x double, y double")
    rows = T.interpolate_border(doubles).collect()
    assert {r.x for r in rows if r.shape_id == 1} == set(map(float, range(31)))
    assert all(r.y == pytest.approx(curve(r.x)) for r in rows if r.shape_id == 1)
    assert {(r.x, r.y) for r in rows if r.shape_id == 2} == {(0.0, 1.0), (3.0, 4.0)}


def test_near_rows_of_a_column_collapse_to_the_nearest(spark):
    given = [(x, 20) for x in range(25) if x not in (13, 14)] + [(15, 22)]
    got = cells_of(T.fill_border(shape(spark, given)), "x", "y")
    assert len({(15, 20), (15, 22)} & got) == 1 and {x for x, _ in got} == set(range(25))
    assert T.fill_border(shape(spark, [])).count() == 0


def test_rescaled_points_leave_no_gap(spark):
    got = cells_of(T.rescale_points(shape(spark, [(x, 5) for x in range(10)]), 3.0), "x", "y")
    assert {x for x, _ in got} == set(range(28)) and {y for _, y in got} == {15}


@pytest.fixture(scope="module")
def clouds():
    rng = random.Random(4)
    near = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)}
    return near | {(900, 7)}, {(rng.randrange(-30, 80), rng.randrange(-30, 80)) for _ in range(60)} | {(5000, -3000), (901, 7)}


def test_distances_have_no_reach(spark, clouds):
    points, asked = clouds
    p, q = shape(spark, points), shape(spark, asked)
    chamfer = lambda a, b: 3 * max(abs(a[0] - b[0]), abs(a[1] - b[1])) + min(abs(a[0] - b[0]), abs(a[1] - b[1]))
    got = {(r.x, r.y): r.distance for r in T.chamfer_distance(q, p).collect()}
    assert got == {a: min(chamfer(a, b) for b in points) for a in asked}
    square = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    found = {(r.qx, r.qy): (r.x, r.y, r.distance) for r in T.nearest(p, q.select("shape_id", F.col("x").alias("qx"), F.col("y").alias("qy"))).collect()}
    for a in asked:
        d, x, y = min((square(a, b), *b) for b in points)
        assert found[a] == (x, y, pytest.approx(d**0.5))
    far = shape(spark, {(10_000, 0)})
    assert T.min_distance(shape(spark, {(0, 0), (3, 4)}), far).first().distance == pytest.approx(((10_000 - 3) ** 2 + 16) ** 0.5)
    assert T.min_distance(shape(spark, {(0, 0)}), shape(spark, {(1, 1)}, 2)).first().distance is None
    assert {r.distance for r in T.chamfer_distance(q, shape(spark, {(1, 1)}, 2)).collect()} == {None}


def test_nearest_group_at_any_distance(spark):
    groups = G.group_points(shape(spark, {(0, 0), (1, 0), (400, 0), (401, 1)}), 2.0)
    got = G.nearest_group(groups, shape(spark, {(1000, 0)})).first()
    assert got.distance == pytest.approx((599**2 + 1) ** 0.5) and got.label == min(r.label for r in groups.where("x >= 400").collect())


def plain_tiles(cells, w, h):
    x0, x1 = min(x for x, _ in cells), max(x for x, _ in cells)
    y0, y1 = min(y for _, y in cells), max(y for _, y in cells)
    bare, out = set(cells), []

    def run(x, y, dx, dy):
        a = b = 0
        while (x + (a - 1) * dx, y + (a - 1) * dy) in cells:
            a -= 1
        while (x + (b + 1) * dx, y + (b + 1) * dy) in cells:
            b += 1
        return (x + a, x + b) if dx else (y + a, y + b)

    def starts(at, line, low, high, size):
        centre = lambda a, b: (a + b - size + 1) // 2
        every = [centre(*line), centre(low, high), at - size // 2, line[0], line[1] - size + 1, low, high - size + 1, at, at - size + 1]
        return [s for s in dict.fromkeys(every) if s <= at < s + size]

    while bare:
        y, x = min((y, x) for x, y in bare)
        across, down = run(x, y, 1, 0), run(x, y, 0, 1)
        best = None
        for tx in starts(x, across, x0, x1, w):
            for ty in starts(y, down, y0, y1, h):
                tile = {(a, b) for a in range(tx, tx + w) for b in range(ty, ty + h)}
                rim = {(a, b) for a, b in tile if a in (tx, tx + w - 1) or b in (ty, ty + h - 1)}
                corner = sum((cx + i, cy + j) in cells for cx in (tx, tx + w - 1) for cy in (ty, ty + h - 1) for i in range(-2, 3) for j in range(-2, 3))
                off = abs(tx - (across[0] + across[1] - w + 1) // 2) + abs(ty - (down[0] + down[1] - h + 1) // 2)
                score = 4096 * len(tile & bare) - 256 * len(rim & cells) - 8192 * corner - off
                if best is None or score > best[0]:
                    best = score, tx, ty, tile
        bare -= best[3]
        out.append(best[1:3])
    return out


@pytest.mark.parametrize("w,h", [(6, 4), (5, 5), (1, 3)])
def test_tiles_match_the_plain_rule(spark, w, h):
    disk = {(x, y) for x in range(-11, 12) for y in range(-11, 12) if x * x + y * y <= 121}
    odd = {(x, y) for x in range(30) for y in range(9) if (x // 3 + y // 4) % 4} | {(40, 2)}
    df = spark.createDataFrame([(i, x, y) for i, s in enumerate((disk, odd)) for x, y in s], "region_id long, x int, y int")
    got = {i: [] for i in (0, 1)}
    for r in X.adaptive_tiles(df, w, h).orderBy("region_id", "tile").collect():
        got[r.region_id].append((r.x, r.y))
    assert got == {0: plain_tiles(disk, w, h), 1: plain_tiles(odd, w, h)}


def test_erosion_by_a_radius_per_shape(spark):
    disk = {(x, y) for x in range(-9, 10) for y in range(-9, 10) if x * x + y * y <= 81}
    df = shape(spark, disk, 1).unionAll(shape(spark, disk, 2)).unionAll(shape(spark, disk, 3))
    radii = spark.createDataFrame([(1, 0), (2, 3)], "shape_id long, r int")
    got = {i: set() for i in (1, 2, 3)}
    for r in T.erode_by(df, radii).collect():
        got[r.shape_id].add((r.x, r.y))
    assert got[1] == got[3] == disk and got[2] == cells_of(T.erode(shape(spark, disk), 3), "x", "y")


def test_outlines_are_smoothed_by_their_own_thickness(spark):
    """Rings of two widths with notches and pinholes come back whole, at most one layer wider."""
    def ring(r, w):
        return {(x, y) for x in range(-r, r + 1) for y in range(-r, r + 1) if (r - w) ** 2 < x * x + y * y <= r * r}

    thick, thin = ring(40, 9), ring(40, 3)
    broken = {1: (thick - {(36, 0), (0, 35), (1, 35)}), 2: thin - {(-39, 0)}}
    points = spark.createDataFrame([(i, x, y) for i, cells in broken.items() for x, y in cells], POINTS)
    contour = K.trace(shape(spark, thick, 1).unionAll(shape(spark, thin, 2))).cache()
    widths = {r.shape_id: r.thickness for r in K.thickness_of(points, contour).collect()}
    assert widths[1] >= 2 * widths[2] >= 4
    got = {1: set(), 2: set()}
    for r in K.smooth_outline(points, contour).collect():
        got[r.shape_id].add((r.x, r.y))
    for i, whole in ((1, thick), (2, thin)):
        assert len(whole - got[i]) < 0.02 * len(whole) and len(got[i] - whole) < 0.3 * len(whole)
        assert (thick if i == 1 else thin) - broken[i] <= got[i]


def plain_match(a, b):
    """(other, score, confidence) per sample, all pairs in plain Python."""
    import math

    def near(rows, loc):
        return min(rows, key=lambda r: (round(min(abs(r.location - loc + t) for t in (-1, 0, 1)), 12), r.ord)).ord

    def score(p, q):
        turn = abs(math.atan2(p.ty, p.tx) - math.atan2(q.ty, q.tx))
        arc = abs(p.location - q.location)
        return round(
            math.hypot(p.u - q.u, p.v - q.v) + 0.6 * min(turn, 2 * math.pi - turn) / math.pi + 0.45 * min(1, abs(p.derivative - q.derivative))
            + 0.3 * abs(p.share - q.share) + 0.4 * min(arc, 1 - arc), 12,
        )

    def best(p, rows):
        at, n = near(rows, p.location), len(rows)
        tried = [(d, rows[(at + d) % n]) for d in range(-12, 13)]
        arcs = lambda q: min(abs(p.location - q.location), 1 - abs(p.location - q.location))
        local = [(score(p, q), d, q.ord) for d, q in tried if arcs(q) <= 0.025]
        return min(local or [(score(p, q), q.ord, q.ord) for q in rows])

    out = {}
    for p in a:
        s, _, other = best(p, b)
        back = best(b[other], a)[2]
        out[p.ord] = (other, pytest.approx(s), pytest.approx(min(1, max(0.1, (1 if back == p.ord else 0.65) / (1 + s)))))
    return out


def test_matches_scan_all_samples_where_none_is_near(spark):
    ring = [(round(20 * c), round(14 * s)) for c, s in [(0, -1), (0.5, -0.87), (0.87, -0.5), (1, 0), (0.87, 0.5), (0.5, 0.87), (0, 1), (-0.5, 0.87), (-0.87, 0.5), (-1, 0), (-0.87, -0.5), (-0.5, -0.87)]]
    contour = lambda pts: spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(pts)], "shape_id long, ord int, x int, y int")
    dense = [p for a, b in zip(ring, ring[1:] + ring[:1]) for p in (a, ((a[0] + b[0]) // 2, (a[1] + b[1]) // 2), ((a[0] + 3 * b[0]) // 4, (a[1] + 3 * b[1]) // 4))]
    for p, q in ((dense, ring[::2]), (ring, dense)):
        fa, fb = M.build_features(contour(p)), M.build_features(contour(q))
        a, b = (sorted(M.comparable(f).collect(), key=lambda r: r.ord) for f in (fa, fb))
        got = {r.ord: (r.other, r.score, r.confidence) for r in M.best_match(fa, fb).collect()}
        assert got == plain_match(a, b)


def test_outer_edge_grows_its_rays_with_the_perimeter(spark):
    import math

    ring = [(round(400 * math.cos(t / 500 * math.tau)), round(400 * math.sin(t / 500 * math.tau))) for t in range(500)]
    contour = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(ring)] + [(2, i, x, y) for i, (x, y) in enumerate([(0, 0), (9, 0), (9, 9), (0, 9)])], "shape_id long, ord int, x int, y int")
    length = sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1]))
    got = {1: {}, 2: {}}
    for r in K.outer_edge(contour).collect():
        got[r.shape_id][r.bin] = r.radius
    assert len(got[1]) == math.ceil(1.5 * length) and len(got[2]) == 720
    assert all(abs(v - 400) < 2 for v in got[1].values())
    for b, v in got[2].items():
        t = (b + 0.5) * math.tau / 720
        assert v == pytest.approx(4.5 / max(abs(math.cos(t)), abs(math.sin(t))))
    mid = K.halfway(contour, contour).where("shape_id = 2").collect()
    assert len(mid) == 720 and {max(abs(r.x - 4.5), abs(r.y - 4.5)) for r in mid} <= {4.5, 3.5, 5.5}


def test_anchors_average_along_the_loop(spark):
    import math

    ring = [(round(20 * math.cos(t / 30 * math.tau)), round(14 * math.sin(t / 30 * math.tau))) for t in range(30)]
    rng = random.Random(2)
    members = sorted({(x + rng.randrange(-2, 3), y + rng.randrange(-2, 3)) for x, y in ring})
    contour = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(ring)], "shape_id long, ord int, x int, y int")
    up = lambda v: math.floor(v + 0.5)

    def average(pts, i, r):
        w = [(r + 1 - abs(d), pts[(i + d) % len(pts)]) for d in range(-r, r + 1)]
        return tuple(up(sum(k * p[c] for k, p in w) / sum(k for k, _ in w)) for c in (0, 1))

    smooth = [average(ring, i, 3) for i in range(30)]
    near = [min(members, key=lambda m: ((m[0] - x) ** 2 + (m[1] - y) ** 2, m)) for x, y in smooth]
    want = {}
    for i in range(30):
        mean = average(near, i, 6)
        want[i] = tuple(up(near[i][c] + (mean[c] - near[i][c]) * 0.82) for c in (0, 1))
    assert {r.ord: (r.x, r.y) for r in M.anchors(contour, shape(spark, members)).collect()} == want


def test_images_are_read_in_natural_order_and_broken_ones_are_errors(spark, tmp_path):
    from pyspark.sql import Row

    frames = {"frame 10.bmp": 3, "frame 9.bmp": 2, "frame 1.bmp": 1}
    rows = [Row(frame_id=int(n.split()[1].split(".")[0]), x=x, y=y, argb=-16777216 + v * 65536 + x * 256 + y) for n, v in frames.items() for x in range(5) for y in range(3)]
    images.write_bitmaps(spark.createDataFrame(rows, "frame_id long, x int, y int, argb int"), f"file:{tmp_path}", 5, 3)
    meta, pixels = images.read_frames(spark, f"file:{tmp_path}")
    assert [(r.frame_id, r.width, r.height, r.has_alpha) for r in meta.orderBy("frame_id").collect()] == [(i, 5, 3, False) for i in (1, 2, 3)]
    got = {(r.frame_id, r.x, r.y): r.argb for r in pixels.collect()}
    assert got == {(v, x, y): -16777216 + v * 65536 + x * 256 + y for v in (1, 2, 3) for x in range(5) for y in range(3)}
    (tmp_path / "frame 11.bmp").write_bytes(b"no image")
    with pytest.raises(Exception, match="not a readable image"):
        images.read_frames(spark, f"file:{tmp_path}")[1].collect()


def test_gray_and_transparent_images(spark, tmp_path):
    import struct
    import zlib

    def png(color, rows):
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, color, 0, 0, 0)
        body = b"".join(b"\0" + b"".join(bytes(p) for p in r) for r in rows)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png(0, [[(0,), (128,)], [(255,), (7,)]]))
    (tmp_path / "b.png").write_bytes(png(6, [[(1, 2, 3, 255), (4, 5, 6, 0)]]))
    got = {(r.frame_id, r.x, r.y): r.argb & 0xFFFFFFFF for r in images.read_frames(spark, f"file:{tmp_path}")[1].collect()}
    assert got == {(1, 0, 0): 0xFF000000, (1, 1, 0): 0xFF808080, (1, 0, 1): 0xFFFFFFFF, (1, 1, 1): 0xFF070707, (2, 0, 0): 0xFF010203, (2, 1, 0): 0x00040506}


def test_mini_anchors(spark):
    blob = {(x, y): 1 for x in range(10, 30) for y in range(20, 35)} | {(x, 40): 1 for x in range(50, 55)} | {(x, y): 2 for x in range(40, 48) for y in range(5, 12)}
    p = spark.createDataFrame([(1, x, y, blob.get((x, y), 0)) for x in range(64) for y in range(48)], "frame_id long, x int, y int, argb int")
    frames = spark.createDataFrame([(1, 64, 48)], "frame_id long, width int, height int")
    tests = lambda m: (m, [F.col("argb") == 1, F.col("argb") == 2, F.col("argb") == 3])
    got = {r.which: (r.x, r.y) for r in G.mini_anchors(p, frames, 2.0, tests, 3).collect()}
    assert set(got) == {0, 1} and abs(got[0][0] - 19.5) <= 1 and abs(got[0][1] - 27) <= 1 and blob[got[1]] == 2
    local = cells_of(G.mini_anchor_then_local(p, frames, 2.0, lambda m: (m, [F.col("argb") == 1]), F.col("argb") == 1), "x", "y")
    assert local == {k for k, v in blob.items() if v == 1 and k[1] < 36}
    with pytest.raises(Exception, match="no pixel meets predicate 2"):
        G.mini_anchors(p, frames, 2.0, tests, 3, accept_empty=False).collect()
