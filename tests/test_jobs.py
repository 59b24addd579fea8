"""The ready-made jobs on small frames against plain Python."""

import colorsys
import math

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import pixels as X
from rasterloom.plans import jobs as J

from . import plain as P

WIDE, HIGH = 44, 34
WHITE, BLACK = 0xFFFFFF, 0x000000


def signed(rgb):
    v = 0xFF000000 | rgb
    return v - (1 << 32)


def rgb_of(v):
    return (v >> 16) & 255, (v >> 8) & 255, v & 255


def hsv(rgb):
    h, s, v = colorsys.rgb_to_hsv(*[c / 255 for c in rgb_of(rgb)])
    return h * 360, s * 100, v * 100


def ink(rgb):
    """Fixed colours only: black is ink, all others of these tests are not."""
    return rgb == BLACK


def ring(cx, cy, r, w):
    return {(x, y) for x in range(WIDE) for y in range(HIGH) if (r - w) ** 2 < (x - cx) ** 2 + (y - cy) ** 2 <= r * r}


def disk(cx, cy, r):
    return {(x, y) for x in range(WIDE) for y in range(HIGH) if (x - cx) ** 2 + (y - cy) ** 2 <= r * r}


def frame(*painted, ground=WHITE):
    """Cells of a frame: a ground with colours on it, later ones on top."""
    out = {(x, y): ground for x in range(WIDE) for y in range(HIGH)}
    for cells, rgb in painted:
        out.update({c: rgb for c in cells if c in out})
    return out


def table(spark, frames):
    return spark.createDataFrame([(i, x, y, signed(v)) for i, f in frames.items() for (x, y), v in f.items()], "frame_id long, x int, y int, argb int").cache()


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.frame_id, {})[(r.x, r.y)] = r.argb & 0xFFFFFF
    return out


def points(spark, shapes):
    return spark.createDataFrame([(i, x, y) for i, cells in shapes.items() for x, y in cells], "shape_id long, x int, y int")


def sizes(spark, frames):
    """As large as a mini image, so that both are the same."""
    return spark.createDataFrame([(i, 320, 240) for i in frames], "frame_id long, width int, height int")


def multiply(a, b):
    return sum(((x * y + 127) // 255) << s for x, y, s in zip(rgb_of(a), rgb_of(b), (16, 8, 0)))


def subtract(a, b):
    return sum(max(0, x - y) << s for x, y, s in zip(rgb_of(a), rgb_of(b), (16, 8, 0)))


FRAMES = {
    0: frame((disk(20, 16, 9), 0xC8B4A0), (ring(20, 16, 12, 3), BLACK), ({(2, 2), (3, 2)}, BLACK)),
    5: frame((disk(24, 17, 8), 0x3060C0), (ring(24, 17, 13, 5), BLACK), ({(40, 30)}, BLACK)),
}


def contracted(cells, dist=None):
    loop = P.trace(P.dilate(cells, max(1, round(dist))) if dist else cells)
    r = max(1, math.floor(P.outline_width(cells, loop) / 3 + 0.5))
    return P.rasterize(P.trace(P.erode(P.rasterize(loop), r)))


def test_part_combine_pastes_the_insides_in_order(spark):
    base = spark.createDataFrame([(x, y, signed(0x101010)) for x in range(WIDE) for y in range(HIGH)], "x int, y int, argb int")
    borders = {0: ring(20, 16, 12, 3), 5: ring(26, 17, 9, 2)}
    out = {(r.x, r.y): r.argb & 0xFFFFFF for r in J.part_combine(base, table(spark, FRAMES), points(spark, borders)).collect()}
    want = {(x, y): 0x101010 for x in range(WIDE) for y in range(HIGH)}
    for i in (0, 5):
        want.update({c: FRAMES[i][c] for c in P.rasterize(P.trace(borders[i])) if c in FRAMES[i]})
    assert out == want


@pytest.mark.parametrize("given", [False, True])
def test_paint_crop_takes_the_object_or_the_given_border(spark, given):
    rect = (6, 2, 36, 30)
    within = lambda cells: {(x, y) for x, y in cells if 6 <= x < 42 and 2 <= y < 32}
    border = {0: ring(22, 16, 10, 2), 5: ring(24, 17, 13, 3)}
    ground = {i: frame(ground=0x224466) for i in FRAMES}
    out = got(J.paint_crop(table(spark, FRAMES), table(spark, ground), rect, 2.0, border=points(spark, border) if given else None))
    for i, f in FRAMES.items():
        cells = within(border[i]) if given else P.largest(within({c for c, v in f.items() if ink(v)}), 2.0)
        inner = contracted(cells, None if given else 2.0)
        assert out[i] == {c: f[c] if c in inner else 0x224466 for c in f}
        assert len(inner) > 80


def test_part_overlay_multiplies_and_lays_the_inside_over(spark):
    ground = {i: frame(ground=0x80C0F0) for i in FRAMES}
    out = got(J.part_overlay(table(spark, FRAMES), table(spark, ground), sizes(spark, FRAMES), 2.0))
    for i, f in FRAMES.items():
        inner = contracted(P.largest({c for c, v in f.items() if ink(v)}, 2.0), 2.0)
        assert out[i] == {c: v if c in inner else multiply(0x80C0F0, v) for c, v in f.items()}


def test_ink_xerox_stamps_the_closed_drawing(spark):
    """The drawing is neither gray nor white: coloured pencil."""
    pencil = {i: {c: 0x402010 if v == BLACK else 0xFAFAFA for c, v in f.items()} for i, f in FRAMES.items()}
    out = got(J.ink_xerox(table(spark, pencil), sizes(spark, pencil), signed(0x203040), 1.5))
    for i, f in pencil.items():
        drawing = P.largest({c for c, v in f.items() if v == 0x402010}, 1.5)
        body = P.dilate(P.erode(P.dilate(drawing, 3), 4), 1)
        dabs = {(x + dx, y + dy) for x, y in body for dx in range(-3, 4) for dy in range(-3, 4) if math.hypot(dx, dy) <= 2.5}
        assert out[i] == {c: 0x203040 if c in dabs else WHITE for c in f}


def difference(cells):
    """A specimen's cells against their mean colour."""
    mean = [math.floor(sum(rgb_of(v)[k] for v in cells.values()) / len(cells) + 0.5) for k in range(3)]
    return {c: sum(abs(v - m) << s for v, m, s in zip(rgb_of(rgb), mean, (16, 8, 0))) for c, rgb in cells.items()}


def grain(w, h):
    return {(x, y): ((x * 37 + y * 11) % 90 + 100) << 16 | ((x * 5 + y * 23) % 80 + 90) << 8 | (x * y) % 60 + 80 for x in range(w) for y in range(h)}


@pytest.mark.parametrize("seeded", [False, True])
def test_paint_fill_centres_scales_and_tiles(spark, seeded):
    """Three inner parts of one drawing; their specimens are larger, a little smaller, and much smaller."""
    walls = {(x, y) for x in range(2, 42) for y in range(2, 32) if x in (2, 3, 14, 15, 27, 28, 40, 41) or y in (2, 3, 30, 31)}
    drawn = {0: frame((walls, BLACK)), 3: frame((walls, BLACK), ({(9, y) for y in range(2, 12)}, BLACK))}
    colors = [0xC83232, 0x32C832, 0x3232C8]
    rooms = [{(x, y) for x in range(a, b + 1) for y in range(4, 30)} for a, b in ((4, 13), (16, 26), (29, 39))]
    painted = {i: frame(*[(room, color) for room, color in zip(rooms, colors)], (walls, BLACK)) for i in drawn}
    grains = [grain(20, 30), grain(11, 24), grain(4, 3)]
    sized = [(20, 30), (11, 24), (4, 3)]
    specimens = [
        J.Specimen(rgb_of(color), spark.createDataFrame([(x, y, *rgb_of(v)) for (x, y), v in g.items()], "x int, y int, r int, g int, b int"), size)
        for color, g, size in zip(colors, grains, sized)
    ]
    seeds = spark.createDataFrame([(i, k, x, 20) for i in drawn for k, x in enumerate((6, 20, 35))], "frame_id long, which int, x int, y int")
    more = {"seeds": seeds} if seeded else {"painted": table(spark, painted)}
    out = got(J.paint_fill(table(spark, drawn), sizes(spark, drawn), specimens, 2.0, **more))
    for i, f in drawn.items():
        parts = [next(g for g in P.groups({c for c, v in f.items() if not ink(v)}, 1.0) if (x, 20) in g) for x in (6, 20, 35)]
        dark = {c for c, v in f.items() if ink(v)}
        drawing = P.largest(dark, 2.0)
        mx, my = (sum(p[k] for p in drawing) / len(drawing) for k in (0, 1))
        anchor = min(drawing, key=lambda p: (round((p[0] - mx) ** 2 + (p[1] - my) ** 2, 9), p))
        loop = P.trace(P.dilate(drawing, 2))
        vertex = min(loop, key=lambda p: (math.dist(p, anchor), loop.index(p)))
        r = max(1, math.floor(min(math.dist(vertex, c) for part in parts for c in part) / 3))
        want = dict(f)
        regions = [P.rasterize(P.trace(P.dilate(part, r))) for part in parts]
        for region, color in zip(regions, colors):
            want.update({c: multiply(want[c], color) for c in region if c in want})
        for k, (part, region, size) in enumerate(zip(parts, regions, sized)):
            noise, laid = difference(grains[k]), {}
            x0, y0 = min(x for x, _ in part), min(y for _, y in part)
            w, h = max(x for x, _ in part) - x0 + 1, max(y for _, y in part) - y0 + 1
            percent, starts = 100.0, None
            over = [(a - b) * 100 / b for a, b in zip((w, h), size)]
            if w < size[0] and h < size[1]:
                pass
            elif all(0 <= v <= 10 for v in over):
                percent = (max(w / size[0], h / size[1]) + 1) * 100
            else:
                if math.ceil(w / size[0]) * math.ceil(h / size[1]) > 10:
                    percent = 464.827586207
                starts = True
            big = tuple(max(1, math.floor(v * percent / 100 + 0.5)) for v in size)
            if starts is None:
                starts = [(x0 + int((w - big[0]) / 2), y0 + int((h - big[1]) / 2))]
            else:
                cells = spark.createDataFrame([(1, x, y) for x, y in P.dilate(part, r)], "region_id long, x int, y int")
                starts = [(t.x, t.y) for t in X.adaptive_tiles(cells, *big).collect()]
            for sx, sy in starts:
                for a in range(big[0]):
                    for b in range(big[1]):
                        v = noise[(min(int(a * 100 / percent), size[0] - 1), min(int(b * 100 / percent), size[1] - 1))]
                        at = (sx + a, sy + b)
                        laid[at] = max(laid.get(at, -1), v)
            want.update({c: subtract(want[c], v) for c, v in laid.items() if c in region and c in want})
        wrong = {c for c in f if out[i][c] != want[c]}
        assert not wrong, (i, len(wrong), sorted(wrong)[:5])


def test_paint_fill_needs_a_seed_for_every_specimen(spark):
    s = J.Specimen((1, 2, 3), spark.createDataFrame([(0, 0, 1, 2, 3)], "x int, y int, r int, g int, b int"), (1, 1))
    with pytest.raises(ValueError):
        J.paint_fill(table(spark, FRAMES), sizes(spark, FRAMES), [s])
    with pytest.raises(Exception, match="no pixel meets"):
        J.paint_fill(table(spark, FRAMES), sizes(spark, FRAMES), [s], painted=table(spark, FRAMES)).count()


# -- joining paint to the border


def plain_joins(loop, border, extra):
    """Walk along the painted outline, vertex by vertex."""
    out, i, last = set(), 0, None
    while i < len(loop):
        x, y = loop[i]
        column = min(((abs(b - y), b) for a, b in border if a == x), default=None)
        row = min(((abs(a - x), a) for a, b in border if b == y), default=None)
        far = [d[0] for d in (column, row) if d]
        if not far or min(far) > J.JOIN_REACH:
            i += min(far) + 2 if far else 1
            continue
        use = row is None or column is not None and column[0] <= row[0]
        bx, by = (x, column[1]) if use else (row[1], y)
        step = ((0, (by > y) - (by < y)) if use else ((bx > x) - (bx < x), 0))
        if (bx, by) in extra and step != (0, 0):
            while (bx + step[0], by + step[1]) in extra:
                bx, by = bx + step[0], by + step[1]
        xs, ys = [x, bx], [y, by]
        if last and last[0] != use:
            xs, ys = xs + last[1], ys + last[2]
        out |= {(a, b) for a in range(min(xs), max(xs) + 1) for b in range(min(ys), max(ys) + 1)}
        last = (use, [x, bx], [y, by])
        i += 1
    return out


SHAPES = {
    1: (disk(20, 16, 7), ring(20, 16, 12, 3), set()),
    2: (disk(15, 16, 5), ring(20, 16, 12, 3), {(x, y) for x, y in ring(20, 16, 12, 3) if x < 12}),
    3: ({(x, y) for x in range(10, 30) for y in range(10, 14)}, {(x, 17) for x in range(5, 36)} | {(33, y) for y in range(40)}, {(33, 11), (34, 11)}),
    4: ({(x, y) for x in range(4) for y in range(4)}, {(40, 30)}, set()),
    5: ({(x, y) for x in range(6) for y in range(6)}, {(x, 20) for x in range(3)}, set()),
}


def test_joins_follow_the_walk(spark):
    loops = {i: P.trace(s) for i, (s, _, _) in SHAPES.items()}
    contour = spark.createDataFrame([(i, k, *p) for i, loop in loops.items() for k, p in enumerate(loop)], "shape_id long, ord int, x int, y int")
    border = points(spark, {i: b for i, (_, b, _) in SHAPES.items()})
    extra = points(spark, {i: e for i, (_, _, e) in SHAPES.items()})
    for given in (None, extra):
        out = {i: set() for i in SHAPES}
        for r in J.joined_to_border(contour, border, given).collect():
            out[r.shape_id].add((r.x, r.y))
        assert out == {i: plain_joins(loops[i], b, e if given is not None else set()) for i, (_, b, e) in SHAPES.items()}
        assert out[1] and not out[4]


def test_walks_stop_where_pointers_lead(spark):
    steps = {1: [1, 2, 5, 4, 5, 9, 7], 2: [7], 3: [1, 3, 3, 9]}
    df = spark.createDataFrame([(i, k, to) for i, each in steps.items() for k, to in enumerate(each)], "shape_id long, ord int, `to` int")
    assert {(r.shape_id, r.ord) for r in J.reached(df).collect()} == {(1, 0), (1, 1), (1, 2), (1, 5), (2, 0), (3, 0), (3, 1), (3, 3)}


@pytest.mark.parametrize("given", [False, True])
def test_paint_merge_fill_moves_joined_paint_to_the_base(spark, given):
    paint = 0xC02060
    base = {i: frame((ring(15, 14, 10, 2), BLACK), ({(40, 3), (40, 4)}, BLACK)) for i in (0, 2, 9)}
    moved = {
        0: frame((disk(22, 17, 6), paint), (ring(22, 17, 10, 2), BLACK), ({(24, 18)}, WHITE), (disk(4, 4, 2), paint), ({(1, 30), (2, 30)}, BLACK)),
        2: frame((disk(18, 16, 5), paint), (ring(20, 16, 10, 2), BLACK)),
        9: frame((ring(20, 16, 10, 2), BLACK)),
    }
    sample = spark.createDataFrame([(0, x, y, signed(paint)) for x in range(5) for y in range(5)], "frame_id long, x int, y int, argb int")
    more = {}
    if given:
        more = {
            "border": points(spark, {i: {(15, 24)} for i in base}),
            "selection": spark.createDataFrame([(i, 10, 4, 14, 26) for i in base], "frame_id long, x int, y int, width int, height int"),
        }
    out = got(J.paint_merge_fill(table(spark, base), table(spark, moved), sample, 2.0, **more))
    for i, f in moved.items():
        dark = lambda g: {c for c, v in g.items() if v == BLACK}
        root = next(g for g in P.groups(dark(base[i]), 3.0) if (15, 24) in g)
        object_ = min(P.groups(dark(f), 2.0), key=lambda g: (min(math.dist(a, b) for a in g for b in root), min(g)))
        loop = P.trace(P.dilate(object_, 2))
        chosen = lambda c: not given or 10 <= c[0] < 24 and 4 <= c[1] < 30
        fill = P.fill_enclosed({c for c, v in f.items() if v == paint and chosen(c) and P.inside(c, loop)})
        joins = plain_joins(P.trace(fill), object_, object_ - root) if fill else set()
        dx = min(x for x, _ in root) - min(x for x, _ in object_)
        dy = min(y for _, y in root) - min(y for _, y in object_)
        want = dict(base[i])
        for x, y in fill | joins:
            if chosen((x, y)) and P.inside((x, y), loop) and (x, y) in f and (x + dx, y + dy) in want:
                want[(x + dx, y + dy)] = f[(x, y)]
        assert out[i] == want
        assert (i == 9) == (want == base[i])


def test_auto_ink_compares_and_renders_the_largest_drawings(spark):
    """Specks beside the drawings count neither for the comparison nor for the rendering."""
    from rasterloom.operators import compare as CO

    def scan(shapes):
        rows = []
        for i, (strokes, specks) in shapes.items():
            rows += [(i, x, y, 0.9 if (x, y) in strokes else 0.8 if (x, y) in specks else 0.003 * ((x + y) % 3)) for x in range(WIDE) for y in range(HIGH)]
        return spark.createDataFrame(rows, "frame_id long, x int, y int, value double").cache()

    pencil = {0: (ring(20, 16, 9, 2), {(1, 1), (2, 1)}), 3: (ring(22, 15, 11, 3), {(42, 32)})}
    inked = {0: (ring(20, 16, 9, 4), {(40, 2)}), 3: (ring(20, 17, 10, 5), set())}
    a, b = scan(pencil), scan(inked)
    drawings = [points(spark, {i: s for i, (s, _) in shapes.items()}) for shapes in (pencil, inked)]
    compared, rendered = J.auto_ink(a, b, 2.0, least=None)
    looks = [CO.appearances(CO.register_rasters(s, drawing=d)) for s, d in zip((a, b), drawings)]
    plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
    assert plain(compared) == plain(CO.compare_appearances(*looks, None)) and compared.count() == 2
    want = plain(CO.generate(a, b, looks=tuple(looks), drawings=tuple(drawings)))
    gray = {r[:3]: r[3] for r in plain(rendered)}
    assert gray == {r[:3]: r[3] for r in want} and len(gray) == 2 * WIDE * HIGH
    assert gray[(0, 1, 1)] == 255 and gray[(0, 28, 16)] < 128
