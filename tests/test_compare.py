"""Scan comparison and rendering against the same steps in plain Python, cell by cell."""

import math

import numpy as np
import pytest

from rasterloom.operators import compare as CO

SIZE, MARGIN, REACH = 64, 16, CO.PROBE


def scans():
    rng = np.random.default_rng(5)
    out = []
    for n in range(3):
        h, w = 18 + n, 22 - n
        image = rng.random((h, w)) * 0.08
        y, x = np.mgrid[:h, :w]
        ring = np.abs(np.hypot(x - w / 2, (y - h / 2) * 1.2) - 6 - n * 0.5)
        out.append(np.clip(image + np.where(ring < 1.6 + n * 0.3, 0.9 - ring * 0.2, np.where(ring < 3, 0.3, 0)) * (0.8 + 0.1 * n), 0, 1))
    return out


def frame(spark, images):
    rows = [(i, x, y, float(v)) for i, image in enumerate(images) for y, line in enumerate(image) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "frame_id long, x int, y int, value double")


def otsu(values, floor):
    bins = [int(math.floor(min(max(v, 0), 1) * 255 + 0.5)) for v in values if v >= floor]
    if not bins:
        return floor
    best, at, low = -1.0, max(1, math.ceil(floor * 255)), max(1, math.ceil(floor * 255))
    for t in range(low, 256):
        back, fore = [b for b in bins if low <= b <= t], None
        fore = len(bins) - len(back)
        if not back or not fore:
            continue
        mb, mf = sum(back) / len(back), (sum(bins) - sum(back)) / fore
        v = round(len(back) * fore * (mb - mf) ** 2, 6)
        if v > best and t in back:
            best, at = v, t
    return at / 255


def chamfer(mask):
    at = np.argwhere(mask)
    out = np.full(mask.shape, 1_000_000)
    for y in range(mask.shape[0]):
        for x in range(mask.shape[1]):
            if len(at):
                d = np.abs(at - (y, x))
                out[y, x] = (3 * d.max(1) + d.min(1)).min()
    return out


def bounds(image):
    seen = np.argwhere(image >= max(CO.NOISE, image.max() * CO.PEAK_SHARE))
    return seen.min(0), seen.max(0)


def registered(image):
    (y0, x0), (y1, x1) = bounds(image)
    scale = (SIZE - 2 * MARGIN) / max(x1 - x0 + 1, y1 - y0 + 1)
    left, top = (SIZE - (x1 - x0 + 1) * scale) / 2, (SIZE - (y1 - y0 + 1) * scale) / 2
    h, w = image.shape
    out = np.zeros((SIZE, SIZE))
    for j in range(SIZE):
        for i in range(SIZE):
            u, v = x0 + (i - left + 0.5) / scale - 0.5, y0 + (j - top + 0.5) / scale - 0.5
            if 0 <= u <= w - 1 and 0 <= v <= h - 1:
                x, y = int(u), int(v)
                xx, yy = min(w - 1, x + 1), min(h - 1, y + 1)
                a = image[y, x] + (image[y, xx] - image[y, x]) * (u - x)
                b = image[yy, x] + (image[yy, xx] - image[yy, x]) * (u - x)
                out[j, i] = a + (b - a) * (v - y)
    return out, scale


def look(image):
    grid, scale = registered(image)
    core = grid >= max(CO.NOISE, otsu(grid.ravel().tolist(), CO.NOISE))
    pad = np.pad(core, 1)
    edges = sum(int((core & ~pad[1 + dy : SIZE + 1 + dy, 1 + dx : SIZE + 1 + dx]).sum()) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    inside, far = grid[core], chamfer(core)
    opacity = inside.mean()
    profile, top, weight = [0.0] * (REACH + 1), 0.0, 0.0
    for k in range(1, REACH + 1):
        ring = ~core & (far / 3 >= k - 0.5) & (far / 3 < k + 0.5)
        if ring.any():
            profile[k] = min(1, grid[ring].mean() / opacity)
            top, weight = top + profile[k] * (1 - (k - 1) / REACH), weight + 1 - (k - 1) / REACH
    profile[REACH] = 0.0
    for k in range(REACH - 1, 0, -1):
        profile[k] = max(profile[k], profile[k + 1])
    return {
        "core": core, "far": far, "scale": scale, "thickness": 2 * core.sum() / edges, "opacity": opacity,
        "pressure": min(1, inside.std() / max(opacity, 1e-9)), "border": min(1, top / weight), "profile": profile,
    }


def alike(a, b):
    return 1.0 if a < 1e-8 and b < 1e-8 else min(1, math.exp(-abs(math.log((b + 1e-6) / (a + 1e-6)))))


@pytest.fixture(scope="module")
def pair(spark):
    images = scans()
    other = [np.clip(np.roll(i, 1, 1) * 0.9 + 0.02, 0, 1) for i in images[::-1]]
    return images, other, frame(spark, images), frame(spark, other)


def test_appearances(pair):
    images, _, df, _ = pair
    for r in CO.appearances(CO.register_rasters(df, SIZE, MARGIN)).collect():
        want = look(images[r.frame_id])
        assert np.array_equal(np.reshape(r.core, (SIZE, SIZE)), want["core"])
        assert np.array_equal(np.reshape(r.distance, (SIZE, SIZE)), want["far"])
        for k in ("scale", "thickness", "opacity", "pressure", "border", "profile"):
            assert r[k] == pytest.approx(want[k], abs=1e-9), k


def test_similarities_and_transfer(pair):
    images, other, a, b = pair
    got = {r.frame_id: r for r in CO.compare(a, b, None, SIZE, MARGIN).collect()}
    assert len(got) == 3
    for i, r in got.items():
        p, q = look(images[i]), look(other[i])
        far = (q["far"][p["core"]].mean() + p["far"][q["core"]].mean()) / 6
        assert r.shape == pytest.approx(math.exp(-far / max(1.5, 0.75 * (p["thickness"] + q["thickness"]))))
        s = {k: alike(p[k], q[k]) for k in ("thickness", "border", "opacity", "pressure")}
        want = (s["thickness"] + 1.5 * s["border"] + 0.65 * s["opacity"] + 0.35 * s["pressure"]) / 3.5
        assert r.appearance == pytest.approx(want) and r.overall == pytest.approx(r.shape * want)
        assert r.thickness_scale == pytest.approx(q["thickness"] / p["thickness"]) and r.border_delta == pytest.approx(q["border"] - p["border"])
    with pytest.raises(Exception, match="same drawing"):
        CO.compare(a, b, 0.999, SIZE, MARGIN).collect()


def rendered(image, ink, p, q, target, core, icore):
    """The tones of a target core and its halo."""
    bins = np.sort(np.floor(np.clip(image[core], 0, 1) * 255 + 0.5).astype(int))
    ibins = np.sort(np.floor(np.clip(ink[icore], 0, 1) * 255 + 0.5).astype(int))
    quantile = lambda b, s: b[max(1, math.ceil(min(max(s, 0), 1) * len(b))) - 1] / 255
    black = quantile(ibins, 0.9)
    far = chamfer(target)
    out = np.zeros(image.shape, int)
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            if target[y, x]:
                tone = image[y, x] if core[y, x] else quantile(bins, 0.5)
                share = (bins <= math.floor(min(max(tone, 0), 1) * 255 + 0.5)).sum() / len(bins)
                dark = max(quantile(ibins, 0.5), min(1, quantile(ibins, share) * (black / max(black, 1e-8))))
            else:
                d = far[y, x] / 3 * p["scale"]
                low = int(d)
                ring = 0 if d < 0.5 or d >= REACH else q["profile"][1] if d <= 1 else q["profile"][low] + (q["profile"][min(low + 1, REACH)] - q["profile"][low]) * (d - low)
                dark = min(1, ink[icore].mean()) * min(1, ring)
            out[y, x] = math.floor(255 * (1 - dark) + 0.5)
    return out


def closed(mask, r):
    wide = chamfer(mask) <= 3 * r
    return wide & (chamfer(~wide) > 3 * r)


def test_rendering_by_thickness(pair, monkeypatch):
    images, other, a, b = pair
    looks = tuple(CO.appearances(CO.register_rasters(s, SIZE, MARGIN)) for s in (a, b))
    got = {i: np.full(image.shape, -1) for i, image in enumerate(images)}
    for r in CO.generate(a, b, looks=looks).collect():
        got[r.frame_id][r.y, r.x] = r.gray
    for i, image in enumerate(images):
        p, q = look(image), look(other[i])
        core = image >= max(CO.NOISE, otsu(image.ravel().tolist(), CO.NOISE))
        icore = other[i] >= max(CO.NOISE, otsu(other[i].ravel().tolist(), CO.NOISE))
        grow = (q["thickness"] - p["thickness"]) * 0.5 / p["scale"]
        target = core | (chamfer(core) / 3 <= grow) if grow >= 0 else core & (chamfer(~core) / 3 > -grow)
        assert np.abs(got[i] - rendered(image, other[i], p, q, closed(target, 1), core, icore)).max() <= 1


def test_rendering_around_the_centre_line(spark, pair):
    images, other, a, b = pair
    points = lambda df: CO.core_of(df, CO.otsu(df, CO.NOISE))
    rows = CO.generate(a, b, drawings=(points(a), points(b))).collect()
    assert len(rows) == sum(i.size for i in images) and {r.gray for r in rows} <= set(range(256))
    dark = {i: {(r.x, r.y) for r in rows if r.frame_id == i and r.gray < 128} for i in range(3)}
    for i, image in enumerate(images):
        core = {(x, y) for y, x in np.argwhere(image >= otsu(image.ravel().tolist(), CO.NOISE)).tolist()}
        assert len(dark[i] & core) > 0.6 * len(core)


def test_sparse_scans_fill_with_zeros(spark):
    df = spark.createDataFrame([(1, 2, 3, 0.5), (1, 0, 1, 0.25), (1, 4, 1, 0.75)], "frame_id long, x int, y int, value double")
    r = CO.raster(df).first()
    want = np.zeros((4, 5))
    want[3, 2], want[1, 0], want[1, 4] = 0.5, 0.25, 0.75
    assert (r.width, r.height) == (5, 4) and np.array_equal(np.reshape(r["values"], (4, 5)), want)
