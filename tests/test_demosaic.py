"""Demosaic and lens jobs against pixel-by-pixel forms, and tile-size invariance."""

import random

import pytest
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.operators import lens, tiles
from rawlake.session import small_table

W, H = 14, 11
PATTERNS = ["RGGB", "GRBG", "GBRG", "BGGR"]


def frame(seed):
    r = random.Random(seed)
    return [r.randrange(0, 4096) for _ in range(W * H)]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, p, W, H, frame(i)) for i, p in enumerate([*PATTERNS, "QuadBayerRGGB"])]
    return small_table(spark, rows, "frame_id int, pattern string, frame_w int, frame_h int, px array<int>")


def color_of(pattern):
    cfa = vocab.CFA.get(pattern, vocab.CFA["RGGB"])
    return lambda x, y: cfa[(y & 1) * 2 + (x & 1)]


def edges_by_pixel(px, pattern, black):
    """Direct form of the edge-directed method, one pixel at a time."""
    color = color_of(pattern)
    clamp = lambda v, top: max(0, min(v, top))

    def cfa(x, y):
        return max(0.0, px[clamp(y, H - 1) * W + clamp(x, W - 1)] - black[color(x, y)])

    def low(hx, hy):
        taps = (1, 4, 6, 4, 1)
        return sum(a * b * cfa(2 * hx + i - 2, 2 * hy + j - 2) for i, a in enumerate(taps) for j, b in enumerate(taps)) / 256

    def ratio(hx, hy, first, second):
        c = low(hx, hy)
        a = sum(abs(c - low(hx + dx, hy + dy)) for dx, dy in first)
        b = sum(abs(c - low(hx + dx, hy + dy)) for dx, dy in second)
        return a / (1e-5 + a + b)

    def vh(x, y):
        x, y = clamp(x, W - 1), clamp(y, H - 1)
        return ratio(x // 2, y // 2, [(0, -1), (0, 1)], [(-1, 0), (1, 0)])

    def pq(x, y):
        half = lambda v: int(v / 2)
        hx, hy = clamp(half(x), W // 2 - 1), clamp(half(y), H // 2 - 1)
        return ratio(hx, hy, [(-1, -1), (1, 1)], [(1, -1), (-1, 1)])

    def chosen(fn, x, y):
        here = fn(x, y)
        near = 0.25 * (fn(x - 1, y - 1) + fn(x + 1, y - 1) + fn(x - 1, y + 1) + fn(x + 1, y + 1))
        return near if abs(0.5 - here) < abs(0.5 - near) else here

    def raw(x, y):
        return cfa(x, y) if 0 <= x < W and 0 <= y < H else 0.0

    greens = {}

    def green(x, y):
        if (x, y) not in greens:
            if color(x, y) == 1:
                greens[x, y] = raw(x, y)
            else:
                c = 2 * raw(x, y)
                h = 0.5 * (raw(x - 1, y) + raw(x + 1, y)) + 0.25 * (c - raw(x - 2, y) - raw(x + 2, y))
                v = 0.5 * (raw(x, y - 1) + raw(x, y + 1)) + 0.25 * (c - raw(x, y - 2) - raw(x, y + 2))
                t = chosen(vh, x, y)
                greens[x, y] = v * (1 - t) + h * t
        return greens[x, y]

    def gap(x, y):
        return raw(x, y) - green(x, y)

    out = {}
    for y in range(H):
        for x in range(W):
            c, g = color(x, y), green(x, y)
            if c == 1:
                across = g + 0.5 * (gap(x - 1, y) + gap(x + 1, y))
                along = g + 0.5 * (gap(x, y - 1) + gap(x, y + 1))
                out[x, y] = (across, g, along) if color(x - 1, y) == 0 else (along, g, across)
            else:
                p = 0.5 * (gap(x - 1, y - 1) + gap(x + 1, y + 1))
                q = 0.5 * (gap(x + 1, y - 1) + gap(x - 1, y + 1))
                t = chosen(pq, x, y)
                other = g + p * (1 - t) + q * t
                out[x, y] = (raw(x, y), g, other) if c == 0 else (other, g, raw(x, y))
    return out


@pytest.mark.parametrize("size", [(64, 64), (4, 5), (3, 8)])
def test_edges_match_and_do_not_depend_on_tiles(frames, size):
    black = [64.0, 70.0, 90.0]
    t = tiles.cut_tiles(frames, *size, tiles.EDGE_HALO).withColumn("black_rgb", F.array(*[F.lit(b) for b in black]))
    rows = tiles.plane_pixels(tiles.demosaic_edges(t)).collect()
    assert len(rows) == 5 * W * H
    want = {i: edges_by_pixel(frame(i), p, black) for i, p in enumerate([*PATTERNS, "RGGB"])}
    for r in rows:
        assert (r.r, r.g, r.b) == pytest.approx(want[r.frame_id][r.x, r.y], abs=1e-6)


def export_by_pixel(px, pattern):
    """Direct form of the export demosaic; remainders keep the sign."""
    parity = tiles.RED_PARITY.get(pattern)
    rem = lambda v: v - 2 * int(v / 2)
    red = lambda x, y: parity is not None and rem(x) == parity[0] and rem(y) == parity[1]
    blue = lambda x, y: parity is not None and rem(x) == 1 - parity[0] and rem(y) == 1 - parity[1]
    green = lambda x, y: not red(x, y) and not blue(x, y)
    at = lambda x, y: float(px[y * W + x]) if 0 <= x < W and 0 <= y < H else 0.0

    def mean(x, y, steps, test):
        hits = [at(x + dx, y + dy) for dx, dy in steps if test(x + dx, y + dy)]
        return sum(hits) / len(hits) if hits else at(x, y)

    cross, corners = [(0, -1), (0, 1), (-1, 0), (1, 0)], [(-1, -1), (1, -1), (-1, 1), (1, 1)]
    out = {}
    for y in range(H):
        for x in range(W):
            v = at(x, y)
            if red(x, y):
                out[x, y] = (v, mean(x, y, cross, green), mean(x, y, corners, blue))
            elif blue(x, y):
                out[x, y] = (mean(x, y, corners, red), mean(x, y, cross, green), v)
            else:
                s = 1 if y % 2 == 0 else -1
                out[x, y] = (mean(x + s, y, corners, red), v, mean(x - s, y, corners, blue))
    return out


@pytest.mark.parametrize("size", [(64, 64), (4, 5), (1, 3)])
def test_export_demosaic(frames, size):
    rows = tiles.demosaic_export(tiles.cut_tiles(frames, *size, 2)).collect()
    want = {i: export_by_pixel(frame(i), p) for i, p in enumerate([*PATTERNS, "QuadBayerRGGB"])}
    assert len(rows) == 5 * W * H
    for r in rows:
        assert (r.r, r.g, r.b) == pytest.approx(want[r.frame_id][r.x, r.y])


def test_preview_demosaic_tile_invariance(frames):
    whole = tiles.demosaic_preview(tiles.cut_tiles(frames, 64, 64, 1)).collect()
    cut = tiles.demosaic_preview(tiles.cut_tiles(frames, 3, 4, 1)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut))


def lens_input(spark, px, w, h, gains, white, gw=2, gh=2):
    df = small_table(
        spark, [(0, "RGGB", w, h, px, [gains] * 4, gw, gh, w, h, 0, 0, [0.0, 0.0, 0.0], white, white)],
        "frame_id int, pattern string, frame_w int, frame_h int, px array<int>, lens_grid array<array<double>>, grid_w int, grid_h int, "
        "sensor_w int, sensor_h int, crop_x int, crop_y int, src_black array<double>, src_white double, out_white double",
    )
    extra = [c for c in df.columns if c.startswith("crop")]
    return tiles.cut_tiles(df.drop(*extra), 2, 3, 1).withColumns({c: F.lit(0) for c in extra})


def test_unit_grid_changes_nothing(spark):
    px = list(range(16))
    for levels in (True, False):
        t = lens.correct_tiles(lens_input(spark, px, 4, 4, [1.0] * 4, 65535.0), levels)
        got = {(r.y, r.x): r.v for r in tiles.mosaic_pixels(t).collect()}
        assert [got[i // 4, i % 4] for i in range(16)] == px


def test_uniform_gain_scales_and_clamps(spark):
    t = lens.correct_tiles(lens_input(spark, [100] * 16, 4, 4, [2.0] * 4, 65535.0), False)
    assert {r.v for r in tiles.mosaic_pixels(t).collect()} == {200.0}
    t = lens.correct_tiles(lens_input(spark, [100] * 16, 4, 4, [2.0] * 4, 150.0), False)
    assert {r.v for r in tiles.mosaic_pixels(t).collect()} == {150.0}


def test_bilinear_grid(spark):
    one = spark.range(1)
    grid = F.array(*[F.lit(v) for v in (1.0, 1.0, 1.0, 1.0, 2.0, 1.0, 1.0, 1.0, 1.0)])
    centre = lens.blend(grid, F.lit(3), F.lit(3), F.lit(0.5), F.lit(0.5))
    corner = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0))
    ends = [lens.blend(corner, F.lit(2), F.lit(2), F.lit(v), F.lit(v)) for v in (0.0, 1.0)]
    assert tuple(one.select(centre.alias("c"), ends[0].alias("a"), ends[1].alias("b")).first()) == (2.0, 1.0, 4.0)


def test_colour_only_grid(spark):
    grid = F.array(*[F.array(F.lit(v), F.lit(3.0)) for v in (4.0, 2.0, 2.0, 4.0)])
    got = spark.range(1).select(lens.colour_only(grid).alias("g")).first().g
    assert got == [[2.0, 1.0], [1.0, 1.0], [1.0, 1.0], [2.0, 1.0]]
