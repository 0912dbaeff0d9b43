"""Mosaic tiles with a halo, and demosaicing on them.

A tile row holds the pixels of its own area and of a halo around it, clipped to
the frame, so every stencil is local to a row and no pixel is ever shuffled:

``frame_w, frame_h``  size of the frame
``y0, x0, h, w``      area the tile is responsible for
``oy, ox, oh, ow``    stored area (with halo)
``px``                stored pixels, row by row
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawlake import vocab
from rawlake.session import attach

# Tiles of a batch that are worked on at a time.
PART = 500
GEOMETRY = ["frame_w", "frame_h", "y0", "x0", "h", "w", "oy", "ox", "oh", "ow"]


def cut_tiles(frames: DataFrame, tile_h: int = 64, tile_w: int = 512, halo: int = 9) -> DataFrame:
    """Cut whole mosaics (``px``, ``frame_w``, ``frame_h``) into tiles.

    The active area, if the frames carry one, is the area that gets covered;
    the stored pixels may reach beyond it. A frame is cut in one step that
    yields its tiles a few at a time, so its pixels are not repeated per tile.
    """
    cols = frames.columns
    crop = {
        "crop_x": F.col("crop_x") if "crop_x" in cols else F.lit(0),
        "crop_y": F.col("crop_y") if "crop_y" in cols else F.lit(0),
        "crop_w": F.col("crop_w") if "crop_w" in cols else F.col("frame_w"),
        "crop_h": F.col("crop_h") if "crop_h" in cols else F.col("frame_h"),
    }
    area = list(crop)
    keep = [c for c in cols if c not in ("px", *area)]
    whole = {"frame_w": F.col("frame_w").cast("int"), "frame_h": F.col("frame_h").cast("int"), "px": F.col("px").cast("array<int>")}
    f = frames.withColumns({**{k: v.cast("int") for k, v in crop.items()}, **whole})
    f = f.where((F.col("crop_w") > 0) & (F.col("crop_h") > 0)).select(*keep, *crop, "px")
    placed = ["tile_y", "tile_x", *[c for c in GEOMETRY if c not in keep]]
    types = {x.name: x.dataType.simpleString() for x in f.schema.fields}
    schema = ", ".join([*[f"{c} {types[c]}" for c in keep], *[f"{c} int" for c in placed], "px array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = {n: batch.column(n).to_pylist() for n in ("frame_w", "frame_h", *area)}
            for i in range(batch.num_rows):
                k = {n: v[i] for n, v in known.items()}
                px = _pixels(batch.column("px")[i]).reshape(k["frame_h"], k["frame_w"])
                made: dict[str, list] = {c: [] for c in placed}
                parts: list[np.ndarray] = []

                def flush() -> pa.RecordBatch:
                    row = batch.select(keep).take(pa.array([i] * len(parts)))
                    arrays = [*row.columns, *[pa.array(made[c], pa.int32()) for c in placed], _lists(parts, pa.int32())]
                    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *placed, "px"])

                for ty in range(-(-k["crop_h"] // tile_h)):
                    for tx in range(-(-k["crop_w"] // tile_w)):
                        y0, x0 = k["crop_y"] + ty * tile_h, k["crop_x"] + tx * tile_w
                        h, w = min(tile_h, k["crop_h"] - ty * tile_h), min(tile_w, k["crop_w"] - tx * tile_w)
                        oy, ox = max(y0 - halo, 0), max(x0 - halo, 0)
                        ye, xe = min(y0 + h + halo, k["frame_h"]), min(x0 + w + halo, k["frame_w"])
                        spot = {"tile_y": ty, "tile_x": tx, "y0": y0, "x0": x0, "h": h, "w": w, "oy": oy, "ox": ox, "oh": ye - oy, "ow": xe - ox}
                        for c in placed:
                            made[c].append(spot.get(c, k.get(c)))
                        parts.append(px[oy:ye, ox:xe].ravel())
                        if sum(map(len, parts)) > TILES_AT_ONCE:
                            yield flush()
                            made, parts = {c: [] for c in placed}, []
                if parts:
                    yield flush()

    return f.mapInArrow(run, schema)


# Pixels of the tiles in one batch.
TILES_AT_ONCE = 1 << 20


def _pixels(value) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as one list column."""
    sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts) if parts else [], kind))


def over_tiles(tiles: DataFrame, compute, need: list[str], drop: list[str], made: dict[str, pa.DataType], ddl: str, before=None, after=None) -> DataFrame:
    """One numpy call per tile: ``compute(px, fields)`` gives an array for each column of ``made``.

    ``need`` names the columns it reads, ``drop`` those that end here. Work and memory per
    pixel do not depend on the size of the tile. ``before`` (columns it keeps, function of
    batches, as of ``lens.correction``) and ``after`` (its schema, function of batches) run in the same
    Python process, so that a task holds one for all three.
    """
    whole = tiles
    if before is not None:
        tiles = tiles.select(*before[0], "px")
    rest = [c for c in tiles.columns if c not in ("px", *drop)]
    src = whole if before is not None else tiles.select(*rest, *[c for c in drop if c in tiles.columns], "px")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema.fields if f.name in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = {n: batch.column(n).to_pylist() for n in need}
            out: dict[str, list] = {n: [] for n in made}
            for i in range(batch.num_rows):
                done = compute(_pixels(batch.column("px")[i]), {n: v[i] for n, v in known.items()})
                for name, value in zip(made, done, strict=True):
                    out[name].append(value)
            arrays = [_lists(out[n], k.value_type) if pa.types.is_list(k) else pa.array(out[n], k) for n, k in made.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *arrays], names=[*rest, *made])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some tiles at a time, as a batch's rows may be ten thousand
        parts = (batch.slice(at, PART) for batch in batches for at in range(0, batch.num_rows, PART))
        made_of = run(before[1](parts) if before is not None else parts)
        return after[1](made_of) if after is not None else made_of

    return src.mapInArrow(steps, after[0] if after is not None else f"{fields}, {ddl}")


def cropped(tiles: DataFrame, crops: DataFrame, key: str = "clip_id") -> DataFrame:
    """narrow tiles to the active area of their clip (``crop_x, crop_y, crop_w, crop_h``).

    Stored pixels stay, so they serve as halo; tiles outside the area vanish.
    """
    area = crops.select(key, "crop_x", "crop_y", "crop_w", "crop_h")
    t = attach(tiles, area, [key], "inner", spread=[c for c in ("frame_id", "tile_y", "tile_x") if c in tiles.columns])
    t = t.withColumns(
        {
            "_y1": F.least(F.col("y0") + F.col("h"), F.col("crop_y") + F.col("crop_h")),
            "_x1": F.least(F.col("x0") + F.col("w"), F.col("crop_x") + F.col("crop_w")),
            "y0": F.greatest("y0", "crop_y"),
            "x0": F.greatest("x0", "crop_x"),
        }
    )
    t = t.withColumns({"h": F.col("_y1") - F.col("y0"), "w": F.col("_x1") - F.col("x0")})
    return t.where((F.col("h") > 0) & (F.col("w") > 0)).drop("_y1", "_x1", "crop_w", "crop_h")


def site_rows(tiles: DataFrame) -> DataFrame:
    """One row per covered pixel, with ``y`` and ``x``; ``px`` stays a reference."""
    spot = F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("_i")
    out = tiles.select("*", spot)
    y = F.col("y0") + F.floor(F.col("_i") / F.col("w")).cast("int")
    return out.select(*tiles.columns, y.alias("y"), (F.col("x0") + F.col("_i") % F.col("w")).alias("x"))


# The stencils are written as SQL expression text: one pixel names its neighbours
# dozens of times, and one parsed text is much quicker to build than as many
# column objects.


def pixel_at(y: str, x: str) -> str:
    """Stored value of a frame position inside the tile."""
    return f"double(get(px, ({y} - oy) * ow + ({x} - ox)))"


def pixel_or_zero(y: str, x: str) -> str:
    inside = f"{y} >= 0 AND {x} >= 0 AND {y} < frame_h AND {x} < frame_w"
    return f"CASE WHEN {inside} THEN {pixel_at(y, x)} ELSE 0D END"


def _rest(tiles: DataFrame) -> list[str]:
    return [c for c in tiles.columns if c not in (*GEOMETRY, "px", "tile_y", "tile_x")]


def mosaic_pixels(tiles: DataFrame) -> DataFrame:
    """Long form of the mosaic: ``y, x, v``."""
    rows = site_rows(tiles)
    return rows.select(*_rest(tiles), "frame_w", "frame_h", "y", "x", F.expr(pixel_at("y", "x")).alias("v"))


# parity (x, y) of the red sites; quad patterns have no site that matches
RED_PARITY = {"RGGB": (0, 0), "BGGR": (1, 1), "GRBG": (1, 0), "GBRG": (0, 1)}
NO_SITE = 9
CROSS = [(0, -1), (0, 1), (-1, 0), (1, 0)]
CORNERS = [(-1, -1), (1, -1), (-1, 1), (1, 1)]


def export_planes_of(px: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P5 on one tile, as three arrays of its covered area.

    Positions outside the frame read as 0 but still count when their site
    matches; a remainder of -1 matches no odd site, so the site left of or
    above the frame counts as green. Missing colours at a green site come from
    the neighbour on the right or left, by row parity.
    """
    h, w = t["h"], t["w"]
    ys, xs = np.arange(t["y0"] - 1, t["y0"] + h + 1), np.arange(t["x0"] - 2, t["x0"] + w + 2)
    inside = ((ys >= 0) & (ys < t["frame_h"]))[:, None] & ((xs >= 0) & (xs < t["frame_w"]))[None, :]
    store = px.reshape(t["oh"], t["ow"])
    near = store[np.ix_(np.clip(ys - t["oy"], 0, t["oh"] - 1), np.clip(xs - t["ox"], 0, t["ow"] - 1))]
    v = np.where(inside, near, 0).astype(np.float64)
    rx, ry = RED_PARITY.get(t["pattern"], (NO_SITE, NO_SITE))
    py, qx = np.fmod(ys, 2)[:, None], np.fmod(xs, 2)[None, :]
    red = (qx == rx) & (py == ry)
    blue = (qx == 1 - rx) & (py == 1 - ry)

    def mean(steps, site: np.ndarray, shift: int) -> np.ndarray:
        total, count = np.zeros((h, w)), np.zeros((h, w))
        for dx, dy in steps:
            area = np.s_[1 + dy : 1 + dy + h, 2 + shift + dx : 2 + shift + dx + w]
            total += np.where(site[area], v[area], 0.0)
            count += site[area]
        own = v[1 : 1 + h, 2 + shift : 2 + shift + w]
        return np.where(count > 0, total / np.maximum(count, 1), own)

    core = np.s_[1 : 1 + h, 2 : 2 + w]
    value, is_red, is_blue = v[core], red[core], blue[core]
    side = np.where(is_red | is_blue, 0, np.where(ys[1 : 1 + h, None] % 2 == 0, 1, -1))

    def beside(site: np.ndarray, sign: int) -> np.ndarray:
        at = {k: mean(CORNERS, site, k) for k in (-1, 0, 1)}
        return np.where(side == 0, at[0], np.where(side == 1, at[sign], at[-sign]))

    r = np.where(is_red, value, beside(red, 1))
    g = np.where(side != 0, value, mean(CROSS, ~red & ~blue, 0))
    b = np.where(is_blue, value, beside(blue, -1))
    return r.ravel(), g.ravel(), b.ravel()


def preview_planes_of(px: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P6 on one tile."""
    return preview_at(px, t, np.arange(t["y0"], t["y0"] + t["h"]), np.arange(t["x0"], t["x0"] + t["w"]))


def preview_at(px: np.ndarray, t: dict, ys: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P6 at some rows and columns: bilinear colours, edges clamped; quad patterns as the plain one they contain."""
    store = px.reshape(t["oh"], t["ow"])

    def at(dy: int, dx: int) -> np.ndarray:
        rows, cols = np.clip(ys + dy, 0, t["frame_h"] - 1) - t["oy"], np.clip(xs + dx, 0, t["frame_w"] - 1) - t["ox"]
        return store[np.ix_(rows, cols)].astype(np.float64)

    cfa = np.array(vocab.CFA.get(t["pattern"].removeprefix("QuadBayer"), vocab.CFA["RGGB"])).reshape(2, 2)
    site, beside = cfa[np.ix_(ys & 1, xs & 1)], cfa[np.ix_(ys & 1, (xs + 1) & 1)]
    mid, across, along = at(0, 0), at(0, -1) + at(0, 1), at(-1, 0) + at(1, 0)
    corners = (at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1)) * 0.25
    row_red = beside == 0
    r = np.select([site == 0, site == 2, row_red], [mid, corners, across * 0.5], along * 0.5)
    g = np.where(site == 1, mid, (along + across) * 0.25)
    b = np.select([site == 2, site == 0, row_red], [mid, corners, along * 0.5], across * 0.5)
    return r.ravel(), g.ravel(), b.ravel()


PLANES = {c: pa.list_(pa.float64()) for c in ("r", "g", "b")}
PLANES_DDL = "r array<double>, g array<double>, b array<double>"


def _planes(tiles: DataFrame, compute, pattern: str) -> DataFrame:
    return over_tiles(tiles, lambda px, t: compute(px, {**t, "pattern": t[pattern] or ""}), [*GEOMETRY, pattern], [], PLANES, PLANES_DDL)


def demosaic_export(tiles: DataFrame, pattern: str = "pattern") -> DataFrame:
    """P5: bilinear colours with the export path's border rules, one row per pixel."""
    return plane_pixels(_planes(tiles, export_planes_of, pattern))


def demosaic_preview(tiles: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Bilinear colours of every pixel for previews."""
    return plane_pixels(_planes(tiles, preview_planes_of, pattern))


# ---------------------------------------------------------------------------
# Edge-directed demosaic, numpy on one tile at a time
# ---------------------------------------------------------------------------

EDGE_HALO = 9


def _edge_tile(px, oy, ox, oh, ow, fw, fh, y0, x0, h, w, codes, black):
    """Colours of one tile, as three arrays of its covered area."""
    store = np.asarray(px, dtype=np.float64).reshape(oh, ow)
    ring = EDGE_HALO + 3
    ys = np.arange(y0 - ring, y0 + h + ring)
    xs = np.arange(x0 - ring, x0 + w + ring)
    cfa = codes[np.ix_(ys & 1, xs & 1)]
    level = black[cfa]

    def stored(yy, xx):
        yi = np.clip(np.clip(yy, 0, fh - 1) - oy, 0, oh - 1)
        xi = np.clip(np.clip(xx, 0, fw - 1) - ox, 0, ow - 1)
        return store[np.ix_(yi, xi)]

    clamped = np.maximum(stored(ys, xs) - level, 0.0)
    inside = np.ix_((ys >= 0) & (ys < fh), (xs >= 0) & (xs < fw))
    raw = np.zeros_like(clamped)
    raw[inside] = clamped[inside]

    # low-pass at half resolution: block (hy, hx) is centred on (2hy, 2hx)
    taps = np.array([1.0, 4.0, 6.0, 4.0, 1.0]) / 16.0
    hys = np.arange((y0 - ring + 4) // 2, (y0 + h + ring - 3) // 2)
    hxs = np.arange((x0 - ring + 4) // 2, (x0 + w + ring - 3) // 2)
    cy, cx = 2 * hys - ys[0], 2 * hxs - xs[0]
    low = np.zeros((len(hys), len(hxs)))
    for j, wy in zip(range(-2, 3), taps):
        row = np.zeros_like(low)
        for i, wx in zip(range(-2, 3), taps):
            row += wx * clamped[np.ix_(cy + j, cx + i)]
        low += wy * row

    def step(dy, dx):
        moved = np.full_like(low, np.nan)
        a, b = low.shape
        moved[max(0, -dy) : a - max(0, dy), max(0, -dx) : b - max(0, dx)] = low[
            max(0, dy) : a - max(0, -dy), max(0, dx) : b - max(0, -dx)
        ]
        return np.abs(low - moved)

    v, hgrad = step(-1, 0) + step(1, 0), step(0, -1) + step(0, 1)
    p, q = step(-1, -1) + step(1, 1), step(-1, 1) + step(1, -1)
    vh_half, pq_half = v / (1e-5 + v + hgrad), p / (1e-5 + p + q)

    # back to full resolution, positions clamped to the frame as the reads are
    def spread(half, top_y, top_x, whole):
        yy, xx = np.clip(ys, 0, top_y), np.clip(xs, 0, top_x)
        if whole:
            by, bx = yy // 2, xx // 2
        else:
            by = np.clip(np.trunc(ys / 2).astype(int), 0, fh // 2 - 1)
            bx = np.clip(np.trunc(xs / 2).astype(int), 0, fw // 2 - 1)
        yi = np.clip(by - hys[0], 0, len(hys) - 1)
        xi = np.clip(bx - hxs[0], 0, len(hxs) - 1)
        return half[np.ix_(yi, xi)]

    def refined(full):
        near = np.zeros_like(full)
        near[1:-1, 1:-1] = 0.25 * (full[:-2, :-2] + full[:-2, 2:] + full[2:, :-2] + full[2:, 2:])
        return np.where(np.abs(0.5 - full) < np.abs(0.5 - near), near, full)

    vh = refined(spread(vh_half, fh - 1, fw - 1, True))
    pq = refined(spread(pq_half, fh - 1, fw - 1, False))

    def at(plane, dy, dx):
        return np.roll(plane, (-dy, -dx), axis=(0, 1))

    planes = [np.where(cfa == c, raw, 0.0) for c in range(3)]
    own = np.where(cfa == 0, planes[0], planes[2])
    same2 = {d: at(raw, *d) for d in ((-2, 0), (2, 0), (0, -2), (0, 2))}
    green = planes[1]
    h_est = 0.5 * (at(green, 0, -1) + at(green, 0, 1)) + 0.25 * (2 * own - same2[(0, -2)] - same2[(0, 2)])
    v_est = 0.5 * (at(green, -1, 0) + at(green, 1, 0)) + 0.25 * (2 * own - same2[(-2, 0)] - same2[(2, 0)])
    # blended as a * (1 - t) + b * t, the order in which the last bits are those of the SQL
    green = np.where(cfa == 1, raw, v_est * (1 - vh) + h_est * vh)

    diffs = {}
    for d in ((-1, -1), (1, 1), (-1, 1), (1, -1)):
        diffs[d] = at(raw, *d) - at(green, *d)
    p_est, q_est = 0.5 * (diffs[(-1, -1)] + diffs[(1, 1)]), 0.5 * (diffs[(-1, 1)] + diffs[(1, -1)])
    other = green + p_est * (1 - pq) + q_est * pq
    red = np.where(cfa == 0, raw, np.where(cfa == 2, other, 0.0))
    blue = np.where(cfa == 2, raw, np.where(cfa == 0, other, 0.0))

    def fill(plane, across):
        dh = 0.5 * ((at(plane, 0, -1) - at(green, 0, -1)) + (at(plane, 0, 1) - at(green, 0, 1)))
        dv = 0.5 * ((at(plane, -1, 0) - at(green, -1, 0)) + (at(plane, 1, 0) - at(green, 1, 0)))
        return green + np.where(across, dh, dv)

    red_beside = at(cfa, 0, -1) == 0
    full_red = np.where(cfa == 1, fill(red, red_beside), red)
    full_blue = np.where(cfa == 1, fill(blue, ~red_beside), blue)
    core = np.s_[ring : ring + h, ring : ring + w]
    return full_red[core].ravel(), green[core].ravel(), full_blue[core].ravel()


def edge_planes_of(px: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P7 on one tile; ``black`` has a level per colour."""
    cfa = np.array(vocab.CFA.get(t["pattern"], vocab.CFA["RGGB"])).reshape(2, 2)
    return _edge_tile(
        px, t["oy"], t["ox"], t["oh"], t["ow"], t["frame_w"], t["frame_h"], t["y0"], t["x0"], t["h"], t["w"],
        cfa, np.asarray(t["black"], dtype=np.float64),
    )


def demosaic_edges(tiles: DataFrame, pattern: str = "pattern", black: str = "black_rgb") -> DataFrame:
    """Edge-directed colours per tile, black level removed.

    Needs tiles with a halo of at least :data:`EDGE_HALO`; the result does not
    depend on the tile size. Adds array columns ``r, g, b`` and drops ``px``.
    """

    def compute(px, t):
        return edge_planes_of(px, {**t, "pattern": t[pattern], "black": t[black]})

    return over_tiles(tiles, compute, [*GEOMETRY, pattern, black], [], PLANES, PLANES_DDL)


def plane_pixels(planes: DataFrame) -> DataFrame:
    """Long form of tiles with ``r, g, b`` arrays."""
    rest = [c for c in planes.columns if c not in (*GEOMETRY, "tile_y", "tile_x", "r", "g", "b")]
    rows = planes.select(*rest, "y0", "x0", "w", F.posexplode(F.arrays_zip("r", "g", "b")).alias("_i", "_p"))
    y = F.col("y0") + F.floor(F.col("_i") / F.col("w")).cast("int")
    x = F.col("x0") + F.col("_i") % F.col("w")
    return rows.select(*rest, y.alias("y"), x.alias("x"), "_p.r", "_p.g", "_p.b")
