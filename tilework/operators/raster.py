"""Raster tiles as pixel tables: (layer, z, x, y, px, py, r, g, b, a). Compositing works on channels 0..1 as doubles,
palettes and effects on 0..255. All arithmetic is Column expressions; layers meet by an equality on the pixel's key.
"""

from __future__ import annotations

import re

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.functions.grid import _c
from tilework.functions.paths import in_zoom_range
from tilework.operators.tiling import KEY

PIXEL = (*KEY, "px", "py")
RGB = ("r", "g", "b")


# ---- colours and adjustments -----------------------------------------------------------------------------------------


def parse_color(text) -> tuple[int, int, int, int]:
    """(r, g, b, a) of #rgb, #rgba, #rrggbb or #rrggbbaa."""
    if not isinstance(text, str):
        raise TypeError("a colour has to be text")
    if not text.startswith("#"):
        raise ValueError(f"a colour has to begin with #: {text}")
    if len(text) not in (4, 5, 7, 9):
        raise ValueError(f"a colour has to have 3, 4, 6 or 8 digits: {text}")
    if not re.fullmatch("[0-9a-fA-F]+", text[1:]):
        raise ValueError(f"a colour has to be hexadecimal: {text}")
    digits = text[1:] if len(text) > 5 else "".join(c * 2 for c in text[1:])
    values = [int(digits[i : i + 2], 16) for i in range(0, len(digits), 2)]
    return tuple(values + [255] * (4 - len(values)))  # type: ignore[return-value]


def color_struct(text) -> Column:
    """P16 for colours in a column: struct(r, g, b, a); null where the text isn't a colour."""
    t = _c(text)
    wide = F.when(F.length(t) > 5, F.substring(t, F.lit(2), F.length(t))).otherwise(F.regexp_replace(F.substring(t, F.lit(2), F.length(t)), "(.)", "$1$1"))
    byte = lambda i: F.conv(F.substring(wide, i, 2), 16, 10).cast("int")
    alpha = F.when(F.length(wide) == 8, byte(7)).otherwise(255)
    ok = t.rlike("^#([0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")
    return F.when(ok, F.struct(byte(1).alias("r"), byte(3).alias("g"), byte(5).alias("b"), alpha.alias("a")))


def to_unit(df: DataFrame) -> DataFrame:
    """0..255 to 0..1."""
    return df.withColumns({c: (F.col(c) / 255.0).cast("double") for c in (*RGB, "a")})


def to_bytes(df: DataFrame) -> DataFrame:
    """0..1 to 0..255, rounded."""
    return df.withColumns({c: F.round(F.col(c) * 255).cast("int") for c in (*RGB, "a")})


def fill_color(tiles: DataFrame, color: str, size: int) -> DataFrame:
    """A constant raster on every tile, channels 0..1."""
    r, g, b, a = parse_color(color)
    return blank_tiles(tiles, size).withColumns({k: F.lit(v / 255.0) for k, v in zip((*RGB, "a"), (r, g, b, a), strict=True)})


def blank_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """A transparent raster on every tile."""
    rows = tiles.select(*KEY).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return rows.select(*PIXEL, *[F.lit(0.0).alias(c) for c in (*RGB, "a")])


def adjust_threshold(df: DataFrame, red: int, green: int | None = None, blue: int | None = None) -> DataFrame:
    """Channels (0..1) above a value of 0..255 to 1, else 0. One value is for all three channels."""
    values = (red, red, red) if green is None or blue is None else (red, green, blue)
    return df.withColumns({c: F.when(F.col(c) > v / 255.0, 1.0).otherwise(0.0) for c, v in zip(RGB, values, strict=True)})


def _quadratic(points) -> tuple[float, float, float]:
    """a, b, c through three (in, out) of 0..255."""
    m = np.array([[(x / 255.0) ** 2, x / 255.0, 1.0] for x, _ in points])
    return tuple(float(v) for v in np.linalg.solve(m, np.array([y / 255.0 for _, y in points])))  # type: ignore[return-value]


def adjust_curves2(df: DataFrame, map_red, map_green=None, map_blue=None) -> DataFrame:
    """Each channel through the quadratic of three (in, out) points of 0..255, clipped."""
    maps = (map_red, map_red, map_red) if map_green is None or map_blue is None else (map_red, map_green, map_blue)
    out = {}
    for channel, points in zip(RGB, maps, strict=True):
        a, b, c = _quadratic(points)
        v = F.col(channel)
        out[channel] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v * v * a + v * b + c))
    return df.withColumns(out)


def adjust_curves(df: DataFrame, black: int, grey: int, white: int) -> DataFrame:
    """The quadratic that takes black, grey and white to 0, 0.5 and 1."""
    return adjust_curves2(df, [(black, 0), (grey, 127.5), (white, 255)])


ADJUSTMENTS = {"threshold": adjust_threshold, "curves": lambda df, bgw: adjust_curves(df, *bgw), "curves2": adjust_curves2}


# ---- compositing -----------------------------------------------------------------------------------------------------


def blend(bottom, top, mode: str | None) -> Column:
    """One channel (0..1)."""
    b, t = _c(bottom), _c(top)
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    if not mode:
        return t
    modes = {
        "screen": lambda: 1 - (1 - b) * (1 - t),
        "multiply": lambda: b * t,
        "linear light": lambda: clip(b + 2 * t - 1),
        "hard light": lambda: F.when(t < 0.5, 2 * b * t).otherwise(1 - 2 * (1 - b) * (1 - t)),
        "add": lambda: clip(b + t),
        "subtract": lambda: clip(b - t),
    }
    if mode not in modes:
        raise ValueError(f"unknown blend mode: {mode}")
    return modes[mode]()


def blend_join(bottom: DataFrame, top: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Pixels of both layers side by side: PIXEL, struct b, struct t, m (the mask's luma, 1 without a mask). Pixels
    that one side lacks are transparent black; a mask's missing pixels hide."""
    side = lambda df, name: df.select(*PIXEL, F.struct(*RGB, "a").alias(name))
    none = F.struct(*[F.lit(0.0).alias(c) for c in (*RGB, "a")])
    out = side(bottom, "b").join(side(top, "t"), list(PIXEL), "full")
    out = out.withColumn("b", F.coalesce("b", none)).withColumn("t", F.coalesce("t", none))
    if mask is None:
        return out.withColumn("m", F.lit(1.0))
    return out.join(mask.select(*PIXEL, luma().alias("m")), list(PIXEL), "left").withColumn("m", F.coalesce("m", F.lit(0.0)))


def composite_over(bottom: DataFrame, top: DataFrame, mask: DataFrame | None = None, opacity: float = 1.0, mode: str | None = None) -> DataFrame:
    """Top over bottom with straight alpha. The mask is the mask layer's luma times top's alpha times opacity."""
    if opacity == 0:
        return bottom
    m = F.col("m") * F.col("t.a") * opacity
    rows = blend_join(bottom, top, mask).withColumn("k", m)
    below = 1 - (1 - F.col("k")) * (1 - F.col("b.a"))
    ratio = F.col("k") / below
    over = lambda c: F.when(F.col("k") >= 1, blend(F.col(f"b.{c}"), F.col(f"t.{c}"), mode)).when(below > 0, blend(F.col(f"b.{c}"), F.col(f"t.{c}"), mode) * ratio + F.col(f"b.{c}") * (1 - ratio)).otherwise(0.0)
    return rows.select(*PIXEL, *[over(c).alias(c) for c in RGB], below.alias("a"))


def layers_for_zoom(stack: DataFrame, tiles: DataFrame) -> DataFrame:
    """Z, x, y and the stack's entries (position, zoom range text, ...) valid at the tile's zoom, in order. The stack
    is a configuration's few rows; the zooms that occur are matched with it, then tiles by equality on z."""
    zooms = tiles.select("z").distinct()
    valid = zooms.join(F.broadcast(stack), in_zoom_range(F.col("z"), F.col("zoom")))
    return tiles.select(*KEY).join(valid, "z").select(*KEY, "position", *[c for c in stack.columns if c not in ("zoom", "position")])


def composite_stack(stack, layers: dict[str, DataFrame], tiles: DataFrame, size: int) -> DataFrame:
    """The stack drawn on every tile. stack: a list of entries (dicts with src, color, mask, opacity, mode, zoom,
    adjustments) and nested lists, each of which begins transparent and is blended as one. Sources that aren't in
    layers are left out; masks that aren't hide nothing."""
    out = blank_tiles(tiles, size)
    for entry in [stack] if isinstance(stack, dict) else stack:
        if isinstance(entry, list):
            out = composite_over(out, composite_stack(entry, layers, tiles, size))
            continue
        src, mask, color = (entry.get(k) for k in ("src", "mask", "color"))
        if src and mask and color:
            raise ValueError("an entry can't have src, color and mask together")
        if not src and not color:
            raise ValueError("an entry needs src or color" + (", not only a mask" if mask else ""))
        top = None
        if color:
            top = fill_color(tiles, color, size)
        if src:
            if src not in layers:
                continue
            top = layers[src] if top is None else composite_over(top, layers[src])
        for name, args in entry.get("adjustments", []):
            if name not in ADJUSTMENTS:
                raise ValueError(f"unknown adjustment: {name}")
            top = ADJUSTMENTS[name](top, *args)
        if entry.get("zoom"):
            top = top.where(in_zoom_range(F.col("z"), F.lit(entry["zoom"])))
        out = composite_over(out, top, layers.get(mask) if mask else None, float(entry.get("opacity", 1.0)), entry.get("mode"))
    return out


# ---- palettes and effects (0..255) -----------------------------------------------------------------------------------


def apply_palette(pixels: DataFrame, palette: list[tuple[int, int, int]], t_index: int | None = None) -> DataFrame:
    """Adds index, the nearest palette entry (squared distance, first of equals; the transparent entry isn't a
    choice). Pixels of alpha below 128 get t_index if there is one. The palette (256 entries at most) is an array literal, so
    a pixel is looked up where it is."""
    if len(palette) > 256:
        raise ValueError("a palette has 256 entries at most")
    entries = F.array(*[F.struct(*[F.lit(int(v)).alias(k) for k, v in zip(RGB, c, strict=True)], F.lit(i).alias("i")) for i, c in enumerate(palette) if i != t_index])
    gap = lambda e: sum(((F.col(c) - e[c]) * (F.col(c) - e[c]) for c in RGB), F.lit(0))
    best = F.array_min(F.transform(entries, lambda e: F.struct(gap(e).alias("d"), e["i"].alias("i"))))["i"]
    index = best if t_index is None else F.when(F.col("a") < 128, t_index).otherwise(best)
    return pixels.withColumn("index", index)


def luma() -> Column:
    return (F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000


def greyscale(pixels: DataFrame) -> DataFrame:
    """Every channel becomes the luma, cut to a whole number."""
    v = F.floor(luma()).cast("int")
    return pixels.withColumn("_l", v).withColumns({c: F.col("_l") for c in RGB}).drop("_l")


def desaturate(pixels: DataFrame, factor: float = 0.85) -> DataFrame:
    """Channels moved towards the luma by factor, held within 0..1."""
    f = min(1.0, max(0.0, factor))
    return pixels.withColumn("_l", F.floor(luma())).withColumns({c: F.round(F.col(c) * (1 - f) + F.col("_l") * f).cast("int") for c in RGB}).drop("_l")


def pixelate(pixels: DataFrame, n: int = 5, size: int = 256) -> DataFrame:
    """Nearest-neighbour shrinking and growing by n: every pixel takes the colour of its block's middle."""
    if n < 1:
        raise ValueError("n has to be 1 or more")
    middle = lambda p: F.least(F.lit(size - 1), F.floor(F.col(p) / n) * n + n // 2).cast("int")
    source = pixels.select(*KEY, F.col("px").alias("_sx"), F.col("py").alias("_sy"), *RGB, "a")
    place = pixels.select(*PIXEL, middle("px").alias("_sx"), middle("py").alias("_sy"))
    return place.join(source, [*KEY, "_sx", "_sy"]).select(*PIXEL, *RGB, "a")


def blur(pixels: DataFrame, radius: int = 5, size: int = 256) -> DataFrame:
    """P10: separable discrete Gaussian of standard deviation radius / 2 over 2 * radius + 1 pixels, edges repeated. Pixels that
    aren't there count for nothing, and a pixel comes out where one was within reach.

    A tile's pixels are gathered once, into an array with a place for each; both passes go over that array."""
    if radius < 0:
        raise ValueError("the radius has to be 0 or more")
    if radius == 0:
        return pixels
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / (radius / 2)) ** 2)
    taps = [(int(o), float(w)) for o, w in zip(range(-radius, radius + 1), weights / weights.sum(), strict=True)]
    channels, n = [*RGB, "a"], size * size
    item = F.struct((F.col("py") * size + F.col("px")).cast("int").alias("at"), *[F.col(c).cast("double").alias(c) for c in channels])
    kind = "struct<at:int," + ",".join(f"{c}:double" for c in channels) + ">"
    tiles = pixels.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("v"))
    none = lambda k: F.array_repeat(F.lit(None).cast(kind), k)
    v = F.col("v")
    gaps = F.transform(v, lambda p, i: F.concat(none(p["at"] - F.coalesce(F.get(v, i - 1)["at"], F.lit(-1)) - 1), F.array(p)))
    out = tiles.withColumn("v", F.concat(F.flatten(gaps), none(n - 1 - F.element_at(v, -1)["at"])))
    held = lambda p: F.greatest(F.lit(0), F.least(F.lit(size - 1), p))
    row, column = lambda i: F.floor(i / size).cast("int"), lambda i: i % size

    def passed(at) -> Column:
        """The array after one pass; at: the place of the pixel that is o away from place i."""

        def mixed(i: Column) -> Column:
            near = [(F.get(F.col("v"), at(i, o)), w) for o, w in taps]
            sums = [reduce(lambda a, b: a + b, [F.coalesce(p[c] * w, F.lit(0.0)) for p, w in near]).alias(c) for c in channels]
            return F.when(F.coalesce(*[p for p, _ in near]).isNotNull(), F.struct(i.alias("at"), *sums))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), mixed)

    out = out.select(*KEY, passed(lambda i, o: row(i) * size + held(column(i) + o)).alias("v"))
    out = out.select(*KEY, passed(lambda i, o: held(row(i) + o) * size + column(i)).alias("v"))
    out = out.select(*KEY, F.explode(F.filter("v", lambda p: p.isNotNull())).alias("p"))
    return out.select(*KEY, column(F.col("p.at")).cast("int").alias("px"), row(F.col("p.at")).alias("py"), *[F.col(f"p.{c}").alias(c) for c in channels])


# ---- geometry of rasters ---------------------------------------------------------------------------------------------


def split_metatile(pixels: DataFrame, columns: int, rows: int, buffer: int = 0, dim: int = 256) -> DataFrame:
    """A block's raster (keyed by its upper-left tile) cut into tiles; the buffer is thrown away."""
    px, py = F.col("px") - buffer, F.col("py") - buffer
    inside = (px >= 0) & (py >= 0) & (px < columns * dim) & (py < rows * dim)
    cut = pixels.where(inside)
    return cut.select("z", (F.col("x") + F.floor(px / dim)).cast("int").alias("x"), (F.col("y") + F.floor(py / dim)).cast("int").alias("y"), (px % dim).cast("int").alias("px"), (py % dim).cast("int").alias("py"), *RGB, "a")


def mosaic_frame(extent=None, center=None, zoom: int | None = None, size: tuple[int, int] | None = None, dim: int = 256) -> tuple[int, float, float, int, int]:
    """(zoom, left, top, width, height) in pixels of the zoom, for center + zoom + size, extent + size or extent +
    zoom. extent + size takes the deepest zoom at which the extent fits."""
    if center and extent or (extent and size and zoom is not None):
        raise ValueError("bad coverage: center and extent, or extent with both zoom and size")
    at = lambda lat, lon, z: ((lon + 180) / 360 * 2.0**z * dim, (1 - np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) / np.pi) / 2 * 2.0**z * dim)
    if center and zoom is not None and size:
        cx, cy = at(*center, zoom)
        return zoom, cx - size[0] / 2, cy - size[1] / 2, size[0], size[1]
    if extent and (size or zoom is not None):
        n, s, w, e = max(extent[0], extent[2]), min(extent[0], extent[2]), min(extent[1], extent[3]), max(extent[1], extent[3])
        if size:
            zoom = max(z for z in range(31) if z == 0 or (at(s, e, z)[0] - at(n, w, z)[0] <= size[0] and at(s, e, z)[1] - at(n, w, z)[1] <= size[1]))
            (x0, y0), (x1, y1) = at(n, w, zoom), at(s, e, zoom)
            return zoom, (x0 + x1 - size[0]) / 2, (y0 + y1 - size[1]) / 2, size[0], size[1]
        (x0, y0), (x1, y1) = at(n, w, zoom), at(s, e, zoom)
        return zoom, x0, y0, int(np.ceil(x1 - x0)), int(np.ceil(y1 - y0))
    raise ValueError("not enough given for a coverage")


def mosaic(pixels: DataFrame, frame: tuple[int, float, float, int, int], dim: int = 256) -> DataFrame:
    """Px, py (in the image) and channels of the tiles' pixels inside the frame of mosaic_frame."""
    z, left, top, width, height = frame
    x, y = F.col("x") * dim + F.col("px") - int(round(left)), F.col("y") * dim + F.col("py") - int(round(top))
    lo, hi = (int(left // dim), int(top // dim)), (int((left + width) // dim), int((top + height) // dim))
    near = pixels.where((F.col("z") == z) & F.col("x").between(lo[0], hi[0]) & F.col("y").between(lo[1], hi[1]))
    out = near.select(x.cast("int").alias("px"), y.cast("int").alias("py"), *RGB, "a")
    return out.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))


def tile_pattern(tiles: DataFrame, bitmap: DataFrame, width: int, height: int, size: int = 256) -> DataFrame:
    """A small bitmap (px, py, r, g, b, a; width x height) repeated seamlessly: the phase is the global pixel's."""
    place = blank_tiles(tiles, size).select(*PIXEL)
    phase = lambda t, p, n: F.pmod(F.col(t).cast("long") * size + F.col(p), F.lit(n)).cast("int")
    place = place.withColumn("_u", phase("x", "px", width)).withColumn("_v", phase("y", "py", height))
    small = bitmap.select(F.col("px").alias("_u"), F.col("py").alias("_v"), *RGB, "a")  # width * height rows
    return place.join(F.broadcast(small) if width * height <= 1 << 16 else small, ["_u", "_v"]).select(*PIXEL, *RGB, "a")


def check_tile_height(pixels: DataFrame, height: int) -> DataFrame:
    """Z, x, y, height, ok: whether each raster is as high as a tile (or metatile) has to be."""
    return pixels.groupBy(*KEY).agg((F.max("py") + 1).alias("height")).withColumn("ok", F.col("height") == height)


