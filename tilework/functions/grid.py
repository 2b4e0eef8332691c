"""Tile grid arithmetic as Column expressions (no UDF: every function stays inside whole-stage codegen).

Grids: ``mercator`` is the spherical-mercator pyramid (1 tile at zoom 0), ``wgs84`` the plain lon/lat
pyramid (2 x 1 tiles at zoom 0). y counts down from the top in both. Null in, null out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
CIRCUMFERENCE = 2 * math.pi * RADIUS


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def span(z) -> Column:
    """Tiles on a side of the mercator pyramid at zoom z, as a double."""
    return F.pow(F.lit(2.0), _c(z))


def lonlat_to_mercator(lon, lat) -> Column:
    """struct(mx, my) in metres."""
    lon, lat = _c(lon), _c(lat)
    return F.struct(
        (F.lit(RADIUS) * F.radians(lon)).alias("mx"),
        (F.lit(RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))).alias("my"),
    )


def mercator_to_lonlat(mx, my) -> Column:
    """struct(lon, lat) in degrees."""
    mx, my = _c(mx), _c(my)
    return F.struct(
        F.degrees(mx / RADIUS).alias("lon"),
        F.degrees(2 * F.atan(F.exp(my / RADIUS)) - math.pi / 2).alias("lat"),
    )


def mercator_to_tile(mx, my, z) -> Column:
    """Fractional struct(x, y) of a point in metres."""
    mx, my = _c(mx), _c(my)
    return F.struct(
        ((mx / CIRCUMFERENCE + 0.5) * span(z)).alias("x"),
        ((0.5 - my / CIRCUMFERENCE) * span(z)).alias("y"),
    )


def tile_to_mercator(x, y, z) -> Column:
    """struct(mx, my) of a (possibly fractional) tile coordinate's upper-left corner."""
    return F.struct(
        ((_c(x) / span(z) - 0.5) * CIRCUMFERENCE).alias("mx"),
        ((0.5 - _c(y) / span(z)) * CIRCUMFERENCE).alias("my"),
    )


def lonlat_to_tile(lon, lat, z, grid: str = "mercator") -> Column:
    """Fractional struct(x, y); floor it for the containing tile."""
    lon, lat = _c(lon), _c(lat)
    if grid == "wgs84":
        return F.struct(
            ((lon + 180.0) / 180.0 * span(z)).alias("x"),
            ((90.0 - lat) / 180.0 * span(z)).alias("y"),
        )
    return F.struct(
        ((lon + 180.0) / 360.0 * span(z)).alias("x"),
        ((1.0 - F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) / math.pi) / 2.0 * span(z)).alias("y"),
    )


def tile_x(lon, z, grid: str = "mercator") -> Column:
    return F.floor(lonlat_to_tile(lon, F.lit(0.0), z, grid)["x"]).cast("int")


def tile_y(lat, z, grid: str = "mercator") -> Column:
    return F.floor(lonlat_to_tile(F.lit(0.0), lat, z, grid)["y"]).cast("int")


def tile_to_lonlat(x, y, z, grid: str = "mercator") -> Column:
    """Upper-left corner of a tile coordinate, struct(lon, lat)."""
    if grid == "wgs84":
        return F.struct(
            (_c(x) / span(z) * 180.0 - 180.0).alias("lon"),
            (90.0 - _c(y) / span(z) * 180.0).alias("lat"),
        )
    corner = tile_to_mercator(x, y, z)
    return mercator_to_lonlat(corner["mx"], corner["my"])


def zoom_to(coordinate, z, z2) -> Column:
    """A coordinate along one axis, rescaled to another zoom."""
    return _c(coordinate) * F.pow(F.lit(2.0), _c(z2) - _c(z))


def parent(coordinate, n: int = 1) -> Column:
    """The column or row of the ancestor n zooms up (arithmetic shift, so negatives floor too)."""
    return F.shiftright(_c(coordinate), n)


def children(x, y, n: int = 1) -> Column:
    """Array of struct(x, y), the tiles n zooms down, row by row."""
    x, y, k = _c(x), _c(y), 1 << n
    return F.transform(
        F.sequence(F.lit(0), F.lit(k * k - 1)),
        lambda i: F.struct((x * k + i % k).cast("int").alias("x"), (y * k + F.floor(i / k)).cast("int").alias("y")),
    )


def neighbour(x, y, side: str) -> Column:
    """struct(x, y) of the tile to the left, right, up or down."""
    dx, dy = {"left": (-1, 0), "right": (1, 0), "up": (0, -1), "down": (0, 1)}[side]
    return F.struct((_c(x) + dx).alias("x"), (_c(y) + dy).alias("y"))


def tile_envelope(z, x, y, grid: str = "mercator") -> Column:
    """struct(xmin, ymin, xmax, ymax) in the grid's own units (metres or degrees)."""
    if grid == "wgs84":
        low, high, names = tile_to_lonlat(x, _c(y) + 1, z, grid), tile_to_lonlat(_c(x) + 1, y, z, grid), ("lon", "lat")
    else:
        low, high, names = tile_to_mercator(x, _c(y) + 1, z), tile_to_mercator(_c(x) + 1, y, z), ("mx", "my")
    return F.struct(
        low[names[0]].alias("xmin"), low[names[1]].alias("ymin"), high[names[0]].alias("xmax"), high[names[1]].alias("ymax")
    )


def tile_bbox_lonlat(z, x, y, grid: str = "mercator") -> Column:
    """struct(n, s, e, w) in degrees."""
    a, b = tile_to_lonlat(x, y, z, grid), tile_to_lonlat(_c(x) + 1, _c(y) + 1, z, grid)
    return F.struct(
        F.greatest(a["lat"], b["lat"]).alias("n"),
        F.least(a["lat"], b["lat"]).alias("s"),
        F.greatest(a["lon"], b["lon"]).alias("e"),
        F.least(a["lon"], b["lon"]).alias("w"),
    )


def tile_center(z, x, y) -> Column:
    """struct(mx, my, lon, lat) of a mercator tile's middle."""
    m = tile_to_mercator(_c(x) + 0.5, _c(y) + 0.5, z)
    d = mercator_to_lonlat(m["mx"], m["my"])
    return F.struct(m["mx"].alias("mx"), m["my"].alias("my"), d["lon"].alias("lon"), d["lat"].alias("lat"))


def tile_perimeter(z, x, y, grid: str = "mercator", padded: bool = False) -> Column:
    """Array of 17 struct(x, y) clockwise from the upper-left corner, optionally 5 % outside the tile."""
    env = tile_envelope(z, x, y, grid)
    pad = 0.05 if padded else 0.0
    w, h = env["xmax"] - env["xmin"], env["ymax"] - env["ymin"]
    x0, x1, y0, y1 = env["xmin"] - w * pad, env["xmax"] + w * pad, env["ymin"] - h * pad, env["ymax"] + h * pad
    steps = (
        [(k / 4, 1.0) for k in range(4)]
        + [(1.0, 1 - k / 4) for k in range(4)]
        + [(1 - k / 4, 0.0) for k in range(4)]
        + [(0.0, k / 4) for k in range(4)]
        + [(0.0, 1.0)]
    )
    return F.array(*[F.struct((x0 + (x1 - x0) * u).alias("x"), (y0 + (y1 - y0) * v).alias("y")) for u, v in steps])


def zoom_tolerance(z, simplify: float = 1.0, simplify_until: int = 16) -> Column:
    """Metres of one pixel of a 256-pixel tile times ``simplify``; null from ``simplify_until`` up."""
    z = _c(z)
    return F.when(z < simplify_until, F.lit(CIRCUMFERENCE * simplify) / F.pow(F.lit(2.0), z + 8))


def zoom_precision(z) -> Column:
    """Decimals of lon/lat kept at a zoom (about a quarter pixel)."""
    return F.ceil(F.log10(F.pow(F.lit(2.0), _c(z) + 10)) - 2).cast("int")


def padded_envelope(z, x, y, pixels: float) -> Column:
    """Mercator envelope grown by pixels; outside zooms 0-19 a pixel is as large as at zoom 19."""
    env, zz = tile_envelope(z, x, y), _c(z)
    pad = F.lit(float(pixels)) * F.lit(CIRCUMFERENCE) / F.pow(F.lit(2.0), F.when(zz.between(0, 19), zz).otherwise(19) + 8)
    return F.struct(
        (env["xmin"] - pad).alias("xmin"), (env["ymin"] - pad).alias("ymin"), (env["xmax"] + pad).alias("xmax"), (env["ymax"] + pad).alias("ymax")
    )


def metatile_key(x, y, columns: int, rows: int) -> Column:
    """struct(x, y) of the upper-left tile of the block that holds a tile."""
    return F.struct(
        (F.floor(_c(x) / columns) * columns).cast("int").alias("x"), (F.floor(_c(y) / rows) * rows).cast("int").alias("y")
    )


def metatile_tiles(x, y, columns: int, rows: int) -> Column:
    """Array of struct(x, y) of the block, left to right, then top to bottom."""
    key = metatile_key(x, y, columns, rows)
    return F.transform(
        F.sequence(F.lit(0), F.lit(columns * rows - 1)),
        lambda i: F.struct((key["x"] + i % columns).cast("int").alias("x"), (key["y"] + F.floor(i / columns)).cast("int").alias("y")),
    )


def metatile_envelope(z, x, y, columns: int, rows: int, buffer: int = 0, dim: int = 256) -> Column:
    """Mercator box of the block, grown by buffer pixels on every side."""
    key, pad = metatile_key(x, y, columns, rows), buffer / dim
    low = tile_to_mercator(key["x"] - pad, key["y"] + rows + pad, z)
    high = tile_to_mercator(key["x"] + columns + pad, key["y"] - pad, z)
    return F.struct(low["mx"].alias("xmin"), low["my"].alias("ymin"), high["mx"].alias("xmax"), high["my"].alias("ymax"))


def metatile_size(columns: int, rows: int, buffer: int = 0, dim: int = 256) -> tuple[int, int]:
    """Width and height in pixels."""
    return int(dim * (2 * buffer / dim + columns)), int(dim * (2 * buffer / dim + rows))


def metatile_offsets(x, y, columns: int, rows: int, buffer: int = 0, dim: int = 256) -> Column:
    """struct(px, py), where a tile's pixels begin inside its block's raster."""
    return F.struct(
        (F.pmod(_c(x), F.lit(columns)) * dim + buffer).cast("int").alias("px"), (F.pmod(_c(y), F.lit(rows)) * dim + buffer).cast("int").alias("py")
    )


def in_bounds(z, x, y, north=89.0, west=-180.0, south=-89.0, east=180.0, low=31, high=0, grid: str = "mercator") -> Column:
    """True if a tile touches the box and its zoom is within low..high (low is the coarse end).

    The reference's defaults leave ``low=31, high=0``; here a reversed pair means "every zoom".
    Edges count as inside on both ends.
    """
    z, x, y = _c(z), _c(x), _c(y)
    ul, lr = lonlat_to_tile(F.lit(west), F.lit(north), z, grid), lonlat_to_tile(F.lit(east), F.lit(south), z, grid)
    zoom_ok = F.lit(True) if low > high else z.between(low, high)
    return zoom_ok & ~((x > lr["x"]) | (y > lr["y"]) | (x + 1 < ul["x"]) | (y + 1 < ul["y"]))


def flip_y(z, y) -> Column:
    """Row counted from the bottom (its own inverse)."""
    return (F.expr("shiftleft(1, 0)") * F.pow(F.lit(2.0), _c(z)) - 1 - _c(y)).cast("int")


def cover_columns(lo, hi, z, grid: str = "mercator") -> Column:
    """Array of tile columns between two longitudes, closed at both edges."""
    return F.sequence(tile_x(lo, z, grid), tile_x(hi, z, grid))


def cover_rows(lo, hi, z, grid: str = "mercator") -> Column:
    """Array of tile rows between two latitudes (south, north)."""
    return F.sequence(tile_y(hi, z, grid), tile_y(lo, z, grid))
