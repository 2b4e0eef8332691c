"""UTM zones, MGRS references, grid lines and the tiles of a map view (Column expressions)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilework.functions.grid import CIRCUMFERENCE, _c

#: Letters of the latitude bands and of the 100 km squares (columns by zone modulo 3, rows by its parity).
BANDS = "CDEFGHJKLMNPQRSTUVWX"
COLUMNS = {1: "ABCDEFGH", 2: "JKLMNPQR", 0: "STUVWXYZ"}
ROWS = {1: "ABCDEFGHJKLMNPQRSTUV", 0: "FGHJKLMNPQRSTUVABCDE"}


def utm_zone(lon) -> Column:
    """1-60. Halves round away from zero."""
    return (F.pmod(F.round(_c(lon) / 6 + 30.5).cast("int") - 1, F.lit(60)) + 1).cast("int")


def utm_band(lat) -> Column:
    """Band letter; null beyond the bands."""
    i = F.round(_c(lat) / 8 + 9.5).cast("int")
    return F.when(i.between(0, len(BANDS) - 1), F.substring(F.lit(BANDS), i + 1, F.lit(1)))


def hemisphere(lat) -> Column:
    """N (the equator too) or S."""
    return F.when(_c(lat) >= 0, "N").when(_c(lat) < 0, "S")


def utm_grid(lon, lat) -> Column:
    """Zone and band, such as 18Q."""
    return F.concat(utm_zone(lon).cast("string"), utm_band(lat))


def mgrs(e, n, grid, zeros: int) -> Column:
    """Reference such as "18Q YF 80 52" of metres east and north in a grid zone, without the last zeros digits."""
    if not 1 <= zeros <= 5:
        raise ValueError("zeros has to be 1 to 5")
    e, n, grid = _c(e), _c(n), _c(grid)
    zone = F.regexp_extract(grid, r"^(\d+)", 1).cast("int")
    column, row = F.floor(e / 100000).cast("int"), (F.floor((n % 2000000) / 100000) + 1).cast("int")
    ew = F.when(zone % 3 == 1, COLUMNS[1]).when(zone % 3 == 2, COLUMNS[2]).otherwise(COLUMNS[0])
    ns = F.when(zone % 2 == 1, ROWS[1]).otherwise(ROWS[0])
    digits = lambda v: F.substring(F.lpad(F.floor(v % 100000).cast("string"), 5, "0"), 1, 5 - zeros)
    return F.concat_ws(" ", grid, F.concat(F.substring(ew, column, F.lit(1)), F.substring(ns, row, F.lit(1))), digits(e), digits(n))


def line_step(units, pixels, spacing) -> Column:
    """Distance of grid lines: a power of ten of at least spacing pixels."""
    return F.pow(F.lit(10.0), F.ceil(F.log10(_c(units) * _c(spacing) / _c(pixels)))).cast("long")


def grid_lines(xmin, ymin, xmax, ymax, width: int, height: int, spacing: float = 100) -> Column:
    """Array of struct(kind, x, y) of a box in metres: ``vertical`` and ``horizontal`` lines (their coordinate),
    ``tick`` marks at tenths of the step along them, and ``cross`` where two lines meet. The box is widened to the
    step below and one step beyond the step above."""
    xmin, ymin, xmax, ymax = (_c(v) for v in (xmin, ymin, xmax, ymax))
    units = F.sqrt((xmax - xmin) * (xmax - xmin) + (ymax - ymin) * (ymax - ymin))
    step = line_step(units, math.hypot(width, height), spacing)
    down = lambda v: (F.floor(v / step) * step).cast("long")
    xs, ys = (F.sequence(down(a), down(b) + step, step) for a, b in ((xmin, xmax), (ymin, ymax)))
    tenth = F.greatest(F.floor(step / 10).cast("long"), F.lit(1).cast("long"))
    fine_x, fine_y = (F.sequence(down(a), down(b) + step, tenth) for a, b in ((xmin, xmax), (ymin, ymax)))
    none = F.lit(None).cast("long")
    item = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    return F.concat(
        F.transform(xs, lambda x: item("vertical", x, none)),
        F.transform(ys, lambda y: item("horizontal", none, y)),
        F.flatten(F.transform(xs, lambda x: F.transform(fine_y, lambda y: item("tick", x, y)))),
        F.flatten(F.transform(ys, lambda y: F.transform(fine_x, lambda x: item("tick", x, y)))),
        F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: item("cross", x, y)))),
    )


def view_zoom(resolution, zoom_adjust: int = 0) -> Column:
    """Zoom of a view of resolution pixels a metre."""
    return F.round(F.lit(math.log2(CIRCUMFERENCE)) + F.log2(_c(resolution)) - zoom_adjust).cast("int")


def view_range(xmin, ymin, xmax, ymax, resolution, zoom_adjust: int = 0) -> Column:
    """struct(z, x0, x1, y0, y1): the columns and rows of tiles that cover a box in mercator metres at the view's zoom."""
    z = view_zoom(resolution, zoom_adjust)
    at = lambda v: F.floor(F.pow(F.lit(2.0), z) * v).cast("int")
    return F.struct(
        z.alias("z"), at(_c(xmin) / CIRCUMFERENCE + 0.5).alias("x0"), at(_c(xmax) / CIRCUMFERENCE + 0.5).alias("x1"),
        at(0.5 - _c(ymax) / CIRCUMFERENCE).alias("y0"), at(0.5 - _c(ymin) / CIRCUMFERENCE).alias("y1"),
    )


def tiles_for_view(xmin, ymin, xmax, ymax, resolution, zoom_adjust: int = 0) -> Column:
    """Array of struct(z, x, y) that cover a box in mercator metres at the view's zoom, column by column. For tables of views
    ``tiling.view_tiles`` makes rows at less cost."""
    v = view_range(xmin, ymin, xmax, ymax, resolution, zoom_adjust)
    xs, ys = F.sequence(v["x0"], v["x1"]), F.sequence(v["y0"], v["y1"])
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(v["z"].alias("z"), x.alias("x"), y.alias("y")))))
