"""Custom tile grids over already-projected coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilework.functions.grid import _c


@dataclass(frozen=True)
class LinearGrid:
    """Tiles of tile_size pixels at resolutions[zoom] units a pixel, rows counted down from the origin (left, top).

    One of the resolutions has to be 1.0 (the base zoom). A zoom beyond the list is an error at run time.
    """

    resolutions: tuple[float, ...]
    tile_size: int = 256
    left: float = 0.0
    top: float = 0.0

    def __post_init__(self):
        if 1.0 not in self.resolutions:
            raise ValueError("no zoom has resolution 1.0")

    @property
    def base_zoom(self) -> int:
        return self.resolutions.index(1.0)

    def zoom_of(self, resolution: float, tolerance: float = 1e-3) -> int:
        for z, r in enumerate(self.resolutions):
            if abs(r - resolution) <= tolerance * r:
                return z
        raise ValueError(f"no zoom has resolution {resolution}")

    def span(self, z) -> Column:
        """Units on a tile's side."""
        table, z = F.array(*[F.lit(float(r)) for r in self.resolutions]), _c(z)
        beyond = F.raise_error(F.concat(F.lit("zoom beyond the grid: "), z.cast("string"))).cast("double")
        return F.when(z.between(0, len(self.resolutions) - 1), F.get(table, z)).otherwise(beyond) * self.tile_size

    def to_tile(self, px, py, z) -> Column:
        """Fractional struct(x, y)."""
        s = self.span(z)
        return F.struct(((_c(px) - self.left) / s).alias("x"), ((F.lit(self.top) - _c(py)) / s).alias("y"))

    def envelope(self, z, x, y) -> Column:
        s = self.span(z)
        x0, y1 = _c(x) * s + self.left, F.lit(self.top) - _c(y) * s
        return F.struct(x0.alias("xmin"), (y1 - s).alias("ymin"), (x0 + s).alias("xmax"), y1.alias("ymax"))

    def corner_tile(self, px, py, z, tolerance: float = 1e-3) -> Column:
        """Integer struct(x, y) of the tile whose upper-left corner a point is; an error if it isn't one."""
        t = self.to_tile(px, py, z)
        off = F.greatest(F.abs(t["x"] - F.round(t["x"])), F.abs(t["y"] - F.round(t["y"])))
        wrong = F.raise_error(F.lit("the point is no tile's corner")).cast("struct<x:int,y:int>")
        return F.when(off <= tolerance, F.struct(F.round(t["x"]).cast("int").alias("x"), F.round(t["y"]).cast("int").alias("y"))).otherwise(wrong)
