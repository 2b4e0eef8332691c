"""User code on tiles, and the grid functions as SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from tilework.functions.grid import CIRCUMFERENCE
from tilework.operators.tiling import KEY


def render_tiles(tiles: DataFrame, fn: Callable, schema: str | None = None) -> DataFrame:
    """All tiles through a user's maker: a function of DataFrames, or with a schema one of pandas batches."""
    return tiles.transform(fn) if schema is None else tiles.mapInPandas(fn, schema)


def tile_aggregate(features: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A user's serialisation of each tile: fn gets the tile's features as a pandas frame and returns its rows."""
    return features.groupBy(*KEY).applyInPandas(fn, schema)


@udtf(returnType="z int, x int, y int")
class CoverTiles:
    """U03 for SQL users: SELECT * FROM cover_tiles(west, south, east, north, z)."""

    def eval(self, west: float, south: float, east: float, north: float, z: int) -> Iterator[tuple[int, int, int]]:
        import math

        if None in (west, south, east, north, z):
            return
        n = 2**z
        fx = lambda lon: math.floor((lon + 180) / 360 * n)
        fy = lambda lat: math.floor((1 - math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) / math.pi) / 2 * n)
        for y in range(max(0, fy(north)), min(n - 1, fy(south)) + 1):
            for x in range(max(0, fx(west)), min(n - 1, fx(east)) + 1):
                yield z, x, y


BOX = "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"
_PAD = f"pixels * {CIRCUMFERENCE!r}D / pow(2, CASE WHEN z BETWEEN 0 AND 19 THEN z ELSE 19 END + 8)"
#: Names, arguments and bodies of the SQL functions, of the grid's (perimeters and blocks of other sizes than 2 x 2 are Columns only).
SQL_FUNCTIONS = {
    "tw_mercator_x": ("lon DOUBLE", "DOUBLE", "6378137.0D * radians(lon)"),
    "tw_mercator_y": ("lat DOUBLE", "DOUBLE", "6378137.0D * ln(tan(pi() / 4 + radians(lat) / 2))"),
    "tw_lon": ("mx DOUBLE", "DOUBLE", "degrees(mx / 6378137.0D)"),
    "tw_lat": ("my DOUBLE", "DOUBLE", "degrees(2 * atan(exp(my / 6378137.0D)) - pi() / 2)"),
    "tw_tile_x": ("lon DOUBLE, z INT", "INT", "cast(floor((lon + 180) / 360 * pow(2, z)) AS INT)"),
    "tw_tile_y": ("lat DOUBLE, z INT", "INT", "cast(floor((1 - ln(tan(pi() / 4 + radians(lat) / 2)) / pi()) / 2 * pow(2, z)) AS INT)"),
    "tw_wgs84_x": ("lon DOUBLE, z INT", "INT", "cast(floor((lon + 180) / 180 * pow(2, z)) AS INT)"),
    "tw_wgs84_y": ("lat DOUBLE, z INT", "INT", "cast(floor((90 - lat) / 180 * pow(2, z)) AS INT)"),
    "tw_flip_y": ("z INT, y INT", "INT", "cast(pow(2, z) AS INT) - 1 - y"),
    "tw_col": ("mx DOUBLE, z INT", "DOUBLE", f"(mx / {CIRCUMFERENCE!r}D + 0.5D) * pow(2, z)"),
    "tw_row": ("my DOUBLE, z INT", "DOUBLE", f"(0.5D - my / {CIRCUMFERENCE!r}D) * pow(2, z)"),
    "tw_tile_mx": ("x DOUBLE, z INT", "DOUBLE", f"(x / pow(2, z) - 0.5D) * {CIRCUMFERENCE!r}D"),
    "tw_tile_my": ("y DOUBLE, z INT", "DOUBLE", f"(0.5D - y / pow(2, z)) * {CIRCUMFERENCE!r}D"),
    "tw_tile_lon": ("x DOUBLE, z INT", "DOUBLE", "tw_lon(tw_tile_mx(x, z))"),
    "tw_tile_lat": ("y DOUBLE, z INT", "DOUBLE", "tw_lat(tw_tile_my(y, z))"),
    "tw_wgs84_lon": ("x DOUBLE, z INT", "DOUBLE", "x / pow(2, z) * 180 - 180"),
    "tw_wgs84_lat": ("y DOUBLE, z INT", "DOUBLE", "90 - y / pow(2, z) * 180"),
    "tw_zoom_to": ("c DOUBLE, z INT, z2 INT", "DOUBLE", "c * pow(2, z2 - z)"),
    "tw_parent": ("c INT, n INT", "INT", "shiftright(c, n)"),
    "tw_children": ("x INT, y INT", "ARRAY<STRUCT<x: INT, y: INT>>", "transform(sequence(0, 3), i -> named_struct('x', x * 2 + i % 2, 'y', y * 2 + cast(floor(i / 2) AS INT)))"),
    "tw_envelope": ("z INT, x INT, y INT", BOX, "named_struct('xmin', tw_tile_mx(x, z), 'ymin', tw_tile_my(y + 1, z), 'xmax', tw_tile_mx(x + 1, z), 'ymax', tw_tile_my(y, z))"),
    "tw_padded_envelope": ("z INT, x INT, y INT, pixels DOUBLE", BOX, f"named_struct('xmin', tw_tile_mx(x, z) - {_PAD}, 'ymin', tw_tile_my(y + 1, z) - {_PAD}, 'xmax', tw_tile_mx(x + 1, z) + {_PAD}, 'ymax', tw_tile_my(y, z) + {_PAD})"),
    "tw_bbox": ("z INT, x INT, y INT", "STRUCT<n: DOUBLE, s: DOUBLE, e: DOUBLE, w: DOUBLE>", "named_struct('n', tw_tile_lat(y, z), 's', tw_tile_lat(y + 1, z), 'e', tw_tile_lon(x + 1, z), 'w', tw_tile_lon(x, z))"),
    "tw_center": ("z INT, x INT, y INT", "STRUCT<lon: DOUBLE, lat: DOUBLE>", "named_struct('lon', tw_tile_lon(x + 0.5D, z), 'lat', tw_tile_lat(y + 0.5D, z))"),
    "tw_tolerance": ("z INT", "DOUBLE", f"CASE WHEN z < 16 THEN {CIRCUMFERENCE!r}D / pow(2, z + 8) END"),
    "tw_precision": ("z INT", "INT", "cast(ceil(log10(pow(2, z + 10)) - 2) AS INT)"),
    "tw_metatile": ("c INT, n INT", "INT", "cast(floor(c / n) * n AS INT)"),
    "tw_metatile_size": ("n INT, buffer INT, dim INT", "INT", "cast(dim * (2 * buffer / dim + n) AS INT)"),
    "tw_metatile_offset": ("c INT, n INT, buffer INT, dim INT", "INT", "pmod(c, n) * dim + buffer"),
    "tw_in_bounds": (
        "z INT, x INT, y INT, north DOUBLE, west DOUBLE, south DOUBLE, east DOUBLE, low INT, high INT", "BOOLEAN",
        "(low > high OR z BETWEEN low AND high) AND NOT (x > tw_col(tw_mercator_x(east), z) OR y > tw_row(tw_mercator_y(south), z) OR x + 1 < tw_col(tw_mercator_x(west), z) OR y + 1 < tw_row(tw_mercator_y(north), z))",
    ),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Makes the SQL functions and cover_tiles known to the session."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("cover_tiles", CoverTiles)
    return [*SQL_FUNCTIONS, "cover_tiles"]
