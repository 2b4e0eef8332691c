"""Queries over pixel tables and UTFGrids."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tilework.functions import grid
from tilework.operators import raster, tiling, utfgrid
from tilework.plans import fixtures as fx
from tilework.plans.tiles import PZ

QUERIES, ORACLES = {}, {}
U = f"(SELECT x, px, py, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, a / 255.0::DOUBLE AS a FROM ({fx.PIXELS}))"
P = f"({fx.PIXELS})"
KEYS = ["x", "px", "py"]
R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def unit(spark, sf):
    return raster.to_unit(fx.pixels(spark, sf))


PALETTE = [(i * 37 % 256, i * 91 % 256, i * 53 % 256) for i in range(16)]
_DIST = "(r - i * 37 % 256) * (r - i * 37 % 256) + (g - i * 91 % 256) * (g - i * 91 % 256) + (b - i * 53 % 256) * (b - i * 53 % 256)"


@query("apply_palette", f"SELECT x, px, py, (CASE WHEN a < 128 THEN 3 ELSE arg_min(i, ({_DIST}) * 100 + i) END)::INT AS \"index\" FROM {P}, (SELECT unnest(range(0, 16)) AS i) WHERE i != 3 GROUP BY x, px, py, r, g, b, a")
def _(spark, sf):
    return raster.apply_palette(fx.pixels(spark, sf), PALETTE, 3).select(*KEYS, F.col("index").cast("int").alias("index"))


@query("adjust_threshold", f"SELECT x, px, py, CASE WHEN r > 100 / 255.0::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS r, CASE WHEN g > 50 / 255.0::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS g, CASE WHEN b > 200 / 255.0::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS b FROM {U}")
def _(spark, sf):
    return raster.adjust_threshold(unit(spark, sf), 100, 50, 200).select(*KEYS, "r", "g", "b")


def _curve(points, c):
    a, b, k = raster._quadratic(points)
    return f"round(greatest(0, least(1, {c} * {c} * ({a!r}) + {c} * ({b!r}) + ({k!r}))), 6) AS {c}"


@query("adjust_curves", f"SELECT x, px, py, {', '.join(_curve([(0, 0), (204, 127.5), (255, 255)], c) for c in 'rgb')} FROM {U}")
def _(spark, sf):
    return raster.adjust_curves(unit(spark, sf), 0, 204, 255).select(*KEYS, *R6("r", "g", "b"))


MAPS = ([(0, 22), (128, 128), (255, 255)], [(0, 29), (128, 128), (255, 255)], [(0, 65), (128, 128), (255, 228)])


@query("adjust_curves2", f"SELECT x, px, py, {', '.join(_curve(m, c) for m, c in zip(MAPS, 'rgb', strict=True))} FROM {U}")
def _(spark, sf):
    return raster.adjust_curves2(unit(spark, sf), *MAPS).select(*KEYS, *R6("r", "g", "b"))


@query(
    "blend_modes",
    f"""SELECT x, px, py, round(1 - (1 - r) * (1 - g), 6) AS screen, round(r * g, 6) AS multiply, round(greatest(0, least(1, r + 2 * g - 1)), 6) AS linear, round(CASE WHEN g < 0.5 THEN 2 * r * g ELSE 1 - 2 * (1 - r) * (1 - g) END, 6) AS hard,
  round(least(1, r + g), 6) AS added, round(greatest(0, r - g), 6) AS subtracted FROM {U}""",
)
def _(spark, sf):
    m = {"screen": "screen", "multiply": "multiply", "linear": "linear light", "hard": "hard light", "added": "add", "subtracted": "subtract"}
    return unit(spark, sf).select(*KEYS, *[F.round(raster.blend("r", "g", v), 6).alias(k) for k, v in m.items()])


@query(
    "composite_over",
    f"""WITH k AS (SELECT *, a * 0.8 * ((299 * g + 587 * b + 114 * r) / 1000) AS k, 1 - r AS ba FROM {U}), o AS (SELECT *, 1 - (1 - k) * (1 - ba) AS oa FROM k)
SELECT x, px, py, round(CASE WHEN oa > 0 THEN (r * b) * k / oa + b * (1 - k / oa) ELSE 0 END, 6) AS r, round(oa, 6) AS a FROM o""",
)
def _(spark, sf):
    p = unit(spark, sf)
    bottom = p.select("z", "x", "y", "px", "py", F.col("b").alias("r"), "g", "b", (1 - F.col("r")).alias("a"))
    mask = p.select("z", "x", "y", "px", "py", F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b"), "a")
    return raster.composite_over(bottom, p, mask, 0.8, "multiply").select(*KEYS, *R6("r", "a"))


@query("blend_join", f"SELECT count(*) AS n, count(*) FILTER (px < 8) AS tops, count(*) FILTER (py < 8) AS bottoms FROM {P} WHERE px < 8 OR py < 8")
def _(spark, sf):
    p = unit(spark, sf).withColumn("a", F.lit(1.0))
    j = raster.blend_join(p.where("py < 8"), p.where("px < 8"))
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("t.a") > 0).alias("tops"), F.count_if(F.col("b.a") > 0).alias("bottoms"))


@query(
    "composite_stack",
    f"""WITH k AS (SELECT *, a AS ka FROM {U}), base AS (SELECT *, 204 / 255.0::DOUBLE AS c FROM k)
SELECT x, px, py, round(r * a + c * (1 - a), 6) AS r, 1.0::DOUBLE AS a FROM base""",
)
def _(spark, sf):
    p = unit(spark, sf)
    tiles = p.select("z", "x", "y").distinct()
    out = raster.composite_stack([{"color": "#ccc"}, [{"src": "p"}, {"src": "none"}]], {"p": p}, tiles, 16)
    # the stack fills whole tiles; the last tile of parts is not whole, so compare where there are parts
    return out.join(p.select("z", "x", "y", "px", "py"), ["z", "x", "y", "px", "py"], "left_semi").select(*KEYS, *R6("r", "a"))


@query("layers_for_zoom", f"WITH t AS (SELECT DISTINCT z, x, y FROM ({fx.TILE_STORE})), s AS (SELECT * FROM (VALUES (0, '', 0, 99), (1, '2-4', 2, 4), (2, '5', 5, 5)) AS v(position, zoom, lo, hi)) SELECT z, x, y, position, 'l' || position AS name FROM t JOIN s ON z BETWEEN lo AND hi")
def _(spark, sf):
    stack = spark.createDataFrame([(0, "", "l0"), (1, "2-4", "l1"), (2, "5", "l2")], "position int, zoom string, name string")
    return raster.layers_for_zoom(stack, fx.tile_store(spark, sf).select("z", "x", "y").distinct())


LUMA = "floor((299 * r + 587 * g + 114 * b) / 1000.0)::INT"


@query("greyscale", f"SELECT x, px, py, {LUMA} AS r, {LUMA} AS g, {LUMA} AS b FROM {P}")
def _(spark, sf):
    return raster.greyscale(fx.pixels(spark, sf)).select(*KEYS, "r", "g", "b")


@query("desaturate", f"SELECT x, px, py, round(r * 0.75::DOUBLE + {LUMA} * 0.25::DOUBLE)::INT AS r FROM {P}")
def _(spark, sf):
    return raster.desaturate(fx.pixels(spark, sf), 0.25).select(*KEYS, "r")


@query("pixelate", f"SELECT a.x, a.px, a.py, b.r, b.g FROM {P} a JOIN {P} b ON a.x = b.x AND b.px = least(15, a.px // 5 * 5 + 2) AND b.py = least(15, a.py // 5 * 5 + 2)")
def _(spark, sf):
    return raster.pixelate(fx.pixels(spark, sf), 5, 16).select(*KEYS, "r", "g")


def _blur_sql(radius: int, size: int) -> str:
    """Both passes: each pixel spread over the taps, places beyond an edge clamped to it."""
    taps = [math.exp(-0.5 * (o / (radius / 2)) ** 2) for o in range(-radius, radius + 1)]
    taps = ", ".join(f"({o}, {w / sum(taps)!r}::DOUBLE)" for o, w in zip(range(-radius, radius + 1), taps, strict=True))
    once = lambda src, p, q: f"SELECT s.x, t.i AS {p}, s.{q}, sum(s.r * w) AS r, sum(s.a * w) AS a FROM (SELECT unnest(range(0, {size}))::INT AS i) t, (VALUES {taps}) k(o, w), {src} s WHERE s.{p} = greatest(0, least({size - 1}, t.i + o)) GROUP BY ALL"
    return f"WITH p AS (SELECT x, px, py, r, a FROM {P}), h AS ({once('p', 'px', 'py')}), v AS ({once('h', 'py', 'px')}) SELECT x, px, py, round(r, 6) AS r, round(a, 6) AS a FROM v"


@query("blur", _blur_sql(2, 16))
def _(spark, sf):
    return raster.blur(fx.pixels(spark, sf), 2, 16).select(*KEYS, *R6("r", "a"))


@query("split_metatile", f"SELECT (8 + (px - 2) // 6)::INT AS tx, ((py - 2) // 6)::INT AS ty, ((px - 2) % 6)::INT AS px, ((py - 2) % 6)::INT AS py, sum(r)::BIGINT AS r FROM {P} WHERE px BETWEEN 2 AND 13 AND py BETWEEN 2 AND 13 GROUP BY ALL")
def _(spark, sf):
    p = fx.pixels(spark, sf).withColumn("x", F.lit(8)).withColumn("y", F.lit(0))
    s = raster.split_metatile(p, 2, 2, 2, 6)
    return s.groupBy(F.col("x").alias("tx"), F.col("y").alias("ty"), "px", "py").agg(F.sum("r").alias("r"))


@query(
    "mosaic",
    f"""SELECT (x * 16 + px)::INT AS px, (py - round((1 - ln(tan(pi() / 4 + radians(85.06) / 2)) / pi()) / 2 * 1024 * 16))::INT AS py, r, g, b, a FROM {P}""",
)
def _(spark, sf):
    # a frame around all tiles of the table, its top a little above the world's
    p = fx.pixels(spark, sf)
    last = p.agg(F.max("x")).first()[0] or 0
    frame = raster.mosaic_frame(extent=(85.06, -180.0, 85.0, (last + 1) / 1024 * 360 - 180), zoom=10, dim=16)
    return raster.mosaic(p, frame, 16)


@query("tile_pattern", f"SELECT x, px, py, ((x * 16 + px) % 5 * 10 + py % 3)::INT AS r FROM (SELECT DISTINCT x FROM {P}), (SELECT unnest(range(0, 16)) AS px), (SELECT unnest(range(0, 16)) AS py)")
def _(spark, sf):
    tiles = fx.pixels(spark, sf).select("z", "x", "y").distinct()
    bitmap = spark.range(15).select((F.col("id") % 5).cast("int").alias("px"), F.floor(F.col("id") / 5).cast("int").alias("py")).withColumn("r", F.col("px") * 10 + F.col("py")).selectExpr("*", "0 AS g", "0 AS b", "255 AS a")
    return raster.tile_pattern(tiles, bitmap, 5, 3, 16).select(*KEYS, "r")


@query("fill_color", f"SELECT x, px, py, round(255 / 255.0, 6)::DOUBLE AS r, round(153 / 255.0::DOUBLE, 6) AS g, 0.0::DOUBLE AS b, round(136 / 255.0::DOUBLE, 6) AS a FROM (SELECT DISTINCT x FROM {P}), (SELECT unnest(range(0, 4)) AS px), (SELECT unnest(range(0, 4)) AS py)")
def _(spark, sf):
    return raster.fill_color(fx.pixels(spark, sf).select("z", "x", "y").distinct(), "#f908", 4).select(*KEYS, *R6("r", "g", "b", "a"))


@query("blank_tiles", f"SELECT x, px, py, 0.0::DOUBLE AS a FROM (SELECT DISTINCT x FROM {P}), (SELECT unnest(range(0, 4)) AS px), (SELECT unnest(range(0, 4)) AS py)")
def _(spark, sf):
    return raster.blank_tiles(fx.pixels(spark, sf).select("z", "x", "y").distinct(), 4).select(*KEYS, "a")


@query("color_text", f"SELECT x, px, py, r::INT AS r, g::INT AS g, b::INT AS b, 255 AS a FROM {P}")
def _(spark, sf):
    p = fx.pixels(spark, sf).withColumn("c", raster.color_struct(F.format_string("#%02x%02x%02x", "r", "g", "b")))
    return p.select(*KEYS, "c.r", "c.g", "c.b", "c.a")


@query("check_tile_height", f"SELECT x, (max(py) + 1)::INT AS height, max(py) + 1 = 16 AS ok FROM {P} GROUP BY x")
def _(spark, sf):
    return raster.check_tile_height(fx.pixels(spark, sf), 16).select("x", "height", "ok")


# ---- UTFGrids --------------------------------------------------------------------------------------------------------

CELLS = f"""
SELECT z, x, y, floor((fx - x) * 64)::INT AS cx, floor((fy - y) * 64)::INT AS cy, id, segment, name FROM (
  SELECT *, floor(fx)::INT AS x, floor(fy)::INT AS y FROM (SELECT *, (lon + 180) / 360 * 2.0 ** z AS fx, (1 - ln(tan(pi() / 4 + radians(lat) / 2)) / pi()) / 2 * 2.0 ** z AS fy FROM {PZ} WHERE z IN (1, 3)))"""


def cells(spark, sf):
    c = utfgrid.point_cells(fx.points(spark, sf), [1, 3])
    return c.select("z", "x", "y", "cx", "cy", "id", "segment", "name")


def layer(spark, sf, segment, rank):
    c = cells(spark, sf).where(F.col("segment") == segment)
    c = c.withColumn("key", (F.col("id") % 40).cast("string")).withColumn("data", F.concat(F.lit('{"s":"'), "segment", F.lit('"}'))).withColumn("rank", F.lit(rank))
    return utfgrid.topmost(c, ["rank", "id"], ["key", "data", "rank"])


def LAYER(segment, rank):  # noqa: N802
    return f"SELECT z, x, y, cx, cy, (id % 40)::VARCHAR AS key, '{{\"s\":\"' || segment || '\"}}' AS data, {rank} AS rank FROM (SELECT *, row_number() OVER (PARTITION BY z, x, y, cx, cy ORDER BY id DESC) AS n FROM ({CELLS}) WHERE segment = '{segment}') WHERE n = 1"


IDS = "dense_rank() OVER (PARTITION BY z, x, y ORDER BY first)"


@query("utfgrid_cells", f"SELECT z, x, y, cx, cy, max(id) AS id FROM ({CELLS}) GROUP BY ALL")
def _(spark, sf):
    return utfgrid.topmost(cells(spark, sf), ["id"], ["id"])


@query("first_seen_ids", f"WITH t AS ({LAYER('BUILDING', 0)}), f AS (SELECT *, min(cy * 4096 + cx) OVER (PARTITION BY z, x, y, key) AS first FROM t) SELECT z, x, y, cx, cy, key, {IDS}::INT AS id FROM f")
def _(spark, sf):
    return utfgrid.first_seen_ids(layer(spark, sf, "BUILDING", 0)).select("z", "x", "y", "cx", "cy", "key", "id")


@query("utfgrid_tiles", f"WITH t AS ({LAYER('BUILDING', 0)}) SELECT z, x, y, count(DISTINCT key)::INT AS n_keys FROM t GROUP BY ALL")
def _(spark, sf):
    return utfgrid.encode(layer(spark, sf, "BUILDING", 0)).select("z", "x", "y", "n_keys")


@query("utfgrid_round_trip", f"SELECT z, x, y, cx, cy, key, data FROM ({LAYER('BUILDING', 0)})")
def _(spark, sf):
    bodies = utfgrid.encode(layer(spark, sf, "BUILDING", 0), wrapper="grid")
    return utfgrid.decode(bodies).select("z", "x", "y", F.col("cx").cast("int").alias("cx"), F.col("cy").cast("int").alias("cy"), "key", "data")


@query(
    "utfgrid_merge",
    f"""WITH t AS ({LAYER('BUILDING', 0)} UNION ALL {LAYER('MACHINERY', 1)}), m AS (SELECT z, x, y, cx, cy, max_by(key, rank) AS key, max_by(data, rank) AS data FROM t GROUP BY z, x, y, cx, cy),
f AS (SELECT *, min(cy * 4096 + cx) OVER (PARTITION BY z, x, y, key) AS first FROM m) SELECT z, x, y, cx, cy, key, data, {IDS}::INT AS id FROM f""",
)
def _(spark, sf):
    return utfgrid.merge(layer(spark, sf, "BUILDING", 0), layer(spark, sf, "MACHINERY", 1)).select("z", "x", "y", "cx", "cy", "key", "data", "id")


@query(
    "utfgrid_composite",
    f"""WITH t AS ({LAYER('BUILDING', 0)} UNION ALL {LAYER('MACHINERY', 1)} UNION ALL {LAYER('FURNITURE', 2)}),
k AS (SELECT z, x, y, key, data, row_number() OVER (PARTITION BY z, x, y, key ORDER BY r, data) AS n FROM (SELECT z, x, y, key, data, min(rank) AS r FROM t GROUP BY ALL)),
m AS (SELECT z, x, y, cx, cy, max_by(key, rank) AS key, max_by(data, rank) AS data FROM t GROUP BY z, x, y, cx, cy),
g AS (SELECT m.z, m.x, m.y, cx, cy, m.key || CASE n WHEN 1 THEN '' ELSE chr(95 + n::INT) END AS key, m.data FROM m JOIN k USING (z, x, y, key, data)),
f AS (SELECT *, min(cy * 4096 + cx) OVER (PARTITION BY z, x, y, key) AS first FROM g) SELECT z, x, y, cx, cy, key, data, {IDS}::INT AS id FROM f""",
)
def _(spark, sf):
    rows = layer(spark, sf, "BUILDING", 0).unionByName(layer(spark, sf, "MACHINERY", 1)).unionByName(layer(spark, sf, "FURNITURE", 2))
    return utfgrid.composite(rows).select("z", "x", "y", "cx", "cy", "key", "data", "id")


@query(
    "utfgrid_overlap",
    f"""WITH t AS ({LAYER('BUILDING', 0)} UNION ALL {LAYER('MACHINERY', 1)}), c AS (SELECT z, x, y, cx, cy, string_agg(data, ';' ORDER BY rank) AS data FROM t GROUP BY z, x, y, cx, cy)
SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY cy, cx)::INT AS id FROM c""",
)
def _(spark, sf):
    rows = layer(spark, sf, "BUILDING", 0).unionByName(layer(spark, sf, "MACHINERY", 1))
    return utfgrid.overlap(rows).select("z", "x", "y", "cx", "cy", F.array_join("data", ";").alias("data"), "id")


@query("utfgrid_crop", f"SELECT z, x, y, cx - 8 AS cx, cy - 16 AS cy, key FROM ({LAYER('BUILDING', 0)}) WHERE cx BETWEEN 8 AND 39 AND cy BETWEEN 16 AND 63")
def _(spark, sf):
    return utfgrid.crop(layer(spark, sf, "BUILDING", 0), 32, 64, 160, 256).select("z", "x", "y", "cx", "cy", "key")


@query("utfgrid_polygons")
def _(spark, sf):
    a = tiling.assign_tiles(fx.boxes(spark, sf).select("id", "geom"), [3], exact=False)
    return utfgrid.polygon_cells(a, 16).groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


