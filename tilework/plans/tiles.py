"""Queries over grid functions, plans and paths."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tilework.functions import grid, linear, paths, utm
from tilework.operators import tiling
from tilework.plans import fixtures as fx
from tilework.sources import tiles as tile_io

QUERIES, ORACLES = {}, {}
R6 = lambda c, n: F.round(c, 6).alias(n)
Z = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("z")
PZ = f"(SELECT *, z FROM ({fx.POINTS}), (SELECT unnest(range(0, 15))::INT AS z))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("tile_counts", f"SELECT z, {fx.TX} AS x, {fx.TY} AS y, count(*) AS n FROM (SELECT * FROM {PZ} WHERE z < 11) GROUP BY ALL")
def _(spark, sf):
    return tiling.tile_counts(fx.points(spark, sf), range(11))


@query("lonlat_to_mercator", f"SELECT id, round(6378137.0 * radians(lon), 6) AS mx, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS my FROM ({fx.POINTS})")
def _(spark, sf):
    m = grid.lonlat_to_mercator("lon", "lat")
    return fx.points(spark, sf).select("id", R6(m["mx"], "mx"), F.round(m["my"], 4).alias("my"))


@query("mercator_to_lonlat", f"SELECT id, round(degrees(lon * 100000 / 6378137.0), 6) AS lon2, round(degrees(2 * atan(exp(lat * 100000 / 6378137.0)) - pi() / 2), 6) AS lat2 FROM ({fx.POINTS})")
def _(spark, sf):
    m = grid.mercator_to_lonlat(F.col("lon") * 100000, F.col("lat") * 100000)
    return fx.points(spark, sf).select("id", R6(m["lon"], "lon2"), R6(m["lat"], "lat2"))


@query("lonlat_to_tile", f"SELECT id, z, {fx.TX} AS x, {fx.TY} AS y FROM {PZ}")
def _(spark, sf):
    return fx.points(spark, sf).select("id", "lon", "lat", Z(0, 14)).select("id", "z", grid.tile_x("lon", "z").alias("x"), grid.tile_y("lat", "z").alias("y"))


@query("wgs84_tiles", f"SELECT z, floor((lon + 180) / 180 * 2.0 ** z)::INT AS x, floor((90 - lat) / 180 * 2.0 ** z)::INT AS y, count(*) AS n FROM {PZ} GROUP BY ALL")
def _(spark, sf):
    p = fx.points(spark, sf).select("lon", "lat", Z(0, 14))
    return p.groupBy("z", grid.tile_x("lon", "z", "wgs84").alias("x"), grid.tile_y("lat", "z", "wgs84").alias("y")).agg(F.count("*").alias("n"))


C = 2 * math.pi * grid.RADIUS


@query(
    "mercator_tile_round_trip",
    f"SELECT id, round((mx / {C} + 0.5) * 1024, 6) AS x, round((0.5 - my / {C}) * 1024, 6) AS y, round(mx, 4) AS mx, round(my, 4) AS my FROM (SELECT id, 6378137.0 * radians(lon) AS mx, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS my FROM ({fx.POINTS}))",
)
def _(spark, sf):
    m = fx.points(spark, sf).withColumn("m", grid.lonlat_to_mercator("lon", "lat")).withColumn("t", grid.mercator_to_tile("m.mx", "m.my", F.lit(10)))
    back = grid.tile_to_mercator("t.x", "t.y", F.lit(10))
    return m.select("id", R6(F.col("t.x"), "x"), R6(F.col("t.y"), "y"), F.round(back["mx"], 4).alias("mx"), F.round(back["my"], 4).alias("my"))


@query(
    "linear_grid",
    f"SELECT id, z, floor((lon + 180) / (256 * r))::INT AS x, floor((90 - lat) / (256 * r))::INT AS y FROM (SELECT *, ([4.0, 2.0, 1.0, 0.5, 0.25])[z + 1] AS r FROM {PZ} WHERE z < 5)",
)
def _(spark, sf):
    lg = linear.LinearGrid((4.0, 2.0, 1.0, 0.5, 0.25), left=-180.0, top=90.0)
    t = lg.to_tile("lon", "lat", "z")
    return fx.points(spark, sf).select("id", "lon", "lat", Z(0, 4)).select("id", "z", F.floor(t["x"]).cast("int").alias("x"), F.floor(t["y"]).cast("int").alias("y"))


T10 = f"(SELECT DISTINCT 10 AS z, {fx.TX.replace('z)', '10)')} AS x, {fx.TY.replace('z)', '10)')} AS y FROM ({fx.POINTS}))".replace("** z", "** 10")


def tiles10(spark, sf):
    p = fx.points(spark, sf)
    return p.select(F.lit(10).alias("z"), grid.tile_x("lon", F.lit(10)).alias("x"), grid.tile_y("lat", F.lit(10)).alias("y")).distinct()


@query("tile_family", f"SELECT x, y, x >> 3 AS px, y >> 3 AS py, round(x / 8.0, 6) AS fx, list_sum([2 * x, 2 * x + 1, 2 * x, 2 * x + 1])::BIGINT AS kids_x, list_sum([2 * y, 2 * y, 2 * y + 1, 2 * y + 1])::BIGINT AS kids_y, x - 1 AS left_x, y + 1 AS down_y FROM {T10}")
def _(spark, sf):
    kids = grid.children("x", "y")
    total = lambda k: F.aggregate(kids, F.lit(0).cast("long"), lambda a, t: a + t[k])
    return tiles10(spark, sf).select(
        "x", "y", grid.parent("x", 3).alias("px"), grid.parent("y", 3).alias("py"), R6(grid.zoom_to("x", F.lit(10), F.lit(7)), "fx"), total("x").alias("kids_x"), total("y").alias("kids_y"),
        grid.neighbour("x", "y", "left")["x"].alias("left_x"), grid.neighbour("x", "y", "down")["y"].alias("down_y"),
    )


MX = f"((x + {{0}}) / 1024.0 - 0.5) * {C}"
MY = f"(0.5 - (y + {{0}}) / 1024.0) * {C}"


@query("tile_envelope", f"SELECT x, y, round({MX.format(0)}, 3) AS xmin, round({MY.format(1)}, 3) AS ymin, round({MX.format(1)}, 3) AS xmax, round({MY.format(0)}, 3) AS ymax FROM {T10}")
def _(spark, sf):
    e = grid.tile_envelope("z", "x", "y")
    return tiles10(spark, sf).select("x", "y", *[F.round(e[k], 3).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])


LAT = "degrees(2 * atan(exp(({0}) / 6378137.0)) - pi() / 2)"


@query(
    "tile_bbox_lonlat",
    f"SELECT x, y, round({LAT.format(MY.format(0))}, 6) AS n, round({LAT.format(MY.format(1))}, 6) AS s, round((x + 1) / 1024.0 * 360 - 180, 6) AS e, round(x / 1024.0 * 360 - 180, 6) AS w, round({LAT.format(MY.format(0.5))}, 6) AS center_lat FROM {T10}",
)
def _(spark, sf):
    b, c = grid.tile_bbox_lonlat("z", "x", "y"), grid.tile_center("z", "x", "y")
    return tiles10(spark, sf).select("x", "y", *[R6(b[k], k) for k in "nsew"], R6(c["lat"], "center_lat"))


@query("tile_perimeter", f"SELECT x, y, i, round({C} * ((x + u) / 1024.0 - 0.5), 3) AS px, round({C} * (0.5 - (y + v) / 1024.0), 3) AS py FROM {T10}, (SELECT i, greatest(0, least(1.0, CASE WHEN i <= 4 THEN i / 4.0 WHEN i <= 8 THEN 1 WHEN i <= 12 THEN (12 - i) / 4.0 ELSE 0 END)) * 1.1 - 0.05 AS u, (CASE WHEN i <= 4 THEN 0 WHEN i <= 8 THEN (i - 4) / 4.0 WHEN i <= 12 THEN 1 ELSE (16 - i) / 4.0 END) * 1.1 - 0.05 AS v FROM (SELECT unnest(range(0, 17)) AS i))")
def _(spark, sf):
    t = tiles10(spark, sf).select("x", "y", F.posexplode(grid.tile_perimeter("z", "x", "y", padded=True)).alias("i", "p"))
    return t.select("x", "y", F.col("i").cast("long").alias("i"), F.round("p.x", 3).alias("px"), F.round("p.y", 3).alias("py"))


@query("padded_envelope", f"SELECT x, y, round({MX.format(0)} - 8 * {C} / 2 ** 18, 3) AS xmin, round({MY.format(0)} + 8 * {C} / 2 ** 18, 3) AS ymax FROM {T10}")
def _(spark, sf):
    e = grid.padded_envelope("z", "x", "y", 8)
    return tiles10(spark, sf).select("x", "y", F.round(e["xmin"], 3).alias("xmin"), F.round(e["ymax"], 3).alias("ymax"))


@query(
    "metatiles",
    f"SELECT mx, my, count(*) AS n, min(px) AS px, max(py) AS py, round(({C} * ((mx - 0.25) / 1024.0 - 0.5)), 3) AS xmin, 16 AS members FROM (SELECT x // 4 * 4 AS mx, y // 4 * 4 AS my, x % 4 * 256 + 64 AS px, y % 4 * 256 + 64 AS py FROM {T10}) GROUP BY mx, my",
)
def _(spark, sf):
    k, o = grid.metatile_key("x", "y", 4, 4), grid.metatile_offsets("x", "y", 4, 4, 64)
    t = tiles10(spark, sf).select(k["x"].alias("mx"), k["y"].alias("my"), o["px"].alias("px"), o["py"].alias("py"))
    out = t.groupBy("mx", "my").agg(F.count("*").alias("n"), F.min("px").alias("px"), F.max("py").alias("py"))
    e = grid.metatile_envelope(F.lit(10), "mx", "my", 4, 4, 64)
    return out.select("*", F.round(e["xmin"], 3).alias("xmin"), F.size(grid.metatile_tiles("mx", "my", 4, 4)).alias("members"))


LON0, LON1 = (-122.358 + 180) / 360, (-100.0 + 180) / 360


@query(
    "in_bounds",
    f"SELECT z, count(*) AS n FROM (SELECT DISTINCT z, {fx.TX} AS x, {fx.TY} AS y FROM {PZ}) WHERE z BETWEEN 3 AND 9 AND NOT (x > {LON1} * 2.0 ** z OR x + 1 < {LON0} * 2.0 ** z OR y + 1 < (1 - ln(tan(pi() / 4 + radians(60.0) / 2)) / pi()) / 2 * 2.0 ** z OR y > (1 - ln(tan(pi() / 4 + radians(10.0) / 2)) / pi()) / 2 * 2.0 ** z) GROUP BY z",
)
def _(spark, sf):
    p = fx.points(spark, sf).select("lon", "lat", Z(0, 14)).select("z", grid.tile_x("lon", "z").alias("x"), grid.tile_y("lat", "z").alias("y")).distinct()
    return p.where(grid.in_bounds("z", "x", "y", 60.0, -122.358, 10.0, -100.0, 3, 9)).groupBy("z").agg(F.count("*").alias("n"))


@query(
    "parse_tile_path",
    f"SELECT event_id, path, CASE WHEN event_id % 50 = 0 THEN NULL ELSE layer END AS player, CASE WHEN event_id % 50 = 0 THEN NULL ELSE z END AS pz, CASE WHEN event_id % 50 = 0 THEN NULL ELSE x END AS px, CASE WHEN event_id % 50 = 0 THEN NULL ELSE y END AS py FROM ({fx.REQUESTS})",
)
def _(spark, sf):
    t = fx.requests(spark, sf).withColumn("t", paths.parse_tile_path("path"))
    return t.select("event_id", "path", F.col("t.layer").alias("player"), F.col("t.z").alias("pz"), F.col("t.x").alias("px"), F.col("t.y").alias("py"))


@query(
    "tile_disk_paths",
    f"""WITH t AS (SELECT layer, z, x, y FROM ({fx.TILE_STORE}))
SELECT layer, z, x, y, layer || '/' || z || '/' || substr(lpad(x::VARCHAR, 6, '0'), 1, 3) || '/' || substr(lpad(x::VARCHAR, 6, '0'), 4, 3) || '/' || substr(lpad(y::VARCHAR, 6, '0'), 1, 3) || '/' || substr(lpad(y::VARCHAR, 6, '0'), 4, 3) || '.json.gz' AS safe,
  layer || '/' || z || '/' || x || '/' || y || '.json' AS portable,
  array_to_string([((y >> (z - i)) & 1) * 2 + ((x >> (z - i)) & 1) FOR i IN range(0, z + 1)], '') AS quad FROM t""",
)
def _(spark, sf):
    t = fx.tile_store(spark, sf)
    ext = F.lit("JSON")
    return t.select("layer", "z", "x", "y", paths.tile_disk_path("layer", "z", "x", "y", ext, "safe", True).alias("safe"), paths.tile_disk_path("layer", "z", "x", "y", ext, "portable").alias("portable"), paths.quadtile("z", "x", "y").alias("quad"))


@query(
    "tile_store_keys",
    f"""SELECT layer, z, x, y, 'cool_prefix/1/' || layer || '/' || z || '/' || x || '/' || y || '.JSON' AS memcache, 'p/' || layer || '/' || z || '/' || x || '/' || y || '.JSON' AS redis,
  '/' || layer || '/' || z || '/' || x || '/' || y || '.json' AS object, 'application/json' AS mime FROM ({fx.TILE_STORE})""",
)
def _(spark, sf):
    k = lambda **a: paths.tile_store_key("layer", "z", "x", "y", "format", **a)
    return fx.tile_store(spark, sf).select("layer", "z", "x", "y", k(prefix="cool_prefix", revision=1).alias("memcache"), k(kind="redis", prefix="p").alias("redis"), k(kind="object").alias("object"), paths.content_type("format").alias("mime"))


@query("flip_y", f"SELECT z, x, y, ((1 << z) - 1 - y)::INT AS tms FROM ({fx.TILE_STORE})")
def _(spark, sf):
    return fx.tile_store(spark, sf).select("z", "x", "y", grid.flip_y("z", "y").alias("tms"))


@query("tile_url", f"SELECT z, x, y, 'http://tile/' || z || '/' || x || '/' || y || '.png?{{N}}' AS url FROM ({fx.TILE_STORE})")
def _(spark, sf):
    return fx.tile_store(spark, sf).select("z", "x", "y", paths.tile_url("http://tile/{Z}/{X}/{Y}.png?{N}", "z", "x", "y").alias("url"))


@query(
    "tiles_for_view",
    f"""WITH b AS (SELECT id, 6378137.0 * radians(lon) AS mx, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS my, round(log2({C}) + log2(0.0001) - 1)::INT AS z FROM ({fx.POINTS}) WHERE abs(lon) < 170),
r AS (SELECT *, floor(2.0 ** z * ((mx - 500000) / {C} + 0.5))::INT AS x0, floor(2.0 ** z * ((mx + 500000) / {C} + 0.5))::INT AS x1, floor(2.0 ** z * (0.5 - (my + 500000) / {C}))::INT AS y0, floor(2.0 ** z * (0.5 - (my - 500000) / {C}))::INT AS y1 FROM b)
SELECT id, z, count(*) AS n, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys FROM (SELECT id, z, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM r) a, LATERAL (SELECT unnest(range(a.y0, a.y1 + 1)) AS y) GROUP BY id, z""",
)
def _(spark, sf):
    m = fx.points(spark, sf).where("abs(lon) < 170").withColumn("m", grid.lonlat_to_mercator("lon", "lat"))
    x, y = F.col("m.mx"), F.col("m.my")
    t = tiling.view_tiles(m, "id", x - 500000, y - 500000, x + 500000, y + 500000, F.lit(0.0001), 1)
    return t.groupBy("id", "z").agg(F.count("*").alias("n"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


@query(
    "utm_grid",
    f"""SELECT id, (((round(lon / 6 + 30.5)::INT - 1) % 60 + 60) % 60 + 1)::INT AS zone, nullif(substr('CDEFGHJKLMNPQRSTUVWX', round(lat / 8 + 9.5)::INT + 1, 1), '') AS band, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS hemi,
  e, n FROM (SELECT *, 100000 + id * 7919 % 800000 AS e, id * 104729 % 9000000 AS n FROM ({fx.POINTS}) WHERE lat BETWEEN -79 AND 83)""",
)
def _(spark, sf):
    p = fx.points(spark, sf).where("lat BETWEEN -79 AND 83")
    return p.select("id", utm.utm_zone("lon").alias("zone"), utm.utm_band("lat").alias("band"), utm.hemisphere("lat").alias("hemi"), (100000 + F.col("id") * 7919 % 800000).alias("e"), (F.col("id") * 104729 % 9000000).alias("n"))


@query(
    "mgrs",
    f"""SELECT id, zone || 'Q ' || substr(CASE zone % 3 WHEN 1 THEN 'ABCDEFGH' WHEN 2 THEN 'JKLMNPQR' ELSE 'STUVWXYZ' END, (e // 100000)::INT, 1)
  || substr(CASE zone % 2 WHEN 1 THEN 'ABCDEFGHJKLMNPQRSTUV' ELSE 'FGHJKLMNPQRSTUVABCDE' END, (n % 2000000 // 100000)::INT + 1, 1) || ' ' || substr(lpad((e % 100000)::VARCHAR, 5, '0'), 1, 2) || ' ' || substr(lpad((n % 100000)::VARCHAR, 5, '0'), 1, 2) AS ref
FROM (SELECT c_custkey AS id, c_custkey % 60 + 1 AS zone, 100000 + c_custkey * 7919 % 800000 AS e, c_custkey * 104729 % 9000000 AS n FROM customer)""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select(k.alias("id"), utm.mgrs(100000 + k * 7919 % 800000, k * 104729 % 9000000, F.concat((k % 60 + 1).cast("string"), F.lit("Q")), 3).alias("ref"))


@query(
    "grid_lines",
    f"""WITH b AS (SELECT id, xmin * 1000 AS x0, ymin * 1000 AS y0, xmax * 1000 AS x1, ymax * 1000 AS y1 FROM ({fx.BOXES})),
s AS (SELECT *, (10 ** ceil(log10(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * 100 / sqrt(2 * 256 * 256))))::BIGINT AS step FROM b)
SELECT id, step, ((floor(x1 / step) - floor(x0 / step)) + 2)::BIGINT AS verticals, ((floor(y1 / step) - floor(y0 / step)) + 2)::BIGINT AS horizontals FROM s""",
)
def _(spark, sf):
    b = fx.boxes(spark, sf)
    x0, y0, x1, y1 = (F.col(c) * 1000 for c in ("xmin", "ymin", "xmax", "ymax"))
    lines = utm.grid_lines(x0, y0, x1, y1, 256, 256)
    n = lambda k: F.size(F.filter(lines, lambda v: v["kind"] == k)).cast("long")
    units = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    return b.select("id", utm.line_step(units, F.lit(math.hypot(256, 256)), F.lit(100)).alias("step"), n("vertical").alias("verticals"), n("horizontal").alias("horizontals"))


@query("zoom_range", "SELECT event_id, (user_id % 7)::INT AS z, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN user_id % 7 BETWEEN 2 AND 4 ELSE user_id % 7 = 5 END AS inside FROM events")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", (F.col("user_id") % 7).cast("int").alias("z"))
    text = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "2-4").otherwise("5")
    return e.withColumn("inside", paths.in_zoom_range("z", text))


@query("tile_formats", "SELECT p_partkey, ext, CASE ext WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'json' THEN 'text/json' WHEN 'pbf' THEN 'application/x-protobuf' END AS mime, CASE ext WHEN 'png' THEN 'PNG' WHEN 'jpg' THEN 'JPEG' WHEN 'json' THEN 'JSON' WHEN 'pbf' THEN 'PBF' END AS format FROM (SELECT p_partkey, (['png', 'jpg', 'json', 'pbf', 'gif'])[p_partkey % 5 + 1] AS ext FROM part)")
def _(spark, sf):
    ext = F.get(F.array(*map(F.lit, ("png", "jpg", "json", "pbf", "gif"))), (F.col("p_partkey") % 5).cast("int"))
    p = fx.table(spark, sf, "part").select("p_partkey", ext.alias("ext")).withColumn("f", paths.tile_format("ext", "archive", fail=False))
    return p.select("p_partkey", "ext", F.col("f.mime").alias("mime"), F.col("f.format").alias("format"))


@query("sniff_format", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'GIF' WHEN 2 THEN 'TIFF' END AS kind FROM part")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    body = F.unhex(F.when(k == 0, "89504E470D0A1A0A").when(k == 1, "474946383961").when(k == 2, "49492A0008").otherwise("00112233"))
    return fx.table(spark, sf, "part").select("p_partkey", paths.sniff_image_format(body).alias("kind"))


@query("zoom_tolerance", f"SELECT id, z, CASE WHEN z < 16 THEN round({C} / 2.0 ** (z + 8), 6) END AS tolerance, ceil(log10(2.0 ** (z + 10)) - 2)::INT AS digits FROM (SELECT c_custkey AS id, (c_custkey % 20)::INT AS z FROM customer)")
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 20).cast("int").alias("z"))
    return c.select("id", "z", R6(grid.zoom_tolerance("z"), "tolerance"), grid.zoom_precision("z").alias("digits"))


# ---- plans over the store's area -------------------------------------------------------------------------------------


def area(spark, sf, padding=0):
    """The plan of the box around all points at zoom 2 and the two zooms about which a tile has a point: it grows with the points."""
    p = fx.points(spark, sf)
    n, *box = p.agg(F.count("*"), F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
    deep = (n.bit_length() + 1) // 2
    # a longitude of 180 degrees or -180 is on the world's edge, which a plan's box can't touch
    south, west, north, east = box
    return tiling.tile_plan(spark, (south, max(west, -179.99), north, east), sorted({2, deep - 1, deep}), padding)


AREA = f"""
b AS (SELECT min(lat) AS s, greatest(min(lon), -179.99) AS w, max(lat) AS n, max(lon) AS e, (length(bin(count(*))) + 1) // 2 AS deep FROM ({fx.POINTS})),
r AS (SELECT z, floor((w + 180) / 360 * 2.0 ** z)::INT - 1 AS x0, floor((e + 180) / 360 * 2.0 ** z)::INT + 1 AS x1, floor((1 - ln(tan(pi() / 4 + radians(n) / 2)) / pi()) / 2 * 2.0 ** z)::INT - 1 AS y0,
  floor((1 - ln(tan(pi() / 4 + radians(s) / 2)) / pi()) / 2 * 2.0 ** z)::INT + 1 AS y1 FROM b, (SELECT DISTINCT unnest([2, deep - 1, deep])::INT AS z FROM b)),
plan AS (SELECT z, x::INT AS x, y::INT AS y FROM (SELECT z, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM r) a, LATERAL (SELECT unnest(range(a.y0, a.y1 + 1)) AS y)),
store AS ({fx.TILE_STORE})"""


@query("tile_plan", f'WITH {AREA} SELECT z, x, y, row_number() OVER (ORDER BY z, y, x) - 1 AS "offset", count(*) OVER () AS total FROM plan')
def _(spark, sf):
    return area(spark, sf, 1)


@query("plan_progress", f'WITH {AREA} SELECT z, x, y, row_number() OVER (ORDER BY z, x, y) - 1 AS "offset", count(*) OVER () AS total FROM (SELECT DISTINCT z, x, y FROM store WHERE z = 3)')
def _(spark, sf):
    return tiling.with_progress(fx.tile_store(spark, sf).where("z = 3").select("z", "x", "y").distinct(), ["z", "x", "y"])


@query("keep_tiles", f"WITH {AREA} SELECT layer, z, x, y FROM store WHERE (z, x, y) IN (SELECT (z, x, y) FROM plan)")
def _(spark, sf):
    return tiling.keep_tiles(fx.tile_store(spark, sf), area(spark, sf, 1)).select("layer", "z", "x", "y")


@query("missing_tiles", f"WITH {AREA} SELECT z, x, y FROM plan WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.z = plan.z AND s.x = plan.x AND s.y = plan.y)")
def _(spark, sf):
    return tiling.missing_tiles(area(spark, sf, 1).select("z", "x", "y"), fx.tile_store(spark, sf))


@query("tile_source", f"WITH {AREA} SELECT z, x, y FROM plan")
def _(spark, sf):
    return tiling.tile_source(None, None, area(spark, sf, 1))


@query("tile_list", f"SELECT z || '/' || x || '/' || y AS value FROM ({fx.TILE_STORE})")
def _(spark, sf):
    return tile_io.tile_list(fx.tile_store(spark, sf))
