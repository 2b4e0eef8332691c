"""Streaming and user-code operators over the whole tables as bounded input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilework.functions import udf
from tilework.operators import store
from tilework.plans import fixtures as fx
from tilework.plans.tiles import PZ
from tilework.streaming import streams

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


LAYERS = '{"layers": {"click": {"bounds": {"north": 60, "west": -90, "south": -60, "east": 90, "low": 2, "high": 5}}, "view": {}, "error": {"bounds": {"low": 1, "high": 4}}}}'
#: Row of a latitude at the zoom, as a fraction.
ROW = "(1 - ln(tan(pi() / 4 + radians({0}) / 2)) / pi()) / 2 * 2.0 ** z"


@query(
    "request_hits",
    f"""WITH r AS ({fx.REQUESTS}), t AS (SELECT DISTINCT layer, z, x, y, true AS hit FROM r WHERE layer != 'error' AND z < 5)
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'bad path' WHEN layer NOT IN ('click', 'view', 'error') THEN 'unknown layer'
  WHEN layer = 'click' AND (z NOT BETWEEN 2 AND 5 OR x > 0.75 * 2.0 ** z OR x + 1 < 0.25 * 2.0 ** z OR y > {ROW.format('-60.0')} OR y + 1 < {ROW.format('60.0')}) THEN 'out of bounds'
  WHEN layer = 'error' AND z NOT BETWEEN 1 AND 4 THEN 'out of bounds' WHEN hit THEN 'hit' ELSE 'miss' END AS outcome
FROM r LEFT JOIN t USING (layer, z, x, y)""",
)
def _(spark, sf):
    r = fx.requests(spark, sf)
    stored = r.where("layer != 'error' AND z < 5").select("layer", "z", "x", "y", F.lit("JSON").alias("format"))
    return streams.request_hits(r.select("event_id", "path"), stored, store.layer_catalog(spark, LAYERS)).select("event_id", "outcome")


@query("tile_counts_stream", f"SELECT date_trunc('hour', ts) AS \"start\", z, {fx.TX} AS x, {fx.TY} AS y, count(*) AS n FROM (SELECT ts, 3 AS z, {fx.PLACE.format('event_id')} FROM events) GROUP BY ALL")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), *fx.place("event_id"))
    return streams.tile_counts_stream(e, 3).select(F.col("start").cast("timestamp_ntz").alias("start"), "z", "x", "y", "n")


@query(
    "idle_processes",
    f"""SELECT pid, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY pid ORDER BY ts, message) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY pid ORDER BY ts, message) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ({fx.STATUS}))) GROUP BY pid, s""",
)
def _(spark, sf):
    s = fx.status(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.idle_processes(s, "6 hours").select("pid", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")], "n")


NOW = "2024-01-20 12:00:00"


@query(
    "process_states",
    f"""SELECT pid, ts AS last, message, CASE WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR THEN 'dropped' WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR THEN 'expired'
  WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE THEN 'hidden' ELSE 'shown' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts DESC, message DESC) AS rn FROM ({fx.STATUS}) WHERE ts <= TIMESTAMP '{NOW}') WHERE rn = 1""",
)
def _(spark, sf):
    s = fx.status(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.process_states(s, NOW).withColumn("last", F.col("last").cast("timestamp_ntz"))


TIMED = "SELECT user_id AS pid, '/p' || user_id % 5 AS path, ts, event_type FROM events"


@query("request_timing", f"SELECT a.pid, a.path, a.ts AS started, epoch_us(b.ts) - epoch_us(a.ts) AS micros FROM ({TIMED}) a JOIN ({TIMED}) b ON a.pid = b.pid AND a.path = b.path AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'view'")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("pid"), F.format_string("/p%d", F.col("user_id") % 5).alias("path"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = streams.request_timing(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "6 hours")
    return out.select("pid", "path", F.col("started").cast("timestamp_ntz").alias("started"), "micros")


@query("seed_batch", f"SELECT z, x, y, CASE WHEN (x + y) % 5 < 4 THEN greatest(1, (x + y) % 5)::INT END AS attempt FROM (SELECT DISTINCT z, x, y FROM ({fx.TILE_STORE}))")
def _(spark, sf):
    # a maker whose tiles need as many attempts as their place says, four of them more than are made
    t = fx.tile_store(spark, sf).select("z", "x", "y").distinct()
    render = lambda df, attempt: df.withColumn("body", F.lit("b")).withColumn("error", F.when((F.col("x") + F.col("y")) % 5 > attempt, "no"))
    made, failed = streams.seed_batch(t, render)
    return made.select("z", "x", "y", "attempt").unionByName(failed.select("z", "x", "y", F.lit(None).cast("int").alias("attempt")))


def _lines(batches):
    for b in batches:
        yield b.assign(body=b["z"].astype(str) + "/" + b["x"].astype(str) + "/" + b["y"].astype(str))


@query("render_tiles", f"SELECT DISTINCT z, x, y, z || '/' || x || '/' || y AS body FROM ({fx.TILE_STORE})")
def _(spark, sf):
    return udf.render_tiles(fx.tile_store(spark, sf).select("z", "x", "y").distinct(), _lines, "z int, x int, y int, body string")


def _named(pdf):
    return pdf[["z", "x", "y"]].head(1).assign(names="|".join(pdf.sort_values("id")["name"]))


@query("tile_aggregate", f"SELECT z, {fx.TX} AS x, {fx.TY} AS y, string_agg(name, '|' ORDER BY id) AS names FROM {PZ} WHERE z = 5 GROUP BY ALL")
def _(spark, sf):
    from tilework.functions import grid

    z = F.lit(5)
    p = fx.points(spark, sf).select(z.alias("z"), grid.tile_x("lon", z).alias("x"), grid.tile_y("lat", z).alias("y"), "id", "name")
    return udf.tile_aggregate(p, _named, "z int, x int, y int, names string")


@query(
    "sql_functions",
    f"SELECT id, {fx.TX} AS x, {fx.TY} AS y, 1023 - {fx.TY} AS flipped, floor((lon + 180) / 180 * 1024.0)::INT AS wx, floor((90 - lat) / 180 * 1024.0)::INT AS wy, round(6378137.0 * radians(lon), 4) AS mx, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS my FROM {PZ} WHERE z = 10",
)
def _(spark, sf):
    udf.register_sql(spark)
    return fx.points(spark, sf).selectExpr(
        "id", "tw_tile_x(lon, 10) AS x", "tw_tile_y(lat, 10) AS y", "tw_flip_y(10, tw_tile_y(lat, 10)) AS flipped", "tw_wgs84_x(lon, 10) AS wx", "tw_wgs84_y(lat, 10) AS wy",
        "round(tw_mercator_x(lon), 4) AS mx", "round(tw_mercator_y(lat), 4) AS my",
    )


_M = "6378137.0 * 2 * pi()"
_LAT = "degrees(2 * atan(exp((0.5 - ({0}) / 2.0 ** z) * 2 * pi())) - pi() / 2)"


@query(
    "sql_grid_functions",
    f"""SELECT id, z, round((x / 2.0 ** z - 0.5) * {_M}, 3) AS xmin, round((0.5 - y / 2.0 ** z) * {_M} + 4 * {_M} / 2.0 ** (z + 8), 3) AS ymax, round({_LAT.format('y')}, 6) AS north, round(x / 2.0 ** z * 360 - 180, 6) AS west,
  round((x + 0.5) / 2.0 ** z * 360 - 180, 6) AS lon, round({_LAT.format('y + 0.5')}, 6) AS lat, x // 4 AS up, x * 2 + 1 AS child_x, y * 2 + 1 AS child_y, x // 4 * 4 AS block, x % 4 * 256 + 64 AS pixel, 1152 AS size,
  round({_M} / 2.0 ** (z + 8), 6) AS tolerance, ceil(log10(2.0 ** (z + 10)) - 2)::INT AS "precision", lon >= -60 AND lon <= 60 AND z >= 9 AS inside
FROM (SELECT id, z, floor((lon + 180) / 360 * 2.0 ** z)::INT AS x, {fx.TY} AS y, round(floor((lon + 180) / 360 * 2.0 ** z) / 2.0 ** z * 360 - 180, 6) AS lon FROM {PZ} WHERE z IN (6, 10) AND abs(lon) NOT BETWEEN 54 AND 66)""",
)
def _(spark, sf):
    udf.register_sql(spark)
    p = fx.points(spark, sf).where("abs(lon) NOT BETWEEN 54 AND 66").selectExpr("id", "lon", "lat", "explode(array(6, 10)) AS z").selectExpr("id", "z", "tw_tile_x(lon, z) AS x", "tw_tile_y(lat, z) AS y")
    return p.selectExpr(
        "id", "z", "round(tw_envelope(z, x, y).xmin, 3) AS xmin", "round(tw_padded_envelope(z, x, y, 4D).ymax, 3) AS ymax", "round(tw_bbox(z, x, y).n, 6) AS north", "round(tw_bbox(z, x, y).w, 6) AS west",
        "round(tw_center(z, x, y).lon, 6) AS lon", "round(tw_center(z, x, y).lat, 6) AS lat", "tw_parent(x, 2) AS up", "tw_children(x, y)[3].x AS child_x", "tw_children(x, y)[3].y AS child_y",
        "tw_metatile(x, 4) AS block", "tw_metatile_offset(x, 4, 64, 256) AS pixel", "tw_metatile_size(4, 64, 256) AS size", "round(tw_tolerance(z), 6) AS tolerance", "tw_precision(z) AS precision",
        "tw_in_bounds(z, x, y, 89D, -60D, -89D, 60D, 9, 12) AS inside",
    )


@query(
    "cover_tiles",
    f"""SELECT id, x, y FROM (SELECT id, 5 AS z, greatest(0, floor((xmin + 180) / 360 * 32))::INT AS x0, least(31, floor((xmax + 180) / 360 * 32))::INT AS x1,
  greatest(0, floor((1 - ln(tan(pi() / 4 + radians(ymax) / 2)) / pi()) / 2 * 32))::INT AS y0, least(31, floor((1 - ln(tan(pi() / 4 + radians(ymin) / 2)) / pi()) / 2 * 32))::INT AS y1 FROM ({fx.BOXES})) b,
  LATERAL (SELECT unnest(range(b.x0, b.x1 + 1)) AS x), LATERAL (SELECT unnest(range(b.y0, b.y1 + 1)) AS y)""",
)
def _(spark, sf):
    udf.register_sql(spark)
    return spark.sql("SELECT b.id, t.x, t.y FROM {boxes} AS b, LATERAL cover_tiles(b.xmin, b.ymin, b.xmax, b.ymax, 5) AS t", boxes=fx.boxes(spark, sf))
