"""Files, archives and streamed tables over whole tables: what is written is read back, and the rows read are the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.functions import geom, grid
from tilework.operators import encode, osm, tiling
from tilework.operators.tables import scratch_dir, written
from tilework.plans import fixtures as fx
from tilework.plans.stores import CLOSED, X12, Y12, osm_tiles
from tilework.sources import geojson, tiles
from tilework.streaming import areas, streams

QUERIES, ORACLES = {}, {}
META = {"name": "points", "type": "baselayer", "version": "1", "description": "tiles of points", "format": "json"}
#: A tile's body in SQL: its place.
BODY = "z || '/' || x || '/' || y"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def body() -> F.Column:
    return F.format_string("%d/%d/%d", "z", "x", "y")


@query("geojson_files", f"SELECT id::VARCHAR AS id, 'Point' AS kind, round(lon, 6) AS lon, round(lat, 6) AS lat, name, segment FROM ({fx.POINTS})")
def _(spark, sf):
    a = tiling.assign_tiles(fx.point_features(spark, sf), [4], edges="half_open")
    path = folder(spark, "geojson")
    encode.geojson_tiles(a).select("x", "y", "body").repartition("x", "y").write.partitionBy("x", "y").text(path)
    p = F.get(geom.points("geom"), F.lit(0))
    props = F.from_json("props", "name string, segment string")
    f = geojson.read_geojson(spark, f"{path}/*/*")
    return f.select("id", F.col("geom.kind").alias("kind"), F.round(p["x"], 6).alias("lon"), F.round(p["y"], 6).alias("lat"), props["name"].alias("name"), props["segment"].alias("segment"))


def _tree(layout: str):
    def run(spark, sf) -> DataFrame:
        path = folder(spark, "tree")
        kind = F.when(F.col("x") % 2 == 0, "json").otherwise("png")  # the first is gzipped in the tree, the other isn't
        tiles.write_tile_tree(fx.tile_store(spark, sf).select("layer", "z", "x", "y", kind.alias("format"), body().alias("body")), path, layout)
        return tiles.read_tile_tree(spark, path, layout).select("layer", "z", "x", "y", "format", F.col("body").cast("string").alias("body"))

    return run


TREE = f"SELECT layer, z, x, y, CASE WHEN x % 2 = 0 THEN 'json' ELSE 'png' END AS format, {BODY} AS body FROM ({fx.TILE_STORE})"
for _layout in ("safe", "portable", "quadtile"):
    query(f"tile_tree_{_layout}", TREE)(_tree(_layout))


@query("tile_archives", f"SELECT z, x, y, 'json' AS format, {BODY} AS body FROM (SELECT DISTINCT z, x, y FROM ({fx.TILE_STORE}))")
def _(spark, sf):
    path = folder(spark, "archives")
    t = fx.tile_store(spark, sf).select("z", "x", "y").distinct().withColumn("body", body())
    tiles.write_mbtiles(t.repartition("z", "x", "y"), path, META)
    return tiles.read_mbtiles(spark, path).select("z", "x", "y", "format", F.col("body").cast("string").alias("body"))


@query("tile_set", f"SELECT z, x, y, CASE WHEN z >= 5 THEN 'new ' ELSE '' END || {BODY} AS body FROM (SELECT DISTINCT z, x, y FROM ({fx.TILE_STORE}))")
def _(spark, sf):
    path = folder(spark, "set")
    t = fx.tile_store(spark, sf).select("z", "x", "y").distinct().withColumn("body", body())
    tiles.write_tileset(t, path, META)
    tiles.write_tileset(t.where("z >= 5").withColumn("body", F.concat(F.lit("new "), "body")), path, META)
    return tiles.read_tileset(spark, path).select("z", "x", "y", "body")


@query("tile_list_files", f"SELECT DISTINCT z, x, y FROM ({fx.TILE_STORE})")
def _(spark, sf):
    path = folder(spark, "list")
    tiles.write_tile_list(fx.tile_store(spark, sf).select("z", "x", "y").distinct(), path)
    return tiles.read_tile_list(spark, path)


@query(
    "osm_files",
    f"""WITH {CLOSED} SELECT x, y, 2::BIGINT AS frame, (SELECT count(*) FROM nd WHERE nd.x = t.x AND nd.y = t.y) AS nodes, (SELECT count(*) FROM w JOIN ways USING (id) WHERE w.x = t.x AND w.y = t.y) AS ways,
  (SELECT count(*) FROM w JOIN ways USING (id) JOIN wn ON wn.way_id = id WHERE w.x = t.x AND w.y = t.y) AS refs FROM (SELECT x, y FROM nd UNION SELECT x, y FROM w) t""",
)
def _(spark, sf):
    o, path = fx.osm(spark, sf), folder(spark, "osm")
    at = osm.nodes_in_tiles(o["nodes"], osm_tiles(spark))
    osm.write_osm_xml(osm.osm_nodes(o["nodes"], osm_tiles(spark), o["users"]), osm.osm_ways(at, o["ways"], o["way_nodes"], o["users"]), path, compression="gzip")
    lines = spark.read.text(path)
    is_node, is_way = F.col("value").startswith("<node "), F.col("value").startswith("<way ")
    frame = F.col("value").isin('<osm version="0.6">', "</osm>")
    return lines.groupBy("x", "y").agg(F.count_if(frame).alias("frame"), F.count_if(is_node).alias("nodes"), F.count_if(is_way).alias("ways"), F.sum(F.when(is_way, F.regexp_count("value", F.lit("<nd "))).otherwise(0)).alias("refs"))


@query("status_feed", f"SELECT pid, rn::INT AS rn, ts, message FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts DESC, message DESC) AS rn FROM ({fx.STATUS})) WHERE rn <= 21")
def _(spark, sf):
    # four batches of a stream: what a process sent before comes from the state
    path = folder(spark, "feed")
    s = fx.status(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    s.repartition(4).write.parquet(f"{path}/messages")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/messages")
    save = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/feed/batch={n}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feed = streams.status_feed(stream).writeStream.foreachBatch(save).outputMode("update")
        feed.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    last = spark.read.parquet(f"{path}/feed").groupBy("pid", "rn").agg(F.max_by(F.struct("ts", "message"), "batch").alias("m"))
    return last.select("pid", "rn", F.col("m.ts").cast("timestamp_ntz").alias("ts"), "m.message")


@query(
    "area_table",
    f"""WITH p AS (SELECT id, segment, {X12} AS x, {Y12} AS y FROM ({fx.POINTS})), b AS (SELECT DISTINCT x, y FROM p WHERE segment = 'BUILDING')
SELECT id, 'old' AS state FROM p WHERE (x, y) NOT IN (SELECT (x, y) FROM b) UNION ALL SELECT id, 'new' AS state FROM p WHERE segment != 'MACHINERY' AND (x, y) IN (SELECT (x, y) FROM b)""",
)
def _(spark, sf):
    # a stream of changed boxes replaces their rows; played once more, its batches change nothing
    p = fx.points(spark, sf).select("id", "segment", "lon", "lat")
    z = F.lit(12)
    path = folder(spark, "areas")
    rows = written(p.select("id", "lon", "lat", F.lit("old").alias("state")), "rows")
    table = areas.AreaTable(spark, f"{path}/table", rows.schema, 12, 2).create(rows)
    changes = p.where("segment = 'BUILDING'").select(grid.tile_x("lon", z).alias("x"), grid.tile_y("lat", z).alias("y"))
    changes.write.parquet(f"{path}/changes")
    fresh = p.where("segment != 'MACHINERY'").select("id", "lon", "lat", F.lit("new").alias("state"))
    for attempt in ("first", "again"):
        stream = spark.readStream.schema(changes.schema).parquet(f"{path}/changes")
        areas.refresh_areas(stream, table, lambda _, n: fresh if n == 0 else None, f"{path}/{attempt}").awaitTermination()
    return table.current().select("id", "state")
