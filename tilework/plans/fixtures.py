"""Inputs of the registered queries, derived from the shared tables by exact integer arithmetic: the same rows in Spark
and, as SQL text, in an oracle. The shared tables have no locations, so keys stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilework.functions import geom as g
from tilework.operators.tables import written

PLACE = "({0} * 7919 % 36000) / 100.0 - 180 AS lon, ({0} * 104729 % 17000) / 100.0 - 85 AS lat"
POINTS = f"SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, {PLACE.format('c_custkey')} FROM customer"
#: Tile column and row of lon and lat in SQL.
TX = "floor((lon + 180) / 360 * 2.0 ** z)::INT"
TY = "floor((1 - ln(tan(pi() / 4 + radians(lat) / 2)) / pi()) / 2 * 2.0 ** z)::INT"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_place(rows: DataFrame) -> DataFrame:
    """Adds place, the number of each row in the order that the DataFrame is in: its number within its partition, after the partitions before."""
    # written, since a sort that ran again would draw other ranges, and other rows would be in a partition than were counted
    rows = written(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_n")), "placed")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_m"), F.min("_n").alias("_first"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return rows.join(F.broadcast(sizes.select("_part", "_first", before.alias("_b"))), "_part").withColumn("place", F.col("_b") + F.col("_n") - F.col("_first")).drop("_part", "_n", "_first", "_b")


def place(key: str) -> list:
    k = F.col(key)
    return [((k * 7919 % 36000).cast("double") / 100.0 - 180.0).alias("lon"), ((k * 104729 % 17000).cast("double") / 100.0 - 85.0).alias("lat")]


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as points: id, name, segment, balance, lon, lat."""
    names = [F.col(a).alias(b) for a, b in (("c_custkey", "id"), ("c_name", "name"), ("c_mktsegment", "segment"), ("c_acctbal", "balance"))]
    return table(spark, sf, "customer").select(*names, *place("c_custkey"))


def point_features(spark: SparkSession, sf: str) -> DataFrame:
    """points with geom and props."""
    p = points(spark, sf)
    return p.select("id", g.point("lon", "lat").alias("geom"), F.to_json(F.struct("name", "segment")).alias("props"), "lon", "lat")


LINES = f"""
SELECT c_custkey AS id, list_prepend({{'lon': (c_custkey * 7919 % 36000) / 100.0 - 180, 'lat': (c_custkey * 104729 % 17000) / 100.0 - 85}}, pts) AS pts FROM customer JOIN (
  SELECT o_custkey, list({{'lon': lon, 'lat': lat}} ORDER BY o_orderkey) AS pts FROM (SELECT o_custkey, o_orderkey, {PLACE.format('o_orderkey')} FROM orders) GROUP BY o_custkey)
ON o_custkey = c_custkey"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's point and those of all their orders, as lines: id, geom."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", *place("o_orderkey"))
    pts = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "lon", "lat"))).alias("p"))
    c = points(spark, sf).select("id", "lon", "lat").join(pts, F.col("id") == F.col("o_custkey"))
    tail = F.transform("p", lambda v: F.struct(v["lon"].alias("x"), v["lat"].alias("y")))
    return c.select("id", g.line(F.concat(F.array(g.xy("lon", "lat")), tail)).alias("geom"))


BOXES = f"""
SELECT s_suppkey AS id, lon - 1 - s_nationkey AS xmin, greatest(-85.0, lat - 1 - s_nationkey) AS ymin, lon + 1 + s_nationkey AS xmax, least(85.0, lat + 1 + s_nationkey) AS ymax
FROM (SELECT *, {PLACE.format('s_suppkey')} FROM supplier)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as boxes around their points: id, xmin, ymin, xmax, ymax, geom."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("h"), *place("s_suppkey"))
    s = s.select(
        "id", (F.col("lon") - 1 - F.col("h")).alias("xmin"), F.greatest(F.lit(-85.0), F.col("lat") - 1 - F.col("h")).alias("ymin"),
        (F.col("lon") + 1 + F.col("h")).alias("xmax"), F.least(F.lit(85.0), F.col("lat") + 1 + F.col("h")).alias("ymax"),
    )
    return s.withColumn("geom", g.box("xmin", "ymin", "xmax", "ymax"))


TILE_STORE = f"""
SELECT segment AS layer, z, x, y, 'JSON' AS format, (100 + (x * 31 + y * 17) % 900)::BIGINT AS size, TIMESTAMP '1995-01-01' + to_seconds((x * 7 + y * 13 + z * 1000) % 86400 * 30) AS mtime
FROM (SELECT DISTINCT segment, z, {TX} AS x, {TY} AS y FROM ({POINTS}), (SELECT unnest(range(0, 7))::INT AS z))"""


def tile_store(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of zooms 0-6 of each segment's points, as a store: layer, z, x, y, format, size, mtime."""
    from tilework.functions import grid

    p = points(spark, sf).select("segment", "lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("z"))
    t = p.select(F.col("segment").alias("layer"), "z", grid.tile_x("lon", "z").alias("x"), grid.tile_y("lat", "z").alias("y")).distinct()
    size = (100 + (F.col("x") * 31 + F.col("y") * 17) % 900).cast("long")
    at = F.timestamp_micros(F.lit(788918400000000) + ((F.col("x") * 7 + F.col("y") * 13 + F.col("z") * 1000) % 86400 * 30).cast("long") * 1000000)
    return t.select("*", F.lit("JSON").alias("format"), size.alias("size"), at.cast("timestamp_ntz").alias("mtime"))


REQUESTS = f"""
SELECT event_id, ts, event_type AS layer, z, x, y, CASE WHEN event_id % 50 = 0 THEN '/' || event_type || '/' || z || '/bad' ELSE '/' || event_type || '/' || z || '/' || x || '/' || y || '.json' END AS path
FROM (SELECT *, {TX} AS x, {TY} AS y FROM (SELECT *, (user_id % 7)::INT AS z, {PLACE.format('event_id')} FROM events))"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as request paths: event_id, ts, layer, z, x, y, path; every 50th path is malformed."""
    from tilework.functions import grid

    e = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("layer"), (F.col("user_id") % 7).cast("int").alias("z"), *place("event_id"))
    e = e.select("event_id", "ts", "layer", "z", grid.tile_x("lon", "z").alias("x"), grid.tile_y("lat", "z").alias("y"))
    bad = F.format_string("/%s/%d/bad", "layer", "z")
    return e.withColumn("path", F.when(F.col("event_id") % 50 == 0, bad).otherwise(F.format_string("/%s/%d/%d/%d.json", "layer", "z", "x", "y")))


STATUS = "SELECT user_id AS pid, ts, event_type || ' ' || event_id AS message FROM events"


def status(spark: SparkSession, sf: str) -> DataFrame:
    """Events as status messages of processes: pid, ts, message."""
    return table(spark, sf, "events").select(F.col("user_id").alias("pid"), "ts", F.format_string("%s %d", "event_type", "event_id").alias("message"))


PIXELS = """
SELECT p_partkey // 256 AS x, p_partkey % 16 AS px, p_partkey // 16 % 16 AS py, p_partkey * 37 % 256 AS r, p_partkey * 101 % 256 AS g, p_partkey * 11 % 256 AS b, p_partkey * 53 % 256 AS a FROM part"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as 16 x 16 rasters: z (10), x, y (0), px, py, r, g, b, a."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.lit(10).alias("z"), F.floor(k / 256).cast("int").alias("x"), F.lit(0).alias("y"), (k % 16).cast("int").alias("px"), (F.floor(k / 16) % 16).cast("int").alias("py"),
        *[(k * m % 256).cast("int").alias(c) for c, m in (("r", 37), ("g", 101), ("b", 11), ("a", 53))],
    )


OSM = {
    "osm_nodes": f"SELECT c_custkey AS id, c_nationkey::BIGINT AS user_id, {PLACE.format('c_custkey')} FROM customer",
    "osm_ways": "SELECT o_orderkey AS id, o_custkey % 25 AS user_id FROM orders",
    "osm_way_nodes": "SELECT l_orderkey AS way_id, l_partkey % (SELECT count(*) FROM customer) + 1 AS node_id, l_linenumber AS sequence_id FROM lineitem",
    "osm_users": "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation",
    "osm_relations": "SELECT p_partkey AS id FROM part",
    "osm_members": """
SELECT l_partkey AS relation_id, CASE l_linenumber % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'W' ELSE 'R' END AS member_type,
  CASE l_linenumber % 3 WHEN 0 THEN l_suppkey WHEN 1 THEN l_orderkey ELSE l_partkey // 2 + 1 END AS member_id, l_orderkey * 10 + l_linenumber AS sequence_id
FROM lineitem""",
}


def osm(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Shared tables in the shape of the OpenStreetMap tables, by name."""
    c, o, li, p = (table(spark, sf, t) for t in ("customer", "orders", "lineitem", "part"))
    n = c.count()
    tags = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p_{k}").alias("v")) for k in ("brand", "type")])).alias("t")
    kind = F.col("l_linenumber") % 3
    blank = [F.lit(1).alias("version"), F.timestamp_micros(F.lit(788918400000000)).alias("tstamp"), F.lit(1).cast("long").alias("changeset_id")]
    return {
        "nodes": c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("user_id"), *place("c_custkey"), *blank),
        "ways": o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("user_id"), *blank),
        "way_nodes": li.select(F.col("l_orderkey").alias("way_id"), (F.col("l_partkey") % n + 1).alias("node_id"), F.col("l_linenumber").alias("sequence_id")),
        "users": table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
        "relation_tags": p.select(F.col("p_partkey").alias("id"), tags).select("id", "t.k", "t.v").where("v IS NOT NULL"),
        "relations": p.select(F.col("p_partkey").alias("id"), F.lit(1).cast("long").alias("user_id"), *blank),
        "members": li.select(
            F.col("l_partkey").alias("relation_id"), F.when(kind == 0, "N").when(kind == 1, "W").otherwise("R").alias("member_type"),
            F.when(kind == 0, F.col("l_suppkey")).when(kind == 1, F.col("l_orderkey")).otherwise(F.floor(F.col("l_partkey") / 2) + 1).cast("long").alias("member_id"),
            F.lit("part").alias("member_role"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence_id"),
        ),
    }
