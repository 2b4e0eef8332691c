"""Files, archives, JDBC and XML, by round trip."""

import json
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tilework.functions import geom, udf
from tilework.operators import osm, store, tiling
from tilework.plans import fixtures as fx
from tilework.sources import geojson, jdbc, tiles


def store_with_bodies(spark, sf):
    return fx.tile_store(spark, sf).where("z < 3").withColumn("body", F.format_string("%s %d/%d/%d", "layer", "z", "x", "y").cast("binary"))


def rows(df, *cols):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("layout", ["safe", "portable", "quadtile"])
def test_tile_tree(spark, sf, tmp_path, layout):
    t = store_with_bodies(spark, sf).withColumn("format", F.when(F.col("x") % 2 == 0, "json").otherwise("png"))
    tiles.write_tile_tree(t, str(tmp_path), layout)
    cols = ("layer", "z", "x", "y", "format", "body")
    assert rows(tiles.read_tile_tree(spark, str(tmp_path), layout), *cols) == rows(t, *cols)


def test_archives(spark, sf, tmp_path):
    t = store_with_bodies(spark, sf).where("layer = 'BUILDING'")
    meta = {"name": "n", "type": "baselayer", "version": "1", "description": "d", "format": "json"}
    tiles.write_mbtiles(t.repartition(2), str(tmp_path / "a"), meta)
    files = sorted(str(p) for p in (tmp_path / "a").iterdir())
    assert files and all(tiles.tileset_exists(f) for f in files) and tiles.tileset_info(files[0])["format"] == "json"
    for given in (",".join(files), str(tmp_path / "a")):
        assert rows(tiles.read_mbtiles(spark, given, 3), "z", "x", "y", "body") == rows(t, "z", "x", "y", "body")
    (tmp_path / "none").mkdir()
    assert tiles.read_mbtiles(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        tiles.write_mbtiles(t, str(tmp_path / "b"), {"name": "n"})
    tiles.write_tileset(t.select("z", "x", "y", "body"), str(tmp_path / "set"), meta)
    tiles.write_tileset(t.where("z = 1").select("z", "x", "y", F.lit(b"new").alias("body")), str(tmp_path / "set"), meta)
    back = tiles.read_tileset(spark, str(tmp_path / "set"))
    assert back.count() == t.count() and back.where("z = 1 AND body != cast('new' AS BINARY)").count() == 0


def test_tile_list(spark, sf, tmp_path):
    t = fx.tile_store(spark, sf).select("z", "x", "y").distinct()
    tiles.write_tile_list(t, str(tmp_path / "list"))
    assert rows(tiles.read_tile_list(spark, str(tmp_path / "list")), "z", "x", "y") == rows(t, "z", "x", "y")


def test_geojson(spark, tmp_path):
    kinds = {
        "Point": [1.5, 2.5], "MultiPoint": [[1, 2], [3, 4]], "LineString": [[1, 2], [3, 4]], "MultiLineString": [[[1, 2], [3, 4]]],
        "Polygon": [[[0, 0], [1, 0], [1, 1], [0, 0]]], "MultiPolygon": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]],
    }
    feats = [{"type": "Feature", "id": i, "properties": {"k": k}, "geometry": {"type": k, "coordinates": c}} for i, (k, c) in enumerate(kinds.items())]
    feats.append({"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": []}})
    feats.append({"type": "Other"})
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats}, indent=1))
    got = geojson.read_geojson(spark, str(tmp_path / "f.json"))
    out = {r["k"]: json.loads(r["j"]) for r in got.select(F.col("geom.kind").alias("k"), geom.geometry_json("geom").alias("j")).collect()}
    assert out == {k: {"type": k, "coordinates": c} for k, c in kinds.items()}
    assert got.where(~geom.is_usable("geom")).count() == 0


def test_jdbc(spark, sf, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    p = fx.points(spark, sf).select("id", "lon", "lat")
    p.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "pts").mode("overwrite").save()
    got = jdbc.read_features_jdbc(spark, url, table="pts", driver=driver)
    assert got.count() == p.count()
    box = got.where("lon BETWEEN 0 AND 50")
    assert "PushedFilters" in box._jdf.queryExecution().executedPlan().toString() and box.count() == p.where("lon BETWEEN 0 AND 50").count()
    assert jdbc.read_features_jdbc(spark, url, query='SELECT "id", "lon" FROM pts WHERE "lat" > 0', driver=driver).count() == p.where("lat > 0").count()
    with pytest.raises(ValueError):
        jdbc.read_features_jdbc(spark, url)


def test_osm_xml(spark, sf, tmp_path):
    o = fx.osm(spark, sf)
    tags = spark.createDataFrame([(1, "b", "2"), (1, "a", '1 <&" é')], "id long, k string, v string")
    tile = spark.createDataFrame([(0, 0, 0)], "z int, x int, y int")
    nodes = osm.osm_nodes(o["nodes"], tile, o["users"], tags)
    ways = osm.osm_ways(osm.nodes_in_tiles(o["nodes"], tile), o["ways"], o["way_nodes"], o["users"])
    osm.write_osm_xml(nodes, ways, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("z=0/x=0/y=0/part-*")
    root = ElementTree.parse(file).getroot()
    assert root.tag == "osm" and root.attrib == {"version": "0.6"}
    kinds = [e.tag for e in root]
    assert kinds == ["node"] * nodes.count() + ["way"] * ways.count() and ways.count() > 0
    assert [int(e.get("id")) for e in root.iter("node")] == sorted(r["id"] for r in nodes.collect())
    want = {r["id"]: r["nodes"] for r in ways.collect()}
    assert {int(w.get("id")): [int(n.get("ref")) for n in w] for w in root.iter("way")} == want
    first = root.find("node[@id='1']")
    assert [(t.get("k"), t.get("v")) for t in first] == [("a", '1 <&" é'), ("b", "2")] and first.get("timestamp") == "1995-01-01T00:00:00Z"


def test_osm_document_per_tile(spark, sf, tmp_path):
    o = fx.osm(spark, sf)
    tiles = spark.createDataFrame([(1, x, y) for x in (0, 1) for y in (0, 1)], "z int, x int, y int")
    nodes = osm.osm_nodes(o["nodes"], tiles, o["users"])
    ways = osm.osm_ways(osm.nodes_in_tiles(o["nodes"], tiles), o["ways"], o["way_nodes"], o["users"])
    osm.write_osm_xml(nodes, ways, str(tmp_path / "out"))
    files = {tuple(int(v.split("=")[1]) for v in f.parts[-4:-1]): f for f in (tmp_path / "out").glob("z=*/x=*/y=*/part-*")}
    sizes = {(r["z"], r["x"], r["y"]): r["n"] for r in nodes.groupBy("z", "x", "y").agg(F.count("*").alias("n")).collect()}
    assert {k: len(ElementTree.parse(f).getroot().findall("node")) for k, f in files.items()} == sizes and len(files) == 4


def test_eviction_of_uses_of_one_moment(spark):
    rows = [(f"p{i:04}", i % 7 * (i > 300), 10 + i % 5) for i in range(600)]
    usage = spark.createDataFrame(rows, "path string, s int, size long").select("path", F.when(F.col("path") != "p0599", F.timestamp_seconds("s")).alias("used"), "size")
    for limit in (0, 1, 3000, 5000, 10**6):
        left, want = sum(r[2] for r in rows) - limit, set()
        for path, _, size in sorted(rows, key=lambda r: (r[0] != "p0599", r[1], r[0])):
            if left > 0:
                want.add(path)
            left -= size
        for bucket_rows in (5, 100_000):
            got = store.evict_lru(usage, limit, 4, bucket_rows)
            assert {r["path"] for r in got.collect()} == want and got.columns == ["path", "used", "size"]
    assert store.evict_lru(usage.where("false"), 5).count() == 0


def test_sql_functions_and_user_code(spark, sf):
    udf.register_sql(spark)
    r = spark.sql("SELECT tw_tile_x(-122.42D, 10) AS x, tw_tile_y(37.78D, 10) AS y, tw_flip_y(3, 1) AS f, (SELECT count(*) FROM cover_tiles(-10D, -10D, 10D, 10D, 3)) AS n").first()
    assert (r["x"], r["y"], r["f"], r["n"]) == (163, 395, 6, 4)
    t = fx.tile_store(spark, sf).select("z", "x", "y").distinct()
    made = udf.render_tiles(t, lambda batches: (b.assign(body="t") for b in batches), "z int, x int, y int, body string")
    assert made.where("body = 't'").count() == t.count()
    n = udf.tile_aggregate(t.withColumn("v", F.lit(1)), lambda pdf: pdf.groupby(["z", "x", "y"], as_index=False)["v"].sum(), "z int, x int, y int, v long")
    assert n.count() == t.count()


def test_refusals(spark, sf):
    p = fx.points(spark, sf)
    with pytest.raises(ValueError):
        store.replace_area(p, p, p, 11)
    for bad in ((91, 0, 0, 0), (0, 181, 0, 0)):
        with pytest.raises(ValueError):
            tiling.tile_plan(spark, bad, [1])
    with pytest.raises(ValueError):
        tiling.tile_plan(spark, (0, 0, 1, 1), [1], -1)
    assert os.path.isdir(sf)
