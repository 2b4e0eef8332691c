"""What shows only on more rows, or on values that the smallest tables don't have."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tilework.functions import geom as g
from tilework.functions import clip as clips
from tilework.functions import shapes, utm
from tilework.operators import encode, osm, store, tables, tiling, utfgrid
from tilework.plans import features
from tilework.plans import fixtures as fx
from tilework.plans import stores
from tilework.streaming import streams


def test_points_on_edges(spark):
    # a column's and a row's edge, and latitudes whose tile's corner is a rounding off
    rows = [(i, float(lon), float(lat)) for i, (lon, lat) in enumerate([(45, -60), (157.5, -52.5), (22.5, -27.5), (0, 0), (-180, 10), (90, 40)])]
    p = spark.createDataFrame(rows, "id long, lon double, lat double")
    one, two = g.point("lon", "lat"), F.struct(F.lit("MultiPoint").alias("kind"), F.array(F.array(F.array(g.xy("lon", "lat")))).alias("parts"))
    for geom in (one, two):
        a = tiling.assign_tiles(p.withColumn("geom", geom), [4, 7], edges="half_open")
        assert a.groupBy("z").agg(F.count_distinct("id").alias("ids"), F.count("*").alias("n")).orderBy("z").collect() == [(4, 6, 6), (7, 6, 6)]
    closed = tiling.assign_tiles(p.where("id = 0").withColumn("geom", one), [4]).select("x").distinct()
    assert sorted(r["x"] for r in closed.collect()) == [9, 10]


def test_line_along_an_edge(spark):
    up = g.line(F.array(g.xy(F.lit(45.0), F.lit(1.0)), g.xy(F.lit(45.0), F.lit(2.0))))
    a = tiling.assign_tiles(spark.range(1).withColumn("geom", up), [4], edges="half_open")
    assert [r["x"] for r in a.collect()] == [10]


def test_within_radius_on_an_edge(spark):
    p = spark.createDataFrame([(1, 45.0, 1.0)], "id long, lon double, lat double")
    t = spark.createDataFrame([(4, x, 7) for x in (9, 10)], "z int, x int, y int")
    assert [r["x"] for r in tiling.within_radius(t, p, 5000).collect()] == [10]


def test_age_of_messages(spark):
    # 600.5 seconds passed, over 601 on the clock
    s = spark.createDataFrame([(1, "2024-01-01 00:00:00.9", "a"), (2, "2024-01-01 00:00:00.3", "b")], "pid long, ts string, message string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = store.latest_per_process(s, F.lit("2024-01-01 00:10:01.4"))
    assert {r["pid"]: r["hidden"] for r in out.collect()} == {1: False, 2: True}


def test_age_of_messages_to_the_microsecond(spark, tmp_path):
    # in the query's SQL the fraction of a second counts: 600.5 seconds are more than 600
    rows = [(0, "2024-01-01 00:10:01.4"), (1, "2024-01-01 00:00:00.9"), (2, "2024-01-01 00:00:01.399999"), (3, "2024-01-01 00:00:01.4"), (4, "2023-12-31 18:10:01.0"), (5, "2023-12-31 18:10:00.9")]
    e = spark.createDataFrame([(i, ts, "view", i) for i, ts in rows], "user_id long, ts string, event_type string, event_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    out = stores.QUERIES["latest_per_process"](spark, str(tmp_path))
    assert {r["pid"]: r["hidden"] for r in out.collect()} == {0: False, 1: True, 2: True, 3: False, 4: True}


def test_place_of_many_rows(spark):
    # a sort of many small partitions, read with all columns and for the sizes with its own only
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 300_000, numPartitions=8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"))
        placed = fx.with_place(encode.sort_features(rows, "name descending")).select("place", "id", "name", F.lag("name").over(fx.Window.orderBy("place")).alias("before"))
        assert placed.agg(F.count_distinct("place"), F.min("place"), F.max("place"), F.count_if(F.col("name") > F.col("before")), F.count_distinct("id")).first() == (300_000, 0, 299_999, 0, 300_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_views_and_polygons_are_dealt_out(spark):
    # one partition in, as a small file is; the work on its rows isn't one task's
    views = spark.range(0, 100, numPartitions=1).withColumn("c", F.col("id") * 10000.0)
    t = tiling.view_tiles(views, "id", F.col("c"), F.col("c"), F.col("c") + 1e5, F.col("c") + 1e5, F.lit(0.001))
    one = views.select("id", F.explode(utm.tiles_for_view(F.col("c"), F.col("c"), F.col("c") + 1e5, F.col("c") + 1e5, F.lit(0.001))).alias("t")).select("id", "t.*")
    assert t.exceptAll(one).isEmpty() and one.exceptAll(t).isEmpty()
    boxes = spark.range(0, 100, numPartitions=1).withColumn("geom", g.box(F.col("id") * 0.1, F.lit(1.0), F.col("id") * 0.1 + 5, F.lit(6.0)))
    cells = utfgrid.polygon_cells(tiling.assign_tiles(boxes, [3], exact=False), 16)
    for rows in (t, cells):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_relation_that_names_a_member_many_times(spark):
    tile = spark.createDataFrame([(1, 0, 0, 5)], "z int, x int, y int, id long")
    members = spark.createDataFrame([(r, m, t, "", n) for n in range(50) for r, m, t in ((1, 5, "N"), (2, 1, "R"), (1, 1, "R"))], "relation_id long, member_id long, member_type string, member_role string, sequence_id long")
    found = osm.relations_of(tile, tile.where("id < 0"), members)
    assert sorted(found.select("id", "level").collect()) == [(1, 0), (2, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[id#\d+L, relation_id#\d+L\]", plan)  # pairs are made distinct below the joins


def test_nested_extract_in_pieces(spark):
    # batches smaller than a tile: the sums go on over them
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(200).select(F.lit(1).alias("z"), (F.col("id") % 2).cast("int").alias("x"), F.lit(0).alias("y"), (F.col("id") % 3).cast("int").alias("kind"), "id", F.concat(F.lit("N"), F.col("id")).alias("refs"))
        tiles = spark.createDataFrame([(1, x, 0) for x in (0, 1)] + [(1, 0, 1)], "z int, x int, y int")
        got = {(r["x"], r["y"]): r for r in osm.extract_sums(tiles, rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = lambda x, k: [i for i in range(200) if i % 2 == x and i % 3 == k]
    for x in (0, 1):
        assert got[x, 0]["nodes"] == ",".join(map(str, own(x, 0)))
        assert [got[x, 0][c] for c in ("ways", "relations")] == [hashlib.md5(";".join(f"{i}:N{i}" for i in own(x, k)).encode()).hexdigest() for k in (1, 2)]
    assert got[0, 1]["nodes"] is None and got[0, 1]["ways"] is None


def _shuffled(spark):
    """Bytes that this session's shuffles have written."""
    time.sleep(1)  # the last task's figures
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_nested_extract_ships_a_text_once_for_eight_tiles(spark, sf):
    before = _shuffled(spark)
    stores.QUERIES["osm_nested"](spark, sf).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before < 800_000  # 1,549,000 when a line was shuffled for each of its tiles


def test_packed_lines():
    # one pack a column of eight tiles and run of ids; a line comes out for each of its tiles once
    ids, tiles = np.arange(5000, 5006), np.array([1, 1 << 63, 3 << 8, 257, 1 << 9, 129], np.uint64).view(np.int64)
    lines = ["", ";5001:é", ";5002:a", ";5003:b", ";5004:c", ";5005:"]
    b = pa.RecordBatch.from_arrays([pa.array([v] * 6, pa.int32()) for v in (3, 0, 0, 1)] + [pa.array([0, 0, 0, 0, 1, 1]), pa.array(ids), pa.array(tiles), pa.array(lines)], ["z", "bx", "by", "kind", "chunk", "id", "tiles", "line"])
    packs = [(r["column"], r["id"], *(v.tolist() if isinstance(v, np.ndarray) else v.to_pylist() for v in osm._unpacked(r["lines"]))) for out in osm._packed([b, b.slice(0, 0)]) for r in out.to_pylist()]
    assert packs == [(0, 5000, [1, 1], ["", ";5003:b"]), (1, 5000, [3, 1], [";5002:a", ";5003:b"]), (7, 5000, [128], [";5001:é"]), (0, 5004, [129], [";5005:"]), (1, 5004, [2], [";5004:c"])]


def test_sets_of_tiles(spark):
    # blocks of 64 tiles, the last bit included; sums over sets and over their rows are the same
    rows = spark.range(3000).select(F.lit(5).alias("z"), (F.col("id") % 17).cast("int").alias("x"), (F.col("id") % 23).cast("int").alias("y"), (F.col("id") % 40).alias("id"))
    sets = osm.tile_sets(rows.union(rows))
    assert sorted(map(tuple, osm.tiles_of(sets).select("z", "x", "y", "id").collect())) == sorted(set(map(tuple, rows.collect())))
    assert sets.count() == sets.select(*osm.BLOCK, "id").distinct().count() and not sets.where("tiles < 0").isEmpty()
    lines = sets.select("*", (F.col("id") % 3).cast("int").alias("kind"), F.concat(F.lit("N"), F.col("id")).alias("refs"))
    sums = [sorted(map(tuple, osm.extract_sums(rows, df).select("z", "x", "y", "nodes", "ways", "relations").collect())) for df in (lines, osm.tiles_of(lines))]
    assert sums[0] == sums[1] and len(sums[0]) == 391
    own = {}
    for z, x, y, i in sorted(set(map(tuple, rows.collect()))):
        own.setdefault((z, x, y), ([], [], []))[i % 3].append(i)
    md5 = lambda ids: hashlib.md5(";".join(f"{i}:N{i}" for i in ids).encode()).hexdigest() if ids else None
    assert sums[0] == sorted((*k, ",".join(map(str, a)) or None, md5(b), md5(c)) for k, (a, b, c) in own.items())


def test_relations_with_user_tags_and_members(spark, sf):
    # the query returns what J06 finds of a relation, not only its id
    found = stores.QUERIES["osm_relations"](spark, sf).select("id", "user", "tags", "members").distinct().collect()
    assert len(found) == len({r["id"] for r in found}) > 150
    parts = {r["p_partkey"]: r for r in fx.table(spark, sf, "part").collect()}
    members = {}
    for r in sorted(fx.table(spark, sf, "lineitem").collect(), key=lambda r: (r["l_orderkey"], r["l_linenumber"])):
        k, i = r["l_partkey"], r["l_linenumber"] % 3
        members.setdefault(k, []).append(f"{'NWR'[i]}{(r['l_suppkey'], r['l_orderkey'], k // 2 + 1)[i]}")
    for r in found:
        p = parts[r["id"]]
        assert tuple(r)[1:] == ("NATION_1", f"brand={p['p_brand']},type={p['p_type']}", hashlib.md5(",".join(members[r["id"]]).encode()).hexdigest())


def test_thinning_with_few_winners(spark, sf, monkeypatch):
    # the rest of a hot tile is held against its first features' winners, not decided by rounds over cells
    lines = clips.clipped(tiling.assign_tiles(fx.lines(spark, sf), [1]), "geom", tiling.lonlat_envelope())
    thin = lambda n: sorted(map(tuple, tiling.thin_by_spacing(lines, 40, geom="geom", task_rows=n).select("z", "x", "y", "id").collect()))
    whole = thin(10**6)
    monkeypatch.setattr(tiling, "_first_round", None)
    assert thin(70) == whole


def test_clear_of():
    rng = np.random.default_rng(5)
    for kinds in (["LineString"], ["Point", "LineString", "Polygon"]):
        def shape():
            p = rng.uniform(0, 100, 2) + rng.uniform(-8, 8, (4, 2))
            return {"Point": ("Point", p[:1, 0], p[:1, 1], [1]), "LineString": ("LineString", p[:, 0], p[:, 1], [4]), "Polygon": ("Polygon", p[[0, 1, 2, 0], 0], p[[0, 1, 2, 0], 1], [4])}[kinds[rng.integers(len(kinds))]]

        own, kept = [shape() for _ in range(150)], [shape() for _ in range(12)]
        near = [any(shapes.within(a[0], shapes.edges(*a), b[0], shapes.edges(*b), 3.0) for b in kept) for a in own]
        assert 0 < sum(near) < 150 and shapes.clear_of(own, kept, 3.0).tolist() == [not v for v in near]


def test_hot_tiles_stay_where_they_are(spark, sf, monkeypatch):
    # of a hot tile only the first features are shuffled as shapes; winners of many points are gone to by the rest in pieces, with the same result
    a = tiling.assign_tiles(fx.lines(spark, sf), [0])
    lines = tables.written(a.unionByName(a.withColumn("id", F.col("id") + 1000)).select(*tiling.KEY, "id", "geom"), "lines")
    thin = lambda n: sorted(map(tuple, tiling.thin_by_spacing(lines, 40, geom="geom", task_rows=n).select("z", "x", "y", "id").collect()))
    whole = thin(10**6)
    before = _shuffled(spark)
    assert thin(20) == whole
    assert _shuffled(spark) - before < 60_000
    monkeypatch.setattr(tiling, "WINNER_POINTS", 0)
    assert thin(20) == whole


def test_clear_rows():
    rng = np.random.default_rng(6)
    for kinds in (["LineString", "MultiLineString"], ["Point", "LineString", "Polygon"]):
        def shape():
            p = rng.uniform(0, 100, 2) + rng.uniform(-8, 8, (4, 2))
            kind = kinds[rng.integers(len(kinds))]
            n = {"Point": [1], "LineString": [4], "MultiLineString": [2, 2], "Polygon": [4]}[kind]
            p = p[[0, 1, 2, 0]] if kind == "Polygon" else p[: sum(n)]
            return kind, p[:, 0].tolist(), p[:, 1].tolist(), n

        own, group = [shape() for _ in range(300)], rng.integers(0, 4, 300)
        kept = {0: [shape() for _ in range(9)], 1: [shape()], 2: [shape() for _ in range(20)]}  # none for the last group
        columns = [pa.array(c) for c in zip(*[("x", [], [], [])] * 2, *own, strict=True)]
        got = shapes.clear_rows([c.slice(2) for c in columns], group, kept, 3.0)
        want = [not any(shapes.within(s[0], shapes.edges(*s), k[0], shapes.edges(*k), 3.0) for k in kept.get(int(g), [])) for s, g in zip(own, group, strict=True)]
        assert got.tolist() == want and 0 < sum(want) < 300


def test_validity_by_signs_as_in_sql():
    # points in keys' progressions, nearly on one line, where rounding decides: segments whose boxes are apart, and the corner before the first point
    apart = [(-65.76, 76.84), (116.08999999999997, -9.810000000000002), (6.97999999999999, 42.18000000000001), (-29.389999999999986, 59.50999999999999)]
    corner = [(-8.050000000000011, 57.44999999999999), (-104.53, 25.769999999999996), (-152.77, 9.930000000000007), (40.19, 73.28999999999999)]
    for points, valid in ((apart, False), (corner, True)):
        side = lambda i, j, k, p=points: np.sign(shapes.turn(*p[i], *p[j], *p[k]))
        cut = lambda a, b, c, d: side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0
        assert (not cut(0, 1, 2, 3) and not cut(1, 2, 3, 0)) == valid
        assert shapes.simple_polygon([np.array(points + points[:1])]) == valid
    far = [(0, 0), (4, 0), (4, 4), (8, 4), (8, 0), (12, 0), (12, 9), (0, 9), (0, 0)]  # two sides on one line, apart
    assert shapes.simple_polygon([np.array(far, float)])


def test_topology_in_lines(spark, sf):
    # a tile's lines one after the other are its body; its features lie in many ranges
    lines = tiling.assign_tiles(fx.lines(spark, sf).where("id % 4 = 0"), [1, 2]).withColumn("props", F.lit("{}"))
    points = tiling.assign_tiles(fx.point_features(spark, sf), [2, 5], edges="half_open")
    boxes = tiling.assign_tiles(fx.boxes(spark, sf).select("id", "geom"), [1], exact=False).withColumn("props", F.lit('{"a":1}')).withColumn("clipped", F.col("id") % 2 == 0)

    def joined(layers):
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "layer", "place", "line"))), lambda v: v["line"]), "")
        return {tuple(r[:3]): r for r in encode.topojson_lines(layers).groupBy("z", "x", "y").agg(text.alias("body"), F.max("n_layers").alias("n_layers"), F.max("n").alias("n"), F.max("n_arcs").alias("n_arcs")).collect()}

    for own in (lines, points, boxes):
        want = {tuple(r[:3]): (r["n"], r["n_arcs"], r["body"]) for r in encode.topojson_tiles(own).collect()}
        assert {k: (r["n"], r["n_arcs"], r["body"]) for k, r in joined({"vectile": own}).items()} == want
    merged = None
    for name, own in (("b", lines), ("a", points), ("c", boxes)):
        t = encode.topojson_tiles(own).withColumn("layer", F.lit(name))
        merged = t if merged is None else merged.unionByName(t)
    want = {tuple(r[:3]): (r["n_layers"], r["n_arcs"], json.loads(r["body"])) for r in encode.merge_topojson(merged).collect()}
    assert {k: (r["n_layers"], r["n_arcs"], json.loads(r["body"])) for k, r in joined({"b": lines, "a": points, "c": boxes}).items()} == want
    rows = lines.select("z", "x", "y", "id", F.lit(1).alias("one"))
    numbered = tables.sums_within(tables.written(rows, "rows"), ["z", "x", "y"], ["id"], {"place": "one"})
    assert numbered.groupBy("z", "x", "y").agg(F.count_distinct("place").alias("n"), F.max("place").alias("m"), F.count("*").alias("c")).where("n != c OR m != c - 1").isEmpty()
    assert numbered.select("z", "x", "y").distinct().count() == 20


def test_topology_queries_hold_no_tile(spark, sf):
    # the queries' rows are a body's lines: none grows with its tile's features
    for name in ("topojson_tiles", "merge_topojson"):
        longest, rows, most = features.QUERIES[name](spark, sf).agg(F.max(F.length("line")), F.count("*"), F.max("n_arcs")).first()
        assert longest < 2000 and rows > most > 50


def test_geojson_lengths_without_bodies(spark, sf):
    lines = tiling.assign_tiles(fx.lines(spark, sf).where("id % 3 = 0"), [3]).withColumn("props", F.lit("{}"))
    whole = encode.geojson_tiles(clips.clipped(lines, "geom", tiling.lonlat_envelope()), precision_by_zoom=True)
    boxes = tiling.assign_tiles(fx.lines(spark, sf).where("id % 3 = 0"), [3], exact=False).withColumn("props", F.lit("{}"))
    sums = encode.geojson_lengths(encode.geojson_lines(clips.clipped(boxes, "geom", tiling.lonlat_envelope()), precision_by_zoom=True))
    assert sorted(map(tuple, sums.collect())) == sorted(tuple(r) for r in whole.select("z", "x", "y", "n", F.length("body")).collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    query = plan(features.QUERIES["geojson_line_tiles"](spark, sf))
    # no body as one value, no test of segments before the clipping
    assert query.count("collect_list") == plan(fx.lines(spark, sf)).count("collect_list") and "exists(" not in query and "exists(" in plan(lines)


def test_status_feed_calls_for_state():
    # one reading and one writing of state for the messages of several processes in a batch
    calls, state = [], [None]

    class Value:
        def get(self):
            calls.append("get")
            return state[0]

        def update(self, value):
            calls.append("update")
            state[0] = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    feed = streams._Last(2)
    feed.init(Handle())
    first = list(feed.handleInputRows((0,), iter([(0, pid, us, f"m{us}") for pid in range(16) for us in (1, 3, 2)]), None))
    assert [tuple(r) for r in first if r["pid"] == 5] == [(5, 1, 3, "m3"), (5, 2, 2, "m2")] and len(first) == 32
    second = list(feed.handleInputRows((0,), iter([(0, 5, 3, "a"), (0, 5, None, "b"), (0, 7, 9, "c"), (0, None, 1, "d")]), None))
    assert sorted(map(tuple, second), key=repr) == sorted([(5, 1, 3, "m3"), (5, 2, 3, "a"), (7, 1, 9, "c"), (7, 2, 3, "m3"), (None, 1, 1, "d")], key=repr)
    assert calls == ["get", "update"] * 2 and len(state[0][0]) == 33


def test_compressed_osm_documents(spark, sf, tmp_path):
    # the same whole document a tile, in a fraction of the bytes
    o = fx.osm(spark, sf)
    tiles = spark.createDataFrame([(1, x, y) for x in (0, 1) for y in (0, 1)], "z int, x int, y int")
    nodes = osm.osm_nodes(o["nodes"], tiles, o["users"])
    ways = osm.osm_ways(osm.nodes_in_tiles(o["nodes"], tiles), o["ways"], o["way_nodes"], o["users"])
    for name, compression in (("plain", None), ("gzip", "gzip")):
        osm.write_osm_xml(nodes, ways, str(tmp_path / name), compression=compression)
    files = {name: {f.parts[-4:-1]: f for f in (tmp_path / name).glob("z=*/x=*/y=*/part-*")} for name in ("plain", "gzip")}
    assert {k: f.read_bytes() for k, f in files["plain"].items()} == {k: gzip.decompress(f.read_bytes()) for k, f in files["gzip"].items()} and len(files["gzip"]) == 4
    size = {name: sum(f.stat().st_size for f in fs.values()) for name, fs in files.items()}
    assert size["gzip"] * 4 < size["plain"]
