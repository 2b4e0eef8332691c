"""Streams run to their end with availableNow and are compared with the batch answer."""

import pytest
from pyspark.sql import functions as F

from tilework.functions import grid
from tilework.operators import store
from tilework.plans import fixtures as fx
from tilework.streaming import areas, streams


def run(df, tmp_path, mode="append", name="out"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return df.sparkSession.table(name)


def stream_of(spark, df, tmp_path, name="in"):
    path = str(tmp_path / name)
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def timed(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_recent_tiles(spark, sf, tmp_path):
    r = timed(fx.requests(spark, sf)).where("z < 3").withColumn("format", F.lit("json")).select("ts", "layer", "z", "x", "y", "format")
    out = run(streams.recent_tiles(stream_of(spark, r, tmp_path)), tmp_path, name="recent")
    assert out.count() == r.select("layer", "z", "x", "y", "format").distinct().count()


def test_status_feed(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = timed(fx.status(spark, sf)).where("pid < 20")
    out = run(streams.status_feed(stream_of(spark, s, tmp_path), 5), tmp_path, "update", "feed")
    want = store.recent_messages(s, 5).select("pid", "rn", "message")
    assert sorted(map(tuple, out.select("pid", "rn", "message").collect())) == sorted(map(tuple, want.collect()))


def test_counts_and_spans(spark, sf, tmp_path):
    e = timed(fx.table(spark, sf, "events").select("ts", *fx.place("event_id")))
    out = run(streams.tile_counts_stream(stream_of(spark, e, tmp_path), 2), tmp_path, "complete", "counts")
    want = e.groupBy(F.window("ts", "1 hour").start.alias("start"), grid.tile_x("lon", F.lit(2)).alias("x"), grid.tile_y("lat", F.lit(2)).alias("y")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, out.select("start", "x", "y", "n").collect())) == sorted(map(tuple, want.collect()))
    s = timed(fx.status(spark, sf))
    spans = run(streams.idle_processes(stream_of(spark, s, tmp_path, "in2")), tmp_path, "append", "spans")
    assert 0 < spans.agg(F.sum("n")).first()[0] <= s.count()


def test_request_hits(spark, sf, tmp_path):
    r = timed(fx.requests(spark, sf)).select("ts", "path")
    layers = [x["layer"] for x in fx.requests(spark, sf).select("layer").distinct().orderBy("layer").collect()]
    catalog = store.layer_catalog(spark, '{"layers": {"%s": {"bounds": {"low": 1, "high": 4}}, "%s": {}}}' % tuple(layers[:2]))
    tiles = fx.requests(spark, sf).where("event_id % 3 = 0").select("layer", "z", "x", "y", F.lit("JSON").alias("format"))
    out = run(streams.request_hits(stream_of(spark, r, tmp_path), tiles, catalog), tmp_path, name="hits")
    want = streams.request_hits(r, tiles, catalog)
    count = lambda df: {tuple(x) for x in df.groupBy("outcome").count().collect()}
    assert count(out) == count(want) and {x["outcome"] for x in want.select("outcome").distinct().collect()} == {"bad path", "unknown layer", "out of bounds", "hit", "miss"}


def test_seeding_retries(spark, sf, tmp_path):
    t = fx.tile_store(spark, sf).where("z < 4").select("z", "x", "y").distinct()
    render = lambda df, attempt: df.withColumn("body", F.lit("b")).withColumn("error", F.when((F.col("x") + F.col("y")) % 5 >= attempt + 1, "no"))
    got = {}

    def save(made, failed, n):
        got[n] = (made.count(), failed.count(), {r["attempt"] for r in made.select("attempt").distinct().collect()})

    assert streams.seed_stream(stream_of(spark, t, tmp_path), render, save, str(tmp_path / "c")).awaitTermination(180)
    made, failed, attempts = got[0]
    assert made + failed == t.count() and failed == t.where("(x + y) % 5 = 4").count() and attempts == {1, 2, 3}


def test_areas_are_replaced_once(spark, sf, tmp_path):
    p = fx.points(spark, sf).select("id", "lon", "lat", F.lit("old").alias("state"))
    z = F.lit(12)
    tile = lambda df: df.select(grid.tile_x("lon", z).alias("x"), grid.tile_y("lat", z).alias("y"))
    table = areas.AreaTable(spark, str(tmp_path / "table"), p.schema).create(p)
    assert sorted(map(tuple, table.current().collect())) == sorted(map(tuple, p.collect()))
    changed, calls = [tile(p.where("id % 10 = 3")), tile(p.where("id % 10 = 4"))], []
    for k, c in enumerate(changed):
        c.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))

    def stage(tiles, n):
        calls.append(n)
        return p.where("id % 20 IN (3, 4)").withColumn("state", F.lit(f"new {n}"))  # every other one is gone

    stream = spark.readStream.schema(changed[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    assert areas.refresh_areas(stream, table, stage, str(tmp_path / "c")).awaitTermination(180)
    now = {r["id"]: r["state"] for r in table.current().collect()}
    ids = [r["id"] for r in p.select("id").collect()]
    assert set(now) == {i for i in ids if i % 20 not in (13, 14)}
    assert {s for i, s in now.items() if i % 20 in (3, 4)} == {"new 0", "new 1"} and {s for i, s in now.items() if i % 10 not in (3, 4)} == {"old"}
    # a replay of a batch, whatever it would stage, changes nothing; neither does what a failed attempt has left
    assert not table.replace(changed[0], p.where("false"), 1)
    table._placed(p.withColumn("state", F.lit("half"))).write.partitionBy("area").parquet(str(tmp_path / "table/rows/batch=7"))
    assert {r["id"]: r["state"] for r in table.current().collect()} == now and sorted(calls) == [0, 1]
    assert table.replace(changed[1], p.where("false"), 7)
    assert {r["id"] for r in table.current().collect()} == {i for i in now if i % 10 != 4}


def test_silence_is_reported_in_order_and_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    minutes = [[(1, 0, "a"), (1, 0, "b"), (2, 0, "x")], [(2, 9, "x")], [(2, 13, "x")], [(2, 30, "x")], [(2, 80, "x")], [(2, 500, "x")], [(2, 501, "x")], [(1, 505, "back"), (2, 506, "x")], [(2, 507, "y")]]
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    for k, rows in enumerate(minutes):
        df = spark.createDataFrame(rows, "pid long, m int, message string").select("pid", (start + F.expr("make_interval(0, 0, 0, 0, 0, m)")).alias("ts"), "message")
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    seen = []
    q = streams.silent_processes(stream).writeStream.foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    one = [(r[3], r[4]) for r in sorted(seen, key=lambda r: r[0]) if r[1] == 1]
    assert one == [("b", "shown"), ("b", "hidden"), ("b", "expired"), ("b", "dropped"), ("back", "shown")]
    # pid 2's own messages make event time go on, so it is never silent
    assert {r[4] for r in seen if r[1] == 2} == {"shown"}


def test_request_pairs(spark, sf, tmp_path):
    s = timed(fx.status(spark, sf)).select("ts", F.col("pid"), F.concat(F.lit("/p"), (F.col("pid") % 5).cast("string")).alias("path"))
    a, b = stream_of(spark, s, tmp_path, "a"), stream_of(spark, s.withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 seconds")), tmp_path, "b")
    out = run(streams.request_timing(a, b), tmp_path, name="timing")
    assert out.where("micros = 3000000").count() >= 1


@pytest.mark.parametrize("stack, zooms", [([None, 1, 2], [0, 1, 2, 3])])
def test_zoom_lists(spark, sf, stack, zooms):
    from tilework.operators import tiling

    p = fx.points(spark, sf).select("id")
    got = tiling.features_for_zooms([None if q is None else p.where(F.col("id") % 2 == q % 2) for q in stack], zooms).groupBy("z").count().collect()
    assert {r["z"] for r in got} == {1, 2, 3}


def test_process_states(spark):
    at = "2024-01-01 12:00:00"
    idle = {1: "shown", 10: "shown", 11: "hidden", 60: "hidden", 61: "expired", 360: "expired", 361: "dropped"}
    rows = spark.createDataFrame([(m, m) for m in idle], "pid long, m int").select("pid", F.lit("x").alias("message"), (F.lit(at).cast("timestamp") - F.expr("make_interval(0, 0, 0, 0, 0, m)")).alias("ts"))
    later = rows.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    got = streams.process_states(rows.unionByName(later), at)
    assert {r["pid"]: r["state"] for r in got.collect()} == idle
    assert streams.process_states(rows.where("pid < 0"), at).count() == 0


def test_flaky_maker_is_kept(spark, tmp_path):
    """A maker that answers by chance: every tile is made or failed, once, and no attempt is rendered again, with keep or without."""
    t = spark.range(200).select(F.lit(8).alias("z"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"))

    def keep(df, n):
        df.write.parquet(str(tmp_path / f"a{n}"))
        return spark.read.parquet(str(tmp_path / f"a{n}"))

    maker = lambda df, n: df.withColumn("body", F.lit("b")).withColumn("error", F.when(F.expr("rand() < 0.5"), "no"))
    made, failed = streams.seed_batch(t, maker, 3, keep)
    assert sorted([r["x"] for r in made.collect()] + [r["x"] for r in failed.collect()]) == list(range(200))
    made, failed = streams.seed_batch(t, maker, 3)
    assert sorted([r["x"] for r in made.collect()] + [r["x"] for r in failed.collect()]) == list(range(200))
