"""Tile stores as tables: lookups across tiers, what to render, replacing, cleaning, evicting, reporting.

tiles: layer, z, x, y, format, body, size, mtime. Updates are declarative: a store's next state is a union of an
anti-join and the new rows, written with dynamic partition overwrite (layer, z), so only touched partitions change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilework.functions import grid
from tilework.operators.tables import sums_before, written
from tilework.operators.tiling import KEY, exact_in_bounds

TILE = ("layer", *KEY, "format")

#: A layer's defaults.
LAYER_DEFAULTS = {"projection": "spherical mercator", "metatile_rows": 1, "metatile_columns": 1, "metatile_buffer": 0, "tile_height": 256, "cache_lifespan": None, "write_cache": True, "stale_lock_timeout": 15, "maximum_cache_age": None, "redirects": None}


def layer_catalog(spark: SparkSession, config: DataFrame | str) -> DataFrame:
    """Layers of a JSON configuration (text, or a DataFrame with one in column value) as rows with defaults:
    layer, provider, projection, metatile_rows, metatile_columns, metatile_buffer, tile_height, cache_lifespan,
    write_cache, stale_lock_timeout, north, west, south, east, low, high."""
    df = spark.createDataFrame([(config,)], "value string") if isinstance(config, str) else config
    kind = (
        "struct<layers:map<string,struct<provider:struct<name:string,class:string>,projection:string,metatile:struct<rows:int,columns:int,buffer:int>,`tile height`:int,"
        "`cache lifespan`:long,`write cache`:boolean,`stale lock timeout`:int,`maximum cache age`:long,bounds:struct<north:double,west:double,south:double,east:double,low:int,high:int>>>>"
    )
    rows = df.select(F.explode(F.from_json("value", kind)["layers"]).alias("layer", "l"))
    d = LAYER_DEFAULTS
    dflt = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return rows.select(
        "layer",
        F.coalesce("l.provider.name", "l.provider.class").alias("provider"),
        dflt("l.projection", d["projection"]).alias("projection"),
        dflt("l.metatile.rows", 1).alias("metatile_rows"),
        dflt("l.metatile.columns", 1).alias("metatile_columns"),
        dflt("l.metatile.buffer", 0).alias("metatile_buffer"),
        dflt("l.`tile height`", 256).alias("tile_height"),
        F.col("l.`cache lifespan`").alias("cache_lifespan"),
        dflt("l.`write cache`", True).alias("write_cache"),
        dflt("l.`stale lock timeout`", 15).alias("stale_lock_timeout"),
        dflt("l.bounds.north", 89.0).alias("north"),
        dflt("l.bounds.west", -180.0).alias("west"),
        dflt("l.bounds.south", -89.0).alias("south"),
        dflt("l.bounds.east", 180.0).alias("east"),
        dflt("l.bounds.low", 0).alias("low"),
        dflt("l.bounds.high", 31).alias("high"),
    )


def resolve_layer(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds known (the layer exists) and problem: null, or a text that names the known layers."""
    known = catalog.select("layer").distinct()
    names = known.agg(F.array_join(F.array_sort(F.collect_list("layer")), ", ").alias("_names"))
    out = requests.join(known.withColumn("known", F.lit(True)), "layer", "left").crossJoin(F.broadcast(names))  # one row
    out = out.withColumn("known", F.coalesce("known", F.lit(False)))
    text = F.concat(F.lit('"'), F.coalesce("layer", F.lit("")), F.lit('" is not a layer. There are: '), F.col("_names"))
    return out.withColumn("problem", F.when(~F.col("known"), text)).drop("_names")


def read_through(requests: DataFrame, stored: DataFrame, render, catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, to_store). Requested tiles (TILE) are taken from the store or else rendered (render: DataFrame of
    TILE -> TILE, body). Tiles outside their layer's bounds answer an empty body and aren't stored; neither are tiles of
    layers with write_cache false."""
    asked = requests.select(*TILE).distinct()
    hits = asked.join(stored.select(*TILE, "body"), list(TILE))
    misses = asked.join(stored.select(*TILE), list(TILE), "left_anti")
    outside = misses.where(F.lit(False))
    storable = None
    if catalog is not None:
        bounds = catalog.select("layer", "north", "west", "south", "east", "low", "high", "write_cache")
        ul, lr = grid.lonlat_to_tile("west", "north", "z"), grid.lonlat_to_tile("east", "south", "z")
        inside = F.col("z").between(F.col("low"), F.col("high")) & ~((F.col("x") > lr["x"]) | (F.col("y") > lr["y"]) | (F.col("x") + 1 < ul["x"]) | (F.col("y") + 1 < ul["y"]))
        placed = misses.join(bounds, "layer", "left").withColumn("_in", F.coalesce(inside, F.lit(True)))
        outside = placed.where(~F.col("_in")).select(*TILE)
        storable = placed.where(F.col("_in") & F.coalesce("write_cache", F.lit(True))).select(*TILE)
        misses = placed.where("_in").select(*TILE)
    made = render(misses).select(*TILE, "body")
    answers = (
        hits.withColumn("source", F.lit("store"))
        .unionByName(made.withColumn("source", F.lit("rendered")))
        .unionByName(outside.withColumn("body", F.lit("").cast(stored.schema["body"].dataType)).withColumn("source", F.lit("outside")))
    )
    return answers, made if storable is None else made.join(storable, list(TILE), "left_semi")


def tier_lookup(tiers: list[DataFrame], requests: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(found, back-fill). found: TILE, body, tier: each tile's body from the first tier that has one that isn't
    empty. back-fill: for every tier, the found tiles that come from a later one."""
    rows = None
    for i, t in enumerate(tiers):
        t = t.select(*TILE, "body", F.lit(i).alias("tier")).where("length(body) > 0")
        rows = t if rows is None else rows.unionByName(t)
    if requests is not None:
        rows = rows.join(requests.select(*TILE).distinct(), list(TILE), "left_semi")
    best = rows.groupBy(*TILE).agg(F.min_by(F.struct("tier", "body"), "tier").alias("b")).select(*TILE, "b.body", "b.tier")
    return best, [best.where(F.col("tier") > i).drop("tier") for i in range(len(tiers))]


def remove_everywhere(tiers: list[DataFrame], keys: DataFrame) -> list[DataFrame]:
    """The tiers without the tiles of keys."""
    return [t.join(keys.select(*TILE), list(TILE), "left_anti") for t in tiers]


def put_tiles(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new tiles replacing those of their key."""
    return stored.join(new.select(*TILE), list(TILE), "left_anti").unionByName(new.select(*stored.columns))


def replace_area(target: DataFrame, staged: DataFrame, boxes: DataFrame, zoom: int, x: str = "lon", y: str = "lat") -> DataFrame:
    """target's rows outside the boxes (tiles z, x, y of one zoom, 12 or finer) plus staged's rows inside them; a row
    is inside if its point's tile is listed. An equality on tile keys; the boxes are as many as the change asks for."""
    if zoom < 12:
        raise ValueError("areas of zooms below 12 are too large to replace")
    key = [grid.tile_x(F.col(x), F.lit(zoom)).alias("_x"), grid.tile_y(F.col(y), F.lit(zoom)).alias("_y")]
    at = lambda df: df.select("*", *key)
    area = boxes.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    out = at(target).join(area, ["_x", "_y"], "left_anti")
    return out.unionByName(at(staged).join(area, ["_x", "_y"], "left_semi")).drop("_x", "_y")


def clean_tiles(stored: DataFrame, plan: DataFrame, layers: list[str] | str, formats: dict[str, list[str]] | None = None) -> DataFrame:
    """The store without the plan's tiles of the layers ("ALL": every layer), of formats that a layer supports."""
    hit = F.lit(True) if layers == "ALL" else F.col("layer").isin(layers)
    if formats is not None:
        ok = F.lit(False)
        for layer, names in formats.items():
            ok = ok | ((F.col("layer") == layer) & F.lower("format").isin([n.lower() for n in names]))
        hit = hit & ok
    gone = stored.where(hit).join(plan.select(*KEY).distinct(), list(KEY), "left_semi").select(*TILE)
    return stored.join(gone, list(TILE), "left_anti")


def evict_lru(usage: DataFrame, limit: int, buckets: int = 1024, bucket_rows: int = 100_000) -> DataFrame:
    """Path, used, size of what to remove: if all sizes exceed limit, the least recently used first (null before all, ties by path)
    until the excess is covered.

    Without an order of all rows. Sizes are summed by a fixed number of time buckets, of which the one is found in which the
    excess is covered; that one is cut into as many again, until it has few rows or is a microsecond wide. Only its rows are
    ordered then, by ranges of time and path, so that uses of one moment don't meet in one task either. usage is read once."""
    rows = written(usage.select("path", "used", "size", F.coalesce(F.unix_micros(F.col("used").cast("timestamp")), F.lit(-1 << 60)).alias("_t")), "usage")
    whole = rows.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    excess, lo, hi, gone = whole["total"] - limit, whole["lo"], whole["hi"], rows.where(F.lit(False))
    if excess <= 0:
        return gone.drop("_t")
    while True:
        width = -(-(hi - lo + 1) // buckets)
        inside, bucket = rows.where(F.col("_t").between(lo, hi)), ((F.col("_t") - lo) / width).cast("long")
        hist = inside.groupBy(bucket.alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        for b, s, n in sorted(hist.collect()):  # ``buckets`` rows at most, and one for what rounding puts beyond
            crossing = (b, n)
            if s >= excess:
                break
            excess -= s
        edge = inside.where(bucket == crossing[0])
        gone = gone.unionByName(inside.where(bucket < crossing[0]))
        if width == 1 or crossing[1] <= bucket_rows:
            break
        span = edge.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).first()
        lo, hi = span["lo"], span["hi"]
    edge = sums_before(edge, ["_t", "path"], {"_c": F.col("size")}).where(F.col("_c") < excess)
    return gone.unionByName(edge.drop("_c")).drop("_t")


def store_size(tiles: DataFrame, by: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Bytes, n: total size, each tile rounded up to whole blocks where the block size is known."""
    size = F.col("size") if block is None else F.ceil(F.col("size") / block) * block
    return tiles.groupBy(*(by or [])).agg(F.sum(size).cast("long").alias("bytes"), F.count("*").alias("n"))


def stale_tiles(tiles: DataFrame, catalog: DataFrame, now: Column) -> DataFrame:
    """Tiles older than their layer's cache_lifespan (seconds); a layer without one never expires."""
    lives = catalog.where("cache_lifespan IS NOT NULL").select("layer", "cache_lifespan")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp"))
    return tiles.join(lives, "layer").where(age > F.col("cache_lifespan") * 1_000_000).drop("cache_lifespan")


def seed_report(results: DataFrame) -> DataFrame:
    """Results (…, size, error) -> tiles done, failed, total, kilobytes."""
    failed = F.col("error").isNotNull()
    return results.agg(
        F.count_if(~failed).alias("done"), F.count_if(failed).alias("failed"), F.count("*").alias("total"), F.round(F.coalesce(F.sum(F.when(~failed, F.col("size"))), F.lit(0)) / 1024, 2).alias("kb")
    )


def recent_messages(status: DataFrame, n: int = 21) -> DataFrame:
    """The last n messages of each process: pid, ts, message, rn. Of a busy process only n rows a task reach the
    window: each task keeps its own n first."""
    order = F.struct(F.col("ts"), F.col("message"))
    own = Window.partitionBy("pid").orderBy(order.desc())
    return status.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= n)


def latest_per_process(status: DataFrame, now: Column, hide_s: int = 600, drop_s: int = 21600, whole_seconds: bool = True) -> DataFrame:
    """Pid, ts, message, hidden: the newest message of each process; hidden when more than 10 minutes have passed since (counted
    in whole seconds, or with whole_seconds=False to the microsecond), gone after 6 hours (by the clock's seconds)."""
    best = status.groupBy("pid").agg(F.max(F.struct("ts", "message")).alias("b")).select("pid", "b.ts", "b.message")
    at, ts = now.cast("timestamp"), F.col("ts").cast("timestamp")
    passed = F.unix_micros(at) - F.unix_micros(ts)
    if whole_seconds:
        passed = F.floor(passed / 1_000_000) * 1_000_000  # seconds cut off on both sides would count one more
    return best.where(F.unix_timestamp(at) - F.unix_timestamp(ts) <= drop_s).withColumn("hidden", passed > hide_s * 1_000_000)


def top_messages(status: DataFrame, n: int = 250) -> DataFrame:
    """The n youngest messages of all."""
    return status.orderBy(F.col("ts").desc(), "pid", "message").limit(n)


