"""UTFGrid: interaction grids of tiles, as long cell tables (z, x, y, cx, cy, key, ...) and as their JSON.

A tile of 256 pixels has 256 / scale cells a side. A cell names a feature by an id written as a character; characters
skip the quote and the backslash. Ids are numbered by first appearance in reading order (row by row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions import grid
from tilework.operators.tables import spread
from tilework.operators.tiling import KEY

CELL = ("cy", "cx")


def encode_id(i: Column) -> Column:
    """The character of an id: code 32 + id, one more from the quote on, another one from the backslash on."""
    c = i + 32
    c = F.when(c >= 34, c + 1).otherwise(c)
    c = F.when(c >= 92, c + 1).otherwise(c)
    # UTF-8 by hand: char() knows a byte's range only
    two = F.concat(F.unhex(F.hex((F.lit(0xC0) + F.shiftright(c, 6)).cast("long"))), F.unhex(F.hex((F.lit(0x80) + c.bitwiseAND(63)).cast("long"))))
    three = F.concat(
        F.unhex(F.hex((F.lit(0xE0) + F.shiftright(c, 12)).cast("long"))), F.unhex(F.hex((F.lit(0x80) + F.shiftright(c, 6).bitwiseAND(63)).cast("long"))), F.unhex(F.hex((F.lit(0x80) + c.bitwiseAND(63)).cast("long")))
    )
    return F.when(c < 128, F.char(c)).when(c < 2048, F.decode(two, "UTF-8")).otherwise(F.decode(three, "UTF-8"))


def decode_id(character: Column) -> Column:
    """The id of a character."""
    c = F.ascii(character)
    c = F.when(c >= 93, c - 1).otherwise(c)
    c = F.when(c >= 35, c - 1).otherwise(c)
    return (c - 32).cast("int")


def point_cells(points: DataFrame, zooms: list[int], scale: int = 4) -> DataFrame:
    """A09 for points (id, lon, lat, ...): the cell of each point at each zoom."""
    n = 256 // scale
    rows = points.withColumn("z", F.explode(F.array(*[F.lit(int(z)) for z in zooms])))
    t = grid.lonlat_to_tile("lon", "lat", "z")
    rows = rows.withColumn("x", F.floor(t["x"]).cast("int")).withColumn("y", F.floor(t["y"]).cast("int"))
    cell = lambda v, o: F.least(F.lit(n - 1), F.floor((v - o) * n)).cast("int")
    return rows.withColumn("cx", cell(t["x"], F.col("x"))).withColumn("cy", cell(t["y"], F.col("y")))


def polygon_cells(assigned: DataFrame, scale: int = 4) -> DataFrame:
    """A09 for polygons assigned to tiles (geom in lon/lat): the cells whose centre is inside (even-odd over all rings).
    Cells of the box only are made and tested; the polygons are dealt out before."""
    from tilework.functions import geom as g

    n = 256 // scale
    b = g.bbox("geom")
    low = grid.lonlat_to_tile(b["xmin"], F.least(b["ymax"], F.lit(89.9)), "z")
    high = grid.lonlat_to_tile(b["xmax"], F.greatest(b["ymin"], F.lit(-89.9)), "z")
    clamp = lambda v, o: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - o) * n))).cast("int")
    rows = spread(assigned).withColumn("_a", F.struct(clamp(low["x"], F.col("x")).alias("x0"), clamp(high["x"], F.col("x")).alias("x1"), clamp(low["y"], F.col("y")).alias("y0"), clamp(high["y"], F.col("y")).alias("y1")))
    rows = rows.withColumn("cx", F.explode(F.sequence("_a.x0", "_a.x1"))).withColumn("cy", F.explode(F.sequence("_a.y0", "_a.y1")))
    at = grid.tile_to_lonlat(F.col("x") + (F.col("cx") + 0.5) / n, F.col("y") + (F.col("cy") + 0.5) / n, F.col("z"))
    rows = rows.withColumn("_p", at)
    px, py = F.col("_p.lon"), F.col("_p.lat")

    def crossings(r: Column) -> Column:
        def edge(q, i):
            p = F.get(r, i - 1)
            cuts = (q["y"] > py) != (p["y"] > py)
            return F.when((i > 0) & cuts & (px < (p["x"] - q["x"]) * (py - q["y"]) / (p["y"] - q["y"]) + q["x"]), 1).otherwise(0)

        return F.aggregate(F.transform(r, edge), F.lit(0), lambda a, v: a + v)

    inside = F.aggregate(F.transform(F.flatten(F.col("geom")["parts"]), crossings), F.lit(0), lambda a, v: a + v) % 2 == 1
    return rows.where(inside).drop("_a", "_p")


def topmost(cells: DataFrame, rank: list[str], value: list[str]) -> DataFrame:
    """Per tile and cell the values of the highest rank (pre-aggregated; no sort)."""
    best = F.max_by(F.struct(*value), F.struct(*rank)).alias("v")
    return cells.groupBy(*KEY, *CELL).agg(best).select(*KEY, *CELL, *[F.col(f"v.{v}").alias(v) for v in value])


def first_seen_ids(cells: DataFrame, key: str = "key", start: int = 1) -> DataFrame:
    """Adds id, numbering each tile's keys from start by their first cell in reading order. Null keys have none."""
    n = F.col("cy") * 4096 + F.col("cx")
    seen = cells.where(F.col(key).isNotNull()).groupBy(*KEY, key).agg(F.min(n).alias("_first"))
    seen = seen.withColumn("id", F.row_number().over(Window.partitionBy(*KEY).orderBy("_first")) + (start - 1)).drop("_first")
    return cells.join(seen, [*KEY, key], "left")


def encode(cells: DataFrame, key: str = "key", data: str = "data", size: int = 64, wrapper: str | None = None) -> DataFrame:
    """Cells (at most one row each, key and data text JSON) -> z, x, y, n_keys, body: keys, data and grid as JSON."""
    rows = first_seen_ids(cells, key)
    text = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(" ")))
    tile = rows.where("id IS NOT NULL").groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("cy") * size + F.col("cx")).alias("i"), encode_id(F.col("id")).alias("c")))).alias("m"),
        F.array_sort(F.collect_set(F.struct("id", F.col(key).cast("string").alias("k"), F.col(data).alias("d")))).alias("ks"),
    )
    quoted = lambda s: F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2)
    lines = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: quoted(F.array_join(F.slice(F.col("g"), r * size + 1, size), "")))
    names = F.concat(F.lit('"",'), F.array_join(F.transform("ks", lambda k: quoted(k["k"])), ","))
    body = F.concat(
        F.lit('{"keys":['), names, F.lit('],"data":{'), F.array_join(F.transform("ks", lambda k: F.concat(quoted(k["k"]), F.lit(":"), F.coalesce(k["d"], F.lit("{}")))), ","), F.lit('},"grid":['), F.array_join(lines, ","), F.lit("]}")
    )
    out = tile.withColumn("g", text).select(*KEY, F.size("ks").alias("n_keys"), body.alias("body"))
    return out if wrapper is None else out.withColumn("body", F.concat(F.lit(wrapper + "("), "body", F.lit(")")))


def decode(bodies: DataFrame, body: str = "body") -> DataFrame:
    """UTFGrid JSON, in a wrapper(...) or not, per tile -> cells: z, x, y, cx, cy, key, data (JSON text); cells
    without a feature have none."""
    raw = F.regexp_replace(F.col(body), r"^\s*[\w.]+\(|\)\s*;?\s*$", "")
    plain = F.when(F.col(body).rlike(r"^\s*\{"), F.col(body)).otherwise(raw)
    j = bodies.withColumn("_j", F.from_json(plain, "struct<keys:array<string>,data:map<string,string>,grid:array<string>>"))
    rows = j.select(*KEY, "_j", F.posexplode("_j.grid").alias("cy", "line"))
    chars = rows.select(*KEY, "_j", "cy", F.posexplode(F.split("line", "")).alias("cx", "c")).where(F.col("c") != "")
    key = F.get("_j.keys", decode_id(F.col("c")))
    return chars.select(*KEY, "cx", "cy", key.alias("key"), F.element_at("_j.data", key).alias("data")).where((F.col("key").isNotNull()) & (F.col("key") != ""))


def merge(bottom: DataFrame, top: DataFrame) -> DataFrame:
    """A10: two cell tables: the top one's cell where it has a key, else the bottom one's; ids from 1 in reading order;
    keys without data become empty."""
    value = lambda df, r: df.select(*KEY, *CELL, F.when(F.col("data").isNotNull(), F.col("key")).alias("key"), "data", F.lit(r).alias("rank"))
    both = value(bottom, 0).unionByName(value(top, 1)).where("key IS NOT NULL")
    return first_seen_ids(topmost(both, ["rank"], ["key", "data"]))


def composite(layers: DataFrame, layer_id: str | None = None) -> DataFrame:
    """Cells of ordered layers (rank): the last layer's cell wins. Keys that several layers use for different data
    get a suffix a-z by layer; keys that no cell shows any more are gone; ids from 1 in reading order. layer_id adds the
    layer's name to the data."""
    rows = layers
    if layer_id is not None:
        rows = rows.withColumn("data", F.regexp_replace("data", r"\}$", F.concat(F.lit(',"layer_id":"'), F.col(layer_id), F.lit('"}'))))
    rows = rows.withColumn("data", F.coalesce("data", F.lit("")))
    kinds = rows.groupBy(*KEY, "key", "data").agg(F.min("rank").alias("_r"))
    kinds = kinds.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, "key").orderBy("_r", "data")))
    too_many = F.raise_error(F.lit("more than 26 layers share a key"))
    suffix = F.when(F.col("_n") == 1, "").when(F.col("_n") <= 27, F.char(F.lit(95) + F.col("_n"))).otherwise(too_many)
    named = kinds.select(*KEY, "key", "data", F.concat(F.col("key").cast("string"), suffix).alias("name"))
    top = topmost(rows, ["rank"], ["key", "data"]).join(named, [*KEY, "key", "data"])
    return first_seen_ids(top.select(*KEY, *CELL, F.col("name").alias("key"), "data"))


def overlap(layers: DataFrame) -> DataFrame:
    """Per cell the list of the data of all its layers, in order; every covered cell has an id of its own in
    reading order: z, x, y, cy, cx, id, data (array)."""
    item = F.array_sort(F.collect_list(F.struct("rank", "data")))
    cells = layers.groupBy(*KEY, *CELL).agg(item.alias("l")).select(*KEY, *CELL, F.transform("l", lambda v: v["data"]).alias("data"))
    return cells.withColumn("id", F.row_number().over(Window.partitionBy(*KEY).orderBy(*CELL)))


def crop(cells: DataFrame, left: int, top: int, right: int, bottom: int, scale: int = 4) -> DataFrame:
    """The cells inside a pixel box, counted from its corner."""
    c = [v // scale for v in (left, top, right, bottom)]
    inside = F.col("cx").between(c[0], c[2] - 1) & F.col("cy").between(c[1], c[3] - 1)
    return cells.where(inside).withColumn("cx", F.col("cx") - c[0]).withColumn("cy", F.col("cy") - c[1])
