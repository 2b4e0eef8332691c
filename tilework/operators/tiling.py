"""Features to tiles: plans, the range join by cell explosion, thinning, searches by distance.

A feature's box becomes the range of tiles that cover it at each zoom, exploded to rows; from there on everything is
an equality on (z, x, y), so joins shuffle by tile and never compare all features with all tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilework.functions import clip as clips
from tilework.functions import geom as g
from tilework.functions import grid, shapes, utm
from tilework.functions.grid import _c
from tilework.operators.tables import small, spread, sums_before, written

KEY = ("z", "x", "y")


# ---- plans -----------------------------------------------------------------------------------------------------------


def tile_plan(spark: SparkSession, bbox: tuple[float, float, float, float], zooms: list[int], padding: int = 0) -> DataFrame:
    """Z, x, y, offset, total of all tiles of an area (two opposite corners lat, lon, lat, lon), in flood
    order: zoom, row, column. Rows are made on the executors from a range of offsets, a join-free plan of any size."""
    lat1, lon1, lat2, lon2 = bbox
    if not all(-90 < v < 90 for v in (lat1, lat2)) or not all(-180 < v < 180 for v in (lon1, lon2)):
        raise ValueError("latitudes have to be within 90, longitudes within 180 degrees")
    if padding < 0 or int(padding) != padding:
        raise ValueError("padding has to be a whole number, 0 or more")
    if not zooms or any(int(z) != z or z < 0 for z in zooms):
        raise ValueError("zooms have to be whole numbers")
    north, south, west, east = max(lat1, lat2), min(lat1, lat2), min(lon1, lon2), max(lon1, lon2)
    boxes, total = [], 0
    for z in zooms:
        n = 2.0**z
        fx = lambda lon, n=n: (lon + 180.0) / 360.0 * n
        fy = lambda lat, n=n: (1 - np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) / np.pi) / 2 * n
        x0, x1 = int(np.floor(fx(west))) - padding, int(np.floor(fx(east))) + padding
        y0, y1 = int(np.floor(fy(north))) - padding, int(np.floor(fy(south))) + padding
        count = (x1 - x0 + 1) * (y1 - y0 + 1)
        boxes.append((int(z), x0, y0, x1 - x0 + 1, total, total + count))
        total += count
    where = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(("z", "x0", "y0", "w", "a", "b"), b, strict=True)]) for b in boxes])
    rows = spark.range(total).withColumn("p", F.get(F.filter(where, lambda s: (F.col("id") >= s["a"]) & (F.col("id") < s["b"])), F.lit(0)))
    at = F.col("id") - F.col("p.a")
    x, y = F.col("p.x0") + at % F.col("p.w"), F.col("p.y0") + F.floor(at / F.col("p.w"))
    return rows.select(F.col("p.z").cast("int").alias("z"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.col("id").alias("offset"), F.lit(total).cast("long").alias("total"))


def with_progress(plan: DataFrame, order: list[str]) -> DataFrame:
    """W01 for plans without offsets: each tile's place in the order and the number of all. Numbered by ranges of the order, of
    which only the totals come together."""
    plan = written(plan, "plan")
    return sums_before(plan, order, {"offset": F.lit(1).cast("long")}).withColumn("total", F.lit(plan.count()))


def view_tiles(views: DataFrame, key: str, xmin: Column, ymin: Column, xmax: Column, ymax: Column, resolution: Column, zoom_adjust: int = 0) -> DataFrame:
    """Key, z, x, y: a row for each tile of each view (a box in mercator metres). Views are dealt out by key before they become
    tiles, and columns and rows are exploded as whole numbers, without an array of tiles."""
    v = spread(views.select(key, utm.view_range(xmin, ymin, xmax, ymax, resolution, zoom_adjust).alias("v")).select(key, "v.*"), key)
    cols = v.select(key, "z", "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("x"))
    return cols.select(key, "z", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def tile_source(listed: DataFrame | None = None, archive: DataFrame | None = None, area: DataFrame | None = None) -> DataFrame:
    """The first given one of a list, an archive's tiles, an area's plan."""
    for df in (listed, archive, area):
        if df is not None:
            return df.select(*KEY)
    raise ValueError("no source of tiles")


def keep_tiles(df: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rows whose tile is listed."""
    return df.join(tiles.select(*KEY).distinct(), list(KEY), "left_semi")


def missing_tiles(plan: DataFrame, stored: DataFrame, on: tuple[str, ...] = KEY, ignore_cached: bool = False) -> DataFrame:
    """Tiles of a plan that aren't stored yet (all of them with ignore_cached)."""
    return plan if ignore_cached else plan.join(stored.select(*on), list(on), "left_anti")


# ---- features to tiles -----------------------------------------------------------------------------------------------


def _range(lo: Column, hi: Column, closed: bool, pad: float) -> Column:
    """Tiles whose interval meets lo..hi; closed: a touched edge counts for both of its tiles."""
    first = F.ceil(lo - pad) - 1 if closed else F.floor(lo - pad)
    return F.sequence(first.cast("int"), F.greatest(first, F.floor(hi + pad)).cast("int"))


def _point_in_tile(grid_name: str, closed: bool, pad: float) -> Column:
    """Whether a point of geom counts for the row's tile, by the same arithmetic as the tiles of its box (``_range``): a tile's corner
    taken back to degrees is a rounding off, and would lose points on an edge."""

    def on(v: Column, tile: Column) -> Column:
        first = F.ceil(v - pad) - 1 if closed else F.floor(v - pad)
        return tile.between(first, F.greatest(first, F.floor(v + pad)))

    def held(p: Column) -> Column:
        y = F.greatest(F.least(p["y"], F.lit(89.999)), F.lit(-89.999)) if grid_name == "mercator" else p["y"]
        at = grid.lonlat_to_tile(p["x"], y, F.col("z"), grid_name)
        return on(at["x"], F.col("x")) & on(at["y"], F.col("y"))

    return F.exists(g.points("geom"), held)


#: Degrees by which a tile's box is grown before shapes are held against it: more than a corner's rounding, less than any coordinate's meaning.
SLACK = 1e-12


def assign_tiles(
    features: DataFrame, zooms: list[int], grid_name: str = "mercator", edges: str = "closed", padding: float = 0.0, tiles: DataFrame | None = None, exact: bool = True
) -> DataFrame:
    """Features (geom in lon/lat, ...) -> a row per feature and tile that it meets: z, x, y and the features' columns.

    edges: ``closed`` (a point on an edge is in both tiles) or ``half_open`` (in one: the right or lower one). padding:
    fraction of a tile by which each tile's box grows. tiles: keep only these. exact: test lines and polygons
    themselves, not only their boxes. Tiles outside the pyramid are left out.
    """
    closed = edges == "closed"
    b = g.bbox(F.col("geom"))
    rows = features.withColumn("_b", b).where(F.col("_b.xmin").isNotNull())
    rows = rows.withColumn("z", F.explode(F.array(*[F.lit(int(z)) for z in zooms])))
    low = grid.lonlat_to_tile(F.col("_b.xmin"), F.least(F.col("_b.ymax"), F.lit(89.999 if grid_name == "mercator" else 90.0)), F.col("z"), grid_name)
    high = grid.lonlat_to_tile(F.col("_b.xmax"), F.greatest(F.col("_b.ymin"), F.lit(-89.999 if grid_name == "mercator" else -90.0)), F.col("z"), grid_name)
    rows = rows.withColumn("_lo", low).withColumn("_hi", high)
    rows = rows.withColumn("x", F.explode(_range(F.col("_lo.x"), F.col("_hi.x"), closed, padding)))
    rows = rows.withColumn("y", F.explode(_range(F.col("_lo.y"), F.col("_hi.y"), closed, padding)))
    n = grid.span("z")
    rows = rows.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < n * (2 if grid_name == "wgs84" else 1)) & (F.col("y") < n))
    if tiles is not None:
        rows = keep_tiles(rows, tiles)
    if exact:
        e, kind = lonlat_envelope(padding, grid_name), F.col("geom")["kind"]
        sides = {"xmin": -SLACK, "ymin": -SLACK, "xmax": SLACK, "ymax": SLACK}
        rows = rows.withColumn("_e", F.struct(*[(e[k] + v).alias(k) for k, v in sides.items()]))
        # a point's box is the point; other kinds are held against the tile's box
        meets = F.when(kind == "Point", True).when(kind == "MultiPoint", _point_in_tile(grid_name, closed, padding)).otherwise(clips.meets("geom", F.col("_e")))
        rows = rows.where(meets).drop("_e")
    return rows.drop("_b", "_lo", "_hi")


def lonlat_envelope(padding: float = 0.0, grid_name: str = "mercator", z="z", x="x", y="y") -> Column:
    """The lon/lat box of the row's tile, grown by a fraction of the tile."""
    a = grid.tile_to_lonlat(_c(x) - padding, _c(y) - padding, _c(z), grid_name)
    b = grid.tile_to_lonlat(_c(x) + 1 + padding, _c(y) + 1 + padding, _c(z), grid_name)
    return F.struct(a["lon"].alias("xmin"), b["lat"].alias("ymin"), b["lon"].alias("xmax"), a["lat"].alias("ymax"))


def features_for_zooms(queries: list[DataFrame | None] | dict[int, DataFrame | None], zooms: list[int]) -> DataFrame:
    """One source per zoom. A list's last entry serves all higher zooms; a dict has none for zooms that it lacks;
    None gives no features. Sources share their columns."""
    chosen = []
    for z in zooms:
        q = queries.get(z) if isinstance(queries, dict) else queries[min(z, len(queries) - 1)]
        if q is not None:
            chosen.append(q.withColumn("z", F.lit(int(z))))
    if not chosen:
        some = next(q for q in (queries.values() if isinstance(queries, dict) else queries) if q is not None)
        return some.withColumn("z", F.lit(0)).where(F.lit(False))
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


def tile_counts(points: DataFrame, zooms) -> DataFrame:
    """Points (lon, lat) per tile for all zooms. The finest zoom is counted once and a coarser zoom is a sum over
    x >> n, y >> n, so the points are shuffled, pre-aggregated, only once whatever the number of zooms."""
    top = max(zooms)
    kept = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    fine = kept.groupBy(grid.tile_x("lon", F.lit(top)).alias("fx"), grid.tile_y("lat", F.lit(top)).alias("fy")).agg(F.count("*").alias("n0"))
    zs = F.explode(F.array(*[F.lit(int(z)) for z in sorted(zooms)])).alias("z")
    up = fine.select("*", zs).select("z", F.expr(f"shiftright(fx, {top} - z)").alias("x"), F.expr(f"shiftright(fy, {top} - z)").alias("y"), "n0")
    return up.groupBy("z", "x", "y").agg(F.sum("n0").alias("n"))


# ---- thinning --------------------------------------------------------------------------------------------------------


SHAPE = ["_kind", "_xs", "_ys", "_lens"]


def _shape(geom: Column) -> list[Column]:
    """A geometry in its tile's pixels, as flat arrays: kind, x and y of all points, and the rings' numbers of points."""
    at = lambda p: grid.lonlat_to_tile(p["x"], p["y"], F.col("z"))
    rings = F.flatten(geom["parts"])
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: (at(p)["x"] - F.col("x")) * 256), F.transform(flat, lambda p: (at(p)["y"] - F.col("y")) * 256)
    return [c.alias(n) for c, n in zip((geom["kind"], xs, ys, F.transform(rings, F.size)), SHAPE, strict=True)]


def _cells(pixels: float) -> Column:
    """Array of the cells that a shape's box covers when it grows by half the spacing: two shapes within the spacing share one.
    What lies beyond the tile is held in the outermost cells, so a shape has a fixed number of cells at most."""
    size = max(float(pixels), 16.0)
    last = int(256 // size) + 1
    at = lambda v: F.greatest(F.lit(-1), F.least(F.lit(last), F.floor(v / size))).cast("int")
    reach = lambda c: F.sequence(at(F.array_min(c) - pixels / 2), at(F.array_max(c) + pixels / 2))
    return F.flatten(F.transform(reach("_xs"), lambda i: F.transform(reach("_ys"), lambda j: i * 1000 + j)))


def _first_round(rows: DataFrame, pixels: float) -> tuple[DataFrame, DataFrame]:
    """(kept, undecided) after a round: rows that are the earliest in all of their cells are kept, since no earlier one can
    be near, and rows near one of those are dropped. A cell has one such row at most, so pairs are as many as cells covered."""
    cover = rows.select(*KEY, "_o", F.explode(_cells(pixels)).alias("c"))
    least = cover.groupBy(*KEY, "c").agg(F.min("_o").alias("m"))
    held = written(cover.join(least, [*KEY, "c"]), "cover")
    won = written(held.groupBy(*KEY, "_o").agg(F.min(F.col("_o") == F.col("m")).alias("all")).where("all").select(*KEY, "_o"), "won")
    pairs = held.where("_o != m").select(*KEY, "_o", F.col("m").alias("_w")).distinct().join(won.withColumnRenamed("_o", "_w"), [*KEY, "_w"], "left_semi")
    other = rows.select(*KEY, F.col("_o").alias("_w"), *[F.col(c).alias(f"w{c}") for c in SHAPE])
    pairs = pairs.join(rows.select(*KEY, "_o", *SHAPE), [*KEY, "_o"]).join(other, [*KEY, "_w"])
    gone = pairs.where(shapes.near(*SHAPE, *[f"w{c}" for c in SHAPE], F.lit(float(pixels)))).select(*KEY, "_o").distinct()
    decided = written(won.unionByName(gone), "decided")
    return rows.join(won, [*KEY, "_o"], "left_semi"), rows.join(decided, [*KEY, "_o"], "left_anti")


#: Points of winners that are sent to every task; with more, the rest of the hot tiles is brought to the winners.
WINNER_POINTS = 500_000
#: Rows held against the winners at once.
HELD_ROWS = 65_536


def _clear_of_winners(rest: DataFrame, won: DataFrame, pixels: float) -> DataFrame:
    """Of rows (z, x, y, _n and their shape), the z, x, y, _n of those that aren't near one of their tile's winners, which are few: each task
    has them all, so the rows stay where they are."""
    tiles, kept = {}, {}
    for r in won.select(*KEY, *SHAPE).collect():  # WINNER_POINTS points at most
        kept.setdefault(tiles.setdefault(tuple(r[:3]), len(tiles)), []).append(tuple(r[3:]))

    def left(batches):
        held, n = [], 0

        def done():
            rows = pa.Table.from_batches(held).combine_chunks()
            cols = [c.combine_chunks() for c in rows.columns]
            own, group = np.unique(np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols[:3]]), axis=0, return_inverse=True)
            number = np.array([tiles.get(tuple(t), -1) for t in own.tolist()])
            mask = shapes.clear_rows(cols[4:], number[group.reshape(-1)], kept, float(pixels))
            yield from rows.select([0, 1, 2, 3]).filter(pa.array(mask)).combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD_ROWS:
                yield from done()
                held, n = [], 0
        if n:
            yield from done()

    rows = rest.select(*KEY, "_n", *SHAPE)
    return rows.mapInArrow(left, rows.select(*KEY, "_n").schema)


def thin_by_spacing(
    assigned: DataFrame, pixels: float, order: str = "id", x: str = "lon", y: str = "lat", geom: str | None = None, task_rows: int = 20_000, columns: list[str] | None = None
) -> DataFrame:
    """Per tile, in order, drops a feature within ``pixels`` of one kept before. A pixel is 1/256 of the tile. Points of the columns
    x and y, or shapes of any kind of the column geom (in lon/lat; clip it first if what is near outside the tile shouldn't count).
    The distance is that of the shapes themselves, 0 where they cross or one lies in the other. columns: those to return; others
    aren't carried along.

    A tile of up to task_rows features is one sequential pass. In a larger one the first task_rows features are, and of the rest is dropped
    what is near those kept; where few were kept, few are left. Where these winners have few points, every task has them and the rest
    is read where it was written; with more, the rest goes to them in pieces of task_rows. Where many were kept, rounds over cells decide all
    features that have no undecided earlier one near, wherever in the tile they are, and drop what is near those. Rounds go on until the
    rest is below task_rows, so that no task holds a whole hot tile. Features equal in order come in any order, nulls first.

    Features are written once; only those that a pass is made of, and the numbering of hot tiles by key and order, are shuffled."""

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_v", "_n"], kind="stable", na_position="first")
        return pdf[shapes.greedy(list(zip(*(pdf[c] for c in SHAPE), strict=True)), float(pixels))][[*KEY, "_n"]]

    def thinned(part: DataFrame) -> DataFrame:
        """The rows that a sequential pass over each tile keeps."""
        kinds = dict(part.dtypes)
        own = part.select(*KEY, F.col("_o.o").alias("_v"), F.col("_o.n").alias("_n"), *SHAPE).groupBy(*KEY).applyInPandas(thin, ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", _n long")
        return part.withColumn("_n", F.col("_o.n")).join(own, [*KEY, "_n"], "left_semi").drop("_n")

    def clear(rest: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        if len(rest) and len(won):
            rest = rest[shapes.clear_of(*(list(zip(*(p[c] for c in SHAPE), strict=True)) for p in (rest, won)), float(pixels))]
        return rest[[*KEY, "_n"]]

    def in_pieces(rows: DataFrame, won: DataFrame) -> DataFrame:
        """z, x, y, _n of rows with their piece's number that aren't near one of their tile's winners."""
        kinds = dict(rows.dtypes)
        other = written(rows.select(*KEY, "_piece").distinct().join(won.select(*KEY, *SHAPE), list(KEY)), "won")  # the winners, once for each piece
        own = rows.select(*KEY, "_piece", "_n", *SHAPE)
        return own.groupBy(*KEY, "_piece").cogroup(other.groupBy(*KEY, "_piece")).applyInPandas(clear, ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", _n long")

    def after(rows: DataFrame, won: DataFrame) -> DataFrame:
        """Of rows with their tile's number of rows, those that aren't near one of its winners."""
        rows = rows.withColumn("_n", F.col("_o.n"))
        few_points = won.agg(F.coalesce(F.sum(F.size("_xs")), F.lit(0))).first()[0] <= WINNER_POINTS
        left = _clear_of_winners(rows, won, pixels) if few_points else in_pieces(rows.withColumn("_piece", F.pmod("_n", F.ceil(F.col("_m") / task_rows))), won)
        return rows.join(small(written(left, "left")), [*KEY, "_n"], "left_semi").drop("_n", "_m")

    columns = assigned.columns if columns is None else columns
    shape = _shape(F.col(geom) if geom else g.point(x, y))
    rows = assigned.select(*dict.fromkeys([*KEY, *columns]), F.col(order).alias("_v"), *shape).where(F.size("_xs") > 0)
    rows = written(rows.withColumn("_n", F.monotonically_increasing_id()), "thin")
    rows = rows.withColumn("_o", F.struct(F.col("_v").alias("o"), F.col("_n").alias("n"))).drop("_v", "_n")
    kept, few = [], []
    while True:
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("_m"))
        hot = written(sizes.where(F.col("_m") > task_rows), "hot")
        if hot.isEmpty():
            few.append(rows)
            break
        few.append(rows.join(F.broadcast(hot), list(KEY), "left_anti"))  # tiles of more than task_rows features are few
        inside = rows.join(F.broadcast(hot), list(KEY))
        placed = written(sums_before(inside.select(*KEY, "_o"), [*KEY, "_o"], {"_place": F.lit(1).cast("long")}), "placed")
        first = placed.groupBy(*KEY).agg(F.min("_place").alias("_first"))
        last = placed.join(F.broadcast(first), list(KEY)).where(F.col("_place") - F.col("_first") == task_rows - 1).select(*KEY, F.col("_o").alias("_last"))
        last = F.broadcast(written(last, "last"))  # a row a hot tile: the last of its first features
        cut = inside.join(last, list(KEY))
        won = written(thinned(cut.where("_o <= _last").drop("_last", "_m")), "won")
        if won.count() * 8 <= hot.count() * task_rows:
            rest = after(cut.where("_o > _last").drop("_last"), won)
        else:
            won, rest = _first_round(inside.drop("_m"), pixels)
        kept.append(won)
        rows = written(rest, "thin")

    todo = few[0]
    for f in few[1:]:
        todo = todo.unionByName(f)
    out = thinned(todo).select(*columns)
    for k in kept:
        out = out.unionByName(k.select(*columns))
    return out


def thin_in_catalyst(assigned: DataFrame, pixels: float, order: str = "id", x: str = "lon", y: str = "lat") -> DataFrame:
    """V12 for tiles of few features: the same result by a fold over the tile's sorted array, without Python."""
    at = grid.lonlat_to_tile(F.col(x), F.col(y), F.col("z"))
    item = F.struct(F.col(order).alias("o"), ((at["x"] - F.col("x")) * 256).alias("px"), ((at["y"] - F.col("y")) * 256).alias("py"))
    kind = "array<struct<o:bigint,px:double,py:double>>"
    rows = assigned.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("f"))
    far = lambda kept, p: ~F.exists(kept, lambda q: (q["px"] - p["px"]) * (q["px"] - p["px"]) + (q["py"] - p["py"]) * (q["py"] - p["py"]) <= pixels * pixels)
    kept = F.aggregate("f", F.lit(None).cast(kind), lambda a, p: F.when(far(F.coalesce(a, F.array().cast(kind)), p), F.concat(F.coalesce(a, F.array().cast(kind)), F.array(p))).otherwise(a))
    return rows.select(*KEY, F.explode(kept).alias("p")).select(*KEY, F.col("p.o").alias(order))


# ---- searches --------------------------------------------------------------------------------------------------------


def within_radius(tiles: DataFrame, points: DataFrame, km: float) -> DataFrame:
    """Points of a tile (one on an edge is of the right or lower one) and within km of its centre along the arc: tile keys, the
    points' columns, km."""
    spans = [r["z"] for r in tiles.select("z").distinct().collect()]  # zooms: a few dozen at most
    inside = assign_tiles(points.withColumn("geom", g.point("lon", "lat")), sorted(spans), edges="half_open", exact=False).drop("geom")
    c = grid.tile_center("z", "x", "y")
    lat1, lat2 = F.radians(c["lat"]), F.radians(F.col("lat"))
    h = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(F.radians(F.col("lon") - c["lon"]) / 2), F.lit(2.0))
    out = keep_tiles(inside, tiles).withColumn("km", 2 * 6371.0 * F.asin(F.sqrt(h)))
    return out.where(F.col("km") <= km)


def occupancy(points: DataFrame, finest: int, levels: int, x: str = "mx", y: str = "my") -> DataFrame:
    """The pyramid of the cells that have points (metres): k, cx, cy and the box of the cell's points, for cells of
    CIRCUMFERENCE * 2 ** k metres, k = finest, finest + 3 and so on. Points are counted once; each coarser level is made of the finer one's
    cells, 64 of them at most."""
    at = lambda c: F.floor(F.col(c) / (grid.CIRCUMFERENCE * 2.0**finest)).cast("long")
    kept = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    level = kept.groupBy(at(x).alias("cx"), at(y).alias("cy")).agg(*[f(c).alias(n) for f, c, n in ((F.min, x, "xmin"), (F.max, x, "xmax"), (F.min, y, "ymin"), (F.max, y, "ymax"))])
    out = level = written(level.select(F.lit(finest).alias("k"), "*"), "cells")
    for n in range(1, levels):
        up = level.groupBy(F.shiftright("cx", 3).alias("cx"), F.shiftright("cy", 3).alias("cy")).agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))
        level = written(up.select(F.lit(finest + 3 * n).alias("k"), "*"), "cells")
        out = out.unionByName(level)
    return out


def _search_level(rows: DataFrame) -> DataFrame:
    """rows: a box (bx0, by0, bx1, by1) and a cell's points' box, no wider than half of it. Adds meets: true if a point is surely inside,
    null if that is open, false if not. Cut along one axis only, the cell has a point on the inner side of the cut."""
    apart = (F.col("xmax") < F.col("bx0")) | (F.col("xmin") > F.col("bx1")) | (F.col("ymax") < F.col("by0")) | (F.col("ymin") > F.col("by1"))
    x_in, y_in = ((F.col(f"{c}min") >= F.col(f"b{c}0")) & (F.col(f"{c}max") <= F.col(f"b{c}1")) for c in "xy")
    return rows.withColumn("meets", F.when(apart, False).when(x_in | y_in, True))


def expand_search(tiles: DataFrame, features: DataFrame, limit: float = 1.61e15) -> DataFrame:
    """For each tile the least level at which its box, grown by 3.5 spans on every side a level (8 times wider), edges
    included, holds a feature's point (mx, my in metres): z, x, y, level; null where none does before the area passes limit.

    By a pyramid of occupied cells, never by comparing tiles with features: a level's box lies over nine cells of half its
    width, whose points' boxes mostly settle it. Where a corner of the box cuts a cell both ways, the cell's 64 parts are asked, level
    by level; that leaves one part a corner. Points themselves are compared in the finest such parts, quarters of a tile, alone.
    So the rows joined are a fixed number a tile and level, whatever the number of features."""
    out = None
    for z in sorted(r["z"] for r in tiles.select("z").distinct().collect()):  # zooms: a few dozen at most
        span = grid.CIRCUMFERENCE / 2.0**z
        levels = sum(1 for n in range(64) if (span * 8.0**n) ** 2 < limit * 64)
        own = _expanded(tiles.where(F.col("z") == z).select(*KEY).distinct(), features, z, levels)
        out = own if out is None else out.unionByName(own)
    return tiles.select(*KEY).withColumn("level", F.lit(None).cast("int")) if out is None else tiles.select(*KEY).join(out, list(KEY), "left")


def _lookups(tiles: DataFrame, z: int, levels: int) -> DataFrame:
    """z, x, y, level, the level's box (bx0, by0, bx1, by1) and k, cx, cy: the cells of half its width that it lies over."""
    env = grid.tile_envelope("z", "x", "y")
    asked = tiles.select(*KEY, env.alias("e")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    grow = F.lit(grid.CIRCUMFERENCE / 2.0**z) * (F.pow(F.lit(8.0), F.col("level")) - 1) / 2
    asked = asked.select(*KEY, "level", *[(F.col(f"e.{c}") + s * grow).alias(n) for c, s, n in (("xmin", -1, "bx0"), ("ymin", -1, "by0"), ("xmax", 1, "bx1"), ("ymax", 1, "by1"))])
    asked = asked.withColumn("k", (F.col("level") * 3 - z - 1).cast("int"))
    cell = lambda v: F.floor(F.col(v) / (F.lit(grid.CIRCUMFERENCE) * F.pow(F.lit(2.0), F.col("k")))).cast("long")
    for axis in "xy":
        asked = asked.withColumn(f"c{axis}", F.explode(F.sequence(cell(f"b{axis}0"), cell(f"b{axis}1"))))
    return asked


def _expanded(tiles: DataFrame, features: DataFrame, z: int, levels: int) -> DataFrame:
    """expand_search for the tiles of one zoom: z, x, y, level of those that are answered."""
    finest, box, part = -(z + 1), ["bx0", "by0", "bx1", "by1"], ["xmin", "xmax", "ymin", "ymax"]
    cells, asked = occupancy(features, finest, levels), _lookups(tiles, z, levels)
    known = written(_search_level(asked.join(cells, ["k", "cx", "cy"])).where("meets IS NULL OR meets").drop(*part), "search")
    answers = known.where("meets").groupBy(*KEY).agg(F.min("level").alias("level"))
    open_ = known.where("meets IS NULL").drop("meets")
    while True:
        best = answers.select(*KEY, F.col("level").alias("_best"))
        open_ = written(open_.join(best, list(KEY), "left").where("_best IS NULL OR level < _best").drop("_best"), "open")
        if open_.isEmpty():
            return answers
        inside = cells.select((F.col("k") + 3).alias("k"), F.shiftright("cx", 3).alias("cx"), F.shiftright("cy", 3).alias("cy"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), *part)
        finer = open_.where(F.col("k") > finest).join(inside, ["k", "cx", "cy"]).select(*KEY, "level", *box, (F.col("k") - 3).alias("k"), F.col("_x").alias("cx"), F.col("_y").alias("cy"), *part)
        at = lambda c: F.floor(F.col(c) / (grid.CIRCUMFERENCE * 2.0**finest)).cast("long")
        last = open_.where(F.col("k") == finest).join(features.select("mx", "my", at("mx").alias("cx"), at("my").alias("cy")), ["cx", "cy"])
        last = last.where(F.col("mx").between(F.col("bx0"), F.col("bx1")) & F.col("my").between(F.col("by0"), F.col("by1"))).select(*KEY, "level").distinct()
        found = written(_search_level(finer).where("meets IS NULL OR meets").drop(*part), "search")
        more = found.where("meets").select(*KEY, "level").unionByName(last)
        answers = written(answers.unionByName(more).groupBy(*KEY).agg(F.min("level").alias("level")), "answers")
        open_ = found.where("meets IS NULL").drop("meets")


def exact_in_bounds(tiles: DataFrame, bounds: DataFrame) -> DataFrame:
    """G17 for a list of bounds (north, west, south, east, low, high; a layer's few): tiles inside any of them."""
    b = F.broadcast(bounds)
    ul, lr = grid.lonlat_to_tile("west", "north", "z"), grid.lonlat_to_tile("east", "south", "z")
    ok = F.col("z").between(F.col("low"), F.col("high")) & ~((F.col("x") > lr["x"]) | (F.col("y") > lr["y"]) | (F.col("x") + 1 < ul["x"]) | (F.col("y") + 1 < ul["y"]))
    return tiles.join(b, ok, "left_semi")
