"""Features per tile to tile bodies: GeoJSON, TopoJSON, layer merges, feature lists.

Input is a table of features already assigned to tiles (z, x, y, id, geom, props JSON text, and optionally clipped).
A body is one value, so a tile's features meet in one row: thin or limit low zooms first (``max_features`` fails early
rather than late), or take the body's lines (``topojson_lines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.functions import geom as g
from tilework.functions import grid
from tilework.operators.tables import small, sums_within, written
from tilework.operators.tiling import KEY, lonlat_envelope

MERCATOR_CRS = '{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3857"}}'


def _checked(rows: DataFrame, max_features: int | None) -> DataFrame:
    if max_features is None:
        return rows
    over = F.raise_error(F.concat(F.lit("too many features in a tile: "), F.col("n").cast("string"))).cast("long")
    return rows.withColumn("n", F.when(F.col("n") > max_features, over).otherwise(F.col("n")))


def geojson_lines(features: DataFrame, digits: int | None = 6, precision_by_zoom: bool = False) -> DataFrame:
    """Z, x, y, id, line: the features of each tile's FeatureCollection as text, a row each: in the order of their ids (then their text),
    with commas between, they are its ``features``. No row holds a tile."""
    rows = features
    if precision_by_zoom:
        rows, digits = rows.withColumn("geom", g.round_coords("geom", grid.zoom_precision("z"))), None
    clip = F.col("clipped") if "clipped" in features.columns else None
    return rows.select(*KEY, "id", g.feature_json(F.col("geom"), F.col("props"), F.col("id"), digits, clip).alias("line"))


def _collection_head(projected: bool) -> str:
    return '{"type":"FeatureCollection",' + (f'"crs":{MERCATOR_CRS},' if projected else "") + '"features":['


def geojson_tiles(features: DataFrame, digits: int | None = 6, precision_by_zoom: bool = False, projected: bool = False, max_features: int | None = None) -> DataFrame:
    """Z, x, y, n, body: one FeatureCollection per tile, features in the order of their ids (then their text)."""
    lines = geojson_lines(features, digits, precision_by_zoom).select(*KEY, F.struct("id", "line").alias("f"))
    rows = lines.groupBy(*KEY).agg(F.array_sort(F.collect_list("f")).alias("f"), F.count("*").alias("n"))
    body = F.concat(F.lit(_collection_head(projected)), F.array_join(F.transform("f", lambda x: x["line"]), ","), F.lit("]}"))
    return _checked(rows.select(*KEY, "n", body.alias("body")), max_features)


def geojson_lengths(lines: DataFrame, projected: bool = False) -> DataFrame:
    """Z, x, y, n, length: the characters of each tile's FeatureCollection of ``geojson_lines``, whose lines are summed, not gathered."""
    frame = len(_collection_head(projected)) + len("]}")
    sums = lines.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("_s"))
    return sums.select(*KEY, "n", (F.col("_s") + F.col("n") - 1 + frame).alias("length"))


def esri_tiles(features: DataFrame, digits: int | None = 6) -> DataFrame:
    """One Esri feature set per tile; features of several geometry types in a tile are an error."""
    item = F.struct(F.col("id"), F.concat(F.lit('{"attributes":'), F.coalesce("props", F.lit("{}")), F.lit(',"geometry":'), g.to_esri("geom", digits), F.lit("}")).alias("t"))
    rows = features.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("f"), F.collect_set(g.esri_type("geom")).alias("types"), F.count("*").alias("n"))
    kind = F.when(F.size("types") > 1, F.raise_error(F.lit("a tile has several geometry types"))).otherwise(F.get("types", F.lit(0)))
    body = F.concat(F.lit('{"spatialReference":{"wkid":4326},"geometryType":"'), kind, F.lit('","features":['), F.array_join(F.transform("f", lambda x: x["t"]), ","), F.lit("]}"))
    return rows.select(*KEY, "n", body.alias("body"))


def geometry_types(features: DataFrame) -> DataFrame:
    """Z, x, y, types: the Esri types of each tile, sorted."""
    return features.groupBy(*KEY).agg(F.array_sort(F.collect_set(g.esri_type("geom"))).alias("types"))


def single_geometry_type(features: DataFrame) -> DataFrame:
    """Z, x, y, type; more than one type in a tile is an error."""
    wrong = F.raise_error(F.concat(F.lit("a tile has several geometry types: "), F.array_join("types", ", ")))
    return geometry_types(features).select(*KEY, F.when(F.size("types") > 1, wrong).otherwise(F.get("types", F.lit(0))).alias("type"))


def arc_offsets(features: DataFrame, arcs: Column, order: str = "id") -> DataFrame:
    """Adds first_arc, the number of arcs of the features before this one in its tile."""
    before = Window.partitionBy(*KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return features.withColumn("n_arcs", arcs).withColumn("first_arc", F.coalesce(F.sum("n_arcs").over(before), F.lit(0)))


def _arc_text(ring: Column) -> Column:
    whole = lambda v: v.cast("long").cast("string")
    return F.concat(F.lit("["), F.array_join(F.transform(g.delta_encode(ring), lambda p: F.concat(F.lit("["), whole(p["x"]), F.lit(","), whole(p["y"]), F.lit("]"))), ","), F.lit("]"))


def _topology_parts(features: DataFrame, size: int) -> DataFrame:
    """z, x, y, id, a feature's geometry as text around the numbers of its arcs (head, kind, counts: the rings of each part, inline, tail) and
    its arcs (n_arcs, arcs). Coordinates are whole numbers in the tile's lon/lat box."""
    # the shape and the box are bound to a lambda's argument, so that the box is computed once a row, not once a point
    bound = F.array(F.struct(F.col("geom").alias("g"), lonlat_envelope().alias("e")))
    rows = features.withColumn("q", F.get(F.transform(bound, lambda v: g.topo_quantize(v["g"], v["e"], size)), F.lit(0)))
    k, pt = F.col("geom")["kind"], lambda p: F.concat(F.lit("["), p["x"].cast("long").cast("string"), F.lit(","), p["y"].cast("long").cast("string"), F.lit("]"))
    pointy = k.isin("Point", "MultiPoint")
    rows = rows.withColumn("_r", F.when(pointy, F.array().cast("array<array<struct<x:double,y:double>>>")).otherwise(F.flatten(F.col("q")["parts"])))
    inline = F.when(k == "Point", pt(F.get(g.points("q"), F.lit(0)))).when(k == "MultiPoint", F.concat(F.lit("["), F.array_join(F.transform(g.points("q"), pt), ","), F.lit("]")))
    flag = F.when(F.col("clipped"), ',"clipped":true').otherwise("") if "clipped" in features.columns else F.lit("")
    name = F.to_json(F.array(F.col("id").cast("string")))
    head = F.concat(F.lit('{"type":"'), k, F.lit('","id":'), name.substr(F.lit(2), F.length(name) - 2), F.lit(',"properties":'), F.coalesce("props", F.lit("{}")), F.lit(","))
    return rows.select(
        *KEY, "id", head.alias("head"), k.alias("kind"), F.transform(F.col("q")["parts"], lambda p: F.size(p)).alias("counts"), inline.alias("inline"), F.concat(flag, F.lit("}")).alias("tail"),
        F.size("_r").alias("n_arcs"), F.array_join(F.transform("_r", _arc_text), ",").alias("arcs"),
    )


def _geometry_text(first: Column) -> Column:
    """The geometry of a row of ``_topology_parts`` whose arcs are numbered from first."""
    k, counts = F.col("kind"), F.col("counts")
    number = lambda i: (first + i).cast("long").cast("string")
    nested = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    before = lambda i: F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0), lambda a, c: a + c)
    rings = lambda n, i, f: nested(F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda j: f(number(before(i) + j))), ",")).otherwise(""))
    lines = F.transform(counts, lambda n, i: rings(n, i, lambda v: v))
    polys = F.transform(counts, lambda n, i: rings(n, i, nested))
    arcs = (
        F.when(k == "LineString", F.get(lines, F.lit(0))).when(k == "MultiLineString", nested(F.array_join(lines, ",")))
        .when(k == "Polygon", F.get(polys, F.lit(0))).when(k == "MultiPolygon", nested(F.array_join(polys, ",")))
    )
    shape = F.when(F.col("inline").isNotNull(), F.concat(F.lit('"coordinates":'), F.col("inline"))).otherwise(F.concat(F.lit('"arcs":'), arcs))
    return F.concat("head", shape, "tail")


def _topology_head(env: Column, size: int) -> Column:
    tr = g.topo_transform(env, size)
    num = lambda v: F.format_string("%.12f", v)
    pair = lambda a: F.concat(F.lit("["), num(F.get(a, F.lit(0))), F.lit(","), num(F.get(a, F.lit(1))), F.lit("]"))
    return F.concat(F.lit('{"type":"Topology","transform":{"translate":'), pair(tr["translate"]), F.lit(',"scale":'), pair(tr["scale"]), F.lit('},"objects":{'))


def topojson_tiles(features: DataFrame, size: int = 1024, name: str = "vectile", max_features: int | None = None) -> DataFrame:
    """Z, x, y, n, n_arcs, body: a Topology per tile. Coordinates are whole numbers in the tile's lon/lat box; every
    line and ring is an arc of its own, numbered through the tile; points stay inline. ``topojson_lines`` gives tiles of any size."""
    rows = arc_offsets(_topology_parts(features, size), F.col("n_arcs"))
    item = F.struct(F.col("first_arc"), F.col("id"), _geometry_text(F.col("first_arc")).alias("t"), F.col("arcs").alias("a"))
    tile = rows.select(*KEY, "n_arcs", item.alias("f")).groupBy(*KEY).agg(F.array_sort(F.collect_list("f")).alias("f"), F.count("*").alias("n"), F.sum("n_arcs").alias("n_arcs"))
    body = F.concat(
        _topology_head(lonlat_envelope(), size), F.lit('"' + name + '":{"type":"GeometryCollection","geometries":['),
        F.array_join(F.transform("f", lambda x: x["t"]), ","), F.lit(']}},"arcs":['), F.array_join(F.filter(F.transform("f", lambda x: x["a"]), lambda a: a != ""), ","), F.lit("]}"),
    )
    return _checked(tile.select(*KEY, "n", "n_arcs", body.alias("body")), max_features)


def topojson_lines(layers: dict[str, DataFrame], size: int = 1024) -> DataFrame:
    """Z, x, y, n_layers, n, n_arcs, part, layer, place, line: the lines of one Topology per tile, with an object for each layer
    (name -> features) that the tile has, in the order of part (geometries, then arcs), layer (its number in the order of names) and place
    (a feature's, in the order of ids). A tile's lines one after the other are its body (``topojson_tiles``, ``merge_topojson``), but no
    row and no task holds a tile: arcs are numbered by the sums of ranges of features."""
    rows = None
    for name in sorted(layers):
        one = _topology_parts(layers[name], size).withColumn("name", F.lit(name)).withColumn("one", F.lit(1))
        rows = one if rows is None else rows.unionByName(one)
    rows = written(rows, "topology")
    # arcs are numbered through all layers of a tile, features through one
    rows = sums_within(rows, [*KEY, "name"], ["id"], {"place": "one", "first_arc": "n_arcs"})
    tile = Window.partitionBy(*KEY)
    before = tile.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*KEY, "name").agg(F.count("*").alias("_n"), F.sum("n_arcs").alias("_arcs"))
    totals = totals.select(
        *KEY, "name", "_n", F.row_number().over(tile.orderBy("name")).alias("layer"), F.count("*").over(tile).alias("n_layers"),
        F.sum("_n").over(tile).alias("n"), F.sum("_arcs").over(tile).alias("n_arcs"), F.coalesce(F.sum("_arcs").over(before), F.lit(0)).alias("_shift"),
    )
    rows = rows.withColumnRenamed("n_arcs", "_own").join(small(written(totals, "layers")), [*KEY, "name"])
    first, last = F.col("place") == 0, F.col("place") == F.col("_n") - 1
    text = lambda *parts: F.concat(*[F.when(c, t).otherwise("") for c, t in parts])
    at = F.col("_shift") + F.col("first_arc")
    geometry = F.concat(
        text((first & (F.col("layer") == 1), _topology_head(lonlat_envelope(), size)), (~first | (F.col("layer") > 1), F.lit(",")), (first, F.concat(F.lit('"'), F.col("name"), F.lit('":{"type":"GeometryCollection","geometries":[')))),
        _geometry_text(at), text((last, F.lit("]}")), (last & (F.col("layer") == F.col("n_layers")), F.lit('},"arcs":[')), (last & (F.col("layer") == F.col("n_layers")) & (F.col("n_arcs") == 0), F.lit("]}"))),
    )
    arcs = F.when(F.col("_own") > 0, F.concat(text((at > 0, F.lit(","))), F.col("arcs"), text((at + F.col("_own") == F.col("n_arcs"), F.lit("]}")))))
    both = F.filter(F.array(F.struct(F.lit(0).alias("part"), geometry.alias("line")), F.struct(F.lit(1).alias("part"), arcs.alias("line"))), lambda v: v["line"].isNotNull())
    return rows.select(*KEY, F.col("n_layers").cast("int").alias("n_layers"), "n", "n_arcs", "layer", "place", F.explode(both).alias("_l")).select(*KEY, "n_layers", "n", "n_arcs", "_l.part", "layer", "place", "_l.line")


TOPOLOGY = "struct<transform:struct<translate:array<double>,scale:array<double>>,objects:map<string,struct<type:string,geometries:array<struct<type:string,id:string,properties:string,coordinates:string,arcs:string,clipped:boolean>>>>,arcs:string>"


def merge_topojson(layers: DataFrame) -> DataFrame:
    """Rows (z, x, y, layer, body), one topology per layer and tile -> one topology per tile with an object per
    layer (layer-name, or layer-object where a topology has several objects), arcs one after the other in the order of
    the layers' names and their indexes shifted accordingly. Layers of different transforms are an error."""
    t = F.from_json("body", TOPOLOGY)
    rows = layers.withColumn("t", t).withColumn("_arcs", F.from_json(F.col("t.arcs"), "array<string>"))
    order = Window.partitionBy(*KEY).orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum(F.size("_arcs")).over(order), F.lit(0)))
    shifted = lambda text, by: F.array_join(  # noqa: E731  arcs: nested lists of numbers, shifted number by number
        F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+|[\[\],])"), 1), lambda s: F.when(s.rlike(r"^\d"), (F.when(s.rlike(r"^\d"), s).cast("long") + by).cast("string")).otherwise(s)), ""
    )
    item = lambda x, by: F.concat(
        F.lit('{"type":"'), x["type"], F.lit('","id":'), F.to_json(F.array(x["id"])).substr(F.lit(2), F.length(F.to_json(F.array(x["id"]))) - 2), F.lit(',"properties":'), F.coalesce(x["properties"], F.lit("{}")),
        F.when(x["coordinates"].isNotNull(), F.concat(F.lit(',"coordinates":'), x["coordinates"])).otherwise(""), F.when(x["arcs"].isNotNull(), F.concat(F.lit(',"arcs":'), shifted(x["arcs"], by))).otherwise(""),
        F.when(x["clipped"], ',"clipped":true').otherwise(""), F.lit("}"),
    )
    named = F.transform(
        F.map_entries("t.objects"),
        lambda e: F.concat(F.lit('"'), F.when(F.size("t.objects") > 1, F.concat(F.col("layer"), F.lit("-"), e["key"])).otherwise(F.col("layer")), F.lit('":{"type":"GeometryCollection","geometries":['), F.array_join(F.transform(e["value"]["geometries"], lambda x: item(x, F.col("first"))), ","), F.lit("]}")),
    )
    part = F.struct(F.col("layer"), F.array_join(named, ",").alias("o"), F.array_join("_arcs", ",").alias("a"), F.size("_arcs").alias("n"))
    tile = rows.select(*KEY, F.to_json("t.transform").alias("tr"), part.alias("p")).groupBy(*KEY).agg(F.array_sort(F.collect_list("p")).alias("p"), F.collect_set("tr").alias("trs"))
    one = F.when(F.size("trs") == 1, F.get("trs", F.lit(0))).otherwise(F.raise_error(F.lit("layers of different transforms")))
    join = lambda f: F.array_join(F.filter(F.transform("p", f), lambda v: v != ""), ",")
    body = F.concat(F.lit('{"type":"Topology","transform":'), one, F.lit(',"objects":{'), join(lambda x: x["o"]), F.lit('},"arcs":['), join(lambda x: x["a"]), F.lit("]}"))
    arcs = F.aggregate("p", F.lit(0), lambda a, x: a + x["n"])
    return tile.select(*KEY, F.size("p").alias("n_layers"), arcs.alias("n_arcs"), body.alias("body"))


def merge_layers(layers: DataFrame, names: list[str], known: list[str], mime: str = "json", root: str = "FeatureCollection") -> DataFrame:
    """Rows (z, x, y, layer, body) -> z, x, y, body: an object with the named layers' tiles under their names.
    Unknown names are an error at once; a body that isn't a JSON object of the root type is one when it is met."""
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown layers: {', '.join(unknown)}; there are {', '.join(sorted(known))}")
    kind = F.get_json_object("body", "$.type")
    wrong = F.raise_error(F.concat(F.lit("layer "), F.col("layer"), F.lit(f" has no {mime} body of type {root}")))
    rows = layers.where(F.col("layer").isin(names)).withColumn("body", F.when(kind == root, F.col("body")).otherwise(wrong))
    item = F.struct("layer", "body")
    tile = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("l"))
    text = F.transform("l", lambda x: F.concat(F.lit('"'), x["layer"], F.lit('":'), x["body"]))
    return tile.select(*KEY, F.size("l").alias("n_layers"), F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("body"))


def layer_json_tiles(points: DataFrame, fields: list[str]) -> DataFrame:
    """Points with lat and lon per tile as an array of features: the coordinates become the geometry, the other
    fields its properties, nulls left out."""
    names = [f for f in fields if f not in ("lat", "lon")]
    props = F.to_json(F.struct(*names)) if names else F.lit("{}")
    item = F.struct(F.col("id"), F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), F.format_string("%.6f", "lon"), F.lit(","), F.format_string("%.6f", "lat"), F.lit(']},"properties":'), props, F.lit("}")).alias("t"))
    rows = points.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("f"))
    return rows.select(*KEY, F.size("f").alias("n"), F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("f", lambda x: x["t"]), ","), F.lit("]}")).alias("body"))


# ---- reading back ----------------------------------------------------------------------------------------------------


def drop_repeats(features: DataFrame, shape: str = "geom_text", props: str = "props") -> DataFrame:
    """Features that several tiles gave: of unclipped ones with equal geometry and properties the first tile's
    stays; clipped ones all stay."""
    order = Window.partitionBy(shape, props).orderBy(*KEY)
    clip = F.coalesce(F.col("clipped"), F.lit(False)) if "clipped" in features.columns else F.lit(False)
    # clipped features go round the window, so that a common shape among them is never gathered
    whole = features.where(~clip).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return whole.unionByName(features.where(clip))


def sort_features(features: DataFrame, spec: str) -> DataFrame:
    """O01: "name", "name ascending" or "name descending"; missing values first, or last when descending."""
    name, _, way = spec.strip().partition(" ")
    way = way.strip().lower()
    if way not in ("", "ascending", "descending"):
        raise ValueError(f"unknown sort order: {spec}")
    c = F.col(name)
    return features.orderBy(c.desc_nulls_last() if way == "descending" else c.asc_nulls_first())


def shared_keys(props: DataFrame, group: list[str], props_col: str = "props") -> DataFrame:
    """The property names that every feature of a group has (props: JSON objects): group, key. Each feature's keys
    count once; the counts are pre-aggregated."""
    keys = F.explode(F.array_distinct(F.json_object_keys(props_col))).alias("key")
    counts = props.select(*group, keys).groupBy(*group, "key").agg(F.count("*").alias("n"))
    totals = props.groupBy(*group).agg(F.count("*").alias("_t"))
    return counts.join(totals, group).where("n = _t").select(*group, "key")


def intersect_keys(one: DataFrame, other: DataFrame) -> DataFrame:
    """Keys that both have."""
    return one.select("key").intersect(other.select("key"))


def unknown_names(requested: DataFrame, known: DataFrame, name: str = "layer") -> DataFrame:
    """Requested names that aren't known."""
    return requested.select(name).subtract(known.select(name))
