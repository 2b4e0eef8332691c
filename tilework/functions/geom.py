"""Geometry columns: STRUCT<kind, parts: ARRAY<ARRAY<ARRAY<STRUCT<x, y>>>>> (polygons > rings > points).

A Point is one part of one ring of one point, a MultiPoint n parts of one point, a LineString one part of one ring; a
Polygon's first ring is its outside. All functions are Column expressions over higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilework.functions import grid
from tilework.functions.grid import _c

GEOM = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOM_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(_POINT))))])
KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")


def _geom(kind: Column, parts: Column) -> Column:
    return F.struct(kind.alias("kind"), parts.alias("parts"))


def xy(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def point(x, y) -> Column:
    return _geom(F.lit("Point"), F.array(F.array(F.array(xy(x, y)))))


def line(points) -> Column:
    """LineString of an array of struct(x, y)."""
    return _geom(F.lit("LineString"), F.array(F.array(_c(points))))


def polygon(*rings) -> Column:
    return _geom(F.lit("Polygon"), F.array(F.array(*[_c(r) for r in rings])))


def box(xmin, ymin, xmax, ymax) -> Column:
    """Polygon of a box, closed."""
    return polygon(F.array(xy(xmin, ymin), xy(xmax, ymin), xy(xmax, ymax), xy(xmin, ymax), xy(xmin, ymin)))


def points(geom) -> Column:
    """All points, in order."""
    return F.flatten(F.flatten(_c(geom)["parts"]))


def each_point(geom, f: Callable[[Column], Column]) -> Column:
    """The geometry with f applied to every struct(x, y); nesting kept (V06's frame)."""
    parts = F.transform(_c(geom)["parts"], lambda p: F.transform(p, lambda r: F.transform(r, f)))
    return F.when(_c(geom).isNotNull(), _geom(_c(geom)["kind"], parts))


def each_ring(geom, f: Callable[[Column], Column]) -> Column:
    """The geometry with f applied to every array of points."""
    parts = F.transform(_c(geom)["parts"], lambda p: F.transform(p, f))
    return F.when(_c(geom).isNotNull(), _geom(_c(geom)["kind"], parts))


def bbox(geom) -> Column:
    """struct(xmin, ymin, xmax, ymax); nulls without points."""
    xs, ys = F.transform(points(geom), lambda p: p["x"]), F.transform(points(geom), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def bbox_intersects(geom, env) -> Column:
    """The boxes meet, edges included."""
    b, e = bbox(geom), _c(env)
    return (b["xmin"] <= e["xmax"]) & (b["xmax"] >= e["xmin"]) & (b["ymin"] <= e["ymax"]) & (b["ymax"] >= e["ymin"])


def is_usable(geom) -> Column:
    """Not null, of a known kind, with points, all numbers finite; lines of two points or more; rings closed, of
    four points or more. Whether rings cross themselves or each other is ``shapes.is_valid``'s."""
    g = _c(geom)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rings = F.flatten(g["parts"])
    closed = F.forall(rings, lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)))
    long_ = F.forall(rings, lambda r: F.size(r) >= 2)
    shape = F.when(g["kind"].isin("Polygon", "MultiPolygon"), closed).when(g["kind"].isin("LineString", "MultiLineString"), long_).otherwise(True)
    return F.coalesce(g["kind"].isin(*KINDS) & (F.size(points(g)) > 0) & F.forall(points(g), lambda p: finite(p["x"]) & finite(p["y"])) & shape, F.lit(False))


def reproject(geom, source: str, target: str) -> Column:
    """Between lonlat and mercator."""
    if source == target:
        return _c(geom)
    if (source, target) == ("lonlat", "mercator"):
        return each_point(geom, lambda p: F.struct(grid.lonlat_to_mercator(p["x"], p["y"])["mx"].alias("x"), grid.lonlat_to_mercator(p["x"], p["y"])["my"].alias("y")))
    if (source, target) == ("mercator", "lonlat"):
        return each_point(geom, lambda p: F.struct(grid.mercator_to_lonlat(p["x"], p["y"])["lon"].alias("x"), grid.mercator_to_lonlat(p["x"], p["y"])["lat"].alias("y")))
    raise ValueError(f"can't go from {source} to {target}")


def transform_coords(geom, fx: Callable[[Column, Column], Column], fy: Callable[[Column, Column], Column]) -> Column:
    """Any function of the coordinates."""
    return each_point(geom, lambda p: xy(fx(p["x"], p["y"]), fy(p["x"], p["y"])))


def quantize(geom, env, extent: int = 4096) -> Column:
    """Coordinates in 0..extent of a box, from its lower-left corner, y up."""
    e = _c(env)
    return each_point(geom, lambda p: xy((p["x"] - e["xmin"]) * extent / (e["xmax"] - e["xmin"]), (p["y"] - e["ymin"]) * extent / (e["ymax"] - e["ymin"])))


def round_coords(geom, digits=6) -> Column:
    """Fixed decimals; digits a number, or a Column such as zoom_precision(z)."""
    if isinstance(digits, int):
        return each_point(geom, lambda p: xy(F.round(p["x"], digits), F.round(p["y"], digits)))
    # the scale is bound to a lambda's argument, so that it is computed once a row, not once a point
    bound = F.array(F.struct(_c(geom).alias("g"), F.pow(F.lit(10.0), _c(digits)).alias("s")))
    return F.get(F.transform(bound, lambda v: each_point(v["g"], lambda p: xy(F.round(p["x"] * v["s"]) / v["s"], F.round(p["y"] * v["s"]) / v["s"]))), F.lit(0))


def topo_quantize(geom, env, size: int = 1024) -> Column:
    """Integers (as doubles) round((v - min) / (span / size)), halves to even."""
    e = _c(env)
    at = lambda v, lo, hi: F.rint((v - lo) / ((hi - lo) / size))
    return each_point(geom, lambda p: xy(at(p["x"], e["xmin"], e["xmax"]), at(p["y"], e["ymin"], e["ymax"])))


def topo_transform(env, size: int = 1024) -> Column:
    """struct(translate, scale)."""
    e = _c(env)
    return F.struct(
        F.array(e["xmin"], e["ymin"]).alias("translate"), F.array((e["xmax"] - e["xmin"]) / size, (e["ymax"] - e["ymin"]) / size).alias("scale")
    )


def delta_encode(ring) -> Column:
    """The first point, then the moves between points, without moves of zero."""
    r = _c(ring)
    moves = F.transform(r, lambda p, i: F.when(i == 0, p).otherwise(F.struct((p["x"] - F.get(r, i - 1)["x"]).alias("x"), (p["y"] - F.get(r, i - 1)["y"]).alias("y"))))
    return F.filter(moves, lambda p, i: (i == 0) | (p["x"] != 0) | (p["y"] != 0))


def _number(v: Column, digits: int | None) -> Column:
    return v.cast("string") if digits is None else F.format_string(f"%.{digits}f", v)


def coordinates_json(geom, digits: int | None = 6) -> Column:
    """The GeoJSON coordinates of any kind, as text."""
    g = _c(geom)
    pt = lambda p: F.concat(F.lit("["), _number(p["x"], digits), F.lit(","), _number(p["y"], digits), F.lit("]"))
    many = lambda a, f: F.concat(F.lit("["), F.array_join(F.transform(a, f), ","), F.lit("]"))
    ring = lambda r: many(r, pt)
    part = lambda p: many(p, ring)
    first = lambda a: F.get(a, F.lit(0))
    k = g["kind"]
    return (
        F.when(k == "Point", pt(first(first(first(g["parts"])))))
        .when(k == "MultiPoint", many(g["parts"], lambda p: pt(first(first(p)))))
        .when(k == "LineString", ring(first(first(g["parts"]))))
        .when(k == "MultiLineString", many(g["parts"], lambda p: ring(first(p))))
        .when(k == "Polygon", part(first(g["parts"])))
        .when(k == "MultiPolygon", many(g["parts"], part))
    )


def geometry_json(geom, digits: int | None = 6) -> Column:
    return F.concat(F.lit('{"type":"'), _c(geom)["kind"], F.lit('","coordinates":'), coordinates_json(geom, digits), F.lit("}"))


def feature_json(geom, props, id_=None, digits: int | None = 6, clipped=None) -> Column:
    """A GeoJSON Feature as text. props: JSON text, or a struct or map; an integer id is a number, other ids are
    text; ``clipped: true`` where asked for."""
    p = _c(props)
    text = F.coalesce(p, F.lit("{}"))
    parts = [F.lit('{"type":"Feature","properties":'), text, F.lit(',"geometry":'), geometry_json(geom, digits)]
    if id_ is not None:
        i = _c(id_).cast("string")
        parts.append(F.when(i.isNull(), "").otherwise(F.concat(F.lit(',"id":'), F.when(i.rlike(r"^-?\d{1,18}$"), i).otherwise(F.to_json(F.array(i)).substr(F.lit(2), F.length(F.to_json(F.array(i))) - 2)))))
    if clipped is not None:
        parts.append(F.when(_c(clipped), ',"clipped":true').otherwise(""))
    return F.concat(*parts, F.lit("}"))


ESRI = {"Point": "esriGeometryPoint", "LineString": "esriGeometryPolyline", "Polygon": "esriGeometryPolygon", "MultiPoint": "esriGeometryMultipoint", "MultiLineString": "esriGeometryPolyline", "MultiPolygon": "esriGeometryPolygon"}


def esri_type(geom) -> Column:
    """The Esri name of the geometry's kind."""
    out = F.lit(None).cast("string")
    for k, v in ESRI.items():
        out = F.when(_c(geom)["kind"] == k, v).otherwise(out)
    return out


def to_esri(geom, digits: int | None = 6) -> Column:
    """Esri JSON: x and y, points, paths or rings; a MultiPolygon's rings follow each other."""
    g = _c(geom)
    pt = lambda p: F.concat(F.lit("["), _number(p["x"], digits), F.lit(","), _number(p["y"], digits), F.lit("]"))
    many = lambda a, f: F.concat(F.lit("["), F.array_join(F.transform(a, f), ","), F.lit("]"))
    rings = F.flatten(g["parts"])
    p0 = F.get(points(g), F.lit(0))
    return (
        F.when(g["kind"] == "Point", F.concat(F.lit('{"x":'), _number(p0["x"], digits), F.lit(',"y":'), _number(p0["y"], digits), F.lit("}")))
        .when(g["kind"] == "MultiPoint", F.concat(F.lit('{"points":'), many(points(g), pt), F.lit("}")))
        .when(g["kind"].isin("LineString", "MultiLineString"), F.concat(F.lit('{"paths":'), many(rings, lambda r: many(r, pt)), F.lit("}")))
        .when(g["kind"].isin("Polygon", "MultiPolygon"), F.concat(F.lit('{"rings":'), many(rings, lambda r: many(r, pt)), F.lit("}")))
    )


def select_properties(columns: dict[str, str] | list[str] | None, available: list[str], skip_empty: bool = False, types: dict[str, str] | None = None) -> Column:
    """Properties as JSON text. A list names the fields to keep, a dict renames them too, None takes all available
    ones; geometry and id columns are the caller's to leave out. skip_empty drops null fields. Decimal, interval, map
    and binary fields (by ``types``) are an error."""
    names = {c: c for c in available} if columns is None else dict(columns) if isinstance(columns, dict) else {c: c for c in columns}
    for c in names:
        kind = (types or {}).get(c, "string")
        if kind.split("(")[0].split("<")[0] in ("decimal", "interval", "map", "binary", "void") or "interval" in kind:
            raise TypeError(f"field {c} has the unsupported type {kind}")
    fields = [F.col(c).alias(n) for c, n in names.items() if c in available]
    if not fields:
        return F.lit("{}")
    return F.to_json(F.struct(*fields), {"ignoreNullFields": str(skip_empty).lower()})
