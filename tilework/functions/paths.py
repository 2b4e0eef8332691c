"""Names of tiles: request paths, disk layouts, store keys, formats (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilework.functions.grid import _c, tile_envelope

PATH = r"^/?(\w.*)/(\d+)/(-?\d+)/(-?\d+)\.(\w+)$"
LAYER = r"^/?(\w.*)/(preview\.html)?$"
STRICT_PATH = r"^/?([^/]\S*)/(\d+)/(\d+)/(\d+)\.(\w+)$"


def parse_tile_path(path, strict: bool = False, fail: bool = False) -> Column:
    """struct(layer, z, x, y, ext) of a request path. ``/layer/`` and ``/layer/preview.html`` give ext html without a
    tile. A path of neither form gives null, or with ``fail`` an error."""
    p, pattern = _c(path), STRICT_PATH if strict else PATH
    part = lambda i: F.regexp_extract(p, pattern, i)
    none = F.lit(None).cast("int")
    shape = lambda layer, z, x, y, ext: F.struct(layer.alias("layer"), z.alias("z"), x.alias("x"), y.alias("y"), ext.alias("ext"))
    tile = shape(part(1), part(2).cast("int"), part(3).cast("int"), part(4).cast("int"), part(5))
    out = F.when(p.rlike(pattern), tile)
    if not strict:
        out = out.when(p.rlike(LAYER), shape(F.regexp_extract(p, LAYER, 1), none, none, none, F.lit("html")))
    return out.otherwise(F.raise_error(F.concat(F.lit("not a tile path: "), p)).cast(_TILE)) if fail else out


_TILE = "struct<layer:string,z:int,x:int,y:int,ext:string>"


def format_tile_path(layer, z, x, y, ext) -> Column:
    """The inverse of parse_tile_path."""
    tile = F.format_string("/%s/%d/%d/%d.%s", _c(layer), _c(z), _c(x), _c(y), _c(ext))
    return F.when(_c(z).isNull(), F.concat(F.lit("/"), _c(layer), F.lit("/preview.html"))).otherwise(tile)


def quadtile(z, x, y) -> Column:
    """z + 1 base-4 digits, each the row's bit * 2 + the column's bit, highest first."""
    z, x, y = _c(z), _c(x), _c(y)
    digit = lambda b: F.call_function("shiftright", y, b).bitwiseAND(1) * 2 + F.call_function("shiftright", x, b).bitwiseAND(1)
    return F.array_join(F.transform(F.sequence(z, F.lit(0)), lambda b: digit(b).cast("string")), "")


def tile_disk_path(layer, z, x, y, ext, layout: str = "safe", gzipped: Column | bool = False) -> Column:
    """Path of a tile's file below the cache folder, in layout safe, portable or quadtile."""
    ext = F.concat(F.lower(_c(ext)), F.when(gzipped if isinstance(gzipped, Column) else F.lit(gzipped), ".gz").otherwise(""))
    if layout == "portable":
        body = F.format_string("%d/%d/%d", _c(z), _c(x), _c(y))
    elif layout == "safe":
        half = lambda v: F.concat(F.substring(F.lpad(_c(v).cast("string"), 6, "0"), 1, 3), F.lit("/"), F.substring(F.lpad(_c(v).cast("string"), 6, "0"), 4, 3))
        body = F.concat(_c(z).cast("string"), F.lit("/"), half(x), F.lit("/"), half(y))
    elif layout == "quadtile":
        body = F.array_join(F.regexp_extract_all(quadtile(z, x, y), F.lit("([0-3]{1,3})"), 1), "/")
    else:
        raise ValueError(f"unknown layout: {layout}")
    return F.concat(_c(layer), F.lit("/"), body, F.lit("."), ext)


def tile_store_key(layer, z, x, y, fmt, kind: str = "memcache", prefix: str = "", revision: int = 0, limit: int = 250) -> Column:
    """Key of a tile in a store. ``memcache``: prefix/revision/layer/z/x/y.format, where a key of ``limit``
    characters or more keeps its first and last hundred and has the SHA-1 of what is between them; ``redis``:
    prefix/layer/z/x/y.format; ``object``: the same with prefix as folder and a lower-case extension."""
    tile = lambda ext: F.concat(F.format_string("%s/%d/%d/%d", _c(layer), _c(z), _c(x), _c(y)), F.lit("."), ext)
    if kind == "object":
        return F.concat(F.lit(prefix.strip("/") + "/"), tile(F.lower(_c(fmt))))
    if kind == "redis":
        return F.concat(F.lit(prefix + "/"), tile(_c(fmt)))
    if kind != "memcache":
        raise ValueError(f"unknown kind of store: {kind}")
    key = F.concat(F.lit(f"{prefix}/{revision}/"), tile(_c(fmt)))
    n = F.length(key)
    middle = F.substring(key, F.lit(101), n - 200)
    return F.when(n < limit, key).otherwise(F.concat(F.substring(key, 1, 100), F.sha1(middle), F.substring(key, n - 99, F.lit(100))))


def in_zoom_range(z, text) -> Column:
    """Z within "a-b", equal to "a", or any for an empty or null range; other text is an error."""
    t, z = F.coalesce(_c(text), F.lit("")), _c(z)
    pattern = r"^(\d+)-(\d+)$"
    two = z.between(F.regexp_extract(t, pattern, 1).cast("int"), F.regexp_extract(t, pattern, 2).cast("int"))
    return (
        F.when(t == "", True)
        .when(t.rlike(pattern), two)
        .when(t.rlike(r"^\d+$"), z == F.when(t.rlike(r"^\d+$"), t).cast("int"))
        .otherwise(F.raise_error(F.concat(F.lit("bad zoom range: "), t)).cast("boolean"))
    )


#: File extensions with their mime types and format names, by family.
FORMATS = {
    "raster": {"png": ("image/png", "PNG"), "jpg": ("image/jpeg", "JPEG")},
    "vector": {
        "geojson": ("text/json", "GeoJSON"), "arcjson": ("text/json", "ArcJSON"), "geobson": ("application/x-bson", "GeoBSON"), "arcbson": ("application/x-bson", "ArcBSON"),
        "geoamf": ("application/x-amf", "GeoAMF"), "arcamf": ("application/x-amf", "ArcAMF"), "wkt": ("text/x-wkt", "WKT"),
    },
    "pyramid": {"mvt": ("application/octet-stream+mvt", "MVT"), "json": ("application/json", "JSON"), "topojson": ("application/json", "TopoJSON"), "pbf": ("application/x-protobuf", "PBF")},
    "archive": {"png": ("image/png", "PNG"), "jpg": ("image/jpeg", "JPEG"), "json": ("text/json", "JSON"), "pbf": ("application/x-protobuf", "PBF")},
}
MAGIC = {"89504E47": "PNG", "FFD8FFE0": "JPEG", "FFD8FFE1": "JPEG", "47494638": "GIF", "49492A00": "TIFF", "4D4D002A": "TIFF"}


def tile_format(ext, family: str = "raster", fail: bool = True) -> Column:
    """struct(mime, format) of an extension; unknown ones are an error, or null without ``fail``."""
    e, known = F.lower(_c(ext)), FORMATS[family]
    out = F.lit(None).cast("struct<mime:string,format:string>")
    if fail:
        out = F.raise_error(F.concat(F.lit(f"no {family} format: "), e)).cast("struct<mime:string,format:string>")
    for k, (mime, name) in known.items():
        out = F.when(e == k, F.struct(F.lit(mime).alias("mime"), F.lit(name).alias("format"))).otherwise(out)
    return out


def content_type(fmt) -> Column:
    """Mime type of a stored tile, by its format in any case; null if unknown."""
    f, out = F.lower(_c(fmt)), F.lit(None).cast("string")
    for k, mime in (("json", "application/json"), ("jpeg", "image/jpeg"), ("jpg", "image/jpeg"), ("png", "image/png")):
        out = F.when(f == k, mime).otherwise(out)
    return out


def sniff_image_format(body) -> Column:
    """PNG, JPEG, GIF or TIFF from the first four bytes, else null."""
    h = F.hex(F.substring(_c(body).cast("binary"), 1, 4))
    out = F.lit(None).cast("string")
    for magic, name in MAGIC.items():
        out = F.when(h == magic, name).otherwise(out)
    return out


def tile_url(template: str, z, x, y, width: int = 256, height: int = 256, srs: str = "EPSG:3857", style: str = "braces") -> Column:
    """A request URL per tile. ``braces``: {Z}/{X}/{Y}; ``dollar``: $xmin, $ymin, $xmax, $ymax, $width, $height, $srs,
    $zoom. Names that aren't known stay as they are."""
    out = F.lit(template)
    if style == "braces":
        for name, v in (("{Z}", z), ("{X}", x), ("{Y}", y)):
            out = F.replace(out, F.lit(name), _c(v).cast("string"))
        return out
    env = tile_envelope(z, x, y)
    number = lambda v: F.format_string("%.6f", v)
    known = {
        "height": F.lit(str(height)), "width": F.lit(str(width)), "srs": F.lit(srs), "xmax": number(env["xmax"]), "xmin": number(env["xmin"]),
        "ymax": number(env["ymax"]), "ymin": number(env["ymin"]), "zoom": _c(z).cast("string"),
    }
    for name, v in known.items():
        out = F.replace(F.replace(out, F.lit("${" + name + "}"), v), F.lit("$" + name), v)
    return out
