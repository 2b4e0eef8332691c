"""Tile lists, trees and archives.

The archive is the common SQLite layout (metadata and tiles tables, rows counted from the bottom), read in parallel by
ranges of zoom and column, which its index serves, through a Python data source (``spark.read.format("mbtiles")``) and written as one archive a partition or
as a Parquet tile set.
"""

from __future__ import annotations

import contextlib
import glob
import gzip
import os
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tilework.functions.paths import tile_disk_path

FORMATS = ("png", "jpg", "json", "pbf")
REQUIRED = ("name", "type", "version", "description", "format")
TILES = "z int, x int, y int, format string, body binary"


# ---- lists -----------------------------------------------------------------------------------------------------------


def read_tile_list(spark: SparkSession, path: str) -> DataFrame:
    """Z, x, y of a text file of Z/X/Y lines; other lines are left out."""
    parts = F.split(F.trim("value"), "/")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\d+/-?\d+/-?\d+$"))
    return rows.select(*[F.get(parts, F.lit(i)).cast("int").alias(k) for i, k in enumerate(("z", "x", "y"))])


def tile_list(tiles: DataFrame) -> DataFrame:
    """The lines of a tile list."""
    return tiles.select(F.format_string("%d/%d/%d", "z", "x", "y").alias("value"))


def write_tile_list(tiles: DataFrame, path: str) -> None:
    tile_list(tiles).write.mode("overwrite").text(path)


# ---- trees of files --------------------------------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def gunzip(body: pd.Series) -> pd.Series:
    return body.map(lambda b: None if b is None else gzip.decompress(bytes(b)) if bytes(b[:2]) == b"\x1f\x8b" else bytes(b))


def parse_tree_path(path, layout: str = "safe"):
    """layer, z, x, y, ext, gz of a file's path below the cache folder, as a struct of nullable fields."""
    forms = {"safe": r"([^/]+)/(\d+)/(\d{3})/(\d{3})/(\d{3})/(\d{3})\.(\w+?)(\.gz)?$", "portable": r"([^/]+)/(\d+)/(-?\d+)/(-?\d+)\.(\w+?)(\.gz)?$", "quadtile": r"([^/]+)/((?:[0-3]{3}/)*[0-3]{1,3})\.(\w+?)(\.gz)?$"}
    if layout not in forms:
        raise ValueError(f"unknown layout: {layout}")
    part = lambda i: F.regexp_extract(path, forms[layout], i)
    if layout == "safe":
        layer, z, x, y, ext, gz = part(1), part(2), F.concat(part(3), part(4)), F.concat(part(5), part(6)), part(7), part(8)
    elif layout == "portable":
        layer, z, x, y, ext, gz = (part(i) for i in range(1, 7))
    else:
        digits = F.replace(part(2), F.lit("/"), F.lit(""))
        bits = F.transform(F.split(digits, ""), lambda d: F.when(d != "", d).cast("int"))
        bits = F.filter(bits, lambda d: d.isNotNull())
        number = lambda f: F.aggregate(bits, F.lit(0), lambda a, d: a * 2 + f(d))
        layer, z, ext, gz = part(1), F.size(bits) - 1, part(3), part(4)
        x, y = number(lambda d: d % 2), number(lambda d: F.floor(d / 2).cast("int"))
    return F.struct(layer.alias("layer"), z.cast("int").alias("z"), x.cast("int").alias("x"), y.cast("int").alias("y"), ext.alias("ext"), (gz != "").alias("gz"))


def read_tile_tree(spark: SparkSession, path: str, layout: str = "safe") -> DataFrame:
    """Layer, z, x, y, format, body, size, mtime of the tiles below a folder; gzipped bodies are unpacked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.withColumn("p", parse_tree_path(F.col("path"), layout)).where("p.layer != ''")
    plain = rows.where("NOT p.gz").withColumn("body", F.col("content"))
    packed = rows.where("p.gz").withColumn("body", gunzip("content"))
    return plain.unionByName(packed).select("p.layer", "p.z", "p.x", "p.y", F.col("p.ext").alias("format"), "body", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def write_tile_tree(tiles: DataFrame, path: str, layout: str = "safe", gzipped: tuple[str, ...] = ("txt", "text", "json", "xml")) -> None:
    """Files of tiles (layer, z, x, y, format, body) below a folder that all executors share; each is written beside
    its place and renamed, so a repeated or lost task does no harm."""
    zipped = F.lower("format").isin([g.lower() for g in gzipped])
    rows = tiles.select(tile_disk_path("layer", "z", "x", "y", "format", layout, zipped).alias("p"), zipped.alias("gz"), F.col("body").cast("binary").alias("body"))

    def save(part):
        for r in part:
            target = os.path.join(path, r["p"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            own = f"{target}.{os.getpid()}.tmp"
            body = bytes(r["body"] or b"")
            with open(own, "wb") as f:
                f.write(gzip.compress(body, mtime=0) if r["gz"] else body)
            os.replace(own, target)

    rows.foreachPartition(save)


# ---- archives --------------------------------------------------------------------------------------------------------


#: The archive's tables and the columns that are read.
LAYOUT = {"metadata": {"name", "value"}, "tiles": {"zoom_level", "tile_column", "tile_row", "tile_data"}}


def tileset_exists(path: str) -> bool:
    """Whether a file is an archive: both tables (or views) have the needed columns."""
    if not os.path.isfile(path):
        return False
    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        try:
            return all(need <= {name for (name,) in db.execute("SELECT name FROM pragma_table_info(?)", (table,))} for table, need in LAYOUT.items())
        except sqlite3.DatabaseError:  # not a database at all
            return False


def tileset_info(path: str) -> dict[str, str | None]:
    """Name, type, version, description, format and bounds."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        found = dict(db.execute("SELECT name, value FROM metadata"))
    return {k: found.get(k) for k in (*REQUIRED, "bounds")}


def create_tileset(path: str, meta: dict[str, str]) -> None:
    """An empty archive with its metadata row."""
    missing = [k for k in REQUIRED if k not in meta]
    if missing:
        raise ValueError(f"metadata needs {', '.join(missing)}")
    if meta["format"] not in FORMATS:
        raise ValueError(f"unknown format: {meta['format']}")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
        db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
        db.execute("CREATE UNIQUE INDEX tile_key ON tiles (zoom_level, tile_column, tile_row)")
        db.executemany("INSERT INTO metadata VALUES (?, ?)", [(k, v) for k, v in meta.items() if k in (*REQUIRED, "bounds")])


class _Part(InputPartition):
    def __init__(self, path: str, zoom: int, low: int, high: int):
        self.path, self.zoom, self.low, self.high = path, zoom, low, high


class _Reader(DataSourceReader):
    """Ranges of columns of one zoom. A zoom's columns between its first and last are cut into equal parts, as many as
    options.partitions at most; zooms are looked up one after the other in the index, so no tile is read for planning."""

    def __init__(self, options):
        self.given = [p for p in options["path"].split(",") if p]
        self.parts = max(1, int(options.get("partitions", "8")))

    def archives(self) -> list[str]:
        """The archives named, and those in folders named (as the writer leaves them)."""
        return [a for p in self.given for a in (sorted(glob.glob(os.path.join(glob.escape(p), "*.mbtiles"))) if os.path.isdir(p) else [p])]

    def partitions(self):
        out = []
        for p in self.archives():
            with contextlib.closing(sqlite3.connect(f"file:{p}?mode=ro", uri=True)) as db:
                first = lambda q, *a: db.execute(q, a).fetchone()[0]  # noqa: B023, E731
                z = first("SELECT min(zoom_level) FROM tiles")
                while z is not None:
                    low, high = (first(f"SELECT {f}(tile_column) FROM tiles WHERE zoom_level = ?", z) for f in ("min", "max"))
                    step = -(-(high - low + 1) // self.parts)
                    out += [_Part(p, z, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
                    z = first("SELECT min(zoom_level) FROM tiles WHERE zoom_level > ?", z)
        return out or [_Part("", 0, 0, -1)]

    def read(self, part):
        if not part.path:  # no tile anywhere
            return
        with contextlib.closing(sqlite3.connect(f"file:{part.path}?mode=ro", uri=True)) as db:
            kind = (db.execute("SELECT value FROM metadata WHERE name = 'format'").fetchone() or [None])[0]
            q = "SELECT zoom_level, tile_column, (1 << zoom_level) - 1 - tile_row, tile_data FROM tiles WHERE zoom_level = ? AND tile_column BETWEEN ? AND ?"
            for z, x, y, body in db.execute(q, (part.zoom, part.low, part.high)):
                yield z, x, y, kind, bytes(body) if not isinstance(body, str) else body.encode()


class _Done(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    """One archive a partition: path/part-00000.mbtiles and so on, in a folder that all executors share."""

    def __init__(self, options):
        self.path, self.meta = options["path"], {k: options[k] for k in (*REQUIRED, "bounds") if k in options}

    def write(self, rows):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        target = os.path.join(self.path, f"part-{n:05d}.mbtiles")
        os.makedirs(self.path, exist_ok=True)
        own = f"{target}.{os.getpid()}.tmp"
        if os.path.exists(own):
            os.remove(own)
        create_tileset(own, self.meta)
        with sqlite3.connect(own) as db:
            db.executemany("REPLACE INTO tiles VALUES (?, ?, (1 << ?) - 1 - ?, ?)", ((r["z"], r["x"], r["z"], r["y"], bytes(r["body"] or b"")) for r in rows))
        db.close()
        os.replace(own, target)
        return _Done()


class TileArchive(DataSource):
    """``spark.read.format("mbtiles").load(path)``; options partitions, and for writing the metadata."""

    @classmethod
    def name(cls):
        return "mbtiles"

    def schema(self):
        return TILES

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileArchive)


def read_mbtiles(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """Z, x, y (from the top), format, body of archives (paths between commas) or folders of them."""
    register(spark)
    return spark.read.format("mbtiles").option("partitions", partitions).load(path)


def write_mbtiles(tiles: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Archives of the tiles (z, x, y, body), one a partition. Repartition by tile key first if keys may repeat."""
    register(tiles.sparkSession)
    missing = [k for k in REQUIRED if k not in meta]
    if missing or meta["format"] not in FORMATS:
        raise ValueError(f"metadata needs {', '.join(REQUIRED)} with a format of {', '.join(FORMATS)}")
    rows = tiles.select("z", "x", "y", F.lit(meta["format"]).alias("format"), F.col("body").cast("binary").alias("body"))
    rows.write.format("mbtiles").options(**meta).mode("append").save(path)


def write_tileset(tiles: DataFrame, path: str, meta: dict[str, str]) -> None:
    """The tile set as Parquet partitioned by zoom (dynamic overwrite: only the zooms that tiles has are replaced)
    with a metadata table beside it."""
    missing = [k for k in REQUIRED if k not in meta]
    if missing or meta["format"] not in FORMATS:
        raise ValueError(f"metadata needs {', '.join(REQUIRED)} with a format of {', '.join(FORMATS)}")
    tiles.write.partitionBy("z").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/tiles")
    spark = tiles.sparkSession
    spark.createDataFrame(sorted(meta.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def read_tileset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tiles")
