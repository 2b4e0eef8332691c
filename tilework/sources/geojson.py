"""GeoJSON files as feature tables. S11's XML writer is in operators.osm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.functions.geom import GEOM

_SCHEMA = "type string, features array<struct<type:string,id:string,properties:string,geometry:struct<type:string,coordinates:string>>>"


def geometry_of(kind: Column, coordinates: Column) -> Column:
    """GEOM of a GeoJSON geometry's type and coordinates (JSON text); null for kinds that aren't kept."""
    xy = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, xy)
    d1, d2, d3, d4 = (F.from_json(coordinates, "array<" * n + "double" + ">" * n) for n in (1, 2, 3, 4))
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(xy(d1)))))
        .when(kind == "MultiPoint", F.transform(d2, lambda p: F.array(F.array(xy(p)))))
        .when(kind == "LineString", F.array(F.array(ring(d2))))
        .when(kind == "MultiLineString", F.transform(d3, lambda r: F.array(ring(r))))
        .when(kind == "Polygon", F.array(F.transform(d3, ring)))
        .when(kind == "MultiPolygon", F.transform(d4, lambda p: F.transform(p, ring)))
    )
    return F.when(parts.isNotNull(), F.struct(kind.alias("kind"), parts.alias("parts"))).cast(GEOM)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, geom, props (JSON text) of the Feature members of FeatureCollection files; GeometryCollections are dropped."""
    docs = spark.read.schema(_SCHEMA).option("multiLine", True).json(path)
    f = docs.select(F.explode("features").alias("f")).where("f.type = 'Feature'")
    rows = f.select(F.col("f.id").alias("id"), geometry_of(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geom"), F.coalesce("f.properties", F.lit("{}")).alias("props"))
    return rows.where(F.col("geom").isNotNull())
