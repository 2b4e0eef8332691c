"""Tables of points of which areas are replaced batch by batch, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilework.functions import grid
from tilework.operators.store import replace_area
from tilework.operators.tables import small, written


class AreaTable:
    """Rows with a location under ``path``, in Parquet folders by batch and area (tiles of the zoom ``coarse``).

    A batch writes the areas that it touches anew, then, last of all, a log of which areas those are. Readers take each area from the
    last batch that the log names, so a batch is there as a whole or not at all; what an attempt that failed has written is neither read
    nor kept (its next attempt overwrites it), and a batch in the log is never done again. Only touched areas are read and written."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, zoom: int = 12, coarse: int = 6, x: str = "lon", y: str = "lat"):
        if not 0 <= coarse <= zoom:
            raise ValueError("areas can't be finer than the boxes")
        self.spark, self.path, self.schema, self.zoom, self.coarse, self.x, self.y = spark, path.rstrip("/"), schema, zoom, coarse, x, y

    def _area(self, tx: Column, ty: Column, zoom: int) -> Column:
        step = self.coarse - zoom
        return (F.floor(tx * 2.0**step) * 2**self.coarse + F.floor(ty * 2.0**step)).cast("long")

    def _placed(self, rows: DataFrame) -> DataFrame:
        z = F.lit(self.coarse)
        return rows.withColumn("area", self._area(grid.tile_x(F.col(self.x), z), grid.tile_y(F.col(self.y), z), self.coarse))

    def _log(self) -> DataFrame:
        return self.spark.read.schema("area long, batch long").parquet(f"{self.path}/log")

    def _write(self, rows: DataFrame, areas: DataFrame, batch: int) -> None:
        rows.repartition("area").write.mode("overwrite").partitionBy("area").parquet(f"{self.path}/rows/batch={batch}")
        areas.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def create(self, rows: DataFrame) -> AreaTable:
        """The table's first rows, as batch -1."""
        placed = written(self._placed(rows), "areas")
        self._write(placed, placed.select("area").distinct(), -1)
        return self

    def current(self, areas: DataFrame | None = None) -> DataFrame:
        """The rows as of the last batch, of all areas or of the listed ones (area)."""
        newest = self._log().groupBy("area").agg(F.max("batch").alias("batch"))
        if areas is not None:
            newest = newest.join(areas, "area", "left_semi")
        kept = T.StructType([*self.schema.fields, T.StructField("area", T.LongType()), T.StructField("batch", T.LongType())])
        rows = self.spark.read.schema(kept).parquet(f"{self.path}/rows")
        return rows.join(small(written(newest, "newest")), ["area", "batch"]).select(*self.schema.names)

    def done(self, batch: int) -> bool:
        return not self._log().where(F.col("batch") == batch).isEmpty()

    def replace(self, boxes: DataFrame, staged: DataFrame, batch: int) -> bool:
        """Within the boxes (tiles x, y of the table's zoom): the table's rows go, those of staged come. False, and nothing
        done, if the batch is in the log."""
        if self.done(batch):
            return False
        boxes = written(boxes.select("x", "y").distinct(), "boxes")
        areas = written(boxes.select(self._area(F.col("x"), F.col("y"), self.zoom).alias("area")).distinct(), "touched")
        rows = replace_area(self.current(areas), staged.select(*self.schema.names), boxes, self.zoom, self.x, self.y)
        self._write(self._placed(rows), areas, batch)
        return True


def refresh_areas(stream: DataFrame, table: AreaTable, stage: Callable[[DataFrame, int], DataFrame], checkpoint: str):
    """A stream of changed tiles (x, y of the table's zoom). Each batch's tiles are replaced by the rows that stage(tiles, batch)
    gives for them; a batch that is played again changes nothing."""

    def step(df: DataFrame, n: int) -> None:
        tiles = written(df.select("x", "y").distinct(), "changes")
        if not tiles.isEmpty() and not table.done(n):
            table.replace(tiles, stage(tiles, n), n)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
