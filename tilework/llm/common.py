"""Shared parts: words, scratch tables, size-checked joins, running sums over an order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space and the controls \x09-\x0D (Java's \s is the same six characters).
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only when a count shows that it has no more rows than this (narrow rows only).
BROADCAST_ROWS = 200_000
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of a text's words; null text: no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of a text's words (null: 0), without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all machines share: the session's spark.checkpoint.dir. Only where it is unset on one machine,
    as in tests, a new local folder is taken and set; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table written to the shared folder: lineage ends there and lost executors cost nothing.
    The folder's owner clears it; ``dropped`` removes a table that is surely not needed any more."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table of ``written``."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), with batches of BATCH_BYTES at most (the session's own bound, if lower, stays): an
    executor and its Python workers each hold a batch a task, and texts are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    current = re.match(r"\d+", conf.get(key))
    if current is None or not 0 < int(current[0]) <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table, with a broadcast hint if its counted rows are few enough; else as it is (a shuffle join)."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fixed_hash(*cols: Column) -> Column:
    """52 bits of md5 as a long: the same number in any SQL engine, so an oracle can repeat the draw."""
    text = F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def running(df: DataFrame, order: list[str], amounts: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Adds, for each name -> amount, the sum of the amounts of all rows before this one in ``order``.

    No task sees more than a range of the order: rows are range-partitioned and written with their range's number,
    each range's total is summed, the totals (one row a range) are accumulated, and a window runs inside each range.
    ``order`` has to be total for a defined result; rows equal in all of it may come in any order among themselves.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns({f"_a_{k}": v for k, v in amounts.items()}).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_a_{k}").alias(f"_t_{k}") for k in amounts])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in amounts])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "_range")
    sums = {k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_a_{k}").over(inside), F.lit(0)) for k in amounts}
    return out.select(*df.columns, *[v.alias(k) for k, v in sums.items()])
