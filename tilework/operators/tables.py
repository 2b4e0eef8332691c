"""Intermediate tables, and sums over an order that no single task sees whole."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when a count shows that it has no more rows than this (narrow rows only).
BROADCAST_ROWS = 200_000


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all machines share; a new local folder where it is unset on one machine,
    as in tests; an error where it is unset on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, with no lineage behind them."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if its counted rows are few, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt over all shuffle partitions (by keys, if any): before a step that makes many rows of one, or much work. A
    small file is one partition else, whatever the cluster."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sums_before(df: DataFrame, order: list, amounts: dict[str, Column]) -> DataFrame:
    """Adds, for each name -> amount, the sum over all rows before this one in ``order`` (names or Columns).

    Rows are dealt out by ranges of the order and written with their range's number; only the ranges' totals, a row a
    partition, come together, and a window runs inside each range. A hot value of the first column is cut by the others."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_o{i}": (F.col(o) if isinstance(o, str) else o) for i, o in enumerate(order)}
    rows = df.withColumns({**keys, **{f"_a_{k}": v for k, v in amounts.items()}}).repartitionByRange(n, *keys)
    rows = written(rows.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("_range").agg(*[F.sum(f"_a_{k}").alias(f"_t_{k}") for k in amounts])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in amounts])
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(starts), "_range")
    sums = [(F.col(f"_b_{k}") + F.coalesce(F.sum(f"_a_{k}").over(inside), F.lit(0))).alias(k) for k in amounts]
    return out.select(*df.columns, *sums)


def _passing(group: list[str], amounts: dict[str, str]):
    """A mapInArrow function for rows in the order of their groups: adds the sums over the rows before in the group, as far as the task has
    seen it, and whether the group is the task's first."""

    def run(batches):
        key, seen, carry = None, 0, dict.fromkeys(amounts, 0)
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in group]
            new = np.zeros(b.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[0] = key != tuple(c[0] for c in cols)
            run_of, sums = np.cumsum(new), []
            for name, amount in amounts.items():
                v = b.column(amount).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(v) - v
                sums.append(before - np.concatenate([[-carry[name]], before[new]])[run_of])
                carry[name] = int(sums[-1][-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, sums), pa.array(run_of + seen == 1)], [*b.schema.names, *amounts, "_first"])
            key, seen = tuple(c[-1] for c in cols), seen + int(run_of[-1])

    return run


def sums_within(df: DataFrame, group: list[str], order: list[str], amounts: dict[str, str]) -> DataFrame:
    """Adds, for each name -> column of whole numbers, the sum over the rows before this one in its group, in order. df: a written table,
    since it is read for the ranges too.

    Rows are dealt out by ranges of group and order, sorted, summed as they pass and written once, so that no task holds a group. Only a range's
    first group may go on from the ranges before; what they had of it, at most a row a range, is broadcast."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order).withColumn("_range", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, *[T.StructField(k, T.LongType()) for k in amounts], T.StructField("_first", T.BooleanType())])
    rows = written(rows.mapInArrow(_passing(group, amounts), schema), "sums")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in amounts.items()], F.max("_first").alias("_first"))
    starts = totals.select("_range", "_first", *[F.sum(f"_t_{k}").over(before).alias(f"_b_{k}") for k in amounts])
    starts = starts.where(F.col("_first") & F.col(f"_b_{next(iter(amounts))}").isNotNull())
    out = rows.join(F.broadcast(starts), ["_range", "_first"], "left")
    return out.select(*df.columns, *[(F.col(k) + F.coalesce(f"_b_{k}", F.lit(0))).alias(k) for k in amounts])
