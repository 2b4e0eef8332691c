"""Features from a database over JDBC. Comparisons on the result (such as a bbox) are pushed to the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_features_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, driver: str | None = None, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """One of table and query is required. partition: (column, lower, upper, parts) reads in parallel; a query can be
    partitioned as well (it is wrapped as a table)."""
    if not url:
        raise ValueError("a database url is needed")
    if (table is None) == (query is None):
        raise ValueError("exactly one of table and query is needed")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if driver:
        reader = reader.option("driver", driver)
    if partition:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    if query is not None and not partition:
        return reader.option("query", query).load()
    return reader.option("dbtable", table if query is None else f"({query}) features").load()
