"""WARC Merkle fixity audit.

A replica is known by its inventory: file, offset, record_id, length and sha256 of every record that was read from it. Its
tree is built from that alone: a leaf is a range of ``range_bytes`` of a file, whose hash is that of its records' offsets,
lengths, ids and hashes in order; ``fan`` neighbouring nodes in number make a node of the next level, up to one root, which
stands for everything the replica holds, in its place. Two replicas' trees are made independently and compared from the
root: only below nodes that differ are children fetched from both sides and compared, and only in the ranges that
differ at last are records held against each other.

A lost record leaves a hole and a changed one keeps its place, so neighbours' ranges stay equal. Files may have any length: a file
has as many range numbers as the longest one of either replica needs, and numbers without records cost nothing. A range holds so many
records at most as its bytes allow and a node ``fan`` children, so no group grows with the archive. Levels are written
narrow tables, about fan times smaller each. Records as a whole are joined only with the list of differing ranges.

Defined cases, per record by file, offset and record_id: ``ok``, ``corrupt`` (other bytes or length), ``missing`` (the
archive's alone) and ``extra`` (the replica's alone); a record at another offset is missing at the one and extra at the
other; repeats of one record at one offset are told apart by the order of their hashes; null ids
and null payloads are values like others; an empty archive and replica audit to nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.llm.common import running, small, written

FILE_BYTES, RANGE_BYTES, FAN = 1 << 28, 1 << 17, 16
FIELDS = ["file", "offset", "record_id", "length", "sha256"]


def record(record_id: Column, url: Column, body: Column, date: str = "2026-01-01T00:00:00Z") -> Column:
    """The bytes of a WARC 1.0 resource record; date is that of the capture."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """record_id, warc of each page."""
    return pages.select(F.col("page_id").alias("record_id"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("warc"))


def digest(warc: Column) -> Column:
    return F.sha2(warc.cast("binary"), 256)


def laid_out(hashed: DataFrame) -> DataFrame:
    """hashed (record_id, length, sha256 and others) written one after the other, in the order of ids and hashes, to files of
    FILE_BYTES and what the last record needs: adds file and offset."""
    placed = running(hashed, ["record_id", "sha256"], {"_at": F.col("length")})
    placed = written(placed.withColumn("file", F.floor(F.col("_at") / FILE_BYTES).cast("long")), "placed")
    begins = written(placed.groupBy(F.col("file").alias("_f")).agg(F.min("_at").alias("_begin")), "files")
    return placed.join(small(begins), F.col("file") == F.col("_f")).withColumn("offset", F.col("_at") - F.col("_begin")).drop("_at", "_f", "_begin")


def ranges_of(*inventories: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[int, int]:
    """Ranges of a file, as many as the longest file of all the inventories has, a power of two; and the number of files."""
    ends = [i.agg(F.max("offset").alias("at"), F.max("file").alias("file")).first() for i in inventories]
    most = max((e["at"] or 0) for e in ends) // range_bytes + 1
    return 1 << (most - 1).bit_length(), max((e["file"] or 0) for e in ends) + 1


def _range(offset: Column, file: Column, range_bytes: int, ranges: int) -> Column:
    return file * ranges + F.floor(offset / range_bytes).cast("long")


def leaves(inventory: DataFrame, ranges: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """node, hash of an inventory's ranges; a file has as many as ``ranges``."""
    each = F.struct("offset", "record_id", "length", "sha256")
    text = F.transform("c", lambda x: F.concat_ws(":", x["offset"], F.coalesce(x["record_id"].cast("string"), F.lit("none")), x["length"], x["sha256"]))
    out = inventory.groupBy(_range(F.col("offset"), F.col("file"), range_bytes, ranges).alias("node")).agg(F.array_sort(F.collect_list(each)).alias("c"))
    return written(out.select("node", F.sha2(F.array_join(text, "\n"), 256).alias("hash")), "leaves")


def parents(level: DataFrame, fan: int = FAN) -> DataFrame:
    """node, hash of the level above; children are named in it, so that an empty place counts."""
    out = level.groupBy(F.floor(F.col("node") / fan).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"], x["hash"])), "\n")
    return written(out.select(F.col("up").alias("node"), F.sha2(text, 256).alias("hash")), "level")


def tree(inventory: DataFrame, ranges: int, height: int, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> list[DataFrame]:
    """The levels of a replica's tree, ranges first, the root's (node 0) last."""
    levels = [leaves(inventory, ranges, range_bytes)]
    for _ in range(height):
        levels.append(parents(levels[-1], fan))
    return levels


def height_of(nodes: int, fan: int = FAN) -> int:
    """Levels above so many ranges that lead to one root."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // fan), height + 1
    return height


def differing(one: list[DataFrame], two: list[DataFrame], fan: int = FAN) -> DataFrame:
    """node: the ranges in which two trees differ, found from the roots down."""
    bad = None
    for a, b in zip(reversed(one), reversed(two), strict=True):
        if bad is not None:
            up = small(bad.withColumnRenamed("node", "_up"))
            a, b = (x.join(up, F.floor(x["node"] / fan) == F.col("_up")).select("node", "hash") for x in (a, b))
        pairs = a.join(b.withColumnsRenamed({"node": "_node", "hash": "_hash"}), F.col("node") == F.col("_node"), "full")
        bad = written(pairs.where("NOT hash <=> _hash").select(F.coalesce("node", "_node").alias("node")), "differing")
    return bad


def audit(archive: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """One row per record of either inventory: file, offset, record_id, length, sha256 (the archive's, for extra
    records the replica's), range, status."""
    archive, replica = (x.select(*FIELDS) for x in (archive, replica))
    ranges, files = ranges_of(archive, replica, range_bytes=range_bytes)
    height = height_of(ranges * files, fan)
    bad = small(differing(*(tree(x, ranges, height, range_bytes, fan) for x in (archive, replica)), fan))
    at_ = _range(F.col("offset"), F.col("file"), range_bytes, ranges)
    order = Window.partitionBy("file", "offset", "record_id").orderBy("sha256", "length")
    one, two = (x.withColumn("range", at_) for x in (archive, replica))
    inside = [x.join(bad, F.col("range") == F.col("node"), "left_semi").withColumn("copy", F.row_number().over(order)) for x in (one, two)]
    b = inside[1].select(*[F.col(c).alias(f"_{c}") for c in inside[1].columns])
    key = F.col("record_id").eqNullSafe(F.col("_record_id"))
    for c in ("file", "offset", "copy"):
        key = key & (F.col(c) == F.col(f"_{c}"))
    held = inside[0].join(b, key, "full")
    same = (F.col("sha256") == F.col("_sha256")) & (F.col("length") == F.col("_length"))
    status = F.when(F.col("copy").isNull(), "extra").when(F.col("_copy").isNull(), "missing").when(same, "ok").otherwise("corrupt")
    # of a pair's fields the archive's, of extra records the replica's
    fields = [F.when(F.col("copy").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in (*FIELDS, "range")]
    held = held.select(*fields, status.alias("status"))
    return one.join(bad, F.col("range") == F.col("node"), "left_anti").select(*FIELDS, "range", F.lit("ok").alias("status")).unionByName(held)


def damaged(archive: DataFrame, every: int = 64) -> DataFrame:
    """From an inventory with the column changed (the hash that a record has with one byte changed) that of a replica with known
    damage, for exercising the audit: by the id's crc32 modulo every, records are changed (5), lost (9), moved by a byte
    (13), or stand twice (17)."""
    kind = F.crc32(F.col("record_id").cast("string").cast("binary")) % every
    out = archive.withColumn("_k", F.coalesce(kind, F.lit(-1))).where("_k != 9")
    out = out.withColumns({"sha256": F.when(F.col("_k") == 5, F.col("changed")).otherwise(F.col("sha256")), "offset": F.col("offset") + F.when(F.col("_k") == 13, 1).otherwise(0)})
    return out.withColumn("_c", F.explode(F.when(F.col("_k") == 17, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(*FIELDS)


def query(spark, sf_dir: str) -> DataFrame:
    r = records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    flipped = F.expr("overlay(warc PLACING '~' FROM length(warc) - 4)")
    hashed = r.select("record_id", F.octet_length("warc").cast("long").alias("length"), digest(F.col("warc")).alias("sha256"), digest(flipped).alias("changed"))
    archive = written(laid_out(hashed), "archive")
    return audit(archive, damaged(archive)).withColumnRenamed("record_id", "page_id")
