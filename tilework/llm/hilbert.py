"""Sharding along a Hilbert curve, with DataFrame functions only.

Each document has a place in a cube of metadata dimensions (source, language, size). A dimension is quantised to
2 ** bits buckets of about equal numbers of rows: a value's bucket is the share of rows with lesser values, null first. The cube's cells
are visited along a Hilbert curve, whose neighbours are neighbours in every dimension, rows are sorted by their cell's
index, and the sorted rows are cut into runs: the shards. A run of the curve is a compact piece of the cube, so the least and
greatest values of every dimension, kept in a manifest, let a reader pass over the shards that a filter on any of them excludes.

The law is ``rows``: shard s has the rows of rank r with floor(r * shards / rows) = s, so that counts are at most one
apart whatever the sizes. Equal texts follow each other where their cells are equal.

Scale: texts are read once, into a narrow written table. A dimension's buckets come from its pre-aggregated counts per value.
Ranks come from range totals (``running``); the order is by index, text hash and id, so that a cell with a third
of all rows is cut into as many ranges as it takes. Values are joined by broadcast where they are few (counted first), else by a
shuffle that adaptive execution can split.

Defined cases: null text has size 1 and crc32 0; a null in a dimension has the dimension's first bucket; rows equal in
index, text hash, size and id take neighbouring slots in any order; an empty table has no shards; extra columns, whatever
their names, are ignored or come along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.llm.common import documents, running, small, written
from tilework.llm.manifest import CRC, crc32_sql

SHARDS, BITS = 8, 6
#: What documents are placed by.
DIMENSIONS = ("source", "lang", "size")


def curve_steps(axes: list[str], bits: int):
    """The steps from a cell's coordinates to its index on the curve, as (name, function of a column getter) that are applied one
    after the other: from the highest bit down, the cube is turned or mirrored so that each octant's curve begins where that
    of the one before ends; the Gray code of what is left, bits interleaved, is the index."""

    def turned(axis: str, q: int):
        """One axis at one bit: where the bit is set the first axis is mirrored below it, else both exchange their lower bits."""
        first, p = axes[0], q - 1
        swap = lambda c: (c(first).bitwiseXOR(c(axis))).bitwiseAND(F.lit(p))
        bit = lambda c: c(axis).bitwiseAND(F.lit(q)) != 0
        if axis == first:
            return [{first: lambda c: F.when(bit(c), c(first).bitwiseXOR(F.lit(p))).otherwise(c(first))}]
        low = {first: lambda c: F.when(bit(c), c(first).bitwiseXOR(F.lit(p))).otherwise(c(first).bitwiseXOR(swap(c))), axis: lambda c: F.when(bit(c), c(axis)).otherwise(c(axis).bitwiseXOR(swap(c)))}
        return [low]

    for b in range(bits - 1, 0, -1):
        for axis in axes:
            yield from turned(axis, 1 << b)
    for before, axis in zip(axes[:-1], axes[1:], strict=True):
        yield {axis: lambda c, a=axis, b=before: c(a).bitwiseXOR(c(b))}

    def flips(c):
        out = F.lit(0)
        for b in range(bits - 1, 0, -1):
            out = out.bitwiseXOR(F.when(c(axes[-1]).bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0))
        return out

    yield {axis: lambda c, a=axis: c(a).bitwiseXOR(flips(c)) for axis in axes}


def with_index(df: DataFrame, axes: list[str], bits: int, name: str = "curve") -> DataFrame:
    """Adds the Hilbert index (bits * axes bits, a long) of the cell whose coordinates are the columns axes, 0 to 2 ** bits - 1. Each
    step is a projection of its own, so that expressions don't nest."""
    work = {a: f"_h{i}" for i, a in enumerate(axes)}
    out = df.withColumns({w: F.col(a).cast("long") for a, w in work.items()})
    for step in curve_steps(list(work.values()), bits):
        out = out.withColumns({w: f(F.col) for w, f in step.items()})
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for w in work.values():
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(w), b).bitwiseAND(F.lit(1)))
    return out.withColumn(name, index).drop(*work.values())


def buckets(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """_v, _q for each value of a dimension: the bucket of the rows with lesser values."""
    counts = rows.groupBy(F.col(name).alias("_v")).agg(F.count("*").alias("_m"))
    before = written(running(counts, ["_v"], {"_before": F.col("_m")}), f"values-{name}")
    total = before.agg(F.sum("_m").alias("n")).first()["n"] or 1
    return before.select("_v", F.floor(F.col("_before") * (1 << bits) / total).cast("int").alias("_q"))


def placed(rows: DataFrame, values: dict[str, DataFrame], bits: int = BITS) -> DataFrame:
    """Adds curve, the index of each row's cell, and cell, its coordinates. values: the buckets of each dimension."""
    axes = []
    for i, (name, table) in enumerate(values.items()):
        table = table.withColumnsRenamed({"_v": f"_v{i}", "_q": f"_q{i}"})
        rows = rows.join(small(table), F.col(name).eqNullSafe(F.col(f"_v{i}"))).drop(f"_v{i}")
        axes.append(f"_q{i}")
    return with_index(rows, axes, bits).withColumn("cell", F.array(*axes)).drop(*axes)


def described(docs: DataFrame, *more: Column) -> DataFrame:
    """What is known of a document without its text: doc_id, source, lang, size (UTF-8 bytes of the text and one), text_crc32."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *more)


def sharded(rows: DataFrame, known: DataFrame | None = None, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """rows (those of described, and others) -> plus curve, cell, shard and slot. known: a written table of the same rows, of which
    buckets and counts are taken, where rows itself isn't one."""
    known = rows if known is None else known
    n, values = known.count(), {name: buckets(known, name, bits) for name in dimensions}
    ranked = running(placed(rows, values, bits), ["curve", "text_crc32", "size", "doc_id"], {"_rank": F.lit(1).cast("long")})
    ranked = ranked.withColumn("shard", F.floor(F.col("_rank") * shards / max(n, 1)).cast("int"))
    return ranked.withColumn("slot", F.col("_rank") - F.ceil(F.col("shard").cast("long") * n / shards)).drop("_rank")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **how) -> DataFrame:
    """The documents in their own columns as Parquet under path/shard=..., and their manifest. Texts move once, to their range of
    the order; a range is written in order by the task that numbers it, so a shard is some files, one after the other."""
    known = written(described(docs), "described")
    rows = sharded(described(docs, F.struct(*docs.columns).alias("_doc")), known, shards, **how)
    rows.select("_doc.*", F.col("shard").alias("shard")).write.partitionBy("shard").parquet(path)
    return shard_manifest(sharded(known, known, shards, **how))


def shard_manifest(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row per shard: rows, bytes, and the least and greatest value of each dimension and whether it has nulls."""
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in dimensions for f in (F.min, F.max)]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in dimensions]
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *bounds, *nulls)


def query(spark, sf_dir: str) -> DataFrame:
    out = sharded(written(described(documents(spark, sf_dir)), "described"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _oracle(axes: tuple[str, ...] = ("x", "y", "z"), bits: int = BITS) -> str:
    """The same steps in SQL, a common table expression each."""
    steps, a = [], axes[0]
    for b in range(bits - 1, 0, -1):
        p = (1 << b) - 1
        for c in axes:
            bit, swap = f"{c} & {1 << b} != 0", f"xor({a}, {c}) & {p}"
            new = {a: f"CASE WHEN {bit} THEN xor({a}, {p}) ELSE xor({a}, {swap}) END", c: f"CASE WHEN {bit} THEN {c} ELSE xor({c}, {swap}) END"} if c != a else {a: f"CASE WHEN {bit} THEN xor({a}, {p}) ELSE {a} END"}
            steps.append(new)
    steps += [{c: f"xor({c}, {b})"} for b, c in zip(axes[:-1], axes[1:], strict=True)]
    flips = "0"
    for b in range(bits - 1, 0, -1):
        flips = f"xor({flips}, CASE WHEN {axes[-1]} & {1 << b} != 0 THEN {(1 << b) - 1} ELSE 0 END)"
    steps.append({c: f"xor({c}, {flips})" for c in axes})
    tables = [f"c{i + 1} AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in step.items())}) FROM c{i})" for i, step in enumerate(steps)]
    index = " | ".join(f"((({c} >> {b}) & 1) << {b * len(axes) + len(axes) - 1 - i})" for b in range(bits) for i, c in enumerate(axes))
    share = f"((rank() OVER (ORDER BY {{0}} NULLS FIRST) - 1) * {1 << bits} // count(*) OVER ())::BIGINT AS {{1}}"
    cells = ", ".join(share.format(v, k) for v, k in zip(DIMENSIONS, axes, strict=True))
    return f"""{CRC},
d AS (SELECT doc_id, source, lang, coalesce(octet_length(encode(text)), 0) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents, tab),
c0 AS (SELECT doc_id, size, text_crc32, {cells} FROM d),
{", ".join(tables)},
i AS (SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, ({index})::BIGINT AS curve, count(*) OVER () AS n FROM c{len(steps)}),
r AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, size, doc_id NULLS FIRST) - 1 AS rank FROM i),
s AS (SELECT *, (rank * {SHARDS} // n)::INTEGER AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY rank) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard, curve FROM s"""


ORACLE = _oracle()
