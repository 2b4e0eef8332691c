"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: the sources, in code point order (null last), weigh 5, 2, 1, repeating, and share the words of all documents;
a target stops at 3 times its source's size and the excess is reshared by weight among the rest until none is above.

A source's ratio of target to size gives every document floor(ratio) certain whole copies. The words still missing are
drawn by Pareto order sampling (Rosen 1997): a document's inclusion probability p is proportional to its size, capped
at one (such documents are certain too); its rank is [u / (1 - u)] / [p / (1 - p)] with u a hash of its id and size (of its
text, where it has no id) in (0, 1); the lowest ranks are taken until their words reach the target, the document that crosses it by its nearer
side. So the sample's size is fixed in words, to within half a document.

Scale: words are counted once, into a narrow written table (id, source, size). All per-source decisions need only the
histogram of sizes per source, and one pre-aggregated histogram of rank buckets; ordering row by row happens only
inside the one bucket of a source (about 1/4096 of it) in which the target is crossed. No window ever spans a source.

Defined cases: null text has size 0; a document without words is taken 0 times; null source is a source of its own,
last; rows that repeat id and size, or without an id the text, are drawn alike, all or none; a table without words takes
nothing; extra columns, whatever their names, are ignored or come along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.llm.common import documents, fixed_hash, n_words, small, written

MAX_RATIO = 3
BUCKETS = 4096


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> plus target.

    Under water-filling the capped sources are those of the smallest size for their weight. With the sources in that
    order, level(i) = (all words - 3 * sizes before i) / (weights from i on) rises while sources are capped and falls
    afterwards, so its maximum is the level words are shared at.
    """
    one, n = F.lit(1), F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("_w", F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), (n - one) % 3 + one))
    order = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) - MAX_RATIO * before) / rest
    w = w.withColumn("_level", level).withColumn("_level", F.max("_level").over(Window.partitionBy()))
    return w.select("source", "source_size", F.least(F.col("source_size") * float(MAX_RATIO), F.col("_w") * F.col("_level")).alias("target"))


def _size_factors(hist: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to plan: c, with p = least(1, c * size), so that the sum of p * size is the source's missing words.

    For each size v as the largest that isn't capped, c(v) = (missing - words of larger ones) / (squares up to v);
    the largest v with c(v) * v <= 1 is the right one. hist has a row per source and size.
    """
    h = hist.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).where("missing > 0 AND size > 0")
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("size")
    words = F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger), F.lit(0))
    squares = F.sum(F.col("size").cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")).over(upto)
    h = h.withColumn("c", (F.col("missing") - words) / squares.cast("double")).where("c * size <= 1")
    best = h.groupBy(F.col("source").alias("_s")).agg(F.max_by("c", "size").alias("c"))
    return plan.join(best, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Adds _key, struct(rank, doc_id, size, draw), null where nothing can be drawn."""
    u = (fixed_hash(F.col("draw"), F.col("size"), F.lit(seed)) + 0.5) / float(1 << 52)
    p = F.least(F.lit(1.0), F.col("c") * F.col("size"))
    rank = u * (1 - p) / ((1 - u) * p)
    key = F.struct(rank.alias("rank"), F.col("doc_id"), F.col("size"), F.col("draw"))
    return rows.withColumn("_key", F.when((F.col("missing") > 0) & (F.col("c") > 0) & (F.col("size") > 0), key))


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_s")
    return rows.join(small(plan), rows["source"].eqNullSafe(plan["_s"]), "left").drop("_s")


def mix_plan(sized: DataFrame, seed: int = 1) -> DataFrame:
    """One row per source: source, source_size, target, certain, missing, c, cutoff (the last key that is taken).

    sized: doc_id, source, size, draw (see sizes).
    """
    hist = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    plan = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("certain", F.least(F.lit(MAX_RATIO), ratio).cast("long"))
    plan = written(_size_factors(hist, plan.withColumn("missing", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size")))), "mix-plan")

    ranked = _ranked(_joined(sized, plan), seed).where(F.col("_key").isNotNull())
    ranked = ranked.withColumn("bucket", F.floor(F.col("_key.rank") / (F.col("_key.rank") + 1) * BUCKETS).cast("int"))
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    crossed = sums.where("before < missing AND before + words >= missing").select(F.col("source").alias("_cs"), F.col("bucket").alias("_cb"), "before")
    inside = ranked.join(small(crossed), ranked["source"].eqNullSafe(F.col("_cs")) & (ranked["bucket"] == F.col("_cb")))
    order = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_b", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = inside.where(F.col("_b") + F.col("size") / 2 <= F.col("missing")).groupBy(F.col("source").alias("_cs")).agg(F.max("_key").alias("_last"))
    # where the crossing bucket gives none, everything below the bucket is taken; without a crossing, everything is
    edge = crossed.select(F.col("_cs").alias("_es"), (F.col("_cb") / (BUCKETS - F.col("_cb"))).alias("_edge"))
    out = plan.join(last, F.col("source").eqNullSafe(F.col("_cs")), "left").join(edge, F.col("source").eqNullSafe(F.col("_es")), "left")
    out = out.withColumns({"_low": F.coalesce(F.col("_edge"), F.lit(float("inf")))}).drop("_cs", "_es", "_edge")
    return written(out.withColumnsRenamed({"_last": "cutoff", "_low": "below"}), "mix-cutoffs")


def with_copies(rows: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """Adds source_size, target and copies to rows (those of sizes and others): a map over the rows."""
    out = _ranked(_joined(rows, plan), seed)
    drawn = F.col("_key").isNotNull() & ((F.col("_key.rank") < F.col("below")) | F.coalesce(F.col("_key") <= F.col("cutoff"), F.lit(False)))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + F.when(drawn, 1).otherwise(0)).otherwise(0).cast("long"))
    return out.drop("certain", "missing", "c", "cutoff", "below", "_key")


def _sized(text: str) -> list[Column]:
    """doc_id, source, size and draw, what a document's draw is made of: its id, or without one its text's hash."""
    draw = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null/"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return [F.col("doc_id"), F.col("source"), n_words(F.col(text)).alias("size"), draw.alias("draw")]


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, draw, written once so that the texts are read once."""
    return written(docs.select(*_sized(text)), "sizes")


def mixed(docs: DataFrame, text: str = "text", seed: int = 1) -> DataFrame:
    """The mix itself: the documents in their own columns, each as often as it is taken."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), *_sized(text))
    out = with_copies(rows, mix_plan(sizes(docs, text), seed), seed).where("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    sized = sizes(documents(spark, sf_dir))
    out = with_copies(sized, mix_plan(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, w * max(level) OVER ()) AS target FROM l),
m AS (SELECT *, least(3, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS certain FROM t),
n AS (SELECT *, greatest(0.0::DOUBLE, target - certain * source_size) AS missing FROM m),
h AS (SELECT source, size, count(*) AS n FROM d GROUP BY ALL),
k AS (SELECT h.source, size, (missing - coalesce(sum(size * n) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(size::HUGEINT * size * n) OVER (PARTITION BY h.source ORDER BY size))::DOUBLE AS c FROM h JOIN n ON h.source IS NOT DISTINCT FROM n.source WHERE missing > 0 AND size > 0),
f AS (SELECT source, max_by(c, size) AS c FROM k WHERE c * size <= 1 GROUP BY source),
r AS (
  SELECT d.*, source_size, target, certain, missing, (('0x' || substr(md5(doc_id || '/' || size || '/1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u, least(1.0::DOUBLE, f.c * size) AS p
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source),
o AS (SELECT *, CASE WHEN missing > 0 AND p > 0 THEN u * (1 - p) / ((1 - u) * p) END AS rank FROM r),
b AS (SELECT *, CASE WHEN rank IS NOT NULL THEN coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS before FROM o)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE size * (certain + CASE WHEN before + size / 2.0 <= missing THEN 1 ELSE 0 END) END)::BIGINT AS taken FROM b
"""
