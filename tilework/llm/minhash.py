"""MinHash near-duplicates with tensored banding.

Two small collections of half keys, ``half_keys`` each of ``rows`` minhashes, stand for half_keys**2 tables: the key of
table (i, j) combines half key i of the first collection with half key j of the second. So 2 * half_keys * rows
minhashes do the work of half_keys**2 * 2 * rows (here 104 instead of 1352). Two documents of Jaccard similarity s meet
in a table if a half of either side agrees: with probability (1 - (1 - s**rows)**half_keys)**2, 0.9998 at s = 0.85 and
more above.

A table key can only be shared if both its halves are, so halves that nobody shares are dropped before the keys of the
tables are formed; most documents form none. Documents with equal shingle sets are one class from the start (128 bits
of the set), whatever their number. Candidates are verified on the full sets (see links).

Defined cases: null or empty texts have empty sets, are linked with nothing and stay; texts of fewer than k words have
their whole sequence as one shingle; repeated rows are copies; rows that share a doc_id are rows of one document, so
a component's number is the least doc_id of its rows; null doc_ids come last, and a component without any other has the
number null, of which near_duplicates calls all kept and deduplicated keeps one text; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.llm import arrowtext as at
from tilework.llm.common import documents, in_arrow, small, written
from tilework.llm.links import linked


def signature(k: int, rows: int, half_keys: int, seed: int = 11):
    """mapInArrow function: doc_id, _t, text -> doc_id, _t, n, set, set2, halves (2 * half_keys longs)."""

    def run(batches):
        for batch in batches:
            data, offsets = at.utf8(batch.column(2))
            for lo, hi in at.slices(offsets):
                part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = at.words(part, offs)
                values, bounds = at.sets(*at.shingles(at.word_hashes(part, starts, ends), first, k))
                low = at.minhashes(values, bounds[:-1], bounds[1:], 2 * half_keys * rows, seed)
                halves = np.stack([at.fold(low[:, j * rows : (j + 1) * rows], j) for j in range(2 * half_keys)], axis=1)
                key, key2 = at.set_keys(values, bounds)
                flat = pa.array(halves.ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * half_keys), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), pa.array(key), pa.array(key2), lists],
                    names=["doc_id", "_t", "n", "set", "set2", "halves"],
                )

    return run


def signatures(docs: DataFrame, k: int, rows: int, half_keys: int) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), "text")
    return written(in_arrow(d, signature(k, rows, half_keys), "doc_id long, _t long, n long, set long, set2 long, halves array<long>"), "signatures")


def live_halves(classes: DataFrame, half_keys: int) -> DataFrame:
    """node, one, two: of each class the half keys of either side that another class has too."""
    halves = classes.select("node", F.posexplode("halves").alias("side", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("_m")).where("_m > 1").select("half")
    first = F.col("side") < half_keys
    sides = [F.collect_list(F.when(c, F.col("half"))).alias(n) for c, n in ((first, "one"), (~first, "two"))]
    return halves.join(shared, "half").groupBy("node").agg(*sides).where("size(one) > 0 AND size(two) > 0")


def table_keys(halves: DataFrame) -> DataFrame:
    """key, node: the keys of all tables in which a class could meet another."""
    return halves.select("node", F.explode("one").alias("i"), "two").select("node", "i", F.explode("two").alias("j")).select(F.xxhash64("i", "j").alias("key"), "node")


def _numbered(classes: DataFrame) -> DataFrame:
    """classes with node, a number of 64 bits for each that no other has: half of the set's 128 bits, or where two classes
    agree in that, a hash of all of them with the first salt that tells them all apart."""
    node, salt = F.col("set"), 0
    while not classes.select(node.alias("node")).groupBy("node").agg(F.count("*").alias("_m")).where("_m > 1").isEmpty():
        salt += 1
        node = F.xxhash64("set", "set2", "n", F.lit(salt))
    return classes.withColumn("node", node)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 4, half_keys: int = 13) -> DataFrame:
    """One row per row of docs: doc_id, _t (hash of the text), n_shingles, component_id, kept, _root (null: an empty set).

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of k-word shingles (A-Z lower-cased);
    component_id is the least doc_id that links reach, kept is doc_id = component_id.
    """
    s = signatures(docs, k, rows, half_keys)
    # the smallest document of a class stands for it; 128 bits and the size make the class
    classes = s.where("n > 0").groupBy("set", "set2", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_z"), "doc_id", "_t")).alias("rep"), F.first("halves").alias("halves"))
    classes = written(classes.select("set", "set2", "n", F.col("rep.doc_id").alias("doc_id"), F.col("rep._t").alias("_t"), "halves"), "classes")
    classes = _numbered(classes)

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = written(classes.join(nodes, "node").select("node", F.col("doc_id").alias("_id"), F.col("_t").alias("_tt")), "wanted")
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), "text")
        found = d.join(small(wanted), (d["_t"] == F.col("_tt")) & d["doc_id"].eqNullSafe(F.col("_id")))
        return found.select("node", "text").dropDuplicates(["node"])

    roots = linked(table_keys(live_halves(classes, half_keys)), texts_of, k, percent)
    placed = classes.join(roots, "node", "left").select("set", "set2", "n", F.coalesce("root", "node").alias("_root"), "doc_id")
    least = placed.groupBy("_root").agg(F.min("doc_id").alias("component_id"))
    by_set = placed.drop("doc_id").join(least, "_root")
    out = s.select("doc_id", "_t", "n", "set", "set2").join(by_set, ["set", "set2", "n"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "_t", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "_root")


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that stay, in their own columns: of each component the one of the least doc_id; of texts that share
    that id, the one of the least hash; of rows that repeat it, one. Only the decision travels: documents are joined
    with it by id and text, and only rows that are repeated are gathered."""
    kept = near_duplicates(docs, **parameters).where("kept")
    one = kept.groupBy(F.col("doc_id").alias("_id"), F.when(F.col("doc_id").isNull(), F.coalesce("_root", "_t")).alias("_r"))
    # the rows of the least text; a text without words is a component of its own
    verdict = written(one.agg(F.min("_t").alias("_tt")).drop("_r").distinct(), "kept")
    # the row's own columns travel inside a struct, where their names can't meet those of the decision
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs["doc_id"].alias("_d"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_t"))
    same = lambda a, b: a["_d"].eqNullSafe(b["_id"]) & (a["_t"] == b["_tt"])
    rows = d.groupBy(F.col("_d").alias("_id"), F.col("_t").alias("_tt")).agg(F.count("*").alias("_m")).where("_m > 1").drop("_m")
    twice = written(rows, "repeated")
    out = d.join(verdict, same(d, verdict), "left_semi")
    if not twice.isEmpty():
        once = out.join(twice, same(out, twice), "left_anti")
        out = once.unionByName(out.join(twice, same(out, twice), "left_semi").dropDuplicates(["_d", "_t"]))
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM d),
n AS (SELECT doc_id, len(s)::BIGINT AS n, s FROM s),
e AS (SELECT doc_id, n, unnest(s) AS x FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m.b, n.doc_id)) AS component_id,
  least(n.doc_id, coalesce(m.b, n.doc_id)) = n.doc_id AS kept
FROM n LEFT JOIN m ON m.a = n.doc_id
"""
