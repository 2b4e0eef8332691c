"""From candidate keys to verified links and their components, without all pairs of a group.

1. Star round: in each group of equal keys all nodes are compared with one of its nodes, the one that shares keys with most; of
   all its groups' pivots a node takes the best one, so the round verifies a pair a node at most, whatever the
   groups' sizes. Components of the verified links follow (large-star / small-star rounds, each a shuffle of narrow rows), and
   groups that lie in one component are done.
2. Exact rest: among the nodes of groups that are still open, all pairs of different components that could reach the
   similarity are found by prefix filtering (rare shingles first; two sets of that similarity share one of their few
   rarest, at places that leave room for the overlap) and verified. This join loses no pair and doesn't depend on the
   keys; edited copies that are too far from all others have only rare shingles in their prefixes and meet nobody.
   A pair is formed once, at the first shingle of its prefixes that both have. Nothing is capped.

Texts travel only for nodes that share a key. Joins are plain inner equi-joins, which adaptive execution can split
where a key is hot. Every loop step reads a written table, so lineage stays short and lost executors are cheap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.llm import arrowtext as at
from tilework.llm.common import dropped, in_arrow, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> node, root for every node of an edge; root is the smallest node of its component."""
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = F.struct(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h"))
    before = None
    while (seen := now.agg(sign.alias("s")).first()["s"]) != before:
        before = seen
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        following = written(large.join(low, "u").select(pairs.alias("e")).select("e.u", "e.v").where("u != v").distinct(), "edges")
        dropped(now)
        now = following
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def jaccard_filter(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: rows a, b, text_a, text_b -> the a, b whose k-word shingle sets A, B have
    100 * |A and B| >= percent * |A or B|."""

    def sets_of(texts: pa.Array):
        data, offsets = at.utf8(texts)
        for lo, hi in at.slices(offsets):
            part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, first = at.words(part, offs)
            values, bounds = at.sets(*at.shingles(at.word_hashes(part, starts, ends), first, k))
            for r in range(hi - lo):
                yield values[bounds[r] : bounds[r + 1]]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))  # runs of one a share its set
            left = sets_of(batch.column(2).take(pa.array(new)))
            starts, keep, current = set(new.tolist()), [], None
            for row, right in enumerate(sets_of(batch.column(3))):
                if row in starts:
                    current = next(left)
                if not len(right) or not len(current):
                    continue
                at_ = np.searchsorted(current, right)
                at_[at_ == len(current)] = 0
                both = int(np.count_nonzero(current[at_] == right))
                if 100 * both >= percent * (len(current) + len(right) - both):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on the texts (node, text)."""
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    # a comes last: its rows arrive together, so that its set is built once a run
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return in_arrow(rows, jaccard_filter(k, percent), "a long, b long")


def shingle_sets(k: int):
    """mapInArrow function: node, root, text -> node, root, shingles array<long> (distinct)."""

    def run(batches):
        for batch in batches:
            data, offsets = at.utf8(batch.column(2))
            for lo, hi in at.slices(offsets):
                part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = at.words(part, offs)
                values, bounds = at.sets(*at.shingles(at.word_hashes(part, starts, ends), first, k))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], names=["node", "root", "shingles"])

    return run


def prefix_pairs(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """texts (node, root, text) -> a, b: a superset of the pairs of different roots with 100 * |A and B| >= percent *
    |A or B|, by prefix, size and place."""
    sets = written(in_arrow(texts, shingle_sets(k), "node long, root long, shingles array<long>"), "sets")
    rows = sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("df"))
    ordered = rows.join(often, "s").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("o"))
    # a partner needs ceil(percent / 100 * n) of the shingles, so it has one of the first n - that + 1; shingles that
    # nobody else has keep their places but can't be met
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
    ordered = ordered.select("node", "root", "n", F.slice("o", F.lit(1), reach.cast("int")).alias("o"))
    ordered = ordered.select("node", "root", "n", F.transform("o", lambda v: v["s"]).alias("prefix"), "o")
    ordered = written(ordered.select("node", "root", "n", "prefix", F.filter(F.transform("o", lambda v, i: F.struct(v["df"].alias("df"), v["s"].alias("s"), i.alias("i"))), lambda v: v["df"] > 1).alias("o")), "prefixes")
    side = lambda x: ordered.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "prefix")], F.explode("o").alias("_o")).select("*", F.col("_o.s").alias("s"), F.col("_o.i").alias(f"i_{x}")).drop("_o")
    # |A and B| >= percent / (100 + percent) * (|A| + |B|); from the first shared shingle on there are n - i left
    room = f"{100 + percent} * least(n_a - i_a, n_b - i_b) >= {percent} * (n_a + n_b)"
    first = "NOT arrays_overlap(slice(prefix_a, 1, i_a), slice(prefix_b, 1, i_b))"
    sizes = f"root_a != root_b AND node_a < node_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    pairs = side("a").join(side("b"), "s").where(f"{sizes} AND {room} AND {first}")
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def linked(keys: DataFrame, texts_of: Callable[[DataFrame], DataFrame], k: int, percent: int) -> DataFrame:
    """keys (key, node): candidate groups -> node, root for all nodes with a verified link.

    texts_of: nodes (node) -> their texts (node, text).
    """
    shared = keys.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b"), F.count("*").alias("w")).where("_a != _b").select("key", "w")
    members = written(keys.join(shared, "key").select("key", "node", "w"), "members")
    # the node that shares keys with most others is the nearest to all of its groups
    central = members.groupBy("node").agg(F.sum("w").alias("w"))
    members = written(members.drop("w").join(central, "node").select("key", "node", "w"), "members")
    texts = written(texts_of(members.select("node").distinct()), "texts")
    pivots = members.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("o"), "node")).alias("p"))
    pairs = members.join(pivots, "key").where("node != p.node").groupBy("node").agg(F.min("p").alias("p"))
    edges = written(verified(pairs.select(F.col("p.node").alias("a"), F.col("node").alias("b")), texts, k, percent), "links")
    roots = written(components(edges), "roots")

    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    still = placed.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a != _b").select("key")
    rest = written(placed.join(still, "key").select("node", "root").distinct(), "rest")
    pairs = prefix_pairs(rest.join(texts, "node").select("node", "root", "text"), k, percent)
    more = written(verified(pairs, texts, k, percent), "links")
    if more.isEmpty():
        return roots
    return written(components(edges.union(more)), "roots")
