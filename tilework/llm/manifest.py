"""Merkle dataset manifest by lag and lead windows.

Every row is a leaf. Within a group (the language) leaves stand in order, and while several nodes remain, every ``fan``
consecutive ones become one: level by level, lag and lead columns at fixed offsets, masked by the node's slot and its run's
length, give a node its siblings, and the run's first child hashes the parent. The groups' roots are put together in the
same way. A row's proof is its siblings up to the root; folding them over a leaf gives the root again.

Scale: texts are read once, into a narrow written table of hashes. Rows are numbered by range totals (``running``), never by
a window over a group, and a window sees ``fan ** depth`` rows: the runs of ``depth`` levels are whole within such a block, at
offsets 1, fan, fan squared and so on, so they cost one shuffle together. A block leaves one row for the next such round, so
a third of all rows in one language is as many blocks as it takes. Nothing but a group's count and first number is joined.

Defined cases: a null field is ``-``; rows that repeat an id stand by their leaves, equal rows are equal leaves; null ids come
first, a null group is a group; a group of one row has its leaf as root; an empty table has no rows and no root; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilework.llm.common import documents, running, small, written

FAN, DEPTH = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of blocks with their siblings (a kilobyte or two each) that may be broadcast.
PATH_ROWS = 4_000


def sha(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """H of the fields: each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return sha(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def levels_of(n: int, fan: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds _i, the place of a row in its group by order, and _n, the group's rows."""
    rows = running(rows, [*group, *order], {"_at": F.lit(1)})
    if not group:
        return rows.withColumns({"_i": F.col("_at"), "_n": F.lit(rows.count())}).drop("_at")
    rows = written(rows, "numbered")
    starts = written(rows.groupBy(*group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "groups")
    starts = starts.withColumnsRenamed({g: f"_g{k}" for k, g in enumerate(group)})
    same = F.lit(True)
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    out = rows.join(small(starts), same).withColumn("_i", F.col("_at") - F.col("_first"))
    return out.drop("_at", "_first", *[f"_g{k}" for k in range(len(group))])


def block_levels(nodes: DataFrame, group: list[str], below: int, depth: int, fan: int) -> DataFrame:
    """nodes (group, _i, _n, _h): the nodes of one level, ``below`` levels above the leaves that _n counts. Adds _block, _path
    (an array of left and right, the siblings on either side, for each of the ``depth`` levels from here that the group's tree has) and _top (the
    node that the block comes to)."""
    size = fan**depth
    rows = nodes.withColumn("_block", F.floor(F.col("_i") / size).cast("long"))
    order = Window.partitionBy(*group, "_block").orderBy("_i")
    since = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_h0", F.col("_h"))
    for level in range(depth):
        step, h = fan**level, F.col(f"_h{level}")
        at, count = F.floor(F.col("_i") / step), F.ceil(F.col("_n") / fan ** (below + level))
        slot = at % fan
        length = F.least(F.lit(fan), count - (at - slot))
        # only first rows of a node's block have its hash, and their siblings' first rows are multiples of step away
        own = F.col("_i") % step == 0
        lags = [F.when(slot >= k, F.lag(h, k * step).over(order)).otherwise("") for k in range(fan - 1, 0, -1)]
        leads = [F.when(slot + k < length, F.lead(h, k * step).over(order)).otherwise("") for k in range(1, fan)]
        rows = rows.withColumns({f"_l{level}": F.when(own & (count > 1), F.concat(*lags)), f"_r{level}": F.when(own & (count > 1), F.concat(*leads))})
        parent = F.when(count > 1, sha(h, F.col(f"_r{level}"))).otherwise(h)
        rows = rows.withColumn(f"_h{level + 1}", F.when(F.col("_i") % (step * fan) == 0, parent))
    # the rows below a node have its siblings from its first row, the last one with any
    whole = Window.partitionBy(*group, "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = {f"_{s}{v}": F.last(f"_{s}{v}", ignorenulls=True).over(since) for v in range(depth) for s in "lr"}
    rows = rows.withColumns({**sides, "_top": F.first(f"_h{depth}").over(whole)})
    path = F.array(*[F.struct(F.col(f"_l{v}").alias("left"), F.col(f"_r{v}").alias("right")) for v in range(depth)])
    rows = rows.withColumn("_path", F.filter(path, lambda s: s["left"].isNotNull()))
    return rows.drop(*[f"_{s}{v}" for v in range(depth) for s in "lr"], *[f"_h{v}" for v in range(depth + 1)])


def tree(rows: DataFrame, group: list[str], order: list[str], node: str, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """Adds to rows path (array of left and right, from the row's level up to its group's root; a root's is empty) and top (the group's root)."""
    kept = numbered(rows.withColumn("_h", F.col(node)), group, order)
    height = levels_of(kept.agg(F.max("_n").alias("n")).first()["n"] or 0, fan)
    rounds, below = [], 0
    while True:
        done = written(block_levels(kept, group, below, depth, fan), "blocks")
        rounds.append(done)
        below += depth
        if below >= height:
            break
        kept = done.where(F.col("_i") % fan**depth == 0).select(*group, F.col("_block").alias("_i"), "_n", F.col("_top").alias("_h"))
    above = rounds.pop()
    while rounds:
        under = rounds.pop()
        up = above.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_i").alias("_up"), F.col("_path").alias("_more"), F.col("_top").alias("_root"))
        same = F.col("_block") == F.col("_up")
        for k, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
        up = F.broadcast(up) if up.count() <= PATH_ROWS else up
        above = under.join(up, same).withColumns({"_path": F.concat("_path", "_more"), "_top": F.col("_root")})
        above = above.drop("_up", "_more", "_root", *[f"_g{k}" for k in range(len(group))])
    return above.withColumnsRenamed({"_path": "path", "_top": "top"}).drop("_h", "_i", "_n", "_block")


def proof(path: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    return sha(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(path, start, lambda h, s: sha(s["left"], h, s["right"]))


def manifest(hashed: DataFrame, group: str = "lang", order: str = "doc_id", fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """hashed (order, group, leaf and others) -> plus subroot, root and path, from the leaf to the root."""
    inner = written(tree(hashed, [group], [order, "leaf"], "leaf", fan, depth), "inner")
    subroots = inner.groupBy(group).agg(F.first("top").alias("subroot"))
    outer = tree(written(subroots, "subroots"), [], [group], "subroot", fan, depth)
    outer = written(outer.select(F.col(group).alias("_g"), F.col("path").alias("_outer"), F.col("top").alias("root")), "outer")
    outer = F.broadcast(outer) if outer.count() <= PATH_ROWS else outer
    out = inner.join(outer, F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("path", F.concat("path", "_outer")).withColumnRenamed("top", "subroot").drop("_g", "_outer")


def verified(rows: DataFrame, presented: str = "presented") -> DataFrame:
    """Rows of a manifest, with the leaf that somebody presents for each: adds folded_root and verified."""
    out = rows.withColumn("folded_root", folded(F.col(presented), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, leaf and presented, the leaf that a copy gives in which n_chars of the tampered rows is one more."""
    d = docs.select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    changed = leaf(*{**fields, "n_chars": F.col("n_chars") + 1}.values())
    own = d.select("doc_id", "lang", leaf(*fields.values()).alias("leaf"), F.when(tampered & F.col("n_chars").isNotNull(), changed).alias("presented"))
    return written(own.withColumn("presented", F.coalesce("presented", "leaf")), "leaves")


def query(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what verification finds in a copy that is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = verified(manifest(leaves(documents(spark, sf_dir), tampered)))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


#: CRC tables and sums in SQL: ``crc(list of bytes)`` over ``tab``'s 256 entries.
CRC = r"""
WITH RECURSIVE step AS (SELECT range AS i, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS crc_table FROM step WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8, where ``tab`` is joined."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: ('0x' || o)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, o: xor(a >> 8, crc_table[xor(a & 255, o) + 1])))"


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
ORACLE = (
    CRC
    + f""",
d AS (SELECT *, n_chars + CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN 1 ELSE 0 END AS changed FROM documents, tab),
leaf AS (SELECT doc_id, lang, sha256({" || ".join(_FIELD.format(c) for c in FIELDS)}) AS leaf, sha256({" || ".join(_FIELD.format("changed" if c == "n_chars" else c) for c in FIELDS)}) AS shown FROM d),
base AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i FROM leaf),
inner_ AS (SELECT lang, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM base
  UNION ALL SELECT lang, level + 1, i // 2, sha256(h || coalesce(nxt, '')), n FROM (
    SELECT lang, level, i, h, lead(h) OVER (PARTITION BY lang ORDER BY i) AS nxt, (n + 1) // 2 AS n, n AS m FROM inner_) WHERE m > 1 AND i % 2 = 0),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS m FROM inner_ WHERE n = 1),
outer_ AS (SELECT 0 AS level, g AS i, subroot AS h, m AS n FROM sub
  UNION ALL SELECT level + 1, i // 2, sha256(h || coalesce(nxt, '')), n FROM (
    SELECT level, i, h, lead(h) OVER (ORDER BY i) AS nxt, (n + 1) // 2 AS n, n AS m FROM outer_) WHERE m > 1 AND i % 2 = 0),
up AS (SELECT doc_id, lang, i AS place, leaf, shown, 0 AS level, i, '' AS proof, shown AS fold FROM base
  UNION ALL SELECT doc_id, up.lang, place, leaf, shown, up.level + 1, up.i // 2, proof || coalesce(s.h, ''),
    CASE WHEN up.i % 2 = 0 THEN sha256(fold || coalesce(s.h, '')) ELSE sha256(s.h || fold) END
  FROM up JOIN inner_ o ON up.lang IS NOT DISTINCT FROM o.lang AND up.level = o.level AND up.i = o.i AND o.n > 1
  LEFT JOIN inner_ s ON up.lang IS NOT DISTINCT FROM s.lang AND up.level = s.level AND s.i = xor(up.i, 1)),
high AS (SELECT lang, place, max(level) AS level FROM up GROUP BY lang, place),
below AS (SELECT up.doc_id, up.leaf, sub.subroot, up.place, sub.g, 0 AS level, sub.g AS i, proof, fold FROM up
  JOIN high ON up.lang IS NOT DISTINCT FROM high.lang AND up.place = high.place AND up.level = high.level JOIN sub ON up.lang IS NOT DISTINCT FROM sub.lang),
above AS (SELECT * FROM below
  UNION ALL SELECT doc_id, leaf, subroot, place, g, a.level + 1, a.i // 2, proof || coalesce(s.h, ''),
    CASE WHEN a.i % 2 = 0 THEN sha256(fold || coalesce(s.h, '')) ELSE sha256(s.h || fold) END
  FROM above a JOIN outer_ o ON a.level = o.level AND a.i = o.i AND o.n > 1 LEFT JOIN outer_ s ON a.level = s.level AND s.i = xor(a.i, 1)),
top AS (SELECT max(level) AS level FROM outer_)
SELECT doc_id, leaf, subroot, (SELECT h FROM outer_ WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
  fold = (SELECT h FROM outer_ WHERE n = 1) AS verified FROM above JOIN top USING (level)
"""
)
