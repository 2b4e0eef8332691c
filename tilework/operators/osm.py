"""OpenStreetMap extracts for a set of tiles: nodes, ways, relations with their tags and members.

Tables: nodes(id, version, tstamp, user_id, changeset_id, lon, lat), ways and relations(id, version, tstamp, user_id,
changeset_id), way_nodes(way_id, node_id, sequence_id), relation_members(relation_id, member_id, member_type,
member_role, sequence_id), tags(id, k, v), users(id, name). All joins are on ids or tile keys.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.functions import geom as g
from tilework.operators.tables import written
from tilework.operators.tiling import KEY, assign_tiles, keep_tiles


def nodes_in_tiles(nodes: DataFrame, tiles: DataFrame) -> DataFrame:
    """z, x, y, id of the nodes inside each tile's box, edges included."""
    zooms = sorted(r["z"] for r in tiles.select("z").distinct().collect())  # zooms: a few dozen at most
    placed = assign_tiles(nodes.select("id", g.point("lon", "lat").alias("geom")), zooms, exact=False)
    return keep_tiles(placed, tiles).select(*KEY, "id")


def with_user(rows: DataFrame, users: DataFrame | None) -> DataFrame:
    """Adds user (null where there is none)."""
    if users is None:
        return rows.withColumn("user", F.lit(None).cast("string"))
    return rows.join(users.select(F.col("id").alias("user_id"), F.col("name").alias("user")), "user_id", "left")


def with_tags(rows: DataFrame, tags: DataFrame | None) -> DataFrame:
    """Adds tags, map<string,string>; an empty map where there are none. Of a repeated key the greatest value stays."""
    empty = F.create_map().cast("map<string,string>")
    if tags is None:
        return rows.withColumn("tags", empty)
    one = tags.where("k IS NOT NULL").groupBy("id", "k").agg(F.max("v").alias("v"))
    maps = one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))
    return rows.join(maps, "id", "left").withColumn("tags", F.coalesce("tags", empty))


def osm_nodes(nodes: DataFrame, tiles: DataFrame, users: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Z, x, y and the columns of the tile's nodes, with user and tags."""
    return with_tags(with_user(nodes_in_tiles(nodes, tiles).join(nodes, "id"), users), tags)


def ways_of(node_ids: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """z, x, y, id of the ways that have a node among a tile's."""
    return node_ids.join(way_nodes.select(F.col("node_id").alias("id"), "way_id"), "id").select(*KEY, F.col("way_id").alias("id")).distinct()


def osm_ways(node_ids: DataFrame, ways: DataFrame, way_nodes: DataFrame, users: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Z, x, y and the columns of the ways, with user, tags and nodes (all node ids of the way in sequence)."""
    found = ways_of(node_ids, way_nodes)
    need = way_nodes.join(found.select(F.col("id").alias("way_id")).distinct(), "way_id", "left_semi")
    refs = need.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sequence_id", "node_id"))).alias("n"))
    refs = refs.select("id", F.transform("n", lambda v: v["node_id"]).alias("nodes"))
    return with_tags(with_user(found.join(ways, "id").join(refs, "id"), users), tags)


#: Columns of a block of 8 x 8 tiles; the bits of a long say which of them.
BLOCK = ("z", "bx", "by")


def _grouped(rows: DataFrame) -> DataFrame:
    """A distinct union of sets of tiles: a row per block and id with the bits of all its rows."""
    return rows.groupBy(*BLOCK, "id").agg(F.bit_or("tiles").alias("tiles"))


def _bits(rows: DataFrame) -> list[Column]:
    """The block of a row's tile, and the tile as a bit: the column's number in the block times 8 plus the row's."""
    block = [F.shiftright(c, 3).alias(f"b{c}") for c in ("x", "y")]
    return [F.col("z"), *block, F.expr("shiftleft(1L, (x % 8 * 8 + y % 8)::int)").alias("tiles"), *[c for c in rows.columns if c not in KEY]]


def tile_sets(rows: DataFrame) -> DataFrame:
    """z, x, y, id -> z, bx, by, id, tiles: an id's tiles of a block in one row."""
    return _grouped(rows.select(*_bits(rows.select(*KEY, "id"))))


def tiles_of(sets: DataFrame, tiles: str = "tiles") -> DataFrame:
    """A row (z, x, y and the other columns) for each tile of a set."""
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(tiles, i) == 1)).alias("_bit")
    rows = sets.select("*", bit)
    at = lambda b, n: (F.shiftleft(b, 3) + n).cast("int")
    return rows.select("z", at("bx", F.shiftright("_bit", 3)).alias("x"), at("by", F.col("_bit") % 8).alias("y"), *[c for c in sets.columns if c not in (*BLOCK, tiles)])


def way_sets(node_sets: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """``ways_of`` as sets of tiles."""
    return _grouped(node_sets.join(way_nodes.select(F.col("node_id").alias("id"), "way_id"), "id").select(*BLOCK, F.col("way_id").alias("id"), "tiles"))


def relation_sets(node_sets: DataFrame, way_sets: DataFrame, members: DataFrame) -> DataFrame:
    """``relations_of`` as sets of tiles: z, bx, by, id, tiles (level 0), parent_tiles (level 1)."""
    # a relation may name a member many times: pairs are made distinct before the join, not after it
    kind = lambda t: members.where(F.col("member_type") == t).select(F.col("member_id").alias("id"), "relation_id").distinct()
    near = lambda ids, t: ids.select(*BLOCK, "id", "tiles").join(kind(t), "id").select(*BLOCK, F.col("relation_id").alias("id"), "tiles")
    direct = written(_grouped(near(node_sets, "N").union(near(way_sets, "W"))), "relations")
    parents = _grouped(near(direct, "R")).withColumnRenamed("tiles", "_up")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    both = direct.join(parents, [*BLOCK, "id"], "full")
    return both.select(*BLOCK, "id", zero("tiles").alias("tiles"), zero("_up").bitwiseAND(F.bitwise_not(zero("tiles"))).alias("parent_tiles"))


def _levels(found: DataFrame) -> DataFrame:
    """A row for each tile and level of rows of ``relation_sets``: z, x, y, their other columns, level."""
    own = [c for c in found.columns if c not in ("tiles", "parent_tiles")]
    level = lambda c, n: tiles_of(found.where(F.col(c) != 0).select(*own, F.col(c).alias("tiles"))).withColumn("level", F.lit(n))
    return level("tiles", 0).union(level("parent_tiles", 1))


def relations_of(node_ids: DataFrame, way_ids: DataFrame, members: DataFrame) -> DataFrame:
    """Z, x, y, id, level: relations with a member node or way among the tile's (level 0, a distinct
    union), and one level of their parent relations that aren't there yet (level 1)."""
    return _levels(relation_sets(tile_sets(node_ids), tile_sets(way_ids), members))


def osm_relations(
    node_ids: DataFrame, way_ids: DataFrame, relations: DataFrame, members: DataFrame, users: DataFrame | None = None, tags: DataFrame | None = None, more: dict[str, Column] | None = None
) -> DataFrame:
    """Z, x, y, level and the columns of the relations, with user, tags and members in sequence, and ``more`` columns made of these.
    All are joined and made once for each relation of a block, not once for each of its tiles."""
    found = relation_sets(tile_sets(node_ids), tile_sets(way_ids), members)
    need = members.join(found.select(F.col("id").alias("relation_id")).distinct(), "relation_id", "left_semi")
    item = F.struct("sequence_id", "member_type", "member_id", "member_role")
    lists = need.groupBy(F.col("relation_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("members"))
    return _levels(with_tags(with_user(found.join(relations, "id").join(lists, "id"), users), tags).withColumns(more or {}))


def _extract(tiles: DataFrame, nodes: DataFrame, ways: DataFrame, way_nodes: DataFrame, relations: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes, ways and relations (of both levels) of tiles, as sets of tiles."""
    n = written(tile_sets(nodes_in_tiles(nodes, tiles)), "nodes")
    w = written(way_sets(n, way_nodes).join(ways.select("id"), "id", "left_semi"), "ways")
    r = relation_sets(n, w, members).join(relations.select("id"), "id", "left_semi")
    return n, w, r.select(*BLOCK, "id", F.col("tiles").bitwiseOR(F.col("parent_tiles")).alias("tiles"))


def osm_extract(tiles: DataFrame, nodes: DataFrame, ways: DataFrame, way_nodes: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """Z, x, y, n_nodes, n_ways, n_relations of each tile; a tile without any has zeros."""
    tag = lambda df, k: tiles_of(df).select(*KEY, F.lit(k).alias("kind"))
    count = lambda k: F.count_if(F.col("kind") == k)
    n, w, r = _extract(tiles, nodes, ways, way_nodes, relations, members)
    sums = tag(n, "n").union(tag(w, "w")).union(tag(r, "r")).groupBy(*KEY).agg(count("n").alias("n_nodes"), count("w").alias("n_ways"), count("r").alias("n_relations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return tiles.select(*KEY).distinct().join(sums, list(KEY), "left").select(*KEY, zero("n_nodes"), zero("n_ways"), zero("n_relations"))


def extract_nested(tiles: DataFrame, nodes: DataFrame, ways: DataFrame, way_nodes: DataFrame, relations: DataFrame, members: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The extract itself: z, x, y with arrays nodes, ways and relations, each in the order of its ids. A tile's
    extract is one row by definition: use tiles of zooms where it fits one (the reference's own use is a tile a file)."""
    at = nodes_in_tiles(nodes, tiles)
    w = osm_ways(at, ways, way_nodes, users)
    r = osm_relations(at, w, relations, members, users)
    nest = lambda df, cols, name: df.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    n = nest(at.join(nodes, "id"), ["id", "version", "tstamp", "lon", "lat"], "nodes")
    out = tiles.select(*KEY).distinct().join(n, list(KEY), "left")
    out = out.join(nest(w, ["id", "version", "tstamp", "nodes"], "ways"), list(KEY), "left")
    return out.join(nest(r, ["id", "version", "tstamp", "members"], "relations"), list(KEY), "left")


def extract_sets(tiles: DataFrame, nodes: DataFrame, ways: DataFrame, way_nodes: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """The extract as sets: z, bx, by, tiles (see ``tile_sets``), kind (0 nodes, 1 ways, 2 relations), id, refs: a way's nodes and a
    relation's members (type and id) in their order as text, made and joined once for each way and relation of a block, not once for
    each of its tiles."""
    n, w, r = _extract(tiles, nodes, ways, way_nodes, relations, members)

    def listed(df: DataFrame, key: str, item: list[str], text) -> DataFrame:
        return df.groupBy(F.col(key).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*item))), text), ",").alias("refs"))

    of_way = listed(way_nodes, "way_id", ["sequence_id", "node_id"], lambda v: v["node_id"].cast("string"))
    of_relation = listed(members, "relation_id", ["sequence_id", "member_type", "member_id"], lambda v: F.concat(v["member_type"], v["member_id"].cast("string")))
    rows = lambda df, kind, refs: df.select(*BLOCK, "tiles", F.lit(kind).alias("kind"), "id", refs)
    out = rows(n, 0, F.lit(None).cast("string").alias("refs"))
    return out.unionByName(rows(w.join(of_way, "id"), 1, F.col("refs"))).unionByName(rows(r.join(of_relation, "id"), 2, F.col("refs")))


def extract_rows(tiles: DataFrame, nodes: DataFrame, ways: DataFrame, way_nodes: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """The extract as rows: z, x, y and kind, id, refs of ``extract_sets``. No row holds a tile."""
    return tiles_of(extract_sets(tiles, nodes, ways, way_nodes, relations, members))


def _bytes_of(lines: pa.Array):
    """The bytes of an Arrow array of texts, one after the other, as they lie in its buffer."""
    if not len(lines):
        return b""
    width = np.int64 if pa.types.is_large_string(lines.type) else np.int32
    ends = np.frombuffer(lines.buffers()[1], width)[lines.offset : lines.offset + len(lines) + 1]
    return memoryview(lines.buffers()[2])[ends[0] : ends[-1]] if ends[-1] > ends[0] else b""


_PACKS = pa.schema([*[(c, pa.int32()) for c in (*BLOCK, "kind", "column")], ("id", pa.int64()), ("lines", pa.binary())])


def _packed(batches):
    """Rows (block, kind, id, tiles, line) in the order of block, kind and id -> a row for each column of eight tiles of a run of them: the
    run's first id, and its lines with their masks of eight bits and lengths, compressed."""
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(5)])  # the ids' chunk is the last
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(k)]
        ids, tiles, out = b.column(5).to_numpy(zero_copy_only=False), b.column(6).to_numpy(zero_copy_only=False), []
        for i, j in zip(cuts, cuts[1:], strict=False):
            lines = b.column(7).slice(i, j - i)
            for column in range(8):
                mask = (tiles[i:j] >> (8 * column)) & 255
                held = mask != 0
                if held.any():
                    own = lines.filter(pa.array(held))
                    sizes = pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int32)
                    data = zlib.compress(mask[held].astype(np.uint8).tobytes() + sizes.tobytes() + bytes(_bytes_of(own)), 1)
                    out.append((*k[i, :4].tolist(), column, int(ids[i]), np.int32(held.sum()).tobytes() + data))
        yield pa.RecordBatch.from_pylist([dict(zip(_PACKS.names, row, strict=True)) for row in out], _PACKS)


def _unpacked(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """The masks and lines of a row of ``_packed``."""
    n, raw = int(np.frombuffer(data[:4], np.int32)[0]), zlib.decompress(data[4:])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n, n))]).astype(np.int32)
    return np.frombuffer(raw, np.uint8, n), pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[5 * n :]))


def _summed(batches):
    """Rows of ``_packed`` in the order of block, kind, column and id -> a row a tile and kind: nodes' ids as text, the md5 of the others'
    lines. What came before is in the column's eight running sums, so a task holds a batch at a time. Each line begins with its separator."""
    key, sums = None, {}

    def done():
        z, bx, by, kind, column = key
        texts = [(row, b"".join(t).decode() if kind == 0 else t.hexdigest()) for row, t in sums.items()]
        return pa.RecordBatch.from_pylist([{"z": z, "x": bx * 8 + column, "y": by * 8 + row, "kind": kind, "text": t} for row, t in texts], _SUMS)

    for b in batches:
        keys = zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)
        for now, data in zip(keys, b.column(5), strict=True):
            if now != key:
                if key is not None:
                    yield done()
                key, sums = now, {}
            mask, lines = _unpacked(data.as_py())
            for row in range(8):
                held = (mask >> row) & 1 == 1
                if not held.any():
                    continue
                text, fresh = _bytes_of(lines.filter(pa.array(held))), row not in sums
                if fresh:
                    sums[row], text = [] if key[3] == 0 else hashlib.md5(), text[1:]
                if key[3] == 0:
                    sums[row].append(bytes(text))
                else:
                    sums[row].update(text)
    if key is not None:
        yield done()


_SUMS = pa.schema([*[(c, pa.int32()) for c in (*KEY, "kind")], ("text", pa.string())])

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Neighbouring ids, as bits, whose lines are packed together.
CHUNK_BITS = 12


def extract_sums(tiles: DataFrame, rows: DataFrame) -> DataFrame:
    """Each tile's extract (``extract_sets`` or ``extract_rows``) as z, x, y, nodes (their ids), ways and relations (md5 of id:refs,
    joined by ;), in the order of ids (whole numbers). The lines of neighbouring ids come together and are packed, once for a column of eight
    tiles and not once for each tile; a column's packs of a kind are sorted by one task and pass through it one by one."""
    spark = rows.sparkSession
    bound = re.match(r"\d+", spark.conf.get(_BATCH))
    if bound is None or not 0 < int(bound[0]) <= 8 << 20:  # the session's own bound, if lower, stays
        spark.conf.set(_BATCH, f"{8 << 20}b")
    sets = rows if "tiles" in rows.columns else rows.select(*_bits(rows))
    line = F.when(F.col("kind") == 0, F.concat(F.lit(","), F.col("id").cast("string"))).otherwise(F.concat(F.lit(";"), F.concat_ws(":", "id", "refs")))
    ints = [F.col(c).cast("int").alias(c) for c in (*BLOCK, "kind")]
    chunk = F.shiftright(F.col("id").cast("long"), CHUNK_BITS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = sets.select(*ints, chunk.alias("chunk"), F.col("id").cast("long").alias("id"), "tiles", line.alias("line")).repartition(n, "kind", "chunk")
    packs = near.sortWithinPartitions(*BLOCK, "kind", "chunk", "id").mapInArrow(_packed, "z int, bx int, by int, kind int, column int, id long, lines binary")
    place = F.pmod(F.col("kind") + 3 * (F.col("bx") * 8 + F.col("column") + F.col("by") * 8), F.lit(n)).cast("int")  # neighbours lie in different partitions
    ordered = packs.repartitionById(n, place).sortWithinPartitions(*BLOCK, "kind", "column", "id")
    sums = ordered.select(*BLOCK, "kind", "column", "lines").mapInArrow(_summed, "z int, x int, y int, kind int, text string")
    texts = sums.groupBy(*KEY).agg(*[F.max(F.when(F.col("kind") == k, F.col("text"))).alias(c) for k, c in enumerate(("nodes", "ways", "relations"))])
    return tiles.select(*KEY).distinct().join(texts, list(KEY), "left")


def _escaped(value: Column) -> Column:
    """Text for an XML attribute."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        value = F.replace(value, F.lit(raw), F.lit(name))
    return value


def _attributes(values: dict[str, Column]) -> Column:
    """Attributes of an element; one without a value is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f' {k}="'), _escaped(v.cast("string")), F.lit('"')), F.lit("")) for k, v in values.items()])


def _element(name: str, df: DataFrame, more: dict[str, Column]) -> Column:
    """A node or way as XML text: tags by key, a way's nodes in their order."""
    when = F.date_format(F.col("tstamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = {"id": F.col("id"), "version": F.col("version"), "timestamp": when, "user": F.col("user"), **more}
    inner = [F.transform("nodes", lambda i: F.concat(F.lit('<nd ref="'), i.cast("string"), F.lit('"/>')))] if name == "way" else []
    if "tags" in df.columns:
        tags = F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(F.lit("<tag"), _attributes({"k": t["key"], "v": t["value"]}), F.lit("/>")))
        inner.append(F.coalesce(tags, F.array().cast("array<string>")))
    text = F.array_join(F.concat(*inner), "") if inner else F.lit("")
    return F.concat(F.lit(f"<{name}"), _attributes(base), F.lit(">"), text, F.lit(f"</{name}>"))


def osm_documents(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Z, x, y, part, id, line: the lines of one OSM 0.6 document per tile, in the order of part (its head, nodes, ways, its end) and id.
    nodes: z, x, y, id, version, tstamp, user, lon, lat and, if any, tags; ways: z, x, y, id, version, tstamp, user, nodes and tags."""
    place = {"lat": F.format_string("%.7f", "lat"), "lon": F.format_string("%.7f", "lon")}
    n = nodes.select(*KEY, F.lit(1).alias("part"), "id", _element("node", nodes, place).alias("line"))
    w = ways.select(*KEY, F.lit(2).alias("part"), "id", _element("way", ways, {}).alias("line"))
    frame = [(0, '<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6">'), (3, "</osm>")]
    ends = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(0).cast("long").alias("id"), F.lit(t).alias("line")) for p, t in frame]))
    tiles = n.select(*KEY).union(w.select(*KEY)).distinct().select(*KEY, ends.alias("e")).select(*KEY, "e.*")
    return n.unionByName(w).unionByName(tiles)


def write_osm_xml(nodes: DataFrame, ways: DataFrame, path: str, compression: str | None = None) -> None:
    """A file under path/z=../x=../y=.. for each tile: one whole document with nodes before ways, plain or compressed ("gzip", at its
    fastest). Spark's text writer commits a task's files when it ends and drops those of failed attempts. A tile's document is written by
    one task, as a file is; texts are made before the shuffle, and the sort spills."""
    lines = osm_documents(nodes, ways).repartition(*KEY).sortWithinPartitions(*KEY, "part", "id")
    options = {"compression": compression, "zlib.compress.level": "BEST_SPEED"} if compression else {}
    lines.select(*KEY, "line").write.mode("overwrite").partitionBy(*KEY).options(**options).text(path)
