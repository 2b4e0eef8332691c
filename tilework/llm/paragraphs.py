"""Substring dedup by paragraph MinHash banding.

Paragraphs are of two kinds, both taken over a text's words:

- Lines of at least min_words words. A line's k-word shingle set gets bands * rows minhashes; lines that agree in all rows
  of a band collide. With 5 bands of 2 rows a pair of similarity s >= 0.8 collides with probability 1 - (1 - s**2)**5
  > 0.99. Colliding lines are verified on their full sets (exact Jaccard) and links are closed to components.
- Windows of size + places - 1 words (50) at every word, newlines being space like any other. Such a paragraph has one band:
  its minhash, the least of its first ``places`` shingle hashes, together with the shingles that follow, so that
  the band stands for ``size`` words in a row. Neighbouring paragraphs mostly share their minhash, so its place is
  stored once for all of them (about every 13th word). Equal paragraphs always collide: every run of 50 words or
  more that two texts share, inside, across or wrapped over lines, has a place that both store. What collides is verified
  by the words themselves: the match is grown word by word to both sides, and counts if it has min_words words. Places of a
  run are at most ``places`` words apart, so with size >= places - 1 its bands touch and are grown together.

Of the lines of a component, and of equal bands, the first (least document, then place) stays and the others are
removed, if they lie in two documents or more. A removed word has its counterpart earlier in that order, so something is
left of each passage. Matches on one diagonal of two texts that touch are one; overlapping spans of a document are one
passage, whose first_doc is the least of theirs. A band is held against the first of its equals only: where the outer bands of a run have their first equals in a
third text, up to ``places`` words at its ends may stay.

Scale: the documents are read once for all units, which are written. A pre-aggregated count of hashes alone finds the units
that occur again; only those travel with their places. Equal units are one node whatever their number; members
are found by inner joins on the node, which adaptive execution can split. Around the ends of a match 32 bits of each of at
most ``places`` words are fetched, in one pass over the documents that have matches.

Defined cases: null or empty texts and texts of short lines have no lines, and texts of under size + places - 1 words have no
windows; repeats within a single document are left alone; repeated rows are one document; null doc_ids come first in
the order; extra columns are ignored; an empty table has no passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tilework.llm import arrowtext as at
from tilework.llm.common import documents, in_arrow, small, written
from tilework.llm.links import linked

UNITS = "doc_id long, _t long, at int, n int, node long, bands array<long>"


def reaching(x: np.ndarray, n: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over x[i : i + n], for each i that leaves room."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out, have = of(out[: len(out) - step], out[step:]), have + step
    return out


def band_places(cut: np.ndarray, valid: np.ndarray, places: int) -> np.ndarray:
    """Where cut is the least of ``places`` values in a row that begin at a valid place: there the greatest of the minima of
    all rows around is the value itself."""
    none = np.zeros(places - 1, np.uint64)
    least = np.where(valid, reaching(cut, places, np.minimum)[: len(valid)], np.uint64(0))
    best = reaching(np.concatenate([none, least, none]), places, np.maximum)
    return np.flatnonzero((best > 0) & (best == cut[: len(best)]))


def units_of(k: int, min_words: int, rows: int, bands: int, size: int, places: int, seed: int = 23):
    """mapInArrow function: doc_id, _t, text -> UNITS, lines (with bands) and windows (without). at counts the text's
    words from 0."""

    def run(batches):
        for batch in batches:
            data, offsets = at.utf8(batch.column(2))
            for lo, hi in at.slices(offsets):
                part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                cuts = np.unique(np.concatenate([offs, np.flatnonzero(part == 10) + 1]))  # starts of lines, and the end
                starts, ends, first = at.words(part, cuts)
                begin, counts = np.searchsorted(starts, offs), np.diff(first)
                hashes = at.word_hashes(part, starts, ends)
                cut = at.runs_of(hashes, k)
                line = np.flatnonzero(counts >= min_words)
                low = at.minhashes(cut, first[line], first[line + 1] - k + 1, rows * bands, seed)
                keys = np.stack([at.fold(low[:, b * rows : (b + 1) * rows], b) for b in range(bands)], axis=1)
                n, reach = len(hashes) - size - places + 2, size + places - 2
                doc = np.repeat(np.arange(hi - lo), np.diff(begin))
                places_ = band_places(cut, doc[:n] == doc[reach : reach + n], places) if n > 0 else line[:0]
                spot, length = np.concatenate([first[line], places_]), np.concatenate([counts[line], np.full(len(places_), size)])
                bounds = np.concatenate([np.arange(len(line) + 1), np.full(len(places_), len(line))]) * bands
                owner = np.searchsorted(begin, spot, "right") - 1
                own = [batch.column(i).slice(lo, hi - lo).take(pa.array(owner)) for i in (0, 1)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.ravel(), pa.int64()))
                columns = [*own, pa.array(spot - begin[owner], pa.int32()), pa.array(length, pa.int32()), pa.array(at.run_keys(hashes, spot, length)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_t", "at", "n", "node", "bands"])

    return run


def line_texts(batches):
    """mapInArrow function: text, asks -> node, text of the asked spans of words."""
    for batch in batches:
        nodes, texts = [], []
        for text, asks in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            raw = text.as_py()
            data, offsets = at.utf8(pa.array([raw], pa.string()))
            starts, ends, _ = at.words(data, offsets)
            for ask in asks:
                nodes.append(ask["node"])
                texts.append(data[starts[ask["at"]] : ends[ask["at"] + ask["n"] - 1]].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], names=["node", "text"])


AROUND = "doc_id long, _t long, lo int, hi int, before array<int>, after array<int>"


def surroundings(reach: int):
    """mapInArrow function: doc_id, _t, text, asks -> AROUND, a row for each asked span [lo, hi) of words: 32 bits of each
    of up to reach words before it, nearest first, and after it."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [], [])
            for doc, t, text, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data, offsets = at.utf8(pa.array([text.as_py()], pa.string()))
                hashes = at.word_hashes(data, *at.words(data, offsets)[:2]).astype(np.uint32).view(np.int32)
                for ask in asks:
                    lo, hi = ask["lo"], ask["hi"]
                    for column, value in zip(out, (doc, t, lo, hi, hashes[max(0, lo - reach) : lo][::-1], hashes[hi : hi + reach]), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "_t", "lo", "hi", "before", "after"])

    return run


def with_lists(docs: DataFrame, asks: DataFrame, *columns: str) -> DataFrame:
    """docs (doc_id, _t and others) that have asks (doc_id, _t and columns), with all theirs as the array asks."""
    per = asks.groupBy(F.col("doc_id").alias("_id"), F.col("_t").alias("_tt")).agg(F.collect_list(F.struct(*columns)).alias("asks"))
    per = written(per, "asks")
    per = small(per, per.agg(F.sum(F.size("asks")).alias("n")).first()["n"] or 0)
    return docs.join(per, docs["doc_id"].eqNullSafe(per["_id"]) & (docs["_t"] == per["_tt"])).drop("_id", "_tt")


def repeated_units(units: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, _t, at, n, root, first (doc_id, _t, at, n), exact: each unit that repeats an earlier one, with that one: the
    first equal one, or, for the first of its equals, the first of the component. Only what lies in two documents."""
    often = units.groupBy("node").agg(F.count("*").alias("_m")).where("_m > 1").select("node")
    wanted = often.join(roots, "node", "full").select("node", F.coalesce("root", "node").alias("root"))
    again = written(units.select("doc_id", "_t", "at", "n", "node").join(wanted, "node"), "again")
    place, who = F.struct("doc_id", "_t", "at", "n"), F.struct("doc_id", "_t")
    nodes = again.groupBy("node", "root").agg(F.min(place).alias("first"), F.min(who).alias("_a"), F.max(who).alias("_b"))
    groups = nodes.groupBy("root").agg(F.min("first").alias("group_first"), F.min("_a").alias("_a"), F.max("_b").alias("_b")).where("_a != _b").select("root", "group_first")
    nodes = written(nodes.join(groups, "root").select("node", "root", "first", "group_first"), "passages")
    equal = again.drop("root").join(nodes, "node").where(place != F.col("first"))
    equal = equal.select("doc_id", "_t", "at", "n", "root", "first", F.lit(True).alias("exact"))
    near = nodes.where("first != group_first").select("first.*", "root", F.col("group_first").alias("first"), F.lit(False).alias("exact"))
    return equal.unionByName(near)


def matches(hits: DataFrame) -> DataFrame:
    """From repeated units: doc_id, _t, lo, hi and first_doc, first_t, first_lo, first_hi (spans of words), component_id.
    Equal units that touch on one diagonal of two texts are one match."""
    pair = ["doc_id", "_t", "first_doc", "first_t", "diagonal"]
    flat = hits.select("doc_id", "_t", "at", (F.col("at") + F.col("n")).alias("end"), "root", "exact", *[F.col(f"first.{c}").alias(f"first_{a}") for c, a in (("doc_id", "doc"), ("_t", "t"), ("at", "lo"), ("n", "n"))])
    flat = flat.withColumn("diagonal", F.col("at") - F.col("first_lo"))
    order = Window.partitionBy(*pair).orderBy("at", "end")
    gap = F.col("at") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = flat.where("exact").withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    runs = runs.groupBy(*pair, "_run").agg(F.min("at").alias("lo"), F.max("end").alias("hi"), F.min_by("root", F.struct("at", "root")).alias("component_id"))
    runs = runs.select("doc_id", "_t", "lo", "hi", "first_doc", "first_t", (F.col("lo") - F.col("diagonal")).alias("first_lo"), (F.col("hi") - F.col("diagonal")).alias("first_hi"), "component_id")
    near = flat.where("NOT exact").select("doc_id", "_t", F.col("at").alias("lo"), F.col("end").alias("hi"), "first_doc", "first_t", "first_lo", (F.col("first_lo") + F.col("first_n")).alias("first_hi"), F.col("root").alias("component_id"))
    return runs.unionByName(near)


def _agreeing(a: Column, b: Column) -> Column:
    """How many elements from the first on are equal in both arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def grown(d: DataFrame, found: DataFrame, places: int, min_words: int) -> DataFrame:
    """Matches grown word by word to both sides, those of min_words words and more."""
    found = written(found, "matches")
    first = [F.col(c).alias(a) for c, a in (("first_doc", "doc_id"), ("first_t", "_t"), ("first_lo", "lo"), ("first_hi", "hi"))]
    asks = found.select("doc_id", "_t", "lo", "hi").union(found.select(*first)).distinct()
    around = in_arrow(with_lists(d, asks, "lo", "hi").select("doc_id", "_t", "text", "asks"), surroundings(places), AROUND)
    around = written(around.dropDuplicates(["doc_id", "_t", "lo", "hi"]), "around")
    a, b = (around.select(*[F.col(c).alias(f"{x}_{c}") for c in around.columns]) for x in "ab")
    out = found
    for side, names in ((a, ("doc_id", "_t", "lo", "hi")), (b, ("first_doc", "first_t", "first_lo", "first_hi"))):
        x = side.columns
        out = out.join(side, F.col(names[0]).eqNullSafe(F.col(x[0])) & (F.col(names[1]) == F.col(x[1])) & (F.col(names[2]) == F.col(x[2])) & (F.col(names[3]) == F.col(x[3])))
    out = out.withColumns({"_l": _agreeing(F.col("a_before"), F.col("b_before")), "_r": _agreeing(F.col("a_after"), F.col("b_after"))})
    spans = {c: (F.col(c) - F.col("_l")) if c.endswith("lo") else (F.col(c) + F.col("_r")) for c in ("lo", "hi", "first_lo", "first_hi")}
    return out.withColumns(spans).where(F.col("hi") - F.col("lo") >= min_words).select(*found.columns)


PASSAGES = "doc_id long, _t long, at int, until int, component_id long, first_doc long, kept boolean"


def merged(batches):
    """mapInArrow function: doc_id, _t, asks (array of lo, hi, component_id, first_doc, first_t, first_lo, kept) -> PASSAGES:
    what is removed, and what is kept and isn't removed for another passage. Overlapping spans are one, named by the
    earliest of the places that they repeat (null ids first)."""

    def place(p: dict) -> tuple:
        return p["first_doc"] is not None, p["first_doc"] or 0, p["first_t"], p["first_lo"], p["component_id"]

    for batch in batches:
        out = []
        for doc, t, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            joined = {False: [], True: []}
            for p in sorted(pieces, key=lambda p: (p["lo"], -p["hi"], p["component_id"])):
                have = joined[p["kept"]]
                if have and p["lo"] < have[-1]["hi"]:
                    have[-1] = {**min(have[-1], p, key=place), "lo": have[-1]["lo"], "hi": max(have[-1]["hi"], p["hi"])}
                else:
                    have.append(dict(p))
            left, gone, g = [], joined[False], 0
            for p in joined[True]:
                while g < len(gone) and gone[g]["hi"] <= p["lo"]:
                    g += 1
                h = g
                while h < len(gone) and gone[h]["lo"] < p["hi"]:
                    if p["lo"] < gone[h]["lo"]:
                        left.append({**p, "hi": gone[h]["lo"]})
                    p = {**p, "lo": gone[h]["hi"]}
                    h += 1
                if p["lo"] < p["hi"]:
                    left.append(p)
            out += [(doc, t, p["lo"], p["hi"], p["component_id"], p["first_doc"], p["kept"]) for p in gone + left]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*out, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in PASSAGES.split(", ")])


def repeated_passages(docs: DataFrame, k: int = 5, percent: int = 80, min_words: int = 25, rows: int = 2, bands: int = 5, size: int = 25, places: int = 26) -> DataFrame:
    """One row per repeated passage: doc_id, _t (hash of the text), at, until (its words, counted from 0), component_id, first_doc,
    kept. first_doc is the least document that a part of the passage was held against (null for a null doc_id), component_id
    the least node of the component of the first unit there."""
    d = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), "text")
    units = written(in_arrow(d, units_of(k, min_words, rows, bands, size, places), UNITS), "units")
    lines = units.where("size(bands) > 0")

    def texts_of(nodes: DataFrame) -> DataFrame:
        one = lines.join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "_t", "at", "n")).alias("p")).select("node", "p.*")
        return in_arrow(with_lists(d, one, "node", "at", "n").select("text", "asks"), line_texts, "node long, text string").dropDuplicates(["node"])

    keyed = lines.select(F.explode("bands").alias("key"), "node")
    often = keyed.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1").select("key")
    roots = linked(written(keyed.join(often, "key").distinct(), "keys"), texts_of, k, percent)
    found = grown(d, matches(repeated_units(units, roots)), places, min_words)
    names = ["first_doc", "first_t", "first_lo", "component_id"]
    gone = found.select("doc_id", "_t", "lo", "hi", *names, F.lit(False).alias("kept"))
    stays = found.select(F.col("first_doc").alias("doc_id"), F.col("first_t").alias("_t"), F.col("first_lo").alias("lo"), F.col("first_hi").alias("hi"), *names, F.lit(True).alias("kept"))
    # of the spans that begin at one word one, to the farthest end, so that a document has as many at most as words
    spans = gone.unionByName(stays).groupBy("doc_id", "_t", "kept", "lo").agg(F.max("hi").alias("hi"), F.min(F.struct(*names)).alias("p"))
    per = spans.groupBy("doc_id", "_t").agg(F.collect_list(F.struct("lo", "hi", "p.*", "kept")).alias("asks"))
    return in_arrow(per, merged, PASSAGES)


@F.arrow_udf(StringType())
def _cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without spans of words. Of the white space on both sides of a span that with a newline stays, else the one
    before; at a text's end none does."""
    out = []
    for text, gone in zip(texts, spans.to_pylist(), strict=True):
        if gone is None:
            out.append(None)
            continue
        raw = text.as_py().encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = at.words(data, np.array([0, len(data)]))
        last, parts = 0, []
        for s in sorted(gone, key=lambda s: s["at"]):
            a, b = s["at"], s["until"]
            stop = int(starts[b]) if b < len(starts) else len(raw)
            begin = int(starts[a])
            before, after = raw[ends[a - 1] : begin] if a else b"", raw[ends[b - 1] : stop]
            if b == len(starts) or a and b"\n" in after and b"\n" not in before:
                begin, stop = (int(ends[a - 1]) if a else 0), (stop if b == len(starts) else int(ends[b - 1]))
            parts.append(raw[last : max(last, begin)])
            last = max(last, stop)
        out.append(b"".join([*parts, raw[last:]]).decode())
    return pa.array(out, pa.string())


def without_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """The documents in their own columns, without the passages that repeat another; n_chars, where there is such
    a column, follows the text. All documents stay, those left without text too, with columns of any names."""
    gone = repeated_passages(docs, **parameters).where("NOT kept").groupBy(F.col("doc_id").alias("_id"), F.col("_t").alias("_tt")).agg(F.collect_list(F.struct("at", "until")).alias("_gone"))
    gone = written(gone, "removals")
    gone = small(gone, gone.agg(F.sum(F.size("_gone")).alias("n")).first()["n"] or 0)
    # the row's own columns travel inside a struct, where their names can't meet those of the removals
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs["text"].alias("_text"))
    d = d.withColumn("_t", F.xxhash64(F.coalesce("_text", F.lit(""))))
    out = d.join(gone, d["_doc.doc_id"].cast("long").eqNullSafe(gone["_id"]) & (d["_t"] == gone["_tt"]), "left")
    left = _cut_out(F.when(F.col("_gone").isNotNull(), F.col("_text")), F.col("_gone"))
    out = out.withColumn("_left", left)
    own = {c: F.col("_doc").getField(c) for c in docs.columns}
    own["text"] = F.coalesce("_left", "_text")
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_left").isNull(), own["n_chars"]).otherwise(F.length("_left").cast("long"))
    return out.select(*[v.alias(k) for k, v in own.items()])


def query(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(documents(spark, sf_dir))
    return found.select("doc_id", "at", (F.col("until") - F.col("at")).cast("long").alias("n_words"), "component_id", "first_doc", "kept", F.lit(True).alias("repeated"))
