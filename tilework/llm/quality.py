"""Quality rules: cross-document line frequency, with DataFrame functions only.

Lines are normalised (A-Z lower-cased, digits to 0, white space collapsed), hashed with their host, and counted by
distinct documents of that host; a document is a distinct text, so exact copies (another operator's business) count
once. Lines above the limit are removed, and a document that loses most of its words is rejected. The limit is a share
of the host's documents, bounded below for small hosts and above for large ones.

The texts are read once: their features and the hashes and word counts of their lines are written as a narrow table,
from which all else is taken. Two shuffles of narrow rows (host-and-line hash, text hash): one for the counts,
pre-aggregated on the map side, one to find the lines above the limit in their documents. The join on the line's hash
is an inner join of plain exchanges, so adaptive execution splits the partition of a line that everyone has.

Defined cases: null or empty text has no words and fails the base rules; a null host is a host of its own; a repeated
row gets a repeated result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.llm.common import WORD, documents, words, written

SYMBOLS = "[#*$%&|<>]"


def normalised(line: Column) -> Column:
    """A-Z to a-z, any ASCII digit to 0, runs of white space to one space, ends trimmed."""
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mapped = F.translate(line, upper + digits, upper.lower() + "0" * 10)
    return F.trim(F.regexp_replace(mapped, r"[\x20\x09-\x0D]+", " "))


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) of each whole text.

    Repeated 3-word windows are found row by row: the windows' hashes are sorted with their positions, equal
    neighbours are the repeats, and the words they cover are summed as the gaps of their positions, 3 at most.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumn("_w", words(F.col(text))).withColumn("_lines", lines)
    w = F.col("_w")
    spots = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    out = out.withColumn("_s", F.when(F.size(w) >= 3, F.sort_array(spots)))
    s = F.col("_s")
    twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    out = out.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x
    )
    features = {
        "n_words": F.size(w),
        "word_chars": F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x)),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    return out.withColumns({k: v.cast("long") for k, v in features.items()}).drop("_w", "_lines", "_s", "_p")


def facts(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """A written row per document, without its text: doc_id, _host, the base features, _t (the text's hash) and _l, its
    lines with a word as structs of k (hash of host and normalised line) and n (words)."""
    d = docs.select("doc_id", F.col(host).alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lines = F.filter(F.transform(F.split("_text", "\n"), normalised), lambda x: x != "")
    # a normalised line has one space between two words
    each = F.transform(lines, lambda x: F.struct(F.xxhash64(F.col("_host"), x).alias("k"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))
    f = base_features(d, "_text").withColumns({"_t": F.xxhash64("_text"), "_l": each})
    return written(f.drop("_text"), "facts")


def line_losses(found: DataFrame, min_docs: int = 10, host_share: float = 0.05, max_docs: int = 1000) -> DataFrame:
    """Of a table of ``facts``, the documents with lines above the limit: doc_id, _t, _h (the host), removed_words,
    removed_lines, _keys (the lines' hashes).

    A line is above the limit if more than max(min_docs, host_share * the host's documents) distinct documents of
    the host have it, or more than max_docs however large the host is.
    """
    rows = found.groupBy("doc_id", "_t", F.col("_host").alias("_h")).agg(F.count("*").alias("_rows"))
    hosts = rows.groupBy("_h").agg(F.count_distinct("_t").alias("_docs"))
    lines = found.select("doc_id", "_t", F.explode("_l").alias("_l")).select("doc_id", "_t", F.col("_l.k").alias("_k"), F.col("_l.n").alias("_n"))
    counts = lines.select("_k", "_t").distinct().groupBy("_k").agg(F.count("*").alias("_df")).where(F.col("_df") > min(min_docs, max_docs))
    met = lines.join(counts, "_k").groupBy("doc_id", "_t", "_k").agg(F.max("_df").alias("_df"), F.sum("_n").alias("_n"), F.count("*").alias("_m"))
    rows = rows.withColumnsRenamed({"doc_id": "_id", "_t": "_tt"})
    placed = met.join(rows, met["doc_id"].eqNullSafe(rows["_id"]) & (met["_t"] == rows["_tt"]))
    limits = hosts.select(F.col("_h").alias("_hh"), F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(min_docs)), F.col("_docs") * host_share)).alias("_limit"))
    above = placed.join(limits, F.col("_h").eqNullSafe(F.col("_hh"))).where(F.col("_df") > F.col("_limit"))
    # of a repeated row every line was met as often as the row; the division takes that back
    return above.groupBy("doc_id", "_t", "_h").agg(
        F.sum((F.col("_n") / F.col("_rows")).cast("long")).alias("removed_words"),
        F.sum((F.col("_m") / F.col("_rows")).cast("long")).alias("removed_lines"),
        F.collect_set("_k").alias("_keys"),
    )


def _with_losses(docs: DataFrame, losses: DataFrame) -> DataFrame:
    docs = docs.drop("_l")
    right = losses.withColumnsRenamed({"doc_id": "_id", "_t": "_tt", "_h": "_hh"})
    same = docs["doc_id"].eqNullSafe(right["_id"]) & (docs["_t"] == right["_tt"]) & docs["_host"].eqNullSafe(right["_hh"])
    out = docs.join(right, same, "left").drop("_id", "_tt", "_hh")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(0)).cast("long") for k in ("removed_words", "removed_lines")})


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def quality_verdicts(docs: DataFrame, host: str = "source", text: str = "text", max_loss: float = 0.5, **limits) -> DataFrame:
    """One row per document: doc_id, the base features, base_failed, removed_words, removed_lines, kept.

    kept is false if base_failed, or if lines above the limit hold more than max_loss of the words. The text itself
    stays where it was read; only features and hashes travel.
    """
    f = facts(docs, host, text)
    out = _with_losses(f, line_losses(f, **limits).drop("_keys"))
    out = out.withColumn("base_failed", F.expr(BASE_FAILED))
    lost = F.col("removed_words") > F.col("n_words") * max_loss
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*names, (~F.col("base_failed") & ~lost).alias("kept"), "removed_words", "removed_lines")


def apply_quality(docs: DataFrame, host: str = "source", text: str = "text", max_loss: float = 0.5, **limits) -> DataFrame:
    """The documents that stay, in their own columns (of any names), without the lines above the limit."""
    f = facts(docs, host, text)
    v = _with_losses(f, line_losses(f, **limits))
    v = v.where(~F.expr(BASE_FAILED) & ~(F.col("removed_words") > F.col("n_words") * max_loss))
    v = v.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_tt"), F.col("_host").alias("_hh"), "_keys").dropDuplicates(["_id", "_tt", "_hh"])
    # the row's own columns travel inside a struct, where their names can't meet those of the verdicts
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs[host].alias("_host"), docs[text].alias("_text"))
    rows = rows.withColumn("_t", F.xxhash64(F.coalesce("_text", F.lit(""))))
    out = rows.join(v, rows["_doc.doc_id"].eqNullSafe(v["_id"]) & (rows["_t"] == v["_tt"]) & rows["_host"].eqNullSafe(v["_hh"]))
    left = F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains("_keys", F.xxhash64(F.col("_host"), normalised(x))))
    whole = F.col("_keys").isNull()
    out = out.withColumn("_left", F.when(whole, F.col("_text")).otherwise(F.array_join(left, "\n")))
    own = {c: F.col("_doc").getField(c) for c in docs.columns}
    own[text] = F.col("_left")
    if "n_chars" in own:
        own["n_chars"] = F.when(whole, own["n_chars"]).otherwise(F.length("_left").cast("long"))
    return out.select(*[v.alias(k) for k, v in own.items()])


def query(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
raw AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
line AS (
  SELECT doc_id, source, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM line GROUP BY doc_id),
df AS (SELECT source, norm, count(DISTINCT t) AS df FROM line GROUP BY source, norm),
host AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
loss AS (
  SELECT doc_id, sum(n)::BIGINT AS words, count(*) AS lines FROM line JOIN df USING (source, norm) JOIN host USING (source)
  WHERE df > least(1000.0, greatest(10.0, docs * 0.05::DOUBLE)) GROUP BY doc_id),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(loss.words, 0)::BIGINT AS removed_words, coalesce(loss.lines, 0)::BIGINT AS removed_lines
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN loss USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (removed_words > n_words * 0.5::DOUBLE) AS kept, removed_words, removed_lines FROM b
"""
