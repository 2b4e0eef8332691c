"""Spelling variant grouping by finite-state composition.

Words that differ by one code point inserted, deleted or replaced are the accepted pairs of the vocabulary's acceptor composed with
a transducer of exactly one edit and the acceptor again. A composed state is (state, edits so far, state): before the edit both
sides have read the same, so they stand in one state; the edit takes two different arcs, or an arc on one side only; after
it, both read what both states accept.

The composition is enumerated by initial states. With L the lesser length of a pair and h half of it, the edit lies either at h or
later, then both words enter the state that their first h code points lead to, or before, then they agree in the last L - h. So
the words are dealt out by the state after h code points, and by their endings, as (L, prefix, suffix); within such a group
the middles' own minimised acceptor is built and composed, from that initial state. The position of an edit (the last
possible one, where letters repeat) tells which of the two groups a pair belongs to, so each pair is found once.

Groups stay small: one of more than ``limit`` words takes a step of the composition in Spark, of all its words at once: its words go
on over the arc that both sides match, to the groups of the next prefix, or over the arcs of an edit, to groups of words that have
all of the rest in common, of which there are as many at most as letters. That is repeated until no group is above the limit.
Hot words are counts by then: occurrences are added up before they are shuffled, and only the vocabulary travels.

A word's form is its most frequent near word, if that is ``ratio`` times as frequent; so forms are ever more frequent, and
following them ends at the root. Roots are found by pointer doubling, a join a round.

Defined cases: null and empty texts have no words; a null id is written as nothing in the draw of damage; repeated rows count as
often as they stand; ties are won by the lesser word in code point order; words of any length are held; an empty table has
no words; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.llm.common import documents, in_arrow, small, written
from tilework.llm.manifest import CRC, crc32_sql

MIN_LENGTH, MIN_COUNT, RATIO, LIMIT = 6, 5, 5, 4096
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP = ["length", "prefix", "suffix", "end"]


def runs(text: Column) -> Column:
    """Array of a text's maximal runs of letters, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({RUN})"), 1)


def damaged(word: Column, doc_id: Column, every: int) -> Column:
    """A word of which, once in ``every``, a code point is missing: both drawn by the crc32 of document and word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """words (word, a row per occurrence) -> word, n."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH, every: int | None = None) -> DataFrame:
    """word: a row for each occurrence of a word of min_length or more, damaged if asked for."""
    rows = docs.select("doc_id", F.explode(F.filter(runs(F.col("text")), lambda w: F.length(w) >= min_length)).alias("word"))
    return rows.select(damaged(F.col("word"), F.col("doc_id"), every).alias("word") if every else "word")


# ---- acceptor, transducer, composition ----------------------------------------------------------------------------------


def acceptor(words: list[str]) -> tuple[list[dict[str, int]], list[bool], int]:
    """The minimised acyclic acceptor of sorted distinct words, built word by word: states that accept the same are one. Arcs
    of each state by code point, whether it is final, and the initial state."""
    known: dict[tuple, int] = {}
    arcs: list[dict[str, int]] = []
    finals: list[bool] = []

    def settled(final: bool, out: dict[str, int]) -> int:
        state = known.setdefault((final, *out.items()), len(arcs))
        if state == len(arcs):
            arcs.append(out)
            finals.append(final)
        return state

    path: list[list] = [[False, {}]]  # the states of the last word, which may still get arcs
    last = ""
    for word in [*words, None]:
        final, word, shared = word is not None, word or "", 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            state = settled(*path.pop())
            path[-1][1][last[len(path) - 1]] = state
        path += [[False, {}] for _ in word[shared:]]
        path[-1][0] |= final
        last = word
    return arcs, finals, settled(*path[0])


def accepted_pairs(words: list[str], length: int, bound: int) -> list[tuple[int, int]]:
    """The pairs of places (u, v) in sorted distinct words, of length and length + 1 code points, of which v is u with one code
    point replaced (by a greater one; both of length) or one more, at a place before bound.

    Composed states after the edit are pairs of states; what both accept is known by numbers: a word's place is the
    sum, over its arcs, of the words that come before."""
    arcs, finals, start = acceptor(words)
    counts, before = [0] * len(arcs), [{} for _ in arcs]
    for q in range(len(arcs)):  # a state is settled after all that it leads to
        n = int(finals[q])
        for c, t in arcs[q].items():
            before[q][c] = n
            n += counts[t]
        counts[q] = n
    both: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def rest(q: int, r: int) -> list[tuple[int, int]]:
        """Places, from q and from r on, of what both states accept."""
        waiting = [(q, r)]
        while waiting:
            a, b = pair = waiting[-1]
            if pair not in both:
                if a == b:
                    both[pair] = [(i, i) for i in range(counts[a])]
                    continue
                shared = [(c, (t, arcs[b][c])) for c, t in arcs[a].items() if c in arcs[b]]
                if open_ := [p for _, p in shared if p not in both]:
                    waiting += open_
                    continue
                both[pair] = [(0, 0)] * (finals[a] and finals[b]) + [(before[a][c] + i, before[b][c] + j) for c, p in shared for i, j in both[p]]
            waiting.pop()
        return both[q, r]

    edits: dict[int, list[tuple[int, int]]] = {}

    def edited(q: int) -> list[tuple[int, int]]:
        """Accepted pairs of the composed state (q, no edit, q) whose edit comes next, as places from q on."""
        if q not in edits:
            out, own = [], list(arcs[q].items())
            for k, (c, t) in enumerate(own):
                for d, s in own[k + 1 :]:
                    out += [(before[q][c] + i, before[q][d] + j) for i, j in rest(t, s)]
                low, high = before[q][c], before[q][c] + counts[t]
                # one more c, and no other c after it: that pair's edit comes later
                out += [(i, low + j) for i, j in rest(q, t) if not low <= i < high]
            edits[q] = out
        return edits[q]

    found, waiting = [], [(start, 0, 0)]
    while waiting:
        q, place, depth = waiting.pop()
        if depth >= bound:
            continue
        for i, j in edited(q):
            if len(words[place + i]) == length:
                found.append((place + i, place + j))
        waiting += [(t, place + before[q][c], depth + 1) for c, t in arcs[q].items()]
    return found


def composed(batches):
    """mapInArrow function: length, ahead, behind, bound, members (array of word, n) -> a, na, b, nb: the near pairs of groups, whose
    words have ``ahead`` code points in common before and ``behind`` after the middle."""
    for batch in batches:
        out = ([], [], [], [])
        for length, ahead, behind, bound, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            known = {m["word"][ahead : len(m["word"]) - behind]: m for m in members}
            words = sorted(known)
            for u, v in accepted_pairs(words, length - ahead - behind, bound):
                a, b = known[words[u]], known[words[v]]
                for column, value in zip(out, (a["word"], a["n"], b["word"], b["n"]), strict=True):
                    column.append(value)
        types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["a", "na", "b", "nb"])


# ---- groups ----------------------------------------------------------------------------------------------------------


def _group(length, prefix, suffix, end) -> Column:
    return F.struct(length.alias("length"), prefix.alias("prefix"), suffix.alias("suffix"), end.cast("int").alias("end"))


def _from(word: Column, at) -> Column:
    """What follows ``at`` code points."""
    return F.substring(word, F.lit(1) + at, F.length(word))


def entered(vocab: DataFrame, min_length: int) -> DataFrame:
    """vocab (word, n) -> a row per group of the word: as the one of length L, and as the longer one of L and L + 1."""
    word, n = F.col("word"), F.length("word")
    out = []
    for length in (n, n - 1):
        h = F.floor(length / 2).cast("int")
        out += [_group(length, F.substring(word, F.lit(1), h), F.lit(""), length + 1), _group(length, F.lit(""), _from(word, n - (length - h)), h)]
    groups = F.filter(F.array(*out), lambda g: g["length"] >= min_length)
    return vocab.select(F.explode(groups).alias("g"), "word", "n").select("g.*", "word", "n")


def stepped(rows: DataFrame) -> DataFrame:
    """One step of the composition, for all words of a group: over the arc of the next code point into the group of the longer prefix; and
    over the edit's arcs into groups of words that are equal after it."""
    word, at, length = F.col("word"), F.length("prefix"), F.col("length")
    end, long = (at + 1).cast("int"), F.length("word") > length
    on = F.when((at + 1 < F.col("end")) & (F.length("word") - F.length("suffix") > at), _group(length, F.substring(word, F.lit(1), at + 1), F.col("suffix"), F.col("end")))
    replaced = F.when(~long & (at < length), _group(length, F.col("prefix"), _from(word, at + 1), end))
    one, following = F.substring(word, at + 1, F.lit(1)), F.substring(word, at + 2, F.lit(1))
    more = F.when(long & (one != following), _group(length, F.col("prefix"), _from(word, at + 1), end)).when(~long, _group(length, F.col("prefix"), _from(word, at), end))
    groups = F.filter(F.array(on, replaced, more), lambda g: g.isNotNull())
    return rows.select(F.explode(groups).alias("g"), "word", "n").select("g.*", "word", "n")


def near_pairs(vocab: DataFrame, min_length: int = MIN_LENGTH, limit: int = LIMIT) -> DataFrame:
    """vocab (word, n) -> a, na, b, nb: each pair of words one edit apart, once; a is the shorter or lesser one."""
    rows, parts = entered(vocab, min_length), []
    while True:
        hot = rows.groupBy(*GROUP).agg(F.count("*").alias("_m")).where((F.col("_m") > limit) & (F.col("end") > F.length("prefix") + 1))
        hot = written(hot.select(*GROUP), "hot")
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(small(hot), GROUP, "left_anti"))
        rows = written(stepped(rows.join(small(hot), GROUP, "left_semi")), "arcs")
    groups = reduce(DataFrame.unionByName, parts).groupBy(*GROUP).agg(F.collect_list(F.struct("word", "n")).alias("members")).where(F.size("members") > 1)
    shape = groups.select("length", F.length("prefix").alias("ahead"), F.length("suffix").alias("behind"), (F.col("end") - F.length("prefix")).alias("bound"), "members")
    return in_arrow(shape, composed, "a string, na long, b string, nb long")


def rooted(forms: DataFrame) -> DataFrame:
    """forms (word, form), without circles -> word, root: where following forms ends."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        following = written(now.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "forms")
        if following.where("moved").isEmpty():
            return now
        now = following.drop("moved")


def variants(vocab: DataFrame, min_length: int = MIN_LENGTH, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """vocab (word, n; of min_length code points or more) -> word, form, root, n, n_near, form_n."""
    vocab = written(vocab, "vocabulary")
    pairs = near_pairs(vocab, min_length, limit)
    # -count first and then the word: the least is the most frequent, of equals the lesser
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n{y}")).alias("o"), F.col(y).alias("near")).alias("best")) for x, y in ("ab", "ba")])).alias("e")
    near = pairs.select(ends).groupBy("e.word").agg(F.count("*").alias("n_near"), F.min("e.best").alias("best"))
    out = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.o")).alias("near_n"))
    strong = F.col("near_n") >= ratio * F.col("n")
    out = written(out.select("word", "n", "n_near", F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")), "near")
    roots = rooted(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(occurrences(documents(spark, sf_dir), every=199)))


ORACLE = rf"""{CRC},
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS w FROM documents),
often AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS key, w, count(*) AS m FROM run WHERE length(w) >= {MIN_LENGTH} GROUP BY ALL),
drawn AS (SELECT w, m, {crc32_sql("key")} AS h FROM often, tab),
word AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, m FROM drawn),
v AS (SELECT word, sum(m)::BIGINT AS n FROM word WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(m) >= {MIN_COUNT}),
gap AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS left_ FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM gap a JOIN gap b ON a.left_ = b.left_ AND a.i = b.i AND a.word != b.word
  UNION SELECT g.word, v.word, v.n FROM gap g JOIN v ON g.left_ = v.word
  UNION SELECT v.word, g.word, g.n FROM gap g JOIN v ON g.left_ = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
form AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM form UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON chain.root = form.word WHERE form.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN chain USING (word) WHERE root IN (SELECT word FROM form WHERE form IS NULL)"""
