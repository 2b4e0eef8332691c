"""Toxicity by noisy-channel deobfuscation.

Text that someone disguised is read as a noisy channel's output: letters written as look-alike digits or symbols,
spread out with spaces or dots, or repeated. A suspicious token, or a run of single characters, becomes a lattice whose
columns hold the letters each written character may stand for (with the channel's cost), repeated letters may collapse,
and separators may vanish or be a word's edge; a Viterbi pass under a character trigram model, counted over all
documents, picks the likeliest words. Tokens and runs are decoded whole, whatever their length: time is linear in it, and
states are pairs of letters. Letters written twice or more are such a sign, too: each of them may be kept or collapsed. Tokens without
signs stay as they are. The restored words are then scored, and those that were written.

The score is a logistic model over word beginnings and whole words, fitted on a bounded, documented sample of labelled
documents (sample_rows). Its features are those whose document frequencies differ most between the labels; their counts
are a Spark aggregation. Restoring and scoring are one pass in mapInArrow: no shuffle, memory of a batch and a bounded
memory of decoded tokens; each distinct token of a batch is read once.

Defined cases: null or empty texts get the model's base score; labels of null doc_ids are ignored; documents with
contradicting labels count as toxic; repeated rows repeat; extra columns are ignored. Without labels of both kinds
every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilework.llm.common import documents, in_arrow, written

#: The letters that a written character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "*": "aeiou", "#": "h", "%": "o", "&": "a",
}
SEPARATORS = ".-_*~·'`^"
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
STATES = len(LETTERS) + 1
MEMORY = 4_000_000

#: Signs of a disguise in a token without the punctuation around it: a look-alike or separator between letters, look-alikes
#: before or after letters, or a letter three times running.
_SIGNS = "".join(re.escape(c) for c in LOOKALIKES)
_MIXED = re.compile(rf"[^\W\d_][{_SIGNS}{re.escape(SEPARATORS)}]+[^\W\d_]|^[{_SIGNS}]+[^\W\d_]|[^\W\d_][{_SIGNS}]+$|([^\W\d_])\1\1", re.IGNORECASE)
_DOUBLED = re.compile(r"([^\W\d_])\1+")
#: A run of single letters and look-alikes (four or more, one letter at least) with one or two separators or white space between.
_ONE = rf"(?:[^\W\d_]|[{_SIGNS.replace(re.escape('*'), '')}])"
_SPACED = re.compile(rf"(?<!\S){_ONE}(?:[\s{re.escape(SEPARATORS)}]{{1,2}}{_ONE}){{3,}}+")
_BETWEEN = re.compile(rf"[\s{re.escape(SEPARATORS)}]")
_RUN = re.compile(r"(.)\1*", re.DOTALL)
_WORD = re.compile(r"[^\W\d_]+")
_AROUND = ".,;:!?\"'()[]"


def letter_trigrams(docs: DataFrame) -> DataFrame:
    """code, n: how often each letter triple (0: word edge or another character) occurs in all documents."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c, i in CODE.items():
        table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = i

    def run(batches):
        total = np.zeros(STATES**3, dtype=np.int64)
        for batch in batches:
            for at_ in range(0, batch.num_rows, 256):
                joined = " ".join(t or "" for t in batch.column(0).slice(at_, 256).to_pylist())
                codes = table[np.frombuffer(f"  {joined}  ".encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
                total += np.bincount((codes[:-2] * STATES + codes[1:-1]) * STATES + codes[2:], minlength=STATES**3)
        at_ = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at_.astype(np.int32)), pa.array(total[at_])], names=["code", "n"])

    return in_arrow(docs.select("text"), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """(STATES, STATES, STATES) of log probabilities of the third letter after two, smoothed. Its size is fixed by the
    alphabet, whatever the corpus."""
    counts = np.full(STATES**3, 0.05)
    for code, n in letter_trigrams(docs).collect():  # STATES**3 rows at most
        counts[code] += n
    counts = counts.reshape(STATES, STATES, STATES)
    return np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)


class Decoder:
    """Viterbi over the lattice of one token."""

    SUBSTITUTE, DROP, COLLAPSE, KEEP_RUN, EDGE = 1.5, 1.0, 0.5, 1.5, 0.5

    def __init__(self, model: np.ndarray):
        self.model, self.known = model.tolist(), {}

    def columns(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of one character, the strings that it may stand for, with their costs."""
        return [self.choices(m[0][0], min(len(m[0]), 3)) for m in _RUN.finditer(token.lower())]

    def choices(self, c: str, run: int) -> list[tuple[str, float]]:
        """The strings that a run of c may stand for (run: 1, 2, or 3 for more)."""
        found = self.known.get((c, run))
        if found is not None:
            return found
        choices = []
        letters = [(c, 0.0)] if c in CODE else [(x, self.SUBSTITUTE) for x in LOOKALIKES.get(c, "")]
        for x, cost in letters:
            choices.append((x, cost + self.COLLAPSE * (run > 1)))
            if run >= 2:
                choices.append((x * 2, cost + (self.KEEP_RUN * (run > 2))))
        if c in SEPARATORS or c.isspace() or not letters:  # other characters are edges by themselves
            choices.append(("", self.DROP * (0.2 if c.isspace() else 1.0)))
            choices.append((" ", self.EDGE if c in SEPARATORS or c.isspace() or letters else 0.0))
        if c in CODE or c in LOOKALIKES or c in SEPARATORS:  # as many as the fixed values
            self.known[c, run] = choices
        return choices

    def decode(self, token: str) -> list[str]:
        """The likeliest words; states are the last two letters (0: an edge), paths are linked backwards."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        model = self.model
        for choices in self.columns(token):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for text, cost in choices:
                    p, q, s = a, b, score - cost
                    for x in text:
                        n = CODE.get(x, 0)
                        s += model[p][q][n]
                        p, q = q, n
                    old = following.get((p, q))
                    if old is None or old[0] < s:
                        following[p, q] = (s, (path, text) if text else path)
            best = following
        score, path = max(((s + model[a][b][0], path) for (a, b), (s, path) in best.items()), key=lambda x: x[0])
        parts = []
        while path is not None:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts)).split()


def spaced_runs(text: str) -> list[str]:
    """The text's runs of single characters, in one pass: a run is taken as far as it goes, and back to the last character that white
    space or punctuation follows."""
    out = []
    for m in _SPACED.finditer(text):
        start, end = m.span()
        while end > start and end < len(text) and not text[end].isspace() and text[end] not in ".,!?;:":
            end -= 1
            while end > start and _BETWEEN.match(text[end - 1]):
                end -= 1
        run = text[start:end]
        if sum(not _BETWEEN.match(c) for c in run) >= 4 and any(c.isalpha() for c in run):
            out.append(run)
    return out


class Restorer:
    """Words of texts, with disguised ones restored. What was decoded is remembered, up to MEMORY characters."""

    def __init__(self, model: np.ndarray):
        self.decoder, self.memory, self.held = Decoder(model), {}, 0

    def decoded(self, core: str) -> list[str]:
        found = self.memory.get(core)
        if found is None:
            if self.held > MEMORY:
                self.memory.clear()
                self.held = 0
            found = self.memory[core] = self.decoder.decode(core)
            self.held += len(core)
        return found

    def tokens(self, tokens: list[str]) -> tuple[list[int], list[str]]:
        """owner, word: the words of each token, beside its position."""
        owner, words = [], []
        for i, low in enumerate("\n".join(tokens).lower().split("\n")):
            core = low.strip(_AROUND)
            if core.isalpha():  # its one word is itself
                words.append(core)
                owner.append(i)
                found = ()
            else:
                found = _WORD.findall(low)
            # both readings count: the channel may have left the token alone
            if _DOUBLED.search(core) is not None or (found != () and _MIXED.search(core) is not None):
                found = [*found, *self.decoded(core)]
            if found:
                words.extend(found)
                owner.extend([i] * len(found))
        return owner, words

    def runs(self, text: str) -> list[str]:
        """Words of the text's spaced runs."""
        return [w for run in spaced_runs(text) for w in self.decoder.decode(run)]

    def words(self, text: str) -> set[str]:
        """The distinct restored words of one text."""
        return {*self.tokens(text.split())[1], *self.runs(text)}

    def features(self, texts: pa.Array, names: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """row, feature, names: the distinct features of each text, as positions in texts and in names (if not given, all
        those of these texts). Each distinct token is restored once."""
        texts = pc.fill_null(texts, "")
        split = pc.utf8_split_whitespace(texts)
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        coded = split.flatten().dictionary_encode()
        token, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        owner, words = self.tokens(coded.dictionary.to_pylist())
        rows_of_runs = []
        for i, text in enumerate(texts.to_pylist()):
            found = self.runs(text)
            if found:  # the runs of a text count as one more token
                words += found
                owner += [n + len(rows_of_runs)] * len(found)
                rows_of_runs.append(i)
        row = np.concatenate([row, np.array(rows_of_runs, dtype=row.dtype)])
        token = np.concatenate([token, n + np.arange(len(rows_of_runs))])
        made = word_features(pa.array(words, pa.string()))
        names = made.dictionary_encode().dictionary if names is None else names
        at_ = pc.index_in(made, value_set=names)
        has = at_.is_valid().to_numpy(zero_copy_only=False)
        feature, owner = at_.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), np.tile(np.array(owner, dtype=np.int64), 4)[has]
        order = np.argsort(owner, kind="stable")
        feature, per = feature[order], np.bincount(owner, minlength=n + len(rows_of_runs))
        start, some = np.cumsum(per) - per, per[token] > 0
        row, token = row[some], token[some]
        k = per[token]
        at_ = np.repeat(start[token] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        pairs = np.unique(np.repeat(row, k) * max(1, len(names)) + feature[at_])
        return pairs // max(1, len(names)), pairs % max(1, len(names)), names


def word_features(words: pa.Array) -> pa.Array:
    """Of each word: whole with a mark, then beginnings of 4, 5 and 6 letters (null where it is shorter)."""
    size = pc.utf8_length(words)
    cut = [pc.if_else(pc.greater_equal(size, n), pc.utf8_slice_codeunits(words, 0, n), None) for n in (4, 5, 6)]
    return pa.concat_arrays([pc.binary_join_element_wise(words, "$", ""), *cut])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _training(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """y, text of at most sample_rows labelled documents outside the held-out fold, chosen by a hash of the id."""
    y = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "_id")
    return docs.join(F.broadcast(written(y, "labels")), docs["doc_id"] == F.col("_id")).select("y", "text")  # sample_rows rows at most


class Model:
    def __init__(self, weights: dict[str, float], base: float):
        self.names = pa.array(sorted(weights), pa.string())
        self.weights, self.base = np.array([weights[f] for f in sorted(weights)], dtype=np.float64), base

    def score(self, words: set[str]) -> float:
        """Of the words of one text; ``scores`` gives the same for many texts."""
        hits = pc.is_in(self.names, value_set=word_features(pa.array(sorted(words), pa.string()))).to_numpy(zero_copy_only=False)
        return float(1 / (1 + np.exp(-np.clip(self.base + self.weights[hits.astype(bool)].sum(), -30, 30))))

    def scores(self, restorer: Restorer, texts: pa.Array) -> np.ndarray:
        row, feature, _ = restorer.features(texts, self.names)
        x = self.base + np.bincount(row, self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, lm: np.ndarray, sample_rows: int = 12_000, max_features: int = 2_000, min_docs: int = 3) -> Model:
    """Counts features by label in Spark, keeps those far more frequent with toxic labels (a one-sided bound on the odds),
    and fits their weights by logistic regression on the sample's sparse rows (max_features bounds each)."""
    sample = written(_training(docs, labels, sample_rows), "sample")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        return Model({}, math.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0))

    def count(batches):
        restorer = Restorer(lm)
        for batch in batches:
            row, feature, names = restorer.features(batch.column(1))
            y = batch.column(0).to_numpy(zero_copy_only=False)[row]
            sums = [pa.array(np.bincount(feature[y == k], minlength=len(names)).astype(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([names, *sums], names=["f", "clean", "toxic"])

    sums = in_arrow(sample, count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    bound = odds - 1.0 / F.sqrt(F.col("toxic") + 0.5) - 1.0 / F.sqrt(F.col("clean") + 0.5)
    chosen = sums.where(f"toxic >= {min_docs}").where(bound > math.log(2)).orderBy((bound * F.sqrt("toxic")).desc(), "f").limit(max_features)
    names = [r["f"] for r in chosen.collect()]  # max_features rows at most

    def rows(batches):
        restorer, known = Restorer(lm), pa.array(names, pa.string())
        for batch in batches:
            row, feature, _ = restorer.features(batch.column(1), known)
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["y", "x"])

    data = in_arrow(sample, rows, "y int, x array<int>").groupBy("x").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("t"), F.count("*").alias("n")).collect()
    data.sort(key=lambda d: d["x"])  # sums in one order, whatever order rows come in
    t, n = (np.array([d[c] for d in data], dtype=np.float64) for c in ("t", "n"))
    w, b = _logistic([d["x"] for d in data], len(names), t, n)
    return Model({f: float(v) for f, v in zip(names, w, strict=True)}, b)


def _logistic(x: list[list[int]], width: int, t: np.ndarray, n: np.ndarray, steps: int = 400, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights (not negative: every feature was chosen for the toxic side) and base, by accelerated gradient steps.
    x: the features of each distinct row; t of its n documents are toxic."""
    row = np.repeat(np.arange(len(x)), [len(r) for r in x])
    col = np.array([c for r in x for c in r], dtype=np.int64)
    w, b, total = np.zeros(width), math.log((t.sum() + 1) / (n.sum() - t.sum() + 1)), n.sum()
    positive, negative = total / (2 * max(1.0, t.sum())), total / (2 * max(1.0, n.sum() - t.sum()))
    vw, vb = np.zeros_like(w), 0.0
    rate = 4.0 / max(1.0, float(max(map(len, x), default=0)) ** 0.5)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], minlength=len(x)) + b, -30, 30)))
        g = (p * negative * (n - t) - (1 - p) * positive * t) / total
        vw, vb = 0.9 * vw - rate * (np.bincount(col, g[row], minlength=width) + ridge * w / max(1, width)), 0.9 * vb - rate * g.sum()
        w, b = np.maximum(0, w + vw), b + vb
    return w, float(b)


def scored(docs: DataFrame, model: Model, lm: np.ndarray) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        restorer = Restorer(lm)
        for batch in batches:
            scores = model.scores(restorer, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    lm = language_model(docs)
    out = scored(docs, fit(docs, labels, lm), lm)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
