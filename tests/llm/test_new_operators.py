"""Spelling variants, the Merkle manifest and Hilbert shards against brute force."""

import hashlib
import itertools
import random
import re
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from tilework.llm import common, hilbert, manifest, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n string, shard string, curve string, leaf string, path string"


def frame(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars); columns whose names clash with the operators' own come along."""
    return spark.createDataFrame([(*r, "x", "y", "z", "c", "l", "p") for r in rows], SCHEMA)


# ---- spelling variants -------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def words_like(seed, n, letters="ab", low=6, high=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)})


def test_composition_against_all_pairs():
    for seed in range(30):
        words = words_like(seed, 60, "abé", 0, 6)
        for length in range(7):
            own = [w for w in words if len(w) in (length, length + 1)]
            for bound in (1, 2, 9):
                got = variants.accepted_pairs(own, length, bound)
                assert len(got) == len(set(got))
                pairs = {tuple(sorted((own[u], own[v]), key=lambda w: (len(w), w))) for u, v in got}
                want = {(a, b) for a, b in itertools.permutations(own, 2) if (len(a), a) < (len(b), b) and len(a) == length and one_edit(a, b)}
                same = {(a, b): next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), length) for a, b in want}
                assert pairs == {p for p in want if same[p] < bound}
    arcs, finals, _ = variants.acceptor(sorted(["tapped", "tapping", "topped", "topping"]))
    assert len(arcs) == 9 and sum(finals) == 1
    assert variants.accepted_pairs(["a" * 30_000, "a" * 30_001], 30_000, 40_000) == [(0, 1)]


@pytest.mark.parametrize("limit", [2, 4096])
def test_variants_against_all_pairs(spark, limit):
    rng = random.Random(limit)
    counts = {w: rng.choice([5, 6, 25, 30, 150, 800]) for w in [*words_like(1, 260), *words_like(2, 60, "xyz", 11, 14), "straße", "strasse", "x" * 5000, "x" * 5001]}
    vocab = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")
    got = [tuple(r) for r in variants.variants(vocab, limit=limit).collect()]
    assert len(got) == len(counts) and set(got) == brute_variants(counts)
    assert {r for r in got if r[1]} and any(r[1] != r[2] for r in got if r[1])


def test_vocabulary_of_documents(spark):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = ["Regional REGIONAL regional, Äpfelbäume-äpfelbäume x" * 20, None, "", "regionales " * 3000, "short words only"]
    rows = [(i, texts[i % 5], "en", "s", 1) for i in range(40)] + [(None, texts[0], None, None, None)] + [(3, texts[3], "en", "s", 1)] * 2
    want = {}
    for d, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(upper)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] = want.get(w, 0) + 1
    got = {r["word"]: r["n"] for r in variants.vocabulary(variants.occurrences(frame(spark, rows), every=199)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    empty = variants.vocabulary(variants.occurrences(frame(spark, []), every=199))
    assert variants.variants(empty).count() == 0


# ---- manifest ----------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(nodes, fan):
    """(root, siblings as (left, right) of every leaf)."""
    paths, owner = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, o in enumerate(owner):
            run = o - o % fan
            paths[k].append(("".join(nodes[run:o]), "".join(nodes[o + 1 : run + fan])))
        nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        owner = [o // fan for o in owner]
    return nodes[0], paths


def brute_leaf(r):
    d, text, lang, source, n = r
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


@pytest.mark.parametrize(("fan", "depth"), [(2, 10), (2, 2), (3, 1)])
def test_manifest_against_brute_force(spark, fan, depth):
    rows = [(i, f"text é {i}", random.Random(i).choice(["en", "en", "de", None]), "s", i) for i in range(61)]
    rows += [(70, None, "fr", None, None), (None, "", "en", "s", 0), (None, "no id", "en", "s", None), (5, "other", "en", "s", 3), (7, "text é 7", rows[7][2], "s", 7), (71, "w " * 50_000, "de", "s", 9)]
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, brute_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan) for g in order}
    root, above = brute_tree([trees[g][0] for g in order], fan)
    want = []
    for k, g in enumerate(order):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            path = path + above[k]
            tampered = zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[0] is not None and r[4] is not None
            now = brute_leaf((*r[:4], r[4] + 1)) if tampered else leaf
            for left, right in path:
                now = sha(left + now + right)
            want.append((r[0], leaf, trees[g][0], root, sha("".join(a + b for a, b in path)), now, not tampered))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest.verified(manifest.manifest(manifest.leaves(frame(spark, rows), tampered), fan=fan, depth=depth))
    got = [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")), "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {True, False} == {r[-1] for r in got}


def test_manifest_of_nothing_and_of_one(spark):
    none = F.lit(False)
    assert manifest.manifest(manifest.leaves(frame(spark, []), none)).count() == 0
    (r,) = manifest.manifest(manifest.leaves(frame(spark, [(1, "a", None, None, None)]), none)).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["path"] == []


# ---- Hilbert shards ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("axes", "bits"), [(1, 3), (2, 4), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, axes, bits):
    names = [f"a{i}" for i in range(axes)]
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=axes)), ", ".join(f"{n} int" for n in names))
    got = {r["curve"]: tuple(r)[:axes] for r in hilbert.with_index(cells, names, bits).collect()}
    assert sorted(got) == list(range(1 << bits * axes))
    assert all(sum(abs(x - y) for x, y in zip(got[i], got[i + 1], strict=True)) == 1 for i in range(len(got) - 1))


def shard_rows(n):
    rng = random.Random(n)
    rows = [(i, "word " * rng.randint(0, 300), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b", None]), 1) for i in range(n)]
    return rows + [(None, None, None, None, None), (3, "é" * 90_000, "en", "hot", 1), *[(4, "same", "en", "a", 1)] * 9]


def test_shards_are_runs_of_the_curve(spark):
    rows = shard_rows(300)
    docs = frame(spark, rows)
    got = hilbert.sharded(common.written(hilbert.described(docs), "described")).collect()
    assert len(got) == len(rows)
    shards = [sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"]) for s in range(8)]
    assert max(map(len, shards)) - min(map(len, shards)) <= 1
    assert all([r["slot"] for r in s] == list(range(len(s))) for s in shards)
    flat = [(r["curve"], r["text_crc32"], r["size"], r["doc_id"] is not None, r["doc_id"] or 0) for s in shards for r in s]
    assert flat == sorted(flat)
    texts = sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert texts == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    order = sorted(rows, key=lambda r: (r[3] is not None, r[3] or ""))
    first = {s: next(i for i, r in enumerate(order) if r[3] == s) * 64 // len(rows) for s in {r[3] for r in rows}}
    assert all(r["cell"][0] == first[r["source"]] for r in got)
    assert hilbert.sharded(hilbert.described(frame(spark, []))).count() == 0


def test_written_shards_and_their_manifest(spark):
    docs = frame(spark, shard_rows(400)).drop("shard")
    path = tempfile.mkdtemp(prefix="spark-") + "/shards"
    kept = {r["shard"]: r for r in hilbert.write_shards(docs, path, shards=16).collect()}
    back = spark.read.parquet(path)
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, docs.collect()))
    sizes = {r["shard"]: r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert sizes == {s: r["rows"] for s, r in kept.items()}
    for r in back.collect():
        size = len((r["text"] or "").encode()) + 1
        assert kept[r["shard"]]["min_size"] <= size <= kept[r["shard"]]["max_size"]
    # a filter on any one dimension passes over shards
    open_ = lambda ok: sum(1 for r in kept.values() if ok(r))
    assert open_(lambda r: r["min_size"] <= 100) < 16 and open_(lambda r: (r["min_source"] or "~") <= "a" <= (r["max_source"] or "")) < 16 and open_(lambda r: r["nulls_lang"] > 0) < 16
