"""Each operator on small hand-made tables, against brute force where there is one."""

import hashlib
import html
import itertools
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilework.llm import common, density, fixity, minhash, mixing, paragraphs, quality, toxicity, transport

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string"


def frame(spark, rows):
    """rows: (doc_id, text, source); columns whose names clash with the operators' own come along."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", "y") for d, t, s in rows], SCHEMA)


def sentence(seed, n):
    """n words that no other seed has."""
    return " ".join(f"w{seed}x{(i * 7919 + seed) % 100003}" for i in range(n))


# ---- quality ---------------------------------------------------------------------------------------------------------


def base(text):
    w = WORDS.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_features_and_verdicts(spark):
    shared = "this very line is on all pages"
    rows = [(i, f"{shared}\n{shared} {i}\n" + "\n".join([shared.upper()] * 12) + f"\n{sentence(i, 40)}", "h") for i in range(12)]
    rows += [(20, sentence(20, 80) + f"\n{shared}", "h"), (21, None, "h"), (22, "", None), (23, "a b c a b c a b c d", None), (24, "é ## é\n\né ## é", "g")]
    rows += [(25, "x y " * 3000, "h"), (30, sentence(30, 60), "k"), (30, sentence(30, 60), "k")]
    got = quality.quality_verdicts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for d, text, _ in rows:
        r = next(x for x in got if x["doc_id"] == d)
        if d != 25:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(text), d
        n = r["n_words"]
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert 20 in kept and 30 in kept
    assert next(r for r in got if r["doc_id"] == 20)["removed_words"] == 7
    assert sum(r["removed_words"] for r in got if r["doc_id"] == 30) == 0
    cleaned = {r["doc_id"]: r["text"] for r in quality.apply_quality(frame(spark, rows)).collect()}
    assert set(cleaned) == kept and cleaned[20] == sentence(20, 80)
    assert quality.quality_verdicts(frame(spark, [])).count() == 0


def test_depleted_documents_are_rejected(spark):
    boiler = "\n".join(sentence(100 + k, 10) for k in range(8))
    rows = [(i, f"{boiler}\n{sentence(i, 12)}", "h") for i in range(12)] + [(50, sentence(50, 90), "h")]
    got = {r["doc_id"]: r for r in quality.quality_verdicts(frame(spark, rows)).collect()}
    assert not any(got[i]["kept"] for i in range(12)) and got[50]["kept"] and got[3]["removed_words"] == 80


def test_limit_is_bounded_for_large_hosts_and_names_may_clash(spark):
    often = "a line of boilerplate that eleven documents share " * 3
    own = lambda i: sentence(i, 60).translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731 (digits are all one to a normalised line)
    rows = [(i, own(i) + (f"\n{often}" if i < 11 else ""), "h") for i in range(300)]
    docs = frame(spark, rows).selectExpr("*", "'t' AS _t", "'k' AS _keys", "'h' AS _hh", "1 AS _id", "2 AS _host")
    texts = {r["doc_id"]: r for r in quality.apply_quality(docs).collect()}
    assert all(texts[i]["text"] == t for i, t, _ in rows)  # 5 % of 300 documents are 15
    got = quality.apply_quality(docs, max_docs=10)
    assert got.columns == docs.columns
    for r in got.collect():
        assert r["text"] == own(r["doc_id"]) and r["n_chars"] == len(r["text"]) and (r["_t"], r["_keys"], r["_hh"], r["_id"], r["_host"]) == ("t", "k", "h", 1, 2)
    assert got.count() == 300


# ---- mixing ----------------------------------------------------------------------------------------------------------


def test_mix_targets_and_bounds(spark):
    rows = [(i, sentence(i, 5 + i * 37 % 90), f"s{i % 7}") for i in range(400)] + [(900, None, None), (901, sentence(901, 30), None), (902, "", "s0"), (None, sentence(3, 9), "s1")] + [(910, sentence(910, 20), "s2")] * 3
    sized = mixing.sizes(frame(spark, rows))
    plan = mixing.mix_plan(sized)
    got = mixing.with_copies(sized, plan).collect()
    assert len(got) == len(rows)
    total, by = 0, {}
    for r in got:
        assert 0 <= r["copies"] <= 3 and (r["copies"] == 0 or r["size"] > 0)
        total += r["size"]
        by.setdefault(r["source"], [0, r["source_size"], r["target"]])[0] += r["copies"] * r["size"]
    assert abs(sum(v[2] for v in by.values()) - total) < 1e-6 * total
    for taken, size, target in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 100
    again = sorted(map(str, mixing.with_copies(sized, mixing.mix_plan(sized)).select("doc_id", "copies").collect()))
    assert again == sorted(str(r) for r in mixing.with_copies(sized, plan).select("doc_id", "copies").collect())
    mixed = mixing.mixed(frame(spark, rows))
    assert mixed.columns == frame(spark, []).columns and mixed.count() == sum(r["copies"] for r in got)
    clash = frame(spark, rows).withColumns({n: F.lit("mine") for n in ("size", "target", "source_size", "copies", "c", "missing", "certain", "cutoff", "below", "draw", "_doc", "_key")})
    assert {tuple(r) for r in mixing.mixed(clash).select("size", "target", "c", "missing", "draw").distinct().collect()} == {("mine",) * 5}
    nobody = mixing.sizes(frame(spark, [(None, sentence(i, 20), f"s{i % 3}") for i in range(300)]))
    sums = mixing.with_copies(nobody, mixing.mix_plan(nobody)).groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 20 for r in sums)
    empty = mixing.sizes(frame(spark, []))
    assert mixing.with_copies(empty, mixing.mix_plan(empty)).count() == 0


# ---- near-duplicates -------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, percent):
    s = [shingles(t, k) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(s[i] & s[j])
        if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s[i]), least.get(find(i)) if s[i] else d) for i, (d, _, _) in enumerate(rows) if d is not None)


def edited(text, *places):
    w = text.split()
    for p in places:
        w[p] = f"edit{p}"
    return " ".join(w)


def near_rows():
    rows, n = [], 0
    for g in range(12):
        one = sentence(g, 60 + g * 10)
        for e in range(9):
            rows.append((n, edited(one, *range(0, 5 * e, 5)) if e else one.upper(), "s"))
            n += 1
    rows += [(n, None, "s"), (n + 1, "", "s"), (n + 2, "two words", "s"), (n + 3, "TWO  words", "t"), (n + 4, " \n ", None), (None, sentence(1, 70), "s"), (n + 5, sentence(77, 20000), "s"), (n + 6, sentence(77, 20000) + " more", "s")]
    return rows + [(n + 2, "two words", "s")]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, k, percent):
    rows = near_rows()
    got = minhash.near_duplicates(frame(spark, rows), k, percent).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_document_of_a_group_stays(spark):
    rows = near_rows()
    want = {c for _, _, c in brute(rows, 5, 80)}
    out = minhash.deduplicated(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) - {None} == want
    assert minhash.deduplicated(frame(spark, [])).count() == 0
    alone = [(None, "the same words " * 9, "s")] * 3 + [(None, sentence(5, 20) + " x", "s"), (None, "", "s"), (None, "", "s"), (None, sentence(5, 20), "s")]
    assert minhash.deduplicated(frame(spark, alone)).count() == 3


def test_classes_that_agree_in_half_their_bits_are_told_apart(spark):
    rows = [(1, 2, 5), (1, 3, 5), (1, 3, 6), (7, 7, 7)]
    got = minhash._numbered(spark.createDataFrame(rows, "set long, set2 long, n long")).collect()
    assert len({r["node"] for r in got}) == 4


def test_components_of_long_chains(spark):
    from tilework.llm.links import components

    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5), (7000, 6000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1050), 1000), 7000: 6000, 6000: 6000}


# ---- paragraphs ------------------------------------------------------------------------------------------------------


def words_of(text, r):
    return text.split()[r["at"] : r["until"]]


def test_repeated_passages(spark):
    a, b = sentence(1, 60), sentence(2, 60)
    rows = [
        (1, f"{sentence(11, 40)}\n{a}\n{sentence(12, 5)}", "s"), (2, f"{a}\n{sentence(13, 40)}", "s"), (3, f"{sentence(14, 30)}\n{edited(a, 30)}", "s"), (4, f"{b}\n{b}", "s"), (5, sentence(15, 50), "s"),
        (6, None, "s"), (7, "", "s"), (8, "Licensed under X.", "s"), (9, "Licensed under X.", "s"), (10, sentence(16, 20000), "s"), (None, f"{sentence(17, 40)} {b} {sentence(18, 9)}", "s"), (5, sentence(15, 50), "s"),
        (11, f"{sentence(19, 30)}\n{a} \n{sentence(20, 3)}", None), (11, f"{sentence(21, 30)} {a}", None),
    ]
    got = paragraphs.repeated_passages(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["at"], r["until"], r["kept"]) for r in got) == [(0, 40, 100, True), (1, 40, 100, True), (2, 0, 60, False), (3, 30, 90, False), (4, 0, 60, False), (4, 60, 120, False), (11, 30, 90, False), (11, 30, 90, False)]
    assert {r["first_doc"] for r in got if (r["doc_id"] or 4) != 4} == {1} and {r["first_doc"] for r in got if r["doc_id"] in (None, 4)} == {None}
    out = {(r["doc_id"], r["source"], (r["text"] or "")[:9]): (r["text"], r["n_chars"]) for r in paragraphs.without_repeats(frame(spark, rows)).collect()}
    left = {k[0]: v for k, v in out.items()}
    assert len(out) == len(rows) - 1 and left[2][0] == sentence(13, 40) and left[2][1] == len(left[2][0]) and left[1][0] == rows[0][1] and left[6][0] is None and left[4][0] == "" and left[3][0] == sentence(14, 30)
    assert {v[0] for k, v in out.items() if k[0] == 11} == {sentence(19, 30) + "\n" + sentence(20, 3), sentence(21, 30)}
    assert paragraphs.repeated_passages(frame(spark, [])).count() == 0 and paragraphs.without_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("repeats", [2, 40])
def test_colliding_lines_against_all_pairs(spark, repeats):
    """Lines with edits: those of the components that all pairs' exact Jaccard gives, whatever collides."""
    lines = [sentence(500 + g, 30 + 7 * g) for g in range(9)]
    rows, n = [], 0
    for g, one in enumerate(lines):
        for e in range(repeats):
            rows.append((n, f"{sentence(n + 9000, 6)}\n{edited(one, *[(11 * e * j) % (28 + 7 * g) for j in range(e % (g + 2))])}\n{sentence(n + 7000, 7)}", "s"))
            n += 1
    got = {r["doc_id"] for r in paragraphs.repeated_passages(frame(spark, rows)).collect()}
    sets = [shingles(t.split("\n")[1], 5) for _, t, _ in rows]
    near = {i for i, j in itertools.permutations(range(n), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert near <= got and len(near) > 5


def shared_run(a, b):
    """Length of the longest run of words that both texts have, by brute force."""
    a, b, best, before = a.split(), b.split(), 0, {}
    for x in a:
        now = {j: before.get(j - 1, 0) + 1 for j, y in enumerate(b) if x == y}
        best, before = max([best, *now.values()]), now
    return best


def test_passages_inside_across_and_wrapped_over_lines(spark):
    def wrapped(text, n):
        w = text.split()
        return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))

    rows = []
    for g in range(0, 40, 4):
        p = sentence(1000 + g, 51 + g)
        own = [sentence(2000 + 10 * g + i, 90) for i in range(8)]
        rows += [
            (10 * g, f"{own[0]} {p} {own[1]}", "s"),  # inside a longer line
            (10 * g + 1, f"{own[2]} é\n{p} {own[3]}", "s"),  # at a line's start
            (10 * g + 2, f"{own[4]} {wrapped(p, 9)} {own[5]}", "s"),  # over short lines
            (10 * g + 3, f"{own[6]} {edited(p, 50)} {own[7]}" if g else own[6], "s"),  # an edit, of which g words follow
        ]
    docs = frame(spark, rows)
    got = paragraphs.repeated_passages(docs).collect()
    texts = {d: t for d, t, _ in rows}
    for r in got:
        piece, g = words_of(texts[r["doc_id"]], r), r["doc_id"] // 10
        want = sentence(1000 + g, 51 + g).split()
        if r["doc_id"] % 10 < 3:
            assert piece == want and r["kept"] == (r["doc_id"] % 10 == 0) and r["first_doc"] == 10 * g
        else:
            assert piece in (want[:50], want[51:]) and not r["kept"]
    assert {r["doc_id"] for r in got} == set(texts) - {3}
    out = [r["text"] for r in paragraphs.without_repeats(docs).orderBy("doc_id").collect()]
    assert out[0] == rows[0][1] and out[1] == f"{sentence(2002, 90)} é\n{sentence(2003, 90)}"
    assert all(shared_run(a, b) < 50 for a, b in itertools.combinations(out, 2))


def test_first_document_of_three_that_share_outer_bands(spark):
    """The middle text has more of the passage than the first one, so that the last one's bands meet both."""
    for seed in (3000, 3008):
        p, w = sentence(seed, 90), sentence(seed, 90).split()
        rows = [(0, f"{sentence(seed + 1, 40)} {' '.join(w[30:])} {sentence(seed + 2, 40)}", "s"), (1, f"{sentence(seed + 3, 40)} {p} {sentence(seed + 4, 40)}", "s"), (2, f"{sentence(seed + 5, 40)} {p} {sentence(seed + 6, 40)}", "s")]
        got = paragraphs.repeated_passages(frame(spark, rows)).collect()
        gone = {(r["doc_id"], r["at"], r["until"]): r["first_doc"] for r in got if not r["kept"]}
        assert gone == {(1, 70, 130): 0, (2, 40, 130): 0}


def test_every_shared_run_of_the_table_is_found(spark, sf):
    """Brute force over a whole table: each run of 50 words that two different texts share lies in passages."""
    docs = common.documents(spark, sf)
    texts = {r["doc_id"]: (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}) for r in docs.collect()}
    words = {d: WORDS.findall(t) for d, t in texts.items()}
    runs = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    covered = {}
    for r in paragraphs.repeated_passages(docs).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["at"], r["until"]))
    shared = [p for places in runs.values() if len({d for d, _ in places}) > 1 for p in places]
    whole = sum(len(covered.get(d, set()).intersection(range(i, i + 50))) for d, i in shared)
    assert len(shared) > 50 and all(d in covered for d, _ in shared) and whole > 0.99 * 50 * len(shared)


# ---- toxicity --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lm(spark):
    plain = "the stupid idiot said that the trash is worthless and the moron left with a disgusting loser " * 30
    return toxicity.language_model(frame(spark, [(1, plain, "s"), (2, None, "s"), (3, "", "s")]))


DISGUISED = [
    ("st*pid", "stupid"), ("1d10t", "idiot"), ("tr@sh", "trash"), ("m0r0n", "moron"), ("looooser", "loser"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("w0rthl3ss!", "worthless"),
    ("i d 1 0 t", "idiot"), ("1 d 1 0 t", "idiot"), ("i\nd\ni\no\nt", "idiot"), ("you are a m o r o n", "moron"), ("1d107", "idiot"), ("idi0+", "idiot"), ("tr@5#", "trash"), ("stuupid", "stupid"), ("loserr", "loser"),
    ("the-trash-said-that-the-moron-left-with-a-loser/1d10t", "idiot"), ("t h e " * 60 + "m o r o n", "moron"),
]


@pytest.mark.parametrize("text, word", DISGUISED)
def test_disguised_words_are_restored(lm, text, word):
    assert word in toxicity.Restorer(lm).words(f"and {text} then")


def test_doubled_letters_are_searched(spark):
    plain = "the bullshit of that asshole was small and the fool fell all over the shit hole " * 30
    r = toxicity.Restorer(toxicity.language_model(frame(spark, [(1, plain, "s")])))
    for text, word in (("bullshiit", "bullshit"), ("asshoole", "asshole"), ("asssholle", "asshole"), ("BULLSHITT", "bullshit"), ("bbuullsshhiitt", "bullshit")):
        assert word in r.words(text), text
        choices = r.decoder.columns(text)
        best = max(("".join(p) for p in itertools.product(*[[t for t, _ in c] for c in choices])), key=lambda w: -cost_of(r.decoder, w, text))
        assert best in r.words(text)
    assert "fell" in r.words("fell") and "small" in r.words("small")


def cost_of(decoder, word, text):
    """Of a word read from a text, its least cost in the channel less its log probability."""
    a = b = 0
    total = 0.0
    for x in word + " ":
        n = toxicity.CODE.get(x, 0)
        total -= decoder.model[a][b][n]
        a, b = b, n
    costs = [c for p in itertools.product(*decoder.columns(text)) if "".join(t for t, _ in p) == word for c in [sum(c for _, c in p)]]
    return total + min(costs)


@pytest.mark.parametrize("text", ["1 " * 100_000, "1- " * 100_000, "1-" * 100_000, "a " * 100_000 + "word", "1. 1- " * 50_000])
def test_long_runs_take_linear_time(text):
    import time

    began = time.time()
    assert len(toxicity.spaced_runs(text)) == ("a" in text)
    assert time.time() - began < 20


def test_spaced_runs():
    assert toxicity.spaced_runs("you i d i o t, x") == ["i d i o t"] and toxicity.spaced_runs("a b c") == [] and toxicity.spaced_runs("s.t.u.p.i.d") == ["s.t.u.p.i.d"]
    assert toxicity.spaced_runs("1 2 3 4 5") == [] and toxicity.spaced_runs("i d 1 0 t word") == ["i d 1 0 t"] and toxicity.spaced_runs("m o r o n-like a b") == ["m o r o"]


@pytest.mark.parametrize("token", ["1d1", "s+p", "l00s", "t.r@", "aabb", "i d 1", "6*t", "x"])
def test_decoding_against_all_paths_of_the_lattice(lm, token):
    d = toxicity.Decoder(lm)

    def score(path):
        s, p, q = 0.0, 0, 0
        for text, cost in path:
            s -= cost
            for c in text:
                n = 0 if c == " " else toxicity.CODE[c]
                s, p, q = s + float(lm[p][q][n]), q, n
        return s + float(lm[p][q][0])

    paths = {}
    for path in itertools.product(*d.columns(token)):
        words = tuple("".join(t for t, _ in path).split())
        paths[words] = max(paths.get(words, -1e9), score(path))
    assert paths[tuple(d.decode(token))] == pytest.approx(max(paths.values()), abs=1e-4)


def test_plain_words_stay(lm):
    assert toxicity.Restorer(lm).words("Plain words, 1234 stay.") == {"plain", "words", "stay"}


def test_scores(spark, sf):
    docs, labels = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.language_model(docs)
    model = toxicity.fit(docs, labels, m)
    extra = frame(spark, [(1, None, "s"), (2, "", "s"), (3, "some words", "s"), (3, "some words", "s")])
    got = toxicity.scored(extra, model, m).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    none = toxicity.fit(docs, labels.where("toxic = 0"), m)
    assert none.score(set()) < 1e-6
    assert toxicity.scored(frame(spark, []), model, m).count() == 0


def test_batches_score_as_their_words_do(lm):
    texts = [t for t, _ in DISGUISED] + [None, "", " \n ", "x", "ÀÇ İstanbul ² ΑΣ", "idiot " * 9000, "stupid, (loserr) and s t u p i d", "the idiot", "the idiot"]
    reader = toxicity.Restorer(lm)
    weights = {f"{w}$": 1.0 + i for i, w in enumerate(["idiot", "stupid", "trash", "the"])} | {"lose": 0.5, "moron": 0.25, "worthl": 0.125}
    model = toxicity.Model(weights, -2.0)
    got = model.scores(reader, pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        made = {f for w in reader.words(text or "") for f in (f"{w}$", *(w[:n] for n in (4, 5, 6) if len(w) >= n))}
        expected = -2.0 + sum(v for f, v in weights.items() if f in made)
        assert score == pytest.approx(1 / (1 + math.exp(-expected))) == pytest.approx(model.score(reader.words(text or "")))


def test_null_ids_very_long_texts_and_clashing_columns_are_scored(spark, lm):
    model = toxicity.Model({"moron$": 4.0}, -2.0)
    docs = frame(spark, [(None, "a m0r0n", "s"), (None, "a m0r0n", "s"), (7, "calm words " * 200_000 + "m0r0n", "s"), (8, "x" * 100_000, "s")])
    docs = docs.withColumns({c: F.lit("clash") for c in ("score", "predicted", "y", "f")})
    got = sorted(((r["doc_id"], r["score"] > 0.5) for r in toxicity.scored(docs, model, lm).collect()), key=str)
    assert got == [(7, True), (8, False), (None, True), (None, True)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.language_model(docs)
    scores = toxicity.scored(docs.join(labels.where(toxicity.held_out(labels["doc_id"])).select("doc_id"), "doc_id", "left_semi"), toxicity.fit(docs, labels, m), m)
    rows = scores.join(labels, "doc_id").select("score", "toxic").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert auc > 0.95 and sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in rows) / len(rows) > 0.95


# ---- media -----------------------------------------------------------------------------------------------------------


def test_transport_streams(spark):
    rows = [(1, None, "s"), (2, "é" * 33, "s"), (3, "x" * 100_000, "s"), (4, "", "s"), (4, "", "s")]
    got = transport.described(transport.stored(frame(spark, rows))).collect()
    assert len(got) == 5
    for r in got:
        raw = (next(t for d, t, _ in rows if d == r["doc_id"]) or "").encode()
        p = transport.padded(raw)
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(p) and r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
        assert r["media_bytes"] % 188 == 0 and "continuity=0;crc=0;sync=0" in r["feature"] and "programs=1:1000" in r["feature"]
        units = -(-len(p) // 2048)
        assert (r["first_pts"], r["last_pts"], r["random_access_pts"]) == (0, 3003 * (units - 1), [3003 * u for u in range(0, units, 8)])
    units = transport.access_units(transport.stored(frame(spark, rows)).where("doc_id = 3")).orderBy("unit").collect()
    assert [u["pts"] for u in units] == [i * 3003 for i in range(len(units))] and [u["random_access"] for u in units] == [i % 8 == 0 for i in range(len(units))]


@pytest.mark.parametrize("n", [64, 128, 170, 184, 192, 2048, 2112, 20480])
def test_streams_round_trip_and_damage(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    media = transport.mux(payload)
    s = transport.demux(media)
    assert b"".join(u.data for u in s.units[transport.DATA_PID]) == payload and s.kinds == {transport.DATA_PID: transport.PRIVATE}
    if n > 2000:
        lost = transport.demux(media[: 188 * 5] + media[188 * 6 :])
        assert lost.continuity_errors == 1
        assert transport.demux(b"junk" + media).sync_losses >= 1
        bad = bytearray(media)
        bad[10] ^= 1
        assert transport.demux(bytes(bad)).crc_errors == 1
    assert transport.demux(b"").packets == 0
    points = [i for i in range(0, len(media), 188) if media[i + 1 : i + 3] == b"\x40\x00"]  # a receiver may begin at any of them
    for i, p in enumerate(points):
        joined = transport.demux(media[p:])
        assert b"".join(u.data for u in joined.units[transport.DATA_PID]) == payload[i * 8 * 2048 :] and joined.kinds == s.kinds and not joined.continuity_errors


def test_a_stream_written_by_hand_is_read():
    """Packets put together from the standard's fields: tables with the CRC of zlib's polynomial bit by bit, PTS and DTS, stuffing."""

    def crc(data):
        c = 0xFFFFFFFF
        for b in data:
            for k in range(7, -1, -1):
                bit = (c >> 31) ^ (b >> k & 1)
                c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if bit else 0)
        return c.to_bytes(4, "big")

    pat = bytes.fromhex("00b00d0001c100000003e064")  # program 3: map in pid 0x64
    pmt = bytes.fromhex("02b0120003c10000e065f0001be065f000")  # video 0x1b in pid 0x65
    packets = [bytes.fromhex("47400010") + b"\0" + pat + crc(pat), bytes.fromhex("47406410") + b"\0" + pmt + crc(pmt)]
    pes = bytes.fromhex("000001e00000" + "80c00a" + "3100070001" + "1100050001") + b"abc"  # PTS 3 << 15, DTS 2 << 15
    packets.append(bytes.fromhex("47406537") + bytes([183 - len(pes), 0x40]) + b"\xff" * (182 - len(pes)) + pes)
    packets.append(bytes.fromhex("47006518") + b"d" * 184)
    packets.append(bytes.fromhex("47406539") + bytes([162, 0]) + b"\xff" * 161 + bytes.fromhex("000001e0000a800000") + b"rest of it..")
    s = transport.demux(b"".join(x.ljust(188, b"\xff") for x in packets))
    assert s.programs == {3: 0x64} and s.kinds == {0x65: 0x1B} and (s.crc_errors, s.continuity_errors, s.sync_losses) == (0, 0, 0)
    first = s.units[0x65][0]
    assert (first.pts, first.dts, first.random_access, first.data) == (3 << 15, 2 << 15, True, b"abc" + b"d" * 184)


# ---- fixity ----------------------------------------------------------------------------------------------------------


def inventory(spark, rows):
    return spark.createDataFrame(rows, "file long, offset long, record_id long, length long, sha256 string")


def held_against(one, two):
    """Statuses of a plain comparison of two inventories of (file, offset, record_id, length, sha256)."""
    out = Counter()
    places = {r[:3] for r in (*one, *two)}
    for p in places:
        a, b = (sorted((r[4], r[3]) for r in rows if r[:3] == p) for rows in (one, two))
        for x, y in itertools.zip_longest(a, b):
            out[p, "extra" if x is None else "missing" if y is None else "ok" if x == y else "corrupt"] += 1
    return out


def root(spark, rows):
    (top,) = fixity.tree(inventory(spark, rows), 1 << 12, 4)[-1].collect()
    return top["hash"]


def test_layout_of_records(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i % 50)) for i in range(60)] + [(None, None, None), (7, "http://h/7", "x" * 7), (99, "u", "y" * 300_000)], "page_id long, url string, html string")
    r = fixity.records(pages).withColumns({"length": F.octet_length("warc").cast("long"), "sha256": fixity.digest(F.col("warc"))})
    got = sorted((x["offset"], x["length"], x["record_id"], x["warc"]) for x in fixity.laid_out(r).collect())
    assert len(got) == 63 and [g[0] for g in got] == [sum(x[1] for x in got[:i]) for i in range(63)]
    assert all("\r\nWARC-Date: " in g[3] and len(g[3].encode()) == g[1] for g in got)
    assert fixity.laid_out(r.where("false")).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_audit_against_a_plain_comparison_under_random_damage(spark, seed):
    import random

    pick = random.Random(seed)
    one = [(f, i * 700, f * 1000 + i if i % 41 else None, 700, f"h{f}.{i}") for f in (0, 1, 5) for i in range(200)] + [(0, 700, 1, 700, "h0.1")]
    two = [r for r in one if pick.random() > 0.03]
    two = [(r[0], r[1], r[2], r[3], "bad") if pick.random() < 0.03 else (r[0], r[1] + 3, *r[2:]) if pick.random() < 0.02 else r for r in two]
    two += [(9, 0, 77, 5, "new")] + [r for r in two if pick.random() < 0.01]
    pick.shuffle(two)
    for a, b in ((one, two), (one, one), (two, one), (one, []), ([], one)):
        got = fixity.audit(inventory(spark, a), inventory(spark, b), range_bytes=4096).collect()
        assert Counter(((r["file"], r["offset"], r["record_id"]), r["status"]) for r in got) == held_against(a, b)
    assert fixity.audit(inventory(spark, []), inventory(spark, [])).count() == 0
    # a file of more than 512 MiB: each range is its own leaf, to the last
    long_ = [(0, i << 20, i, 1 << 20, f"h{i}") for i in range(1200)] + [(2, 0, 9999, 5, "x")]
    bad = [(*r[:4], "bad") if r[2] == 1100 else r for r in long_]
    got = fixity.audit(inventory(spark, long_), inventory(spark, bad)).collect()
    assert Counter(((r["file"], r["offset"], r["record_id"]), r["status"]) for r in got) == held_against(long_, bad)
    assert len({r["range"] for r in got}) == 1201
    base = root(spark, one)
    assert base == root(spark, one[::-1]) and base != root(spark, [*one, (9, 0, 77, 5, "new")]) and base != root(spark, [(r[0], r[1] + (i == 5), *r[2:]) for i, r in enumerate(one)])


# ---- html ------------------------------------------------------------------------------------------------------------

PARAS = ["First paragraph with <b>bold</b> text &amp; more of it, long enough to matter.", "Second one &lt;here&gt;,\n  also of some   length, as articles have."]
WANT = "Title\nFirst paragraph with bold text & more of it, long enough to matter.\nSecond one <here>, also of some length, as articles have."
NOISE = '<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="sidebar"><p>Read also many other things on this site today.</p></div>'
TAIL = '<div id="comments"><p>I liked this article very much and would read it again.</p></div><form><p>Subscribe now</p></form><footer>(c) all of it, some words about the firm that made it.</footer>'


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="page"><div class="post">{}</div></div>'])
def test_article_without_the_rest(wrap):
    body = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in PARAS)
    page = f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body>{NOISE}<!-- no --><div class="ad">Buy this thing now, it is cheap.</div>{wrap.format(body)}{TAIL}</body></html>'
    assert density.main_text(page) == WANT


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'data-x="/p?id=ad"', "data-x=/p?id=ad", "data-hidden=1", 'title="class=ad"', 'data-role="ad"', "title='a hidden thing' class=post"])
def test_words_inside_other_values_mark_nothing(attrs):
    assert density.main_text(f"<body><div {attrs}><p>{PARAS[1]}</p></div></body>") == WANT.split("\n")[2]
    assert density.main_text(f'<body><p>See <a href="/hidden-gems" {attrs}>these places</a> and read on about all of them here.</p></body>').startswith("See these places and")


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN", 'a="x"hidden', "hidden=''", 'title="x" class = "big ad"', "id=comments", "aria-hidden='true'", "title='id=x' role=banner"])
def test_marked_elements_are_dropped(attrs):
    assert density.main_text(f"<body><p>{PARAS[1]}</p><div {attrs}><p>Some more words that nobody wants to read here.</p></div></body>") == WANT.split("\n")[2]


@pytest.mark.parametrize("n", [10, 2_400, 300_000])
def test_long_attributes_and_pages(n):
    long_ = "a>b " * (n // 4)
    assert density.main_text(f'<body><p title="{long_}">{PARAS[1]}</p></body>') == WANT.split("\n")[2]
    page = "<body><article>" + "".join(f"<p>Paragraph {i} of a long article.</p>" for i in range(n // 30)) + "</article></body>"
    assert density.main_text(page).count("\n") == n // 30 - 1 if n >= 30 else True
    assert density.main_text("<p>Some text here.</p>" + '<p title="x' * (n // 10)).startswith("Some text here.")


def densities_by_definition(node):
    """(chars, tags, link chars, links) of a nested (tag, [children or text]) tree."""
    c = t = lc = lt = 0
    for x in node[1]:
        if isinstance(x, str):
            c += len(x)
        else:
            a = densities_by_definition(x)
            c, lc, lt = c + a[0], lc + a[2], lt + a[3]
            t += a[1] + (x[0] != "a")
            if x[0] == "a":
                lc, lt = lc + a[0], lt + 1
    return c, t, lc, lt


def test_densities_against_their_definition():
    import math

    trees = [("body", [("div", [("p", ["some words here"]), ("p", ["more ", ("a", ["linked"])])]), ("ul", [("li", [("a", ["one"])]), ("li", [("a", ["two"])])])])]

    def markup(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(markup, x[1]))}</{x[0]}>"

    def nodes(x):
        yield x
        for y in x[1]:
            if not isinstance(y, str) and y[0] != "a":
                yield from nodes(y)

    for tree in trees:
        page = density.Page(markup(tree))
        body = densities_by_definition(tree)
        for node, tag, got in zip(nodes(tree), page.tag, page.densities(), strict=True):
            c, t, lc, lt = densities_by_definition(node)
            base = math.log(math.log(c / max(1, c - lc) * lc + body[2] / body[0] * c + math.e) + 1e-9)
            want = c / max(1, t) * math.log(max(1 + 1e-9, c / max(1, lc) * max(1, t) / max(1, lt))) / max(0.1, base)
            assert tag == node[0] and got == pytest.approx(want)


def test_chosen_nodes_against_their_definition():
    """Random trees: sums, the path's threshold and what is reached, each by recursion from the densities."""
    import random

    for seed in range(60):
        rng, n = random.Random(seed), itertools.count()

        def tree(depth, rng=rng, n=n):
            inner = "".join(tree(depth - 1) if depth and rng.random() < 0.7 else f"<p>{'text ' * rng.randint(0, 30)}{'<a>link</a>' * rng.randint(0, 2)} {next(n)}</p>" for _ in range(rng.randint(1, 4)))
            return f"<{(tag := rng.choice(['div', 'section', 'article', 'main']))}>{inner}</{tag}>"

        page = density.Page(f"<body>{tree(4)}{tree(2)}</body>")
        d, nodes = page.densities(), range(len(page.tag))
        kids = {i: [k for k in nodes if k and page.parent[k] == i] for i in nodes}
        total = {i: sum(d[k] for k in kids[i]) for i in nodes}
        below = lambda i: {i}.union(*(below(k) for k in kids[i]))  # noqa: B023, E731
        best = lambda i: max(below(i), key=lambda k: (total[k], -k))  # noqa: B023, E731
        path, i = [], best(0)
        while i >= 0:
            path.append(d[i])
            i = page.parent[i]
        want, waiting = below(best(0)), [0]
        while waiting:
            for k in kids[waiting.pop()]:
                if page.chars[k] and d[k] >= min(path):
                    waiting.append(k)
                    want |= below(best(k))
        assert page.content() == want, seed


def test_every_page_of_the_table(spark, sf):
    """The pages' template is known: the article's blocks in order are the text."""
    for r in density.extracted(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        art = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", art)
        want = "\n".join(t for t in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b))).strip() for b in blocks) if t)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_odd_pages(spark):
    odd = [(1, None), (2, ""), (3, "no tags at all"), (4, "<p>unclosed <b>bold<p>next<li>x"), (5, "<div>" * 3000 + "deep"), (6, "<body></body>"), (7, "<a title='x>y' href=\"q\">l</a> < & &amp; &#x41;"), (3, "no tags at all")]
    df = spark.createDataFrame([(i, f"u{i}", h, "z") for i, h in odd], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in density.extracted(df).collect()}
    assert got[1] == got[2] == got[6] == "" and got[3] == "no tags at all" and got[5] == "deep" and "A" in got[7] and got[4].startswith("unclosed bold")
