"""The pipeline's stages in a row, each against what its operator promises."""

import corpus_pipeline
from tests.llm.test_operators import brute
from tilework.llm import common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = common.documents(spark, sf)
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, kept[-1], sf), name)
        assert out.columns == COLUMNS
        kept.append(out)
    quality, near, passages, mix = (k.collect() for k in kept[1:])
    assert 0 < len(quality) <= docs.count()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in quality]
    assert sorted(r["doc_id"] for r in near) == sorted({c for _, _, c in brute(rows, 5, 80)})
    assert sorted(r["doc_id"] for r in passages) == sorted(r["doc_id"] for r in near)
    assert {r["doc_id"] for r in mix} <= {r["doc_id"] for r in passages}
    final = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf)
    assert final.count() == len(mix)


def test_empty_input(spark, sf):
    docs = common.documents(spark, sf).where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), name)
    assert docs.count() == 0


def test_nulls_repeats_and_clashing_columns(spark, sf):
    """Every stage keeps the columns that it is given, whatever their names, and gets through nulls in any of them."""
    from tests.llm.test_operators import sentence

    names = "component_id string, kept boolean, size long, target double, copies long, draw string, node long, root long, key long, at int, bands string, n_words long, _t string, _id int, _tt long, _hh string, _keys string, _gone int, _left string, _doc string, _d int"
    extra = ("c", None, 7, None, 3, "d", 1, None, 2, None, "b", 9, "t", 1, None, "h", "k", 2, None, "doc", 3)
    rows = [(i, sentence(i, 70 + i), "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [(20, None, "en", "s0", None), (21, "", None, None, 0), (None, sentence(90, 80), "en", "s1", 5), (None, sentence(91, 80), None, None, None), (3, sentence(3, 73), "en", "s0", 1), (3, sentence(3, 73), "en", "s0", 1)]
    rows += [(30, f"{sentence(0, 70)} {sentence(92, 60)}", "en", "s1", 1), (31, "x y " * 20_000, "en", "s1", 1), (32, sentence(93, 20_000), None, "s2", 1)]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.written(stage(spark, kept[-1], sf), name))
        assert kept[-1].columns == docs.columns, name
    ids = [[r["doc_id"] for r in k.select("doc_id").collect()] for k in kept]
    assert set(ids[1]) == {*range(12), 30, 32, None} and ids[1].count(None) == 2 and ids[1].count(3) == 3
    assert ids[2].count(3) == 1 and ids[2].count(None) == 2 and set(ids[2]) == set(ids[1])
    left = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    assert len(ids[3]) == len(ids[2]) and left[30] == sentence(92, 60) and left[0] == sentence(0, 70)
    assert all(r["component_id"] == "c" and r["bands"] == "b" and r["kept"] is None and (r["_t"], r["_left"], r["_doc"], r["_d"]) == ("t", None, "doc", 3) for r in kept[4].collect())
    final = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf)
    assert final.count() == kept[-1].count()
