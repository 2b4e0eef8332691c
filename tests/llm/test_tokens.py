"""Ids and spans against the libraries, planes by round trip."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tilework.llm import bitplanes, spans

TEXT = st.text(st.sampled_from("ab é▁\n\t  .'sß<|漢　\x1c\x85Ⅷﬁ😀"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_units_give_the_library_s_ids(text):
    e = spans.encoder(spans.default_model())
    assert e.ids(text).tolist() == e.sp.encode(text, add_eos=True)


@settings(max_examples=40, deadline=None)
@given(TEXT)
def test_spans_cover_the_source_and_hold_their_pieces(text):
    e = spans.encoder(spans.default_model())
    ids = e.ids(text)
    found = e.spans(text, ids)
    source = text.encode()
    assert (np.diff(found, axis=1) >= 0).all() and (found[1:, 0] == found[:-1, 1]).all() and found[-1, 1] == len(source)
    proto = e.sp.encode(text, return_type="proto") if text else None
    for (a, b), p in zip(found[:-1].tolist(), proto.pieces if proto else [], strict=True):
        if not p.piece.startswith("<0x"):
            assert source[a:b].decode() == p.surface


def test_unknown_pieces_have_their_characters_spans(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    for i, p in enumerate(["<unk>", "<s>", "</s>", "▁", *"abcdefghijklmnopqrstuvwxyz"]):
        m.pieces.add(piece=p, score=-float(i), type={0: 2, 1: 3, 2: 3}.get(i, 1))
    m.trainer_spec.model_type, m.normalizer_spec.name = 2, "identity"
    m.normalizer_spec.remove_extra_whitespaces = False
    path = tmp_path / "small.model"
    path.write_bytes(m.SerializeToString())
    e = spans.Encoder(str(path))
    for text in ("hello 漢字 x", "漢", "", "a 漢字漢 é b"):
        ids = e.ids(text)
        assert ids.tolist() == e.sp.encode(text, add_eos=True)
        found, source = e.spans(text, ids), text.encode()
        unknown = [source[a:b].decode() for (a, b), i in zip(found.tolist(), ids.tolist(), strict=True) if i == 0]
        assert "".join(unknown) == "".join(c for c in text if ord(c) > 127) and found[-1, 1] == len(source)


def test_compiled_map_matches_the_library():
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(n.serialized_model_proto())
    e = spans.Encoder.__new__(spans.Encoder)
    e.spec = m.normalizer_spec
    e.charsmap = spans.CharsMap(m.normalizer_spec.precompiled_charsmap)
    assert len(e.charsmap.rules) > 1000
    for text in ("ﬁne Ⅷ ｱﾊﾟｰﾄ ①", "plain", "", "é 　x y", "\x1bＡ"):
        want = n.normalize(text)
        out, align = e.normalise(text)
        assert out.decode() == want
        assert len(align) == len(out) + 1 and align[-1] == len(text.encode()) and (np.diff(align) >= 0).all()


@settings(max_examples=60, deadline=None)
@given(st.one_of(TEXT, st.text(max_size=30), st.just("a <|endoftext|> b")))
def test_byte_level_units_give_the_library_s_ids(text):
    e = bitplanes.encoder(bitplanes.default_tokenizer())
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert e.ids(pa.array([text, "a b c d", text]))[2].tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.sampled_from([1, 8]), st.integers(1, 9))
def test_planes_round_trip(ids, kind, block):
    ids = np.array(ids, dtype="<u4")
    data = bitplanes.pack(ids, [(None, 1), (7, len(ids))], kind, block)
    back, who = bitplanes.unpack(data)
    assert back.tolist() == ids.tolist() and who == [(None, 1), (7, len(ids))]
    if len(ids) > block:
        assert bitplanes.unpack(data, range(1, 2))[0].tolist() == ids[block : 2 * block].tolist()


def rows(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, start string")


DOCS = [(3, "b  c", "x"), (None, "a", "x"), (1, None, None), (2, "", "y"), (5, "word " * 3000, "z"), (5, "word " * 3000, "z")]


def test_id_files_read_back(spark):
    files = bitplanes.write_ids(rows(spark, DOCS), bitplanes.default_tokenizer(), file_ids=50)
    got = bitplanes.read_ids(files).collect()
    t = Tokenizer.from_file(bitplanes.default_tokenizer())
    want, at_ = [], 0
    for d, text, _ in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((d, at_, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at_ += len(ids)
    assert sorted((r[0] or -1, r[1], r[2], zlib.crc32(bytes(r[3]))) for r in got) == sorted((w[0] or -1, *w[1:]) for w in want)
    assert bitplanes.read_ids(bitplanes.write_ids(rows(spark, []), bitplanes.default_tokenizer())).count() == 0


def test_piece_digests(spark):
    got = {r["doc_id"]: r for r in spans.digests(rows(spark, DOCS), spans.default_model()).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=spans.default_model())
    for d, text, _ in DOCS:
        ids = sp.encode(text or "", add_eos=True)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert spans.digests(rows(spark, []), spans.default_model()).count() == 0
    r = spans.encoded(rows(spark, DOCS[:1]), spans.default_model()).first()
    assert r["starts"][0] == 0 and r["ends"][-1] == 4
