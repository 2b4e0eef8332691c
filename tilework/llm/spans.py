"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by the model's compiled character map: at every place the longest prefix that the map has is
replaced, and every byte of the result keeps the place in the source that it came from. Pieces tile the normalised
text, so their byte lengths and that alignment project every piece to a span of original bytes.

Ids are exactly those of the sentencepiece library. Where the model allows it (BPE, identity map, no piece with a word
mark after another character), a text is cut before its spaces and each distinct unit is encoded by the library once
a worker: merges can't cross such a cut. The memory of units is bounded and is emptied when full; results don't
depend on it. Other models, and texts that hold the word mark itself, go to the library whole.

Runs in mapInArrow: a row is a text, nothing is shuffled, memory is a batch and the units.

Defined cases: null is the empty text, whose ids are the end id alone; what a model without bytes lacks is an unknown piece
with the span of its characters; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tilework.llm import arrowtext as at
from tilework.llm.common import documents, in_arrow

MARK = "▁"
UNITS = 600_000
_SPACES = re.compile(" {2,}|^ | $")
_UNIT = re.compile(" +[^ ]*")


class CharsMap:
    """The compiled character map of a model: a double-array trie of byte strings and their replacements."""

    def __init__(self, blob: bytes):
        self.rules: dict[bytes, bytes] = {}
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self._units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self._pool = blob[4 + size :]
            self._collect(self._step(0), b"")
        # strings that begin a rule, to pass over everything else quickly
        self.longest = max(map(len, self.rules), default=0)
        firsts = {k[:1] for k in self.rules}
        self._first = re.compile(b"[" + b"".join(re.escape(b) for b in sorted(firsts)) + b"]") if firsts else None

    def _step(self, at_: int) -> int:
        unit = self._units[at_]
        return at_ ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    def _collect(self, base: int, prefix: bytes) -> None:
        stack = [(base, prefix)]
        while stack:
            base, prefix = stack.pop()
            for c in range(1, 256):
                place = base ^ c
                if place >= len(self._units) or self._units[place] & ((1 << 31) | 0xFF) != c:
                    continue
                unit, down = self._units[place], self._step(place)
                if unit >> 8 & 1:
                    start = self._units[down] & ((1 << 31) - 1)
                    self.rules[prefix + bytes([c])] = self._pool[start : self._pool.index(b"\0", start)]
                stack.append((down, prefix + bytes([c])))

    def pieces(self, text: bytes):
        """(replacement, source start, source end) along the text, stretches without a rule whole."""
        if self._first is None:
            yield text, 0, len(text)
            return
        at_, plain = 0, 0
        while (m := self._first.search(text, at_)) is not None:
            at_ = m.start()
            for n in range(min(self.longest, len(text) - at_), 0, -1):
                if (new := self.rules.get(text[at_ : at_ + n])) is not None:
                    if plain < at_:
                        yield text[plain:at_], plain, at_
                    yield new, at_, at_ + n
                    at_ = plain = at_ + n
                    break
            else:
                at_ += 1
                while at_ < len(text) and text[at_] & 0xC0 == 0x80:
                    at_ += 1
        if plain < len(text):
            yield text[plain:], plain, len(text)


class Encoder:
    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.spec = model.normalizer_spec
        self.charsmap = CharsMap(self.spec.precompiled_charsmap)
        pieces = model.pieces
        kinds = type(pieces[0])
        self.lengths = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in pieces])
        inner = any(MARK in p.piece.lstrip(MARK) for p in pieces)
        plain = self.spec.add_dummy_prefix and self.spec.escape_whitespaces and not self.spec.remove_extra_whitespaces
        self.by_unit = bool(
            plain and not inner and not self.charsmap.rules and model.trainer_spec.model_type == 2 and not model.trainer_spec.treat_whitespace_as_suffix and not any(p.type == kinds.USER_DEFINED for p in pieces)
        )
        self.end = self.sp.eos_id()
        self.mark = struct.pack("<i", self.sp.piece_to_id(MARK))
        self.text_of = [str(i) for i in range(len(pieces))]
        self.cache: dict[str, bytes] = {}

    def _units(self, text: str) -> list[str]:
        if not text:
            return []
        if _SPACES.search(text) is None:
            return text.split(" ")
        return [u[1:] for u in _UNIT.findall(" " + text)]

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text, the end id last."""
        if not self.by_unit or MARK in text:
            return np.array(self.sp.encode(text) + [self.end], dtype=np.int32)
        units, cache = self._units(text), self.cache
        new = {u for u in units if u not in cache}
        if new:
            if len(cache) + len(new) > UNITS:
                cache.clear()
                new = set(units)
            new = list(new)
            for u, found in zip(new, self.sp.encode(new, num_threads=1), strict=True):
                cache[u] = struct.pack(f"<{len(found)}i", *found)
            cache[""] = self.mark  # a lone trailing space is a word mark of its own
        return np.frombuffer(b"".join(map(cache.__getitem__, units)) + struct.pack("<i", self.end), dtype="<i4")

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte that it came from."""
        source = text.encode()
        if not self.charsmap.rules:
            out, align = self._identity(source)
        else:
            parts = list(self.charsmap.pieces(source))
            out = b"".join(p for p, _, _ in parts)
            align = np.concatenate([np.arange(a, b) if len(p) == b - a else np.full(len(p), a) for p, a, b in parts] + [[len(source)]]).astype(np.int64)
        if self.spec.remove_extra_whitespaces:
            raw = np.frombuffer(out, np.uint8)
            space = raw == 32
            keep = ~space
            keep[1:] |= ~space[:-1]
            ends = np.flatnonzero(~space)
            if not len(ends):
                return b"", np.array([len(source)])
            keep[: ends[0]] = False
            keep[ends[-1] + 1 :] = False
            align = np.concatenate([align[:-1][keep], [align[ends[-1] + 1]]])
            out = raw[keep].tobytes()
        return self._marked(out, align)

    @staticmethod
    def _identity(source: bytes) -> tuple[bytes, np.ndarray]:
        return source, np.arange(len(source) + 1)

    def _marked(self, out: bytes, align: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Spaces as word marks, and one in front."""
        if not out:
            return b"", align[-1:]
        if self.spec.add_dummy_prefix:
            out, align = b" " + out, np.concatenate([align[:1], align])
        if self.spec.escape_whitespaces:
            width = np.where(np.frombuffer(out, np.uint8) == 32, 3, 1)
            align = np.concatenate([np.repeat(align[:-1], width), align[-1:]])
            out = out.replace(b" ", MARK.encode())
        return out, align

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """(n, 2): start and end of each id's original bytes (the end id: none, at the text's end)."""
        _, align = self.normalise(text)
        lengths = self.lengths[ids]
        unknown = np.flatnonzero(ids == self.sp.unk_id())
        if len(unknown):  # a model without bytes writes one id for a run of characters that it lacks
            pieces = self.sp.encode(text, out_type=str)
            lengths[unknown] = [len(pieces[i].encode()) for i in unknown.tolist()]
        ends = np.cumsum(lengths)
        if len(ids) and ends[-1] != len(align) - 1:
            raise ValueError("the pieces do not tile the normalised text")
        stops = align[ends]
        return np.stack([np.concatenate([[0], stops[:-1]]), stops], axis=1)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int>, starts and ends array<int> (original byte spans) of each text."""

    def run(batches):
        e = encoder(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [e.ids(t) for t in texts]
            spans = [e.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (ids, [s[:, 0].astype(np.int32) for s in spans], [s[:, 1].astype(np.int32) for s in spans]))],
                names=["doc_id", "ids", "starts", "ends"],
            )

    d = docs.select(F.col("doc_id").cast("long"), "text")
    return in_arrow(d, run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes (of the source), spans_crc32 (of all spans' ends)."""

    def run(batches):
        e = encoder(model_path)
        for batch in batches:
            column = batch.column(1)
            _, offsets = at.utf8(column)
            for lo, hi in at.slices(offsets):
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                ids = [e.ids(t) for t in texts]
                lists = [i.tolist() for i in ids]
                decoded = [e.sp.decode(x) for x in lists]
                ends = [e.spans(t, i)[:, 1] for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(x) for x in lists], pa.int64()),
                        pa.array([hashlib.sha256(" ".join(map(e.text_of.__getitem__, x)).encode()).hexdigest() for x in lists]),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                        pa.array([int(x[-1]) for x in ends], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<i8").tobytes()) for x in ends], pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_crc32"],
                )

    d = docs.select(F.col("doc_id").cast("long"), "text")
    return in_arrow(d, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_crc32 long")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return digests(documents(spark, sf_dir), model_path or default_model())
