"""Token ids in bit-plane or byte-plane files.

A file holds the ids of a run of documents in doc_id order. Ids are cut into fixed-size blocks; a block's ids are
transposed into planes (all first bytes, all second bytes, ... or all lowest bits, all second bits, ...), each plane is
compressed by itself with zstandard, and an index of all planes lets a reader fetch one block alone.

Layout, little-endian: magic ``IDPL``, version u8, plane kind u8 (1: bits, 8: bytes), planes u8, zero u8, ids a block
u32, ids u64, documents u32, blocks u32; then per block and plane the compressed length u32 (the chunk index); then
per document doc_id i64, null flag u8, ids u32; then the compressed planes, block by block.

The rows are range-partitioned by doc_id, so each task writes the files of one range, a file each FILE_IDS ids at
least, and documents never straddle files. Files are rows of a written table (range, file number, bytes): they go where
Spark can write, and a lost executor's files are made again by its task. Where a file starts among all ids comes from
the ranges' totals (one row a range) and a window inside the range.

Ids are those of the tokenizers library. Byte-level pre-tokens never cross the place before a space that a
non-space follows, so each distinct unit between such places is encoded once a worker (bounded memory, emptied
when full); texts that hold a special token's string are encoded whole.

Defined cases: null is the empty text, which has the end id alone; null doc_ids come first; rows of one doc_id are
ordered by their text's hash; extra columns are ignored; an empty table gives an empty file table.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilework.llm import arrowtext as at
from tilework.llm.common import documents, in_arrow, small, written

BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 21
UNITS = 600_000
HEAD = struct.Struct("<4sBBBBIQII")
_CUT = re.compile(r" (?=\S)")
#: A space before white space or at the end, in the syntax of Arrow's regular expressions.
_BLANK = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"


def planes_of(ids: np.ndarray, kind: int, planes: int) -> list[bytes]:
    """Planes of uint32 ids, lowest first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == 8:
        return [raw[:, p].tobytes() for p in range(planes)]
    bits = np.unpackbits(raw, axis=1, count=None, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(planes)]


def ids_of(planes: list[bytes], kind: int, n: int) -> np.ndarray:
    out = np.zeros((n, 4), dtype=np.uint8)
    if kind == 8:
        for p, data in enumerate(planes):
            out[:, p] = np.frombuffer(data, np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for p, data in enumerate(planes):
            bits[:, p] = np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little")
        out = np.packbits(bits, axis=1, bitorder="little")
    return out.view("<u4").reshape(-1)


def pack(ids: np.ndarray, docs: list[tuple[int | None, int]], kind: int = 8, block: int = BLOCK_IDS) -> bytes:
    """One file. docs: (doc_id, number of ids) in order."""
    top = int(ids.max()) if len(ids) else 0
    planes = max(1, -(-top.bit_length() // kind))
    press = zstandard.ZstdCompressor(level=3)
    chunks = [press.compress(p) for at_ in range(0, len(ids), block) for p in planes_of(ids[at_ : at_ + block], kind, planes)]
    head = HEAD.pack(b"IDPL", 1, kind, planes, 0, block, len(ids), len(docs), -(-len(ids) // block))
    index = np.array([len(c) for c in chunks], dtype="<u4").tobytes()
    who = b"".join(struct.pack("<qBI", d or 0, d is None, n) for d, n in docs)
    return b"".join([head, index, who, *chunks])


def unpack(data: bytes, blocks: range | None = None) -> tuple[np.ndarray, list[tuple[int | None, int]]]:
    """The ids of a file (or of the given blocks of it, by the chunk index) and its documents."""
    magic, version, kind, planes, _, block, n, docs, count = HEAD.unpack_from(data)
    if magic != b"IDPL" or version != 1:
        raise ValueError("not a plane file")
    index = np.frombuffer(data, "<u4", count * planes, HEAD.size)
    at_ = HEAD.size + index.nbytes
    who = [(None if null else d, k) for d, null, k in struct.iter_unpack("<qBI", data[at_ : at_ + 13 * docs])]
    starts = at_ + 13 * docs + np.concatenate([[0], np.cumsum(index, dtype=np.int64)])
    expand = zstandard.ZstdDecompressor()
    parts = []
    for b in range(count) if blocks is None else blocks:
        found = [expand.decompress(data[starts[b * planes + p] : starts[b * planes + p + 1]]) for p in range(planes)]
        parts.append(ids_of(found, kind, min(block, n - b * block)))
    return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), who


def _byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARACTERS = _byte_characters()
#: The pre-tokens of the byte-level vocabularies, for units without characters on which libraries' classes could differ.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile("[^\t\n\r -~\u00a1-\u024f]")


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes. Where the tokenizer is byte-level BPE without a normaliser, a
    new unit's pre-tokens go to the library's model one by one, and are remembered too: words come with and without
    punctuation."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.cache: dict[str, bytes] = {}
        self.pre: dict[str, bytes] = {}
        shape = json.loads(self.tokenizer.to_str())
        before, model = shape["pre_tokenizer"] or {}, shape["model"]
        self.by_model = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"] and shape["normalizer"] is None and model["type"] == "BPE" and not model["dropout"]
        self.model = self.tokenizer.model

    def _pre_tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens; the new ones go to the library's model once."""
        new = set(tokens).difference(self.pre)
        if new:
            if len(self.pre) + len(new) > UNITS:
                self.pre.clear()
                new = set(tokens)
            new = list(new)
            # one translation for all; byte 0 can't be part of them
            written = "\0".join(new).encode().decode("latin-1").translate(BYTE_CHARACTERS).split(BYTE_CHARACTERS[0])
            tokenize = self.model.tokenize
            for p, text in zip(new, written, strict=True):
                ids = [t.id for t in tokenize(text)]
                self.pre[p] = struct.pack(f"<{len(ids)}I", *ids)
        return list(map(self.pre.__getitem__, tokens))

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of units, each a space and what follows up to the next one."""
        if not self.by_model:
            return self._encode(units)
        usual = units
        if _UNUSUAL.search("".join(units)) is not None:
            usual = [u for u in units if _UNUSUAL.search(u) is None]
        # units of the usual characters hold one space each, their first character, and pre-tokens don't cross it
        tokens = PRE_TOKEN.findall("".join(usual))
        found = self._pre_tokens(tokens)
        at_ = [i for i, t in enumerate(tokens) if t[0] == " "]
        out = [found[a] if b == a + 1 else b"".join(found[a:b]) for a, b in zip(at_, at_[1:] + [len(tokens)], strict=False)]
        if len(usual) < len(units):
            known = dict(zip(usual, out, strict=True))
            rest = [u for u in units if u not in known]
            known.update(zip(rest, self._encode(rest), strict=True))
            out = [known[u] for u in units]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _known(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units (without the space before them), remembered or encoded together."""
        cache = self.cache
        new = [u for u in units if u not in cache]
        if new:
            if len(cache) + len(new) > UNITS:
                cache.clear()
                new = units
            plain = [u for u in new if " " not in u]
            cache.update(zip(plain, self._units([" " + u for u in plain]), strict=True))
            odd = [u for u in new if " " in u]  # units that end in blanks
            cache.update(zip(odd, self._encode([" " + u for u in odd]), strict=True))
        return list(map(cache.__getitem__, units))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text of a column without nulls. Units are split and told apart by Arrow, each distinct one
        is looked up once, and the texts' ids are gathered from theirs."""
        out: dict[int, np.ndarray] = {}
        blank = pc.match_substring_regex(texts, _BLANK).to_numpy(zero_copy_only=False) if len(texts) else []
        special = np.zeros(len(texts), bool)
        if self.special is not None:
            special = pc.match_substring_regex(texts, self.special.pattern).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special | blank).tolist():
            text = texts[i].as_py()
            if special[i]:
                out[i] = np.frombuffer(self._encode([text])[0], "<u4")
            else:
                first, *units = _CUT.split(text)
                known = dict(zip(own := list(set(units)), self._known(own), strict=True))
                out[i] = np.frombuffer(self._encode([first])[0] + b"".join(map(known.__getitem__, units)), "<u4")
        rest = np.flatnonzero(~(special | blank)) if len(texts) else np.empty(0, np.int64)
        lists = pc.split_pattern(texts.take(pa.array(rest)), " ")
        begin = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes, units = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        begin = begin - (begin[0] if len(begin) else 0)
        # a text's first unit has no space before it, so it has codes of its own
        firsts, own = np.unique(codes[begin[:-1]], return_inverse=True)
        heads = [units[c] for c in firsts.tolist()]
        codes[begin[:-1]] = len(units) + own
        ids = self._known(units) + self._encode(heads)
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], dtype=np.int64)
        starts, each = np.concatenate([[0], np.cumsum(sizes)]), sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        gathered = flat[np.repeat(starts[codes] - ends[:-1], each) + np.arange(ends[-1])]
        for i, a, b in zip(rest.tolist(), ends[begin[:-1]].tolist(), ends[begin[1:]].tolist(), strict=True):
            out[i] = gathered[a:b]
        return [out[i] for i in range(len(texts))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0, kind: int = 8, block: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """The written table of files: range, file, n_docs, n_ids, bytes."""

    def run(batches):
        e, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        part, number, who, ids, held = None, 0, [], [], 0

        def closed():
            data = pack(np.concatenate(ids), who, kind, block)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(who)], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())],
                names=["range", "file", "n_docs", "n_ids", "bytes"],
            )

        for batch in batches:
            for doc, part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), e.ids(batch.column(2).fill_null("")), strict=True):
                who.append((doc, len(found) + 1))
                ids += [found, end]
                held += len(found) + 1
                if held >= file_ids:
                    yield closed()
                    number, who, ids, held = number + 1, [], [], 0
        if who:
            yield closed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    d = d.select("doc_id", F.spark_partition_id().alias("_range"), "text")
    return written(in_arrow(d, run, "range int, file int, n_docs long, n_ids long, bytes binary"), "id-planes")


def read_ids(files: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids (little-endian uint32 bytes of the document)."""
    totals = files.groupBy("range").agg(F.sum("n_ids").alias("t"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("range").alias("r"), F.coalesce(F.sum("t").over(before(Window.orderBy("range"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("range").orderBy("file"))), F.lit(0))
    starts = files.select("range", "file", inside.alias("inside")).join(F.broadcast(totals), F.col("range") == F.col("r"))
    starts = written(starts.select(F.col("range").alias("r"), F.col("file").alias("f"), (F.col("base") + F.col("inside")).alias("start")), "id-starts")

    def run(batches):
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, who = unpack(data.as_py())
                ends = np.cumsum([n for _, n in who])
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in who], pa.int64()),
                        pa.array(start + ends - [n for _, n in who], pa.int64()),
                        pa.array([n for _, n in who], pa.int64()),
                        pa.array([raw[4 * (e - n) : 4 * e] for e, (_, n) in zip(ends, who, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    placed = files.join(small(starts), (F.col("range") == F.col("r")) & (F.col("file") == F.col("f"))).select("start", "bytes")
    return in_arrow(placed, run, "doc_id long, start long, n_tokens long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    files = write_ids(documents(spark, sf_dir), tokenizer_path or default_tokenizer())
    return read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
