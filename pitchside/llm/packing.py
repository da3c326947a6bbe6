"""Operator 8: packing along a space-filling curve.

Each document is tokenized and gets a hashed vector of its token ids, projected
to a few dimensions whose Hilbert key orders all documents. The order is made by
a range shuffle; every range is packed as one stream, cut at each full
sequence, so only the last sequence of a range is padded. Ranges are sized to
about a million tokens or more, so padding stays near or below a thousandth
once there is that much text.

Copies share a key; a hash of the id behind it lets the ranges divide them.

Edge cases: null counts as an empty text, and an empty text is the separator
alone; repeated rows are packed each; ties of key and hash are ordered by length
and content; columns other than the id and the text are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import importable, parallelism, slices, written
from pitchside.llm.token_counts import byte_symbols

#: Dimensions of the hashed vector, of the projection, and bits of the key per dimension.
HASHED, DIMS, BITS = 64, 4, 8
#: Tokens of a range: about so many where that keeps all cores busy, at most so many.
RANGE_TOKENS, MOST_TOKENS = 1 << 20, 1 << 26
#: Characters from which a text is left to the library, whose merging is made for runs of any length.
LONG = 1 << 20
#: Fixed value: the pattern by which byte-level BPE files of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    The merging is tiktoken's, from the file's own vocabulary, in which ids rank the merges: it takes a
    fraction of the library's time. Texts that hold special tokens, and very long ones, go through the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        size = self.lib.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.special = sorted(t.content for t in self.lib.get_added_tokens_decoder().values())
        byte = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.lib.get_vocab().items() if t not in self.special}
        self.merge = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if len(text) > LONG or any(t in text for t in self.special):
            ids = np.array(self.lib.encode(text, add_special_tokens=False).ids)
        else:
            ids = self.merge.encode_to_numpy(text, disallowed_special=())
        return ids.astype(self.dtype).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def hilbert_key(coords: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of non-negative integer coordinates below 2^bits.

    Gray-code form: undo the reflections and exchanges level by level, then decode and interleave the bits."""
    x = [c.astype(np.int64).copy() for c in coords.T]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> level) & 1
    return key


def _tables(vocab: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, HASHED, vocab), r.choice([-1.0, 1.0], vocab), r.normal(size=(HASHED, DIMS))


def tokenized(docs: DataFrame, tokenizer: str, separator: int = 0, seed: int = 7) -> DataFrame:
    """doc_id, n tokens (with the separator), Hilbert key, ids (little-endian, 2 or 4 bytes each)."""
    def run(batches):
        enc = encoder(tokenizer)
        slot, sign, project = _tables(enc.lib.get_vocab_size(), seed)
        end = np.array([separator], enc.dtype).tobytes()
        for b in slices(batches, "text", 1 << 20):
            ids = [enc.encode(t or "") + end for t in b.column(1).to_pylist()]
            vec = np.zeros((len(ids), HASHED))
            for i, x in enumerate(ids):
                t = np.frombuffer(x, enc.dtype)
                vec[i] = np.bincount(slot[t], weights=sign[t], minlength=HASHED)
            vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
            # a projected unit vector has about unit variance: 3 deviations to either side make the grid
            grid = np.clip((vec @ project + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()),
                pa.array(hilbert_key(grid, BITS)), pa.array(ids, pa.binary()),
                pa.array([enc.dtype.itemsize] * len(ids), pa.int32())], names=["doc_id", "n", "hkey", "ids", "width"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, hkey long, ids binary, width int")


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, separator: int = 0, seed: int = 7) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, hkey.

    Pieces of a sequence lie gapless from offset 0, in the order of the curve."""
    spark = importable(docs.sparkSession)
    tok = written(tokenized(docs, tokenizer, separator, seed).withColumn("row", F.monotonically_increasing_id()), "op8-tokens")
    total = tok.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // MOST_TOKENS), min(parallelism(spark), -(-total // RANGE_TOKENS)))

    def run(batches):
        pid = TaskContext.get().partitionId()
        at = 0  # tokens of this range so far
        for b in slices(batches, "ids", 1 << 20):
            ids, width = b.column(3).to_pylist(), b.column(4).to_pylist()
            n = b.column(1).to_numpy()
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            pieces = (first + n - 1) // length - first // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            seq = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (first // length)[doc]
            start = np.maximum(seq * length, first[doc])
            stop = np.minimum((seq + 1) * length, (first + n)[doc])
            lo, hi = start - first[doc], stop - first[doc]
            wide = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(ids, width)]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(doc)), pa.array(lo), pa.array(hi - lo),
                pa.array([wide[d][x:y].tobytes() for d, x, y in zip(doc.tolist(), lo.tolist(), hi.tolist())], pa.binary()),
                pa.array(n[doc]), pa.array((pid << 40) + seq), pa.array(start - seq * length), b.column(2).take(pa.array(doc))],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "hkey"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # copies share the key; they are parted by their ids, and those of one id (or none) by the written number of the row
    order = tok.withColumn("salt", F.xxhash64("doc_id")).repartitionByRange(ranges, "hkey", "salt", "row")
    order = order.sortWithinPartitions("hkey", "salt", "row").select("doc_id", "n", "hkey", "ids", "width")
    return order.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, hkey long")
