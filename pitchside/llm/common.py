"""Helpers shared by the operators: tables written between steps, text in Arrow batches as
flat byte arrays, hashed words and shingles, connected components."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pitchside.session import ensure_checkpoint_dir

U64 = np.uint64
#: Odd base of the polynomial word hash (congruent to 5 mod 8) and the multipliers of the finaliser.
_BASE = U64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Rows of an Arrow batch between Spark and Python, bytes of a passage of a long text.
BATCH_ROWS, PASSAGE = 2000, 2048


def importable(spark: SparkSession) -> SparkSession:
    """Put the folder of the package on the path of the Python workers, for those that see the same folder (local
    mode, shared installations). Elsewhere the package is shipped with ``--py-files`` or installed.

    Rows hold whole texts, so Arrow batches of the default 10,000 rows are made smaller for this session."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder of ``spark.checkpoint.dir`` and read back.

    It cuts lineage like ``checkpoint()``, survives lost executors, and is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, df: DataFrame) -> str:
    """A helper column's name that no column of ``df`` has (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], col: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``col`` holds at most ``max_bytes`` (or one row)."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(col)), 0), dtype=np.int64)
        if not len(size):
            continue
        group = (np.cumsum(size) - size) // max_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(size)]):
            yield b.slice(int(s), int(e - s))


def passages(text: bytes, most: int) -> bytes:
    """The text, or if it is over ``most`` bytes whole words of equally many passages from each part of it, at hashed positions."""
    if len(text) <= most:
        return text
    n, seed, out = max(most // PASSAGE, 1), zlib.crc32(text), []
    size = most // n - 1  # and a space
    for i in range(n):
        lo, hi = i * len(text) // n, (i + 1) * len(text) // n
        s = lo + zlib.crc32(i.to_bytes(8, "little"), seed) % (max(hi - lo - size, 0) + 1)
        piece = text[s:s + size]
        words = piece.split()
        # words cut at either end go, unless the passage has no other
        a, z = int(s > 0 and not text[s - 1:s].isspace()), int(s + size < len(text) and not text[s + size:s + size + 1].isspace())
        whole = words[(a if piece[:1].strip() else 0):len(words) - (z if piece[-1:].strip() else 0)]
        out.append(b" ".join(whole) if whole else piece.decode("utf-8", "ignore").encode())
    return b" ".join(out)


def flat_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values (null: none) one after another, and the n+1 offsets."""
    if arr.null_count:
        arr = pc.fill_null(arr, "" if not pa.types.is_binary(arr.type) else b"")
    arr = arr.cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> U64(30))) * _MIX1
    h = (h ^ (h >> U64(27))) * _MIX2
    return h ^ (h >> U64(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        n = max(n, 1 << 16)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("p", _BASE), ("q", inverse)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a)
    return _powers["p"], _powers["q"]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block of texts: byte spans, 64-bit hashes, document of each."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = True):
        b = _LOWER[raw] if lower else raw
        n = len(b)
        self.bytes, self.off = b, off
        starts_doc = np.zeros(n + 1, bool)
        starts_doc[off] = True
        solid = ~_SPACE[b]
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | starts_doc[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | starts_doc[1:n + 1])) + 1
        p, q = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + U64(1)) * p[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * q[self.start] + (self.end - self.start).astype(np.uint64))
        #: word index at which each document begins (n_docs + 1)
        self.first = np.searchsorted(self.start, off)

    def shingle_bytes(self, k: int) -> np.ndarray:
        """Bytes of the words of every shingle, in the order of ``shingles``."""
        count = np.diff(self.first)
        made = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
        at = np.arange(made.sum()) + np.repeat(self.first[:-1] - (np.cumsum(made) - made), made)
        total = np.concatenate([[0], np.cumsum(self.end - self.start)])
        return total[at + np.repeat(np.minimum(count, k), made)] - total[at]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit hashes, n_docs + 1 offsets) of all k-word shingles in text order; a document of 1 to k-1 words has its whole sequence as one."""
        h, first = self.hash, self.first
        count = np.diff(first)
        made = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
        out_off = np.concatenate([[0], np.cumsum(made)])
        at = np.arange(out_off[-1]) + np.repeat(first[:-1] - out_off[:-1], made)
        have = np.repeat(np.minimum(count, k), made)
        out = have.astype(np.uint64)
        padded = np.concatenate([h, np.zeros(k, np.uint64)])
        for j in range(k):
            mult = U64(pow(int(_BASE), j + 2, 1 << 64))
            out += np.where(have > j, padded[at + j], U64(0)) * mult
        return mix(out), out_off


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of each partition as stars around the smallest node that the partition links them to."""
    kind = edges.schema["a"].dataType

    def run(batches):
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(up.setdefault(x, x) if x not in up else x), top(up.setdefault(y, y) if y not in up else y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        far = [(x, r) for x in up if (r := top(x)) != x]
        if far:
            t = to_arrow_type(kind)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in far], t), pa.array([r for _, r in far], t)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}")


def components(edges: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): alternating large-star and small-star
    rounds, each a partially aggregated minimum and an equi-join, written out between rounds; every
    partition first links its own edges. ``root`` is the smallest node of the component."""
    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        return both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        return down.join(low, down.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    e = written(_contracted(edges.where("a <> b")).distinct(), label)
    was = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == was or not now[0]:
            break
        was = tuple(now)
        e = written(small(large(_contracted(e))), label)
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select("b", "b").distinct())
