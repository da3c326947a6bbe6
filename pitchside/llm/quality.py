"""Operator 7: quality classifier on supervised subword embeddings.

Words and character n-grams (bytes, within a word and the space at either side),
and a pseudo-word wherever a word repeats the one before, are hashed to learned vectors, a document is their average, and a softmax layer
classifies it. Vectors and layer are trained by numpy stochastic gradient descent
on a bounded sample of labelled documents. As the layer is linear, a score needs
one learned number per bucket; documents are scored whole, in place, without a
shuffle.

Edge cases: null and empty texts have no features and get the score of the bias
alone; labels that are null, or of ids without a document, are left out;
repeated labels count each; without any label the score is 0.5, with one class
only it is that class's; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import U64, Words, flat_bytes, importable, mix, passages, slices, written

#: log2 of the hash buckets, vector size, n-gram lengths, most labelled documents to learn from (those with the
#: smallest hashed ids), passes, batch and step size of the training.
BUCKET_BITS, DIM, NGRAMS, SAMPLE, PASSES, BATCH, RATE = 17, 8, (2, 4), 3000, 6, 32, 0.15
#: Bytes of text that training takes from the sample in all, and of one document at least.
SAMPLE_BYTES, LEAST_BYTES = 32 << 20, 256
#: Bucket of the pseudo-word for a repeated word.
REPEATED = 1


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and n-gram occurrence of a block of texts, and the document of each."""
    w = Words(raw, off, lower=False)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(w.first))
    # a word right after itself is also further words "repeated", as many as it has bytes and so n-grams
    again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])) + 1
    again = np.repeat(again, (w.end - w.start)[again])
    buckets = [(w.hash >> U64(64 - BUCKET_BITS)).astype(np.int32), np.full(len(again), REPEATED, np.int32)]
    docs = [doc.astype(np.int32), doc[again].astype(np.int32)]
    b = w.bytes
    space = (b == 32) | ((b >= 9) & (b <= 13))
    code = np.where(space, 32, b).astype(np.uint64) + U64(1)
    doc_of = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    for n in NGRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        ok = doc_of[:m] == doc_of[n - 1:]
        for j in range(1, n - 1):
            ok &= ~space[j:j + m]
        if n == 2:
            ok &= ~(space[:m] & space[1:])
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h = h * U64(0x100000001B3) + code[j:j + m]
        at = np.flatnonzero(ok)
        buckets.append((mix(h[at] + U64(n << 56)) >> U64(64 - BUCKET_BITS)).astype(np.int32))
        docs.append(doc_of[at])
    return np.concatenate(buckets), np.concatenate(docs)


def _counted(docs: DataFrame, most: int) -> DataFrame:
    """label, distinct buckets (int32) and counts (float32) of passages of at most ``most`` bytes of each document of the sample."""
    def run(batches):
        for b in slices(batches, "text", 1 << 19):
            short = [passages(x or b"", most).decode("utf-8", "ignore") for x in b.column(1).cast(pa.binary()).to_pylist()]
            bucket, doc = features(*flat_bytes(pa.array(short, pa.string())))
            n, idx, cnt = b.num_rows, [], []
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(n + 1))
            for i in range(n):
                u, c = np.unique(bucket[order[cut[i]:cut[i + 1]]], return_counts=True)
                idx.append(u.astype(np.int32).tobytes())
                cnt.append(c.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], names=["label", "idx", "cnt"])

    return docs.select("label", "text").mapInArrow(run, "label int, idx binary, cnt binary")


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 5) -> tuple[np.ndarray, float]:
    """Learned score of each bucket and the bias (log-odds of label 1 over 0), by AdaGrad steps on averaged vectors."""
    size = 1 << BUCKET_BITS
    y = np.array([r[0] for r in rows])
    if not len(y):
        return np.zeros(size, np.float32), 0.0
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return np.zeros(size, np.float32), prior
    r = np.random.default_rng(seed)
    emb = r.uniform(-1, 1, (size, DIM)).astype(np.float32) / DIM
    emb_sq = np.full(size, 1e-8, np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    layer_sq = np.full((DIM, 2), 1e-8, np.float32)
    bias = np.array([0.0, prior], np.float32)
    # the rarer class weighs more, up to the square root of what would even out both
    balance = np.sqrt(len(y) / 2 / np.bincount(y, minlength=2))
    idx = [x[1] for x in rows]
    weight = [x[2] / max(x[2].sum(), 1) for x in rows]
    for _ in range(PASSES):
        order = r.permutation(len(rows))
        for s in range(0, len(order), BATCH):
            pick = [i for i in order[s:s + BATCH] if len(idx[i])]
            if not pick:
                continue
            flat = np.concatenate([idx[i] for i in pick])
            wt = np.concatenate([weight[i] for i in pick])
            cut = np.cumsum([0] + [len(idx[i]) for i in pick[:-1]])
            hidden = np.add.reduceat(emb[flat] * wt[:, None], cut)
            z = hidden @ layer + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= balance[y[pick], None]
            g_layer = hidden.T @ p
            g_hidden = p @ layer.T
            layer_sq += g_layer ** 2
            layer -= RATE * g_layer / np.sqrt(layer_sq)
            bias -= 0.02 * p.mean(axis=0)
            # all occurrences of a bucket in the batch step together
            uniq, inverse = np.unique(flat, return_inverse=True)
            rows_g = np.repeat(g_hidden, np.diff(np.r_[cut, len(flat)]), axis=0) * wt[:, None]
            g = np.stack([np.bincount(inverse, weights=rows_g[:, d], minlength=len(uniq)) for d in range(DIM)], axis=1).astype(np.float32)
            emb_sq[uniq] += (g ** 2).mean(axis=1)
            emb[uniq] -= RATE * g / np.sqrt(emb_sq[uniq])[:, None]
    return (emb @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from at most ``sample`` labelled documents that are not held out, and of them from passages of SAMPLE_BYTES in all, cut
    in the tasks. Labels without a document do not count; of an id with many texts, the one with the smallest hash is taken."""
    importable(docs.sparkSession)
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label IN (0, 1)").where(~held_out())
    chosen = usable.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    texts = hashed.select("doc_id", "hash").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("hash").alias("hash"))
    texts = written(texts, "op7-sample")
    most = max(SAMPLE_BYTES // max(texts.count(), 1), LEAST_BYTES)
    got = _counted(hashed.join(F.broadcast(texts), ["doc_id", "hash"]), most).distinct().collect()
    rows = [(r.label, np.frombuffer(r.idx, np.int32), np.frombuffer(r.cnt, np.float32)) for r in got]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return train(rows)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score of label 1 from 0 to 1."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table, bias = bc.value
        for b in slices(batches, "text", 1 << 19):
            bucket, doc = features(*flat_bytes(b.column(1)))
            n = b.num_rows
            total = np.bincount(doc, weights=table[bucket], minlength=n)
            z = total / np.maximum(np.bincount(doc, minlength=n), 1) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) of every document."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, scored in place with all their columns. All rows if
    nothing could be learned: no usable label, or labels of one class only."""
    model = fit(docs, labels)
    if not model[0].any():
        return docs
    bc = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        table, bias = bc.value
        for b in batches:
            keep = []
            for part in slices(iter([b]), b.schema.names[at], 1 << 19):
                bucket, doc = features(*flat_bytes(part.column(at)))
                n = part.num_rows
                z = np.bincount(doc, weights=table[bucket], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1) + bias
                keep.append(1 / (1 + np.exp(-np.clip(z, -40, 40))) >= threshold)
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
