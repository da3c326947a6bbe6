"""Operator 10: language identification by a linear-chain conditional random field.

Every word of a text gets scores from hashed features (affixes, character
n-grams, lexicon entries), neighbouring words are tied by learned transitions,
and forward-backward gives each word's language probabilities, so passages of
another language inside a text are labelled as such. A document's language is
the one with the most probability over its words.

Training takes the words of a bounded sample of documents with a known language,
as sequences spliced from one to three languages, and follows the gradient of
the chain's likelihood (numpy, AdaGrad). Prediction is exact forward-backward over
whole texts: texts are cut into blocks, each block is reduced to a transfer
matrix, blocks are chained, and the marginals are made inside every block.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
without any document to learn from all are ``und``; documents whose lang is null
are not learned from; repeated rows each get their row; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchside.llm.common import U64, Words, flat_bytes, importable, mix, passages, slices, written
from pitchside.llm.quality import held_out

#: log2 of the feature buckets, documents to learn from per language (smallest hashed ids), training sequences and
#: their words, passes, batch and step size, entries of the lexicon, words of a block.
BUCKET_BITS, PER_LANG, SEQUENCES, SEQ_WORDS, PASSES, BATCH, RATE, LEXICON, BLOCK = 17, 400, 3000, 40, 3, 64, 0.3, 50_000, 32
#: Parts of a language of which each gives its smallest ids before all are ranked.
PARTS = 64
#: Bytes of text that the driver gathers to learn from (more only beyond 65,536 documents, LEAST_BYTES of each); longer
#: documents give passages.
SAMPLE_BYTES, LEAST_BYTES = 16 << 20, 256
_LETTER = regex.compile(r"\p{L}")


class Model:
    """langs, weights (bucket x lang), transitions (lang x lang), sorted hashes of the lexicon and the bucket of each."""

    def __init__(self, langs, weights, trans, lex_hash, lex_bucket):
        self.langs, self.weights, self.trans, self.lex_hash, self.lex_bucket = langs, weights, trans, lex_hash, lex_bucket


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + U64(kind << 56)) >> U64(64 - BUCKET_BITS)).astype(np.int32)


def word_features(b: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, lex_hash: np.ndarray,
                  lex_bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all features of the words at b[start:end]: prefixes and suffixes of 1 to 3 bytes,
    all n-grams of 2 and 3 bytes, the lexicon's entry, and one for every word."""
    n = len(start)
    size = end - start
    words, out = [np.arange(n)], [np.zeros(n, np.int32)]
    code = b.astype(np.uint64) + U64(1)

    def gram(at, k):
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = h * U64(0x100000001B3) + code[at + j]
        return h

    for k in (1, 2, 3):
        has = np.flatnonzero(size >= k)
        words += [has, has]
        out += [_bucket(gram(start[has], k), k), _bucket(gram(end[has] - k, k), 8 + k)]
    for k in (2, 3):
        many = np.maximum(size - k + 1, 0)
        w = np.repeat(np.arange(n), many)
        at = np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many) + start[w]
        words.append(w)
        out.append(_bucket(gram(at, k), 16 + k))
    if len(lex_hash):
        i = np.minimum(np.searchsorted(lex_hash, hashes), len(lex_hash) - 1)
        hit = np.flatnonzero(lex_hash[i] == hashes)
        words.append(hit)
        out.append(lex_bucket[i[hit]])
    return np.concatenate(words), np.concatenate(out)


def emissions(w: Words, model: Model) -> np.ndarray:
    """Feature score of every word for every language; each distinct word is scored once."""
    uniq, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    word, bucket = word_features(w.bytes, w.start[first], w.end[first], uniq, model.lex_hash, model.lex_bucket)
    got = np.stack([np.bincount(word, weights=model.weights[bucket, j], minlength=len(uniq)) for j in range(len(model.langs))], axis=1)
    return got[inverse]


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Forward-backward: probability of every label at every position of sequences e[first[i]:first[i + 1]].

    All blocks advance together, so the work is in arrays and each sequence is used whole."""
    n, k = e.shape
    if not n:
        return np.zeros((0, k))
    u = np.exp(e - e.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    length = np.diff(first)
    per = -(-length // block)
    nb = int(per.sum())
    seq = np.repeat(np.arange(len(length)), per)
    nth = np.arange(nb) - np.repeat(np.cumsum(per) - per, per)
    begin = first[:-1][seq] + nth * block
    width = np.minimum(block, first[1:][seq] - begin)
    pos = begin[:, None] + np.arange(block)
    live = np.arange(block) < width[:, None]
    pos = np.where(live, pos, 0)
    v = u[pos]  # block x step x label
    # transfer matrix of each block
    m = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for s in range(block):
        step = (m @ t) * v[:, s, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        m = np.where(live[:, s, None, None], step, m)
    # chain the blocks of each sequence: what comes in from the left and from the right
    head = np.cumsum(per) - per
    left, right = np.full((nb, k), 1.0 / k), np.ones((nb, k))
    most = int(per.max())
    order = np.argsort(-per, kind="stable")
    longer = np.array([np.searchsorted(-per[order], -j, side="left") for j in range(most + 1)])  # sequences with more than j blocks
    for j in range(1, most):
        at = head[order[:longer[j]]] + j
        x = np.einsum("bi,bij->bj", left[at - 1], m[at - 1])
        left[at] = x / x.sum(axis=1, keepdims=True)
    for j in range(most - 2, -1, -1):
        at = head[order[:longer[j + 1]]] + j
        x = np.einsum("bij,bj->bi", m[at + 1], right[at + 1])
        right[at] = x / x.max(axis=1, keepdims=True)
    fwd = np.empty((nb, block, k))
    a = left
    for s in range(block):
        x = (a @ t) * v[:, s]
        x /= x.sum(axis=1, keepdims=True)
        a = np.where(live[:, s, None], x, a)
        fwd[:, s] = a
    z = right
    for s in range(block - 1, -1, -1):
        fwd[:, s] *= z
        x = (v[:, s] * z) @ t.T
        x /= x.max(axis=1, keepdims=True)
        z = np.where(live[:, s, None], x, z)
    fwd /= fwd.sum(axis=2, keepdims=True)
    return fwd[live]


def _lexicon(words_of: list[tuple[int, np.ndarray]], n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that one language has more than all others, with the bucket of (language, how clearly)."""
    uniq, inverse = np.unique(np.concatenate([h for _, h in words_of]), return_inverse=True)
    lang = np.concatenate([np.full(len(h), y) for y, h in words_of])
    n = np.stack([np.bincount(inverse[lang == j], minlength=len(uniq)) for j in range(n_langs)], axis=1).astype(float)
    rate = (n + 0.1) / (n.sum(axis=0) + 1)
    share = rate / rate.sum(axis=1, keepdims=True)
    best, clear = share.argmax(axis=1), share.max(axis=1)
    pick = np.flatnonzero((n.sum(axis=1) >= 3) & (clear > 0.5))
    pick = np.sort(pick[np.argsort(-n[pick].sum(axis=1), kind="stable")][:LEXICON])
    level = np.minimum((clear[pick] - 0.5) * 8, 3).astype(np.int64)
    return uniq[pick], _bucket((best[pick] * 4 + level).astype(np.uint64), 32)


def train(texts: list[tuple[str, bytes]], seed: int = 11) -> Model | None:
    """The chain learned from (lang, text) pairs."""
    texts = sorted(x for x in texts if x[1])
    langs = sorted({y for y, _ in texts})
    if not langs:
        return None
    k = len(langs)
    raw, off = flat_bytes(pa.array([x for _, x in texts], pa.binary()))
    w = Words(raw, off)
    y_doc = np.array([langs.index(y) for y, _ in texts])
    weights, trans = np.zeros((1 << BUCKET_BITS, k)), np.zeros((k, k))
    spans = [(int(y), w.hash[w.first[i]:w.first[i + 1]]) for i, y in enumerate(y_doc) if w.first[i + 1] > w.first[i]]
    if not spans:
        return Model(langs, weights, trans, np.zeros(0, np.uint64), np.zeros(0, np.int32))
    lex_hash, lex_bucket = _lexicon(spans, k)
    r = np.random.default_rng(seed)
    by_lang = [[i for i in np.flatnonzero(y_doc == j) if w.first[i + 1] > w.first[i]] for j in range(k)]
    able = [j for j in range(k) if by_lang[j]]
    seqs, golds = [], []
    for _ in range(SEQUENCES):
        idx, gold = [], []
        parts = int(r.choice([1, 2, 3], p=[0.6, 0.3, 0.1]))
        for _ in range(parts):
            j = able[r.integers(len(able))]
            d = by_lang[j][r.integers(len(by_lang[j]))]
            take = min(SEQ_WORDS // parts, int(w.first[d + 1] - w.first[d]))
            s = int(r.integers(w.first[d], w.first[d + 1] - take + 1))
            idx += range(s, s + take)
            gold += [j] * take
        seqs.append(np.array(idx))
        golds.append(np.array(gold))
    g2, t2 = np.full((1 << BUCKET_BITS, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(PASSES):
        order = r.permutation(len(seqs))
        for s in range(0, len(order), BATCH):
            pick = order[s:s + BATCH]
            at = np.concatenate([seqs[i] for i in pick])
            gold = np.concatenate([golds[i] for i in pick])
            first = np.cumsum([0] + [len(seqs[i]) for i in pick])
            word, bucket = word_features(w.bytes, w.start[at], w.end[at], w.hash[at], lex_hash, lex_bucket)
            e = np.stack([np.bincount(word, weights=weights[bucket, j], minlength=len(at)) for j in range(k)], axis=1)
            p = marginals(e, first, trans, SEQ_WORDS)
            d = p.copy()
            d[np.arange(len(at)), gold] -= 1
            # expected less observed transitions; neighbours' joint probability from the marginals of the pair
            inner = np.ones(len(at), bool)
            inner[first[:-1]] = False
            j = np.flatnonzero(inner)
            u = np.exp(e[j] - e[j].max(axis=1, keepdims=True))
            joint = p[j - 1][:, :, None] * np.exp(trans)[None] * u[:, None, :]
            # given the left label, the right one follows transition, emission and the message from beyond
            beyond = p[j] / np.maximum(np.einsum("ni,nij->nj", p[j - 1], np.exp(trans)[None] * u[:, None, :]), 1e-300)
            joint *= beyond[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            g_t = joint.sum(axis=0)
            np.add.at(g_t, (gold[j - 1], gold[j]), -1)
            g_t /= len(pick)
            t2 += g_t ** 2
            trans = np.clip(trans - RATE * g_t / np.sqrt(t2), -8, 8)
            uniq, inverse = np.unique(bucket, return_inverse=True)
            g = np.stack([np.bincount(inverse, weights=d[word, c], minlength=len(uniq)) for c in range(k)], axis=1) / len(pick)
            g2[uniq] += g ** 2
            weights[uniq] -= RATE * g / np.sqrt(g2[uniq])
    return Model(langs, weights.astype(np.float32), trans, lex_hash, lex_bucket)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learn from at most ``per_lang`` documents of each language that are not held out, and of them from passages of
    SAMPLE_BYTES in all, cut in the tasks."""
    importable(docs.sparkSession)
    # the smallest hashed ids of a language, first among the rows of each of its parts, then among those
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = docs.where("lang IS NOT NULL").where(~held_out()).select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("_part"))
    for by in (["lang", "_part"], ["lang"]):
        ids = ids.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= per_lang)
    ids = written(ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")), "op10-sample")

    def of(*cols: str) -> DataFrame:
        return docs.select("doc_id", "lang", *cols).join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")

    most = max(SAMPLE_BYTES // max(of().count(), 1), LEAST_BYTES)

    def cut(batches):
        for b in batches:
            texts = pa.array([passages(x or b"", most) for x in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["lang", "text"])

    return train([(r.lang, bytes(r.text)) for r in of("text").select("lang", "text").mapInArrow(cut, "lang string, text binary").collect()])


def _predict(arr: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """lang_pred and score of every text of an Arrow array."""
    n = len(arr)
    lang, score = np.full(n, "und", object), np.zeros(n)
    if model is None or not n:
        return lang.tolist(), score
    w = Words(*flat_bytes(arr))
    letter = np.zeros(256, np.int64)
    letter[[*range(97, 123), *range(128, 256)]] = 1
    has = np.concatenate([[0], np.cumsum(letter[w.bytes])])
    wordy = (has[w.end] > has[w.start]).astype(float)
    p = marginals(emissions(w, model), w.first, model.trans)
    doc = np.repeat(np.arange(n), np.diff(w.first))
    total = np.stack([np.bincount(doc, weights=p[:, j] * wordy, minlength=n) for j in range(len(model.langs))], axis=1)
    best = total.argmax(axis=1)
    mean = total.max(axis=1) / np.maximum(total.sum(axis=1), 1e-12)
    for i, t in enumerate(arr.to_pylist()):
        if t and _LETTER.search(t):
            lang[i], score[i] = model.langs[best[i]], min(mean[i], 1.0)
    return lang.tolist(), score


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score (the mean probability of lang_pred over the words)."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, "text", 1 << 19):
            lang, score = _predict(b.column(1), bc.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def word_labels(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs``: doc_id and the spans of its languages: array of (start, end) byte offsets of runs of
    words with one most probable language, and that language."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, "text", 1 << 19):
            w, m = Words(*flat_bytes(b.column(1))), bc.value
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            if m is not None and len(w.start):
                best = marginals(emissions(w, m), w.first, m.trans).argmax(axis=1)
                doc = np.repeat(np.arange(b.num_rows), np.diff(w.first))
                cut = np.r_[0, np.flatnonzero((np.diff(best) != 0) | (np.diff(doc) != 0)) + 1, len(best)]
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    d = int(doc[s])
                    spans[d].append({"start": int(w.start[s] - w.off[d]), "end": int(w.end[e - 1] - w.off[d]), "lang": m.langs[best[s]]})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start:long,end:long,lang:string>>")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the documents themselves."""
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a known language of probability ``least`` or more, with all their columns."""
    bc = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep: list[bool] = []
            for part in slices(iter([b]), b.schema.names[at], 1 << 19):
                lang, score = _predict(part.column(at), bc.value)
                keep += [x != "und" and s >= least for x, s in zip(lang, score)]
            if keep:
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
