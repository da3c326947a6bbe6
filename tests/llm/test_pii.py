import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchside.llm import pii, queries

SF = "/root/testdata/sf0.01"
#: The stated patterns as they stand.
STATED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def stated_spans(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            double = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) + sum(digits[-1::-2])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and double % 10 == 0,
                    "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(STATED).index(s[0])))


def test_base_spans_equal_the_stated_patterns():
    r = random.Random(7)
    pieces = ["@", ".", "-", "+", " ", "(", ")", "é", "a", "Z9", "x@y.z", "1.2.3.4", "255", "256", "4539 1488 0343 6467", "4539148803436467", "+1 (017) 555-7713", "0", "12", "\n", "%", "_", "０"]
    n = Counter()
    for _ in range(30_000):
        text = "".join(r.choices(pieces, k=r.randrange(1, 14)))
        want = stated_spans(text)
        assert pii.base_spans(text) == want, text
        n.update(k for k, _, _ in want)
    assert min(n[k] for k in pii.KINDS) > 100


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@", "a@", "+", "+1(", "1 ", "@a.", " at a dot ", "1[.]", "é"])
def test_long_runs_take_linear_time(unit):
    model = pii.Model()
    text = unit * (60_000 // len(unit))
    assert isinstance(pii.found_spans(model, [text])[0], list)


def segmentations(size, phi, n):
    def from_(t):
        if t == size:
            yield []
            return
        yield from ([(t, t + 1, n), *rest] for rest in from_(t + 1))
        for m in range(1, min(pii.SPAN, size - t) + 1):
            for k in range(n):
                if np.isfinite(phi[t + m - 1, m - 1, k]):
                    yield from ([(t, t + m, k), *rest] for rest in from_(t + m))
    return from_(0)


def score(path, phi, trans, n):
    total, last = 0.0, n
    for a, b, k in path:
        total += trans[last, k] + (phi[b - 1, b - a - 1, k] if k < n else 0)
        last = k
    return total + trans[last, n]


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(pii, "SPAN", 3)
    r, n = np.random.default_rng(0), len(pii.KINDS)
    sizes = np.array([4, 2, 1])
    phi = r.normal(size=(3, 4, 3, n))
    phi[r.random(phi.shape) < 0.4] = -np.inf
    for t in range(4):
        phi[sizes <= t, t] = -np.inf
        phi[:, t, t + 1:] = -np.inf
    trans = r.normal(size=(n + 1, n + 1))
    z, p, over = pii.marginals(trans, phi, sizes)
    want_over = np.zeros_like(trans)
    for i, size in enumerate(sizes):
        paths = [(score(path, phi[i], trans, n), path) for path in segmentations(size, phi[i], n)]
        total = math.log(sum(math.exp(s) for s, _ in paths))
        want = np.zeros_like(phi[i])
        for s, path in paths:
            last = n
            for a, b, k in path:
                want_over[last, k] += math.exp(s - total)
                last = k
                if k < n:
                    want[b - 1, b - a - 1, k] += math.exp(s - total)
            want_over[last, n] += math.exp(s - total)
        assert abs(total - z[i]) < 1e-9 and np.allclose(want, p[i])
    assert np.allclose(over, want_over)


def test_decoding_is_the_best_segmentation(monkeypatch):
    monkeypatch.setattr(pii, "SPAN", 5)
    r, n = np.random.default_rng(1), len(pii.KINDS)
    model = pii.Model()
    model.w = r.normal(size=model.w.shape)
    model.trans = r.normal(size=model.trans.shape)
    texts = ["call 12-34 5 now", "9999 8888", "a@b.c", "x 1234567 y", "1.2.3.4567"]
    spans = [(t, *m.span()) for t, text in enumerate(texts) for m in [re.search(r"\S.*\S", text)]]
    for piece in (2_048, 3):
        tokens = pii.Tokens(texts, spans, {})
        got = pii.decode(model, tokens, doubt=0.5, piece=piece)
        for z in range(len(spans)):
            a, b = int(tokens.first[z]), int(tokens.first[z + 1])
            s, e = tokens.candidates(np.arange(a, b))
            phi = np.full((b - a, pii.SPAN, n), -np.inf)
            phi[e - a - 1, e - s - 1] = model.segment_scores(tokens, s, e) - 0.5
            best = max((score(path, phi, model.trans, n), [x for x in path if x[2] < n]) for path in segmentations(b - a, phi, n))
            mine = [(s - a, e - a, k) for s, e, k in got if a <= s < b]
            assert mine == best[1]


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_finds_other_spellings_and_leaves_decoys(spark, model):
    r = random.Random(5)
    found, all_, wrong, clean = Counter(), Counter(), 0, 0
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        x = row.text or ""
        for kind, s, e in pii.base_spans(x):
            left, right = x[max(0, s - 60):s], x[e:e + 60]
            for _ in range(3):
                v = pii._respelled(kind, x[s:e], r)
                spans = pii.found_spans(model, [left + v + right])[0]
                all_[kind] += 1
                found[kind] += any(q[:3] == (kind, len(left), len(left) + len(v)) for q in spans)
                v = pii._decoy(kind, x[s:e], r)
                clean += 1
                wrong += any(q[1] < len(left) + len(v) and q[2] > len(left) for q in pii.found_spans(model, [left + v + right])[0])
    print(found, all_, wrong, clean)
    assert all(found[k] >= 0.9 * all_[k] for k in pii.KINDS) and wrong <= 0.02 * clean


def test_adds_next_to_nothing_to_the_given_texts(spark, model):
    """Documents whose zones are plain numbers stay as they are; the few added spans hold a phone or a card that a longer run of digits hides from the rules."""
    got = pii.personal_data(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()
    added = [s for row in got for s in row.spans if not s.base]
    assert len(added) <= 0.01 * len(got)


def test_query_holds_the_base_spans(spark):
    got = {r.doc_id: r for r in queries.op11_semi_markov_pii(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = stated_spans(d.text or ""), got[d.doc_id]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(text.split(",") if text else []) <= set(spans) and len(spans) == len(want) + r.n_added


def test_edge_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "mail a@b.co and a@b.co"), (2, "x 1.2.3.4 " * 3), (2, "x 1.2.3.4 " * 3), (3, "é😀 +49 (089) 555-01234 ünd"), (4, "ann (at) mail7 [dot] example [dot] com " + "w " * 400_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for c in ("spans", "redacted", "kind", "h"):
        df = df.withColumn(c, F.lit("x"))
    got = pii.personal_data(df, model)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    by = [(r.doc_id, [(s.kind, s.span, s.base) for s in r.spans], r.redacted) for r in got.collect()]
    assert (1, [], "") in by and (2, [], "") in by and by.count((2, [("ip", "1.2.3.4", True)] * 3, "x [IP] " * 3)) == 2
    assert (None, [("email", "a@b.co", True)] * 2, "mail [EMAIL] and [EMAIL]") in by
    assert (3, [("phone", "+49 (089) 555-01234", True)], "é😀 [PHONE] ünd") in by
    assert next(x[1] for x in by if x[0] == 4) == [("email", "ann (at) mail7 [dot] example [dot] com", False)]
    assert pii.personal_data(df.where("false")).count() == 0
    plain = pii.personal_data(spark.createDataFrame([(1, "nothing but 12345678 here")], "doc_id long, text string")).collect()
    assert plain[0].spans == [] and plain[0].redacted == "nothing but 12345678 here"


def test_training_sample_is_bounded_and_order_free(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    a, b = (pii.learn(docs.repartition(n), sample=20) for n in (1, 7))
    assert np.array_equal(a.w, b.w) and np.array_equal(a.trans, b.trans)


def test_overlapping_spans_are_redacted_once():
    text = "a +49 4539 14880 b"
    assert pii.redact(text, [("phone", 2, 16, True), ("card", 6, 16, True)]) == "a [PHONE] b"
