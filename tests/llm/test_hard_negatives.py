import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchside.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives=10):
    """All scores of all anchors, by the definition."""
    good = set()
    for ident, v, label in rows:
        if ident is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.add((ident, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a in (g for g in good if g[0] % every == 0):
        scores = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in good if b != a and len(b[2]) == len(a[2]))
        for s, p, _ in [x for x in scores if x[2] == a[1]][:positives]:
            fit = [(n, -t) for t, n, label in scores if label != a[1] and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a[0], p, i + 1, n, -s, t) for i, (n, t) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, dim, kind):
    r = np.random.default_rng(seed)
    if kind == "smooth":  # neighbouring components alike, where summaries can tell much
        v = np.cumsum(r.normal(size=(n, dim)), axis=1)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    elif kind == "few":  # many ties
        v = r.integers(-2, 3, (n, dim)) / 8
    else:
        v = r.normal(size=(n, dim)) / 4
    return [(int(i), [float(np.float32(x)) for x in v[i]], int(r.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("kind, dim", [("random", 16), ("smooth", 64), ("few", 6), ("random", 1)])
def test_equals_all_pairs(spark, kind, dim):
    rows = vectors(1, 900, dim, kind)
    rows += [(1000 + i, rows[5][1], 1) for i in range(300)] + rows[:7]  # a hot vector that is also an anchor's, repeated rows
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.5, None], 1), (2003, [float("nan")] * dim, 1), (2004, [float("inf")] * dim, 2), (None, rows[0][1], 1), (2100, rows[0][1], None)]
    rows += [(2200 + i, [0.25, -0.5, 0.75] * 7, i % 2) for i in range(0, 120, 20)] + [(2400, [0.0] * dim, 1), (100, rows[8][1], 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for c in ("q", "a", "unit", "ids", "near", "rank"):
        df = df.withColumn(c, F.lit("x"))
    got = hn.mined(df, df.where("vec_id % 100 = 0"))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_many_blocks_and_units(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 9)
    monkeypatch.setattr(hn, "UNIT_IDS", 4)
    rows = vectors(2, 600, 8, "random") + [(700 + i, [0.25] * 8, 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = hn.mined(df, df.where("vec_id % 5 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, every=5)


def test_bounds_hold_and_summaries_save_exact_scores():
    r = np.random.default_rng(3)
    for kind in ("random", "smooth"):
        x, y = (hn.Vectors(np.floor(256 * np.array([v for _, v, _ in vectors(s, 400, 64, kind)]))) for s in (4, 5))
        low = np.full(400, np.quantile(x.q @ y.q.T, 0.995)).astype(np.int64)
        seen = []
        i, j, s = hn.scored(x, y, np.ones((400, 400), bool), low, np.full(400, 2 ** 62), seen)
        want = (x.q @ y.q.T).astype(np.int64)
        assert set(zip(i, j)) == set(zip(*np.nonzero(want >= low[:, None]))) and (want[i, j] == s).all()
        assert seen == sorted(seen, reverse=True) and seen[0] == 160_000
        print(kind, [round(n / seen[0], 4) for n in seen])
        if kind == "smooth":
            assert seen[-1] < 0.2 * seen[0]
    big = r.integers(-2 ** 26, 2 ** 26, (2, 64))
    assert hn.exact_scores(big[:1].astype(float), big[1:].astype(float))[0] == sum(int(a) * int(b) for a, b in zip(*big))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hn.mined(df, df).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 2)], SCHEMA)
    assert hn.mined(one, one.where("vec_id = 100")).count() == 0
