import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchside.llm import chat, fixity, neighbours, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLE[name]).df()
    key = lambda d: Counter(tuple(None if pd.isna(x) else x for x in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns)
    assert key(got) == key(want) and len(got)


def test_rotation_renders_every_perspective(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi é"), (1, 2, "bob", None), (1, 2, "bob", "b"), (1, 2, "bob", "b"), (1, 3, None, "x"),
            (None, None, "cat", ""), (2, 0, "system", "only")]
    got = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("segment", F.lit(1))).collect()
    dialogues = {}
    for r in sorted(got, key=lambda r: (r.conv_id is None, r.conv_id, r.perspective, r.seq)):
        d = dialogues.setdefault((r.conv_id, r.perspective), ["", []])
        assert r.start == len(d[0]) and r.stop == r.start + len(r.segment)
        d[0] += r.segment
        if r.train_start is not None:
            d[1].append((r.train_start, r.train_stop))
    assert set(dialogues) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "cat")}
    text, mask = dialogues[1, "bob"]
    assert text.startswith("<|im_start|>system\nrules<|im_end|>\n<|im_start|>user name=ann\nhi é<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert [text[a:b] for a, b in mask] == ["<|im_end|>\n", "b<|im_end|>\n", "b<|im_end|>\n"]
    assert chat.rotated(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_long_conversation_in_many_ranges(spark):
    rows = [(7, i // 3, f"s{i % 3}", "t" * (i % 11)) for i in range(3000)]
    got = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(8)).where("perspective = 's1'").orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(3000))
    assert [r.start for r in got] == np.cumsum([0] + [len(r.segment) for r in got[:-1]]).tolist()


def replica(spark, rows):
    return spark.createDataFrame(rows, "file string, offset long, payload string").withColumn("digest", F.lit(1))


def test_audit_finds_all_damage(spark):
    r = random.Random(1)
    a = [(f"f{i % 5}", 1000 * i + 7, f"payload {i}" * r.randrange(1, 9)) for i in range(4000)] + [("big", 1 << 45, "x"), ("f1", 3, None), ("f2", 5, "dup"), ("f2", 5, "dup")]
    b = [x for i, x in enumerate(a) if i not in (10, 999)]
    b[50] = (*b[50][:2], "changed")
    b += [("new", 0, "extra"), (None, 4, "no place"), ("f0", None, "no place")]
    b = [(f, o, "" if (f, o) == ("f1", 3) else p) for f, o, p in b if (f, o) != ("big", 1 << 45)] + [("f2", 5, "dup")]
    got = {(x.file, x.offset): x.status for x in fixity.audit(replica(spark, a), replica(spark, b)).collect()}
    want = {a[10][:2]: "missing", a[999][:2]: "missing", b[50][:2]: "corrupt", ("new", 0): "extra", ("f1", 3): "corrupt", ("big", 1 << 45): "missing", ("f2", 5): "corrupt"}
    assert got == want
    assert fixity.unplaced(replica(spark, b)).first()[0] == 2


def test_equal_and_empty_replicas(spark):
    a = [("f", i * 10, str(i)) for i in range(300)]
    assert fixity.audit(replica(spark, a), replica(spark, a[::-1])).count() == 0
    assert fixity.audit(replica(spark, []), replica(spark, [])).count() == 0
    assert {x.status for x in fixity.audit(replica(spark, a), replica(spark, [])).collect()} == {"missing"}
    leaf = {x.offset: x.digest for x in fixity.leaves(replica(spark, a).withColumn("side", F.lit("a"))).collect()}
    assert leaf[20] == hashlib.sha256(b"2").hexdigest()


def test_interleaving_law_and_mixture(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", f"t{i % 50}") for i in range(5000)] + [(None, None, None)] * 5 + [(8, "dup", "x")] * 9
    df = spark.createDataFrame(rows, "doc_id long, source string, shard string").withColumnRenamed("shard", "text").repartition(5)
    got = sharding.interleaved(df, 40).collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter(rows)
    size = Counter(r.shard for r in got)
    assert len(size) == 40 and max(size.values()) - min(size.values()) <= 1
    for s, n in size.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    share = Counter(x[1] for x in rows)
    per = Counter((r.shard, r.source) for r in got)
    for s in range(40):
        for src, n in share.items():
            assert abs(per[s, src] - n / 40) <= 2
    again = {(r.doc_id, r.source, r.text, r.shard, r.slot) for r in sharding.interleaved(df.repartition(3), 40).where("source = 'hot'").collect()}
    assert again == {(r.doc_id, r.source, r.text, r.shard, r.slot) for r in got if r.source == "hot"}
    few = sharding.interleaved(df.where("doc_id IN (1, 2, 4)"), 40).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3
    assert sharding.interleaved(df.where("false"), 40).count() == 0


def test_interleaving_equals_plain_ranks(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", f"t{i % 11}") for i in range(700)] + [(None, "s1", f"n{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    hashed = [tuple(r) for r in df.select("*", F.xxhash64(F.lit(20), "doc_id"), F.xxhash64("doc_id", "source", "text")).collect()]
    low = lambda x: (x is not None, x)
    at = {}
    for source in {r[1] for r in hashed}:
        own = sorted((r for r in hashed if r[1] == source), key=lambda r: (r[3], low(r[0]), r[4]))
        at |= {r[:3]: ((i + 0.5) / len(own), r[3], r[1], r[4]) for i, r in enumerate(own)}
    order = sorted(at, key=at.get)
    want = {}
    for place, r in enumerate(order):
        shard = place * 40 // len(order)
        want[r] = (shard, place - -(-shard * len(order) // 40))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in sharding.interleaved(df, 40).collect()} == want


def test_interleaving_of_hot_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = [(None, "a", "same")] * 900 + [(None, "b", f"t{i}") for i in range(900)] + [(i, "c", "x") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for c in ("_hash", "_bucket", "_all", "_row", "c0", "_source", "slot"):
        df = df.withColumn(c, F.lit("q"))
    got = sharding.interleaved(df, 8)
    assert set(got.columns) == {*df.columns, "shard"}
    got = got.collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter(rows) and {r["_hash"] for r in got} == {"q"}
    per = Counter((r.shard, r.source) for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(250))
        assert all(abs(per[s, src] - n / 8) <= 2 for src, n in (("a", 900), ("b", 900), ("c", 200)))


def brute_neighbours(rows, k, ask):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
    out = {}
    for q in filter(ask, good):
        s = sorted(((-float(good[q] @ x), i) for i, x in good.items() if i != q))
        out[q] = [(i, -d) for d, i in s[:k]]
    return out


@pytest.mark.parametrize("cell", [16_384, 100])
def test_neighbours_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    want = brute_neighbours(rows, 20, lambda i: i % 20 == 0)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9, hit
    near = dict(rows)
    for q, found in got.items():
        for i, s in found:
            assert abs(s - np.dot(near[q], near[i])) < 1e-12
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_neighbours_edge_cases(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.5, 0.5]), (120, [3.0, -1.0]), (140, None), (160, [0.0, 0.0]), (180, [float("nan"), 1.0]), (200, [1.0, None]),
                                                   (220, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, [0.5, 0.5]), (240, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_neighbours(rows, 20, lambda i: i % 20 == 0)
    few = df.where("vec_id IN (100, 120)")
    assert {(r.query_id, r.vec_id) for r in neighbours.nearest(few, few, 20).collect()} == {(100, 120), (120, 100)}
    assert neighbours.nearest(df.where("false"), df, 20).count() == 0


def test_cells_are_bounded_whatever_the_sample(spark, monkeypatch):
    """A sample that allows two cells only, a cluster of vectors in one place and vectors of equal projection."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    monkeypatch.setattr(neighbours, "SAMPLE", 32)
    r = np.random.default_rng(5)
    y = np.concatenate([r.normal(size=(900, 8)), r.normal(size=(700, 8)) * 1e-3 + 4, np.zeros((300, 8))])
    rows = [([float(i), 1.0], [i], 0, [float(a) for a in p]) for i, p in enumerate(y)]
    dealt, boxes = neighbours._bounded_cells(spark.createDataFrame(rows, "v array<double>, ids array<long>, cell long, y array<double>"), 8)
    got = dealt.select("v", "cell", "y").collect()
    assert len(got) == len(rows) and max(Counter(g.cell for g in got).values()) <= 60 and len(boxes) == len({g.cell for g in got})
    box = boxes.set_index("cell")
    for g in got:
        b = box.loc[g.cell]
        assert all(b[f"lo{j}"] <= g.y[j] <= b[f"hi{j}"] for j in range(8))


def test_boxes_meet_queries_in_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "MEET_QUERIES", 7)
    monkeypatch.setattr(neighbours, "MEET_BOXES", 5)
    r = np.random.default_rng(6)
    y, lo = r.normal(size=(30, 4)), r.normal(size=(23, 4))
    hi = lo + r.random((23, 4))
    want = (np.maximum(np.maximum(lo[None] - y[:, None], y[:, None] - hi[None]), 0) ** 2).sum(axis=2)
    got = np.full((30, 23), -1.0)
    for a, c, gap in neighbours._gaps(y, lo, hi):
        assert gap.shape[0] <= 7 and gap.shape[1] <= 5
        got[a:a + gap.shape[0], c:c + gap.shape[1]] = gap
    np.testing.assert_allclose(got, want)


def test_share_of_verified_vectors():
    """Recall and share of verified vectors of the stopping test in one cell, over the confidence."""
    con = duckdb.connect()
    x = np.stack([np.asarray(v, float) for (v,) in con.execute("SELECT embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()])
    big = float((x * x).sum(axis=1).max())
    tree = neighbours.Tree(np.c_[x, np.sqrt(np.maximum(big - (x * x).sum(axis=1), 0))] @ (project := np.random.default_rng(3).normal(size=(x.shape[1] + 1, neighbours.DIMS))))
    recall = {}
    for confidence in (neighbours.CONFIDENCE, 0.2):
        chi = neighbours.chi_square_quantile(confidence, neighbours.DIMS)
        hit = seen = 0
        for q in range(0, len(x), 20):
            want = set(np.argsort(-(x @ x[q]), kind="stable")[:21])
            seen_here = []
            got, _ = neighbours.search(tree, x[tree.order], x[q], np.r_[x[q], 0] @ project, float(x[q] @ x[q]), big, 21, np.inf, chi, seen_here)
            hit, seen = hit + len(want & set(tree.order[got])), seen + sum(seen_here)
        n = len(range(0, len(x), 20))
        recall[confidence] = hit / n / 21
        print(f"confidence {confidence}: recall {recall[confidence]:.3f}, verified {seen / n / len(x):.3f}")
    assert recall[neighbours.CONFIDENCE] >= 0.92
