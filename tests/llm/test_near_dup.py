import re

import pytest

from pyspark.sql import functions as F

from pitchside.llm import near_dup


def brute(docs, k, num, den):
    """Component (smallest id) of every document by comparing all pairs of shingle sets."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[x:x + k]) for x in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    order = sorted(sets)
    for x, a in enumerate(order):
        for b in order[x + 1:]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    return {(i, len(sets[i]), comp[i]) for i in sets}


def cloud(seed=3, n=60):
    """A base text and copies with a growing number of changed words: many pairs at either side of the threshold."""
    import random
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(150)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randrange(0, 6)):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("k,num,block", [(3, 90, 1024), (5, 80, 16)])
def test_components_equal_brute_force(spark, monkeypatch, k, num, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    texts = cloud() + ["", None, "   \n", "a", "A", "a b", "b a", "One two\tthree", "one  two three", "one two three",
                       "same words " * 300, "same words " * 400, "é É", "É É"]
    texts += [texts[0]] * 5 + [" ".join(f"l{x}" for x in range(9000))] * 2 + [" ".join(f"l{x}" for x in range(8900))]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, digest string, n int").repartition(3)
    got = near_dup.jaccard_components(df, k, num, 100)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == brute(docs, k, num, 100)


def test_whole_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.jaccard_components(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], 3, 90, 100)


def test_empty_table_null_ids_and_repeats(spark):
    schema = "doc_id long, text string, lang string"
    assert near_dup.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b c d", None), (7, "a b c d", "x"), (7, "a b c d", "x"), (None, None, None), (9, None, None)], schema)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 0, None), (9, 0, 9)], key=repr)
    kept = near_dup.keep_one_each(df, 5, 80, 100)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(7, "a b c d"), (None, None), (9, None)], key=repr)


def test_lists_handled_in_parts_keep_all_their_rows(spark, monkeypatch):
    """60 sets of 10 and 3 of 11 share a shingle: the list of the larger class has 60 rows from below and 3 own ones."""
    monkeypatch.setattr(near_dup, "CUT", 6)
    rows = [(g, 10, 1, [7, 100 + g]) for g in range(60)] + [(g, 11, 1, [7, 100 + g]) for g in range(60, 63)]
    rows += [(g, 200, 1, [8]) for g in range(100, 140)]
    groups = spark.createDataFrame(rows, "g long, n long, m int, prefix array<long>").repartition(16)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = near_dup._posted(groups, 90, 100).where("m > 0").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    lists = {}
    for r in got:
        lists.setdefault(r.key, []).append((r.n, r.up))
    assert sorted([(10, 1)] * 60 + [(11, 0)] * 3) in [sorted(x) for x in lists.values()]


@pytest.mark.parametrize("cut", [6, 40])
def test_components_with_lists_in_parts(spark, monkeypatch, cut):
    """A cloud of near copies at a border of size classes, few of them in the upper one."""
    monkeypatch.setattr(near_dup, "CUT", cut)
    words = [f"w{x}" for x in range(40)]
    texts = [" ".join(words[:36] + [f"y{x}"]) for x in range(60)] + [" ".join(words[:36] + [f"y{x}", f"z{x}"]) for x in range(4)]
    docs = list(enumerate(texts))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = near_dup.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), 3, 90, 100).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(docs, 3, 90, 100)


def test_one_text_stays_of_a_component_without_ids(spark):
    schema = "doc_id long, text string, lang string"
    words = [f"w{x}" for x in range(40)]
    near = [" ".join(words + [f"y{x}"]) for x in range(4)]
    rows = [(None, t, None) for t in near] + [(None, near[0], "x"), (None, "  " + near[0], None), (7, "a b c d e f", None), (None, "a b c d e f", "x"), (None, "A b c d e f", None),
            (None, "p q r s t u", None), (None, " ", None), (8, None, None)]
    got = sorted(((r.doc_id, (r.text or "").strip()[:5]) for r in near_dup.keep_one_each(spark.createDataFrame(rows, schema), 5, 80, 100).collect()), key=repr)
    assert got == sorted([(None, "w0 w1"), (7, "a b c"), (None, "p q r"), (None, ""), (8, "")], key=repr)


def test_columns_with_names_of_helpers_are_kept(spark):
    rows = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (None, "one two three four five six seven"), (None, "alone in this table of texts"), (3, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_id", "_blank", "_text", "_class", "_root", "digest", "rep"):
        df = df.withColumn(c, F.lit("q"))
    kept = near_dup.keep_one_each(df, k=5, num=80, den=100)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([rows[0], rows[3], rows[4], rows[5]], key=repr)
