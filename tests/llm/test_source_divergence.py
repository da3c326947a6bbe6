import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pitchside.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top=10):
    """Every share of every group by the definition, without collapsing, histograms or sparse sums."""
    docs = [tuple("" if x is None else x for x in (lang, source, text)) for _, text, lang, source in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = set()
    for lang in {d[0] for d in docs}:
        counts, df = defaultdict(Counter), Counter()
        for _, source, text in (d for d in docs if d[0] == lang):
            found = TERM.findall(text.translate(low))
            counts[source].update(found)
            df.update(set(found))
        kept = [t for t in df if df[t] >= min_docs]
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)}
    return out


def corpus(seed, n, sources):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "文字", "A", "a-b", "x1y"]
    texts = [" ".join(r.choices(words, k=r.randrange(0, 30))) for _ in range(n // 2)] + [None, "", "123 ...", "HOT copy text " * 3]
    rows = []
    for i in range(n):
        text = "HOT copy text " * 3 if i % 3 == 0 else r.choice(texts)
        rows.append((i if i % 17 else None, text, r.choice(["en", "en", "de", None, ""]), r.choice(sources)))
    return rows + rows[:5]


@pytest.mark.parametrize("sources, block", [(["s1", "s2", "é", None], 256), ([f"s{i}" for i in range(11)], 3)])
def test_equals_the_definition(spark, monkeypatch, sources, block):
    monkeypatch.setattr(sd, "SOURCES", block)
    monkeypatch.setattr(sd, "HELD", 50)
    rows = corpus(3, 400, sources)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("term", "n", "z", "digest", "rank"):
        docs = docs.withColumn(c, F.lit("x"))
    got = sd.divergence(docs, min_docs=4)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4)


def test_groups_without_terms_and_single_sources(spark):
    rows = [(1, None, "en", "a"), (2, "one two", "en", "b"), (3, "x", "de", "only")] + [(4, "tie tie", "fr", s) for s in ("a", "b", "c")] * 3
    got = {tuple(r) for r in sd.divergence(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 10)
    assert ("en", "a", "pair", "b", 0, 1) in got and not any(r[0] == "de" for r in got)
    assert sd.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_text_is_cut_once(spark):
    rows = [(i, "same text", "en", f"s{i % 4}") for i in range(1000)] + [(5, "same text", "de", "s1"), (6, "other", "en", "s1")]
    got = sorted((r.lang, r.text, sorted((s.source, s.copies) for s in r.sources)) for r in sd.collapsed(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect())
    assert got == [("de", "same text", [("s1", 1)]), ("en", "other", [("s1", 1)]), ("en", "same text", [(f"s{i}", 250) for i in range(4)])]


def test_long_text(spark):
    rows = [(i, f"Word{chr(97 + i)} common " * 60_000, "en", f"s{i % 2}") for i in range(12)]
    assert {tuple(r) for r in sd.divergence(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows, 10)
