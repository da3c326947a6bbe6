import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitchside.llm import decontaminate, lang_id, packing, quality, token_counts
from pitchside.llm.common import flat_bytes

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "  two  spaces ", "It's we're they'll I'd 'tis ''s !'s 'r 'l", "<|endoftext|>x<|startoftext|> <|endoftext|", "line\n\nbreak \n tab\t.",
       "École ẹ́ İstanbul ΣΣ 가가", "\x1c\x1d a\x1cb \x85 \xa0x", "日本語テキスト 12,345.67 €5", "a" * 300, "😀👍🏽 ok", "--- *** &&&",
       "x<|endoftext|>\n<|endoftext|> y", "end \n", "\nstart", "word" * 40 + "!" * 200]


def frame(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, counts string, n int").repartition(2)


def test_prefix_counts_equal_the_library_at_every_prefix():
    c, lib = token_counts.PrefixCounter(WORD), Tokenizer.from_file(WORD)
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("abcdeth'é <|>!1\n") for _ in range(60)) for _ in range(40)]
    for t in texts:
        want = [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert c.of_text(t).tolist() == want, repr(t)


def test_prefix_counts_of_texts_that_are_not_normalised():
    c, lib = token_counts.PrefixCounter(WORD), Tokenizer.from_file(WORD)
    r = random.Random(8)
    pieces = ["e\u0301", "E\u0308", "\u0130", "ab", "\n", "x", "1", "'s", "!", "\u1100\u1161\u11a8", "\uac00\u11a8", "a\u0323\u0307", "\u0301", "\u212b", "\u0958", " ", "\u09c7\u09be", "\u2126"]
    texts = ["".join(r.choices(pieces, k=r.randrange(1, 14))) for _ in range(150)]
    texts += ["e\u0301" * 80, "x" * 60 + "e\u0301b" * 20, "!" * 70 + "\u0301e\u0301", "\u0130" * 60 + "e\u0301", ("ab" * 40 + "e\u0301") * 2]
    for t in texts:
        want = [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert c.of_text(t).tolist() == want, repr(t)


@pytest.mark.parametrize("unit", ["e\u0301", "\u0130ab\n", "\u0130", "e\u0301ab\n", "\u1100\u1161", "x\u0301"])
def test_long_texts_that_are_not_normalised_take_linear_time(unit):
    c = token_counts.PrefixCounter(WORD)
    text = unit * (1_000_000 // len(unit))
    begin = time.time()
    got = c.of_text(text)
    assert len(got) == len(text) + 1 and time.time() - begin < 30
    lib = Tokenizer.from_file(WORD)
    assert got[:201].tolist() == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(201)]


def test_prefix_counts_of_a_table(spark):
    lib = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in token_counts.prefix_counts(docs, WORD, (100, 2048)).withColumn("half", token_counts.tokens_at("counts", 50)).collect()} if docs.count() else {}
    for r in docs.collect():
        n = [len(lib.encode(r.text[:i], add_special_tokens=False).ids) for i in (50, len(r.text))]
        g = got[r.doc_id]
        assert (g.counts[-1], g.n_bytes) == (n[1], len(r.text.encode()))
        if len(r.text) >= 50:
            assert g.half == n[0]
        assert g.counts[g.fits[0]] <= 100 and max(i for i, c in enumerate(g.counts) if c <= 100) == g.fits[0]


def test_prefix_counts_edge_cases(spark):
    got = token_counts.prefix_counts(frame(spark, [None, "", "a b", "a b"]), WORD).orderBy("doc_id").collect()
    assert [list(r.counts) for r in got] == [[0], [0], [0, 1, 1, 2], [0, 1, 1, 2]]
    assert token_counts.prefix_counts(frame(spark, []), WORD).count() == 0


def test_encoder_equals_the_library(monkeypatch):
    enc, lib = packing.Encoder(BYTE), Tokenizer.from_file(BYTE)
    r = random.Random(4)
    texts = ODD + ["".join(r.choice("ab the.\n\t é<|endoftext|>'s1\x1c\x85\u3000") for _ in range(80)) for _ in range(300)] + ["a" * 5000, " " * 5000 + "x", "é" * 3000]
    for long in (packing.LONG, 100):
        monkeypatch.setattr(packing, "LONG", long)
        for t in texts:
            assert np.frombuffer(enc.encode(t), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_key_visits_every_cell_by_steps_of_one(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = packing.hilbert_key(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_round_trip(spark):
    lib = Tokenizer.from_file(BYTE)
    texts = ODD + [None] + ["same text " * 30] * 40 + [" ".join(f"w{i}" for i in range(3000))]
    got = packing.pack(frame(spark, texts), BYTE, 64).withColumn("crc", F.crc32("ids")).collect()
    pieces, seqs = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length and r.crc == zlib.crc32(r.ids) and r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(pieces[i])
        assert [x for _, p, _ in parts for x in p] == want and {n for *_, n in parts} == {len(want)}
        assert [s for s, *_ in parts] == np.cumsum([0] + [len(p) for _, p, _ in parts[:-1]]).tolist()
    short = 0
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
        short += at < 64
    assert short <= 8  # one for each range
    assert packing.pack(frame(spark, []), BYTE).count() == 0


def test_packing_follows_the_curve_and_parts_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_TOKENS", 500)
    rows = [(i, f"text number {i} " * (1 + i % 5)) for i in range(300)] + [(None, "one copy of many")] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = packing.pack(docs, BYTE, 64).collect()
    along = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert [r.hkey for r in along] == sorted(r.hkey for r in got)  # neighbours on the curve are neighbours in the sequences
    ranges = {r.sequence_id >> 40 for r in got if r.doc_id is None}
    assert len(ranges) > 1 and sum(r.length for r in got if r.doc_id is None) == 700 * next(r.doc_tokens for r in got if r.doc_id is None)


def plain_score(text, table, bias):
    """A text's score from its features one by one: the mean of the learned values of all its words and n-grams."""
    raw, off = flat_bytes(pa.array([text]))
    bucket, _ = quality.features(raw, off)
    z = sum(float(table[b]) for b in bucket) / max(len(bucket), 1) + bias
    return 1 / (1 + np.exp(-z))


def test_quality_scores_equal_a_plain_scorer(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    want = {r.doc_id: plain_score(r.text or "", *model) for r in docs.collect()}
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-4
    one = spark.createDataFrame([(1, "good words here"), (2, "good words here " * 3000)], "doc_id long, text string")
    assert {r.doc_id: r.score for r in quality.score(one, model).collect()}[2] == pytest.approx(plain_score("good words here " * 3000, *model), abs=1e-4)


def test_quality_learns_from_a_bounded_sample(spark, monkeypatch):
    """Labels without a document leave room for the others; one id with many texts, or long texts, do not flood the driver."""
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda rows, *a: seen.append(rows) or train(rows, *a))
    docs = [(i, f"fine words number {i % 7} " * 3 if i % 2 else "zz qq 00 xx " * 3) for i in range(40)] + [(4, f"text {i} of one id") for i in range(500)] + [(8, "long " * 200_000), (8, None)]
    labels = [(i, i % 2) for i in range(40)] + [(10_000 + i, 1) for i in range(3000)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 20_000)
    table, _ = quality.fit(docs, labels, sample=60)
    assert table.any() and 0 < len(seen[0]) <= 60 and {y for y, *_ in seen[0]} == {0, 1}
    assert sum(len(b) for _, b, _ in seen[0]) < 60_000


def test_quality_separates_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9, auc
    assert np.mean([r.predicted for r in got if r.quality == 1]) > 0.9


def test_quality_edge_cases(spark):
    docs = frame(spark, [None, "", "good words", "good words", "x" * 100_000])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (2, 1), (99, 0), (None, 1), (3, None), (2, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, one).orderBy("doc_id").collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and got[2].score == got[3].score
    assert quality.keep_good(docs, one, 0.0).columns == docs.columns
    assert quality.quality_scores(frame(spark, []), one).count() == 0


def test_held_out_rule(spark):
    rows = [(i,) for i in range(50)] + [(None,)]
    for r in spark.createDataFrame(rows, "doc_id long").select("doc_id", quality.held_out().alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    lengths = [1, 5, 0, 7, 3]
    first = np.cumsum([0] + lengths)
    e, trans = r.normal(size=(first[-1], 3)), r.normal(size=(3, 3))
    got = lang_id.marginals(e, first, trans, block=2)
    import itertools
    for s, n in zip(first, lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            # the first position is entered from an even start
            p = np.exp(sum(e[s + i, x] for i, x in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            p *= np.exp(trans[:, path[0]]).sum() if n else 1
            for i, x in enumerate(path):
                want[i, x] += p
        if n:
            np.testing.assert_allclose(got[s:s + n], want / want.sum(axis=1, keepdims=True), rtol=1e-8)


def test_languages_held_out_and_switches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(docs)
    got = lang_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(quality.held_out()).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    text = {r.lang: " ".join(r.text.split()[:30]) for r in docs.where("n_chars > 600").where(~quality.held_out()).collect()}
    mixed = text["en"] + " " + text["fr"] + " " + text["en"]
    spans = lang_id.word_labels(frame(spark, [mixed, None, "1 2"]), model).orderBy("doc_id").collect()
    size = {}
    for s in spans[0].spans:
        size[s.lang] = size.get(s.lang, 0) + s.stop - s.start if hasattr(s, "stop") else size.get(s.lang, 0) + s.end - s.start
    assert size["fr"] > 0.7 * len(text["fr"].encode()) and size["en"] > 1.4 * len(text["en"].encode())
    assert len(spans[1].spans) == 0


def test_languages_edge_cases(spark):
    rows = [(i, "the and of words here", "en") for i in range(12)] + [(20 + i, "le la de et mots", "fr") for i in range(12)]
    rows += [(40, None, "en"), (41, "", "fr"), (42, "12 34 !!", "en"), (43, "²", None), (44, "the of " * 20_000, None), (None, "le la de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lang_id.languages(docs).collect()}
    assert [got[i].lang_pred for i in (0, 20, 40, 41, 42, 43, 44, None)] == ["en", "fr", "und", "und", "und", "und", "en", "fr"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[40].score == 0
    assert sorted(r.doc_id for r in lang_id.keep_known(docs).where("doc_id >= 40").collect()) == [44]
    assert {r.lang_pred for r in lang_id.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_id.languages(docs.where("false")).count() == 0


ITEM = "If a farmer named Mary Jones has 12 apples and gives 5 apples to her friend Tom on Monday, how many apples does Mary Jones keep for the long winter?"


def test_reparameterised_item_is_found_and_clean_text_is_not(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short one here"), (3, None), (4, "")], "item_id long, text string")
    other = ITEM.replace("Mary Jones", "Ann").replace("12", "340").replace("Tom", "Bob Lee").replace("Monday", "Friday")
    mixed = ITEM.replace("Mary Jones", "Ann", 1)  # the same slot twice with two values
    texts = ["some words before. " + ITEM + " and after", "prefix " + other, mixed, "nothing to see here at all, really", None, "", "a short one here it is",
             "If a farmer has land then how many apples does he keep for the long winter?", ITEM.upper(), "x " * 50_000 + ITEM]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert {(0, 1), (1, 1), (6, 2), (9, 1)} <= set(got)
    assert not [k for k in got if k[0] in (2, 3, 4, 5, 7)]
    assert got[0, 1].n_changed == 0 and got[1, 1].n_changed >= 4
    kept = decontaminate.keep_clean(frame(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(10)) - {k[0] for k in got})
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, texts), bench.where("false")).count() == 0


def test_planted_items_of_the_table(spark):
    """Brute force: documents that hold a whole item as a substring are found; those without 8 words of one in a row are not."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    runs = {}
    for i, t in items:
        w = t.lower().split()
        for x in range(len(w) - 7):
            runs.setdefault(tuple(w[x:x + 8]), set()).add(i)
    whole, near = set(), set()
    for r in docs.collect():
        whole |= {(r.doc_id, i) for i, t in items if t in r.text}
        w = r.text.lower().split()
        near |= {(r.doc_id, i) for x in range(len(w) - 7) for i in runs.get(tuple(w[x:x + 8]), ())}
    assert whole <= got <= near and whole


def found(spark, texts, item, **least):
    """Numbers of the texts that are contaminated by the item."""
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r.doc_id for r in decontaminate.contaminated(frame(spark, texts), bench, **least).collect()}


def test_rows_are_judged_by_their_own_text(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, "What is the third planet that people can see from the old tower at night?"), (None, None)], "item_id long, text string")
    rows = [(None, "x " + ITEM), (None, "clean words only"), (None, None), (7, ITEM + " end"), (7, "another clean text"), (7, ITEM + " end"), (8, "clean words only"), (None, "clean words only"),
            (9, ITEM[:70]), (9, ITEM[70:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("_bad", "_id", "_digest", "digest", "item_id", "hash"):
        docs = docs.withColumn(c, F.lit(1))
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    halves = {r.doc_id for r in decontaminate.contaminated(docs.where("doc_id = 9"), bench).collect()}
    want = [r for r in rows if not (r[1] and ITEM in r[1]) and r[0] not in halves]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.doc_id == 7) == [(7, 1)] and sum(r.doc_id is None for r in got) == 1


def test_other_blanks_dashes_and_quotes_do_not_hide_a_copy(spark):
    words = ITEM.split()
    copies = [ITEM.replace(" ", "\u00a0"), ITEM.replace(" ", "\u2009"), ITEM.replace(" ", " \u2014 ", 6), ITEM.replace(" ", "-"), ITEM.replace(" ", "\u2013"),
              " ".join(f"\u201c{w}\u201d" if i % 4 == 0 else w for i, w in enumerate(words)), ITEM.replace(" ", "\u3000"), ITEM.replace("farmer", "\u00abfarmer\u00bb")]
    assert found(spark, copies, ITEM) == set(range(len(copies)))
    assert found(spark, ["caf\u00e9 \u00c2 \u20ac \u4e2d\u6587 " * 30, "\u00a0\u2014" * 40], ITEM) == set()


def test_items_in_another_letter_case_are_found(spark):
    copies = [ITEM.upper(), ITEM.lower(), ITEM.title(), "Some words. " + ITEM.upper() + " And Bob went to Paris.",
              " ".join(w if w in ("a", "to", "on", "for", "the") else w.capitalize() for w in ITEM.split())]
    assert found(spark, copies, ITEM) == {0, 1, 2, 3, 4}
    accents = "Élan près du château où naquit Émile, son ami Żółw écrit ẹ̀kọ́ à Ọ̀yọ́ pendant que нос Ивана краснеет"
    assert found(spark, [accents.upper(), accents.lower()], accents) == {0, 1}
    small = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id IN (6420, 8376, 1699)")
    got = decontaminate.contaminated(small, spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet"))
    assert {(6420, 37), (8376, 101), (1699, 130)} <= {(r.doc_id, r.item_id) for r in got.collect()}


def test_edited_items_are_found(spark):
    w = ITEM.split()
    n = len(w)

    def put(*at):
        return " ".join(x for i, word in enumerate(w) for x in (["really", word] if i in at else [word]))

    def other(*at):
        return " ".join("really" if i in at else word for i, word in enumerate(w))

    copies = [put(n // 2), put(n // 3, 2 * n // 3), put(n // 4, n // 2, 3 * n // 4), " ".join(w[:n // 2 - 1] + w[n // 2:]),
              other(13), other(9, 19), ITEM.replace("12 apples", "12apples").replace("5 apples", "5-apples"), "x y z " * 20 + put(n // 2) + " x" * 30]
    assert found(spark, copies, ITEM) == set(range(len(copies)))
    short = "a brown dog and seven old cats sleep near that warm stove until early spring"
    assert found(spark, [short.replace("sleep", "rest"), short.replace("cats", "cats often"), short.replace("brown ", ""), "that warm stove and seven dogs"], short) == {0, 1, 2}


def test_repeated_frames_of_an_item_do_not_hide_a_copy_or_make_one(spark):
    item = " ".join(f"then {a} of the {b} boxes went to the old red barn." for a, b in ((3, 5), (7, 9), (2, 8), (11, 4)))
    assert found(spark, [item, "so " + item.replace("7 of", "7 more of")], item) == {0, 1}
    assert found(spark, ["then 3 of the 5 boxes went to the old red barn"], item) == set()


def test_names_that_begin_sentences_may_be_others(spark):
    item = "Alice has 5 apples. Bob has 7 apples. Carol has 9 apples. How many apples do they have?"
    other = item.replace("Alice", "Dora").replace("Bob", "Eve Smith").replace("Carol", "Zoë").replace("5", "15")
    assert found(spark, [other, "Now read this: " + other, item, "How many pears do they have?"], item) == {0, 1, 2}
    twice = "Alice has 5 apples. Bob gives Alice 7 apples and keeps 2 pears. Alice eats all of the pears that Bob kept."
    assert found(spark, [twice.replace("Alice", "Dora").replace("Bob", "Eve")], twice) == {0}


def test_a_conflict_takes_away_only_its_windows(spark):
    long = " and then the old farmer walks slowly down to the river where all the boats lie waiting for the evening tide"
    item = "She buys 2 apples and 2 pears at the market" + long
    assert found(spark, [item.replace("2 apples and 2", "3 apples and 5"), item.replace("2 apples", "3 apples"), item], item) == {0, 1, 2}
    named = "Yesterday Mary Jones sang and Mary Jones danced" + long
    assert found(spark, [named.replace("Mary Jones", "Ann", 1)], named) == {0}
    assert found(spark, ["We saw 3 apples and 5 pears at the market"], "We saw 2 apples and 2 pears at the market") == set()


def test_quality_keeps_all_when_nothing_could_be_learned(spark):
    docs = frame(spark, ["good words", None, "other words", "more"])
    held = [i for i in range(4) if zlib.crc32(str(i).encode()) % 4 == 2] + [i for i in range(4, 50) if zlib.crc32(str(i).encode()) % 4 == 2]
    for rows in ([], [(0, None), (2, None)], [(i, i % 2) for i in held], [(0, 1), (2, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert sorted(r.doc_id for r in quality.keep_good(docs, labels).collect()) == [0, 1, 2, 3]


def test_training_texts_are_cut_before_they_reach_the_driver(spark, monkeypatch):
    text = " ".join(f"mot{i}é" for i in range(30_000)).encode()
    for most in (256, 5000, 70_000):
        got = lang_id.passages(text, most)
        at = [int(w[3:-2]) for w in got.split()]
        assert most // 2 < len(got) <= most and at == sorted(at) and set(got.split()) <= set(text.split())
        assert most < 70_000 or at[-1] - at[0] > 10_000  # from the whole text
    assert lang_id.passages(text, len(text)) == text and 0 < len(lang_id.passages("é".encode() * 9000, 999)) <= 999
    seen = []
    monkeypatch.setattr(lang_id, "SAMPLE_BYTES", 20_000)
    monkeypatch.setattr(lang_id, "train", lambda texts: seen.extend(texts))
    rows = [(i, "the and of words here " * 5000, "en") for i in range(20)] + [(30, "le la de", "fr"), (None, "x", "fr"), (32, None, "fr")]
    lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sum(len(x) for _, x in seen) <= 20_000 and {y for y, _ in seen} == {"en", "fr"}


def test_windows_of_a_text_read_each_token_once(monkeypatch):
    """The text of a token behind a placeholder is taken once for all windows that hold it; windows and slots stay as they were."""
    import pyarrow as pa
    from types import SimpleNamespace
    from pitchside.llm import decontaminate as dc
    run = {}
    frame = SimpleNamespace(schema={"item_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}, mapInArrow=lambda f, _: run.setdefault("f", f))
    frame.select = lambda *_: frame
    dc._windows(frame, "item_id", None)
    calls, text = [], dc.Tokens.text
    monkeypatch.setattr(dc.Tokens, "text", lambda self, i: calls.append((self.form, i)) or text(self, i))
    batch = pa.RecordBatch.from_pydict({"item_id": [1, 1, 2, 3], "text": ["one cat saw Paris and 12 old dogs near my red house"] * 2 + ["", None]})
    got = [r for b in run["f"](iter([batch])) for r in b.to_pylist()]
    assert {r["item_id"] for r in got} == {1} and {r["size"] for r in got} == {4, 8}
    first = next(r for r in got if r["form"] == dc.INSIDE and r["size"] == 8 and r["pos"] == 0)
    assert first["slots"] == [{"at": 0, "kind": "number", "value": "one"}, {"at": 3, "kind": "name", "value": "paris"}, {"at": 5, "kind": "number", "value": "12"}]
    assert len({(r["form"], r["size"], r["pos"]) for r in got}) == len(got)
    assert any(r["slots"] == [] for r in got) and len(calls) <= 2 * len(set(calls))
