import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from pitchside.llm import decontaminate, lang_id, quality
from pitchside.llm.common import written

from test_near_dup import brute

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    assert E.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in E.oracle_sql()
    assert {n.split("_")[0] for n in E.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "language":
            want = {r.doc_id for r in lang_id.languages(docs).collect() if r.lang_pred != "und" and r.score >= 0.5}
        elif name == "quality":
            want = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
        elif name == "near_duplicates":
            want = {i for i, n, c in brute([(i, rows[i].text) for i in kept], 5, 80, 100) if i == c}
        else:
            want = kept - {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
            whole = {i for i in kept if any(b.text in rows[i].text for b in bench.collect())}
            assert not whole & want
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        got = docs.collect()
        kept = {r.doc_id for r in got}
        assert len(got) == len(kept) and kept == want, name
        assert all(r == rows[r.doc_id] for r in got)
    assert kept
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, SF).collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {i: len(lib.encode(rows[i].text, add_special_tokens=False).ids) + 1 for i in kept}


def test_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the and of " * 20, "en", None, 5),
                                 (3, "the and of words " * 30, "en", "s", 9), (3, "the and of words " * 30, "en", "s", 9)], schema)
    for docs in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
