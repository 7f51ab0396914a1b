from __future__ import annotations

import brute

import corpus_pipeline
from manyfold.llm import queries
from manyfold.llm.common import written

DIR = "/root/testdata/sf0.001"


def test_stages_work_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs, _ = written(stage(spark, docs, DIR), "test-stage")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            assert docs.join(before, columns, "left_anti").isEmpty()
        if k == 2:
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            comp = brute.components(rows, 5, 80)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, c in comp.items() if i == c)
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, DIR).count() == sizes[-1]


def test_pipeline_takes_nulls_empties_and_repeats(spark, tmp_path):
    good = [(i, "the quick brown fox number " + " ".join(f"word{(i * 7 + k) % 90}" for k in range(60)), "en", "a" if i % 3 else None, i) for i in range(60)]
    odd = [(None, None, None, None, None), (100, "", "en", "a", 0), (101, None, "en", "b", 0), (None, good[3][1], "en", "a", 1), (102, " \n ", None, None, 1), good[5], good[5]]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("full", good + odd), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, columns).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert bool(out) == bool(rows) and all(r["doc_id"] not in (100, 101, 102) for r in out)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
