"""The registered queries and the pipeline, stage by stage on a small table."""

import corpus_pipeline
from sparkcurate.llm import bagminhash, decontaminate, quality
from sparkcurate.llm.queries import ORACLES, QUERIES
from sparkcurate.session import store

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "benchmark_free", "source_mix", "token_ids"
    ]


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, before, FOLDER))
        if name != "token_ids":
            assert after.columns == columns
            assert after.join(before, columns, "left_anti").count() == 0
        if name == "quality_rules":
            rows = [quality.measure_text(r.text) for r in after.collect()]
            assert rows and all(r[0] >= 50 and 100 * r[4] <= 50 * r[0] for r in rows)
        if name == "near_duplicates":
            classes = bagminhash.near_duplicates(before)
            assert after.count() == classes.select("class_id").distinct().count()
            assert bagminhash.near_duplicates(after).filter("class_size > 1").count() == 0
        if name == "benchmark_free":
            hit = decontaminate.contaminated(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).select("doc_id").distinct()
            assert after.count() == before.count() - hit.count()
        if name == "source_mix":
            assert after.groupBy("doc_id").count().filter("count > 3").count() == 0
        if name == "token_ids":
            rows = sorted(after.collect(), key=lambda r: r.start)
            assert len(rows) == before.count() and [r.doc_id for r in rows] == sorted(r.doc_id for r in before.collect())
            assert [r.start for r in rows][1:] == [r.start + r.n_tokens for r in rows][:-1]
        before = after
