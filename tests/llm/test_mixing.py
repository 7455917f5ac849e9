"""Weighted mixing: SQL on edge cases, targets by repeated sharing, shares near their targets."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkcurate.llm import mixing as M


def shared_out(sizes, weights=(5, 2, 1), limit=3):
    """Targets by sharing what is over until no source is above its limit."""
    left, open_, target = sum(sizes), dict(enumerate(sizes)), {}
    while open_:
        total = sum(weights[i % 3] for i in open_)
        over = {i: s for i, s in open_.items() if left * weights[i % 3] / total > limit * s}
        if not over:
            return {**target, **{i: left * weights[i % 3] / total for i in open_}}
        for i, s in over.items():
            target[i] = limit * s
            left -= limit * s
            del open_[i]
    return target


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [1, 1, 1, 5000], [0, 7], [100] * 7, [1, 50, 2, 800, 3, 9, 4]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(rows).collect()}
    assert got == {f"s{i}": pytest.approx(t) for i, t in shared_out(sizes).items()}


def test_sql_on_edges(spark, edges, none, tmp_path):
    edges.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(M.ORACLE.replace("ORDER BY draw)", "ORDER BY draw ROWS UNBOUNDED PRECEDING)")).fetchall()
    got = [tuple(r) for r in M.mix(edges).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert M.mix(none).count() == 0 and M.remix(none).columns == none.columns


def test_shares_and_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken = M.mix(docs)
    for r in taken.groupBy("target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect():
        sources = taken.filter(F.col("target") == r.target).select("source_size").distinct().count()
        assert abs(r.t / sources - r.target) <= 2 * r.m
    assert taken.filter("taken > 3 * size").count() == 0
    repeated = M.remix(docs)
    counted = repeated.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    assert taken.join(counted, "doc_id", "left").filter("coalesce(k, 0) * size <> taken").count() == 0
