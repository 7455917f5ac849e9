"""Split sizes, group integrity, audit numbers, samples, replacement."""

import pytest
from pyspark.sql import functions as F

from sparkcurate.operators import audit as AU
from sparkcurate.operators import balance as B
from sparkcurate.operators import splitting as SP

SIZES = {1: (0, 0, 1), 2: (0, 1, 1), 3: (1, 1, 1), 7: (5, 1, 1), 10: (6, 2, 2), 30: (21, 4, 5), 50: (34, 8, 8)}
ROW_SIZES = {1: (0, 0, 1), 2: (0, 1, 1), 3: (1, 1, 1), 7: (5, 1, 1), 10: (8, 1, 1), 30: (22, 4, 4), 50: (36, 7, 7)}


def per_split(df):
    out = {}
    for r in df.groupBy("label").pivot("split", ["train", "val", "test"]).count().fillna(0).collect():
        out[int(r["label"])] = (r["train"], r["val"], r["test"])
    return out


def test_split_sizes(spark):
    rows = [(n * 1000 + k, f"p{n}_{k}", str(n), n * 1000 + k) for n in SIZES for k in range(n)]
    df = spark.createDataFrame(rows, "id bigint, path string, label string, group_id bigint").repartition(5)
    assert per_split(SP.group_split(df)) == SIZES
    assert per_split(SP.row_split(df)) == ROW_SIZES


def test_groups_stay_whole_and_audit_is_clean(spark):
    """100 photos x 6 copies, two labels: 83.3 % redundancy, 68/16/16 groups, nothing leaks."""
    rows = [
        (k, f"{k % 100:03d}/{k:04d}", "healthy" if k % 2 else "anomalous", k % 100, f"s{k % 3}")
        for k in range(600)
    ]
    df = spark.createDataFrame(rows, "id bigint, path string, label string, group_id bigint, source string")
    df = df.withColumn("orbit", F.array(F.col("group_id")))
    kept = SP.group_split(df, hot_rows=4).cache()
    assert kept.count() == 600
    assert kept.groupBy("group_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    groups = {r["split"]: r["n"] for r in kept.groupBy("split").agg(F.countDistinct("group_id").alias("n")).collect()}
    assert groups == {"train": 68, "val": 16, "test": 16}
    again = SP.group_split(df.repartition(9).drop("split"))
    assert {(r["id"], r["split"]) for r in again.collect()} == {(r["id"], r["split"]) for r in kept.collect()}
    report = AU.leakage_report(kept, kept).first()
    assert report["verdict"] == "OK" and report["test"]["leaked"] == 0 and report["redundancy_pct"] == 83.33
    assert report["largest_group"] == 6
    leaky = SP.row_split(df).cache()
    bad = AU.leakage_report(leaky, leaky)
    assert bad.first()["verdict"] == "GRAVE"
    n_leaked = AU.leaked_rows(leaky, hot_rows=4).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in n_leaked} == {
        s: bad.first()[s]["leaked"] for s in ("test", "val")
    }
    clean = AU.clean_test(leaky).count()
    assert clean == bad.first()["test"]["total"] - bad.first()["test"]["leaked"]
    with pytest.raises(Exception, match="still leaks"):
        AU.require_ok(bad).collect()
    assert AU.require_ok(AU.leakage_report(kept, kept)).count() == 1
    gate = AU.audit_gate(AU.leakage_report(kept, kept), kept).first()
    assert gate["passed"] and gate["warning"] is None


def test_conflicts_are_dropped(spark):
    rows = [(1, "a", "healthy", 1), (2, "b", "anomalous", 1), (3, "c", "healthy", 3)]
    df = spark.createDataFrame(rows, "id bigint, path string, label string, group_id bigint")
    assert [tuple(r) for r in AU.label_conflicts(df).collect()] == [(1, 2, 2)]
    assert [r["id"] for r in AU.drop_conflicts(df).collect()] == [3]
    assert [r["id"] for r in SP.group_split(df).collect()] == [3]


def test_report_denominators_and_empty_test(spark):
    rows = [(k, f"p{k}", "healthy", k // 2, "train" if k % 2 else "test", [k]) for k in range(8)]
    schema = "id bigint, path string, label string, group_id bigint, split string, orbit array<bigint>"
    grouped = spark.createDataFrame(rows, schema)
    corrupt = spark.createDataFrame([(k, f"q{k}", "healthy", k, "test", None) for k in range(90, 94)], schema)
    listed = grouped.unionByName(corrupt)
    report = AU.leakage_report(grouped, listed).first()
    assert (report["test"]["leaked_pct"], report["n_corrupted"]) == (50.0, 4)
    readable = AU.leakage_report(grouped, listed, denominator="readable").first()
    assert readable["test"]["leaked_pct"] == 100.0
    train = grouped.filter("split = 'train'")
    none = AU.leakage_report(train, train).first()
    assert none["test"]["total"] == 0 and none["verdict"] == "OK"


def test_samples(spark):
    rows = [(k, f"p{k:03d}", "a" if k < 150 else "b") for k in range(200)]
    df = spark.createDataFrame(rows, "id bigint, path string, label string")
    draws = SP.balanced_resample(df)
    shares = {r["label"]: r["count"] for r in draws.groupBy("label").count().collect()}
    assert sum(shares.values()) == 200 and 70 <= shares["b"] <= 130
    capped = SP.class_cap(df, 60).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in capped} == {"a": 60, "b": 50}
    indexes = [r["class_index"] for r in SP.running_index(df).filter("label = 'b'").collect()]
    assert sorted(indexes) == list(range(50))


def test_alias_table_gives_the_weights():
    from fractions import Fraction

    for weights in ([1.0], [5.0, 0.5, 3.0, 1.0, 2.25, 0.125], [1.0, 0.0, 3.0], [1e-9, 1.0, 1e9], [2.0, 2.0, 2.0]):
        table = SP.alias_table(weights)
        drawn = [Fraction(0)] * len(weights)
        for slot, (limit, other) in enumerate(table):
            drawn[slot] += Fraction(limit, SP.DRAW_RANGE)
            drawn[other] += 1 - Fraction(limit, SP.DRAW_RANGE)
        for got, w in zip(drawn, weights):
            assert abs(got / len(weights) - Fraction(w) / sum(map(Fraction, weights))) < Fraction(1, 2**30)
    for bad in ([0.0, 0.0], [-1.0, 2.0], [float("nan")], [float("inf"), 1.0]):
        with pytest.raises(ValueError):
            SP.alias_table(bad)


def test_weighted_draws(spark):
    rows = [(k, f"p{k:04d}", "abcd"[min(k // 100, 3)]) for k in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, path string, label string")
    draws = SP.balanced_resample(df, weights={"a": 6.0, "b": 3.0, "c": 0.0, "x": 9.0, "d": 1.0}).collect()
    shares = {c: sum(r["label"] == c for r in draws) / 3000 for c in "abcd"}
    assert len(draws) == 3000 and shares["c"] == 0
    assert abs(shares["a"] - 0.6) < 0.04 and abs(shares["b"] - 0.3) < 0.04 and abs(shares["d"] - 0.1) < 0.03
    assert len({r["id"] for r in draws if r["label"] == "a"}) > 95  # 1,800 draws reach nearly every row
    assert SP.balanced_resample(df, weights={"x": 1.0}).count() == 0


def test_same_class_fill_goes_round(spark):
    rows = [(0, "a", False), (1, "b", True), (2, "a", True), (3, "a", False), (4, "a", False), (5, "c", False), (6, "b", False)]
    df = spark.createDataFrame(rows, "idx bigint, label string, ok boolean").withColumn("p", F.concat(F.lit("p"), F.col("idx")))
    got = {r["idx"]: r["used"] for r in SP.same_class_fill(df, "idx", "label", "ok", "p").collect()}
    assert got == {0: "p2", 1: "p1", 2: "p2", 3: "p2", 4: "p2", 5: None, 6: "p1"}


def test_weights_alerts_and_required_cells(spark):
    rows = [("train", "healthy")] * 3 + [("train", "anomalous")] * 10 + [("val", "healthy")]
    df = spark.createDataFrame(rows, "split string, label string")
    alerts = {(r["alert"], r["split"], r["label"]) for r in B.dataset_alerts(df, min_per_class=4).collect()}
    assert alerts == {
        ("low", "train", "healthy"), ("low", "val", "healthy"), ("empty", "val", "anomalous"),
        ("empty", "test", "healthy"), ("empty", "test", "anomalous"), ("unbalanced", "train", "anomalous"),
    }
    cells = {"split": ("train", "val", "test"), "label": ("healthy", "anomalous")}
    with pytest.raises(Exception, match="test/anomalous, test/healthy, val/anomalous"):
        B.require_cells(df, cells).collect()
    big = spark.range(71052 + 139780).select(F.when(F.col("id") < 71052, "healthy").otherwise("anomalous").alias("label"))
    line = B.loss_weights(big).first()
    assert (round(line["healthy_weight"], 6), round(line["anomalous_weight"], 6)) == (1.483646, 0.754157)
    one = B.loss_weights(big.filter("label = 'healthy'")).first()
    assert tuple(one) == (1.0, 1.0, float("inf"))
