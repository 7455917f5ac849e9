"""Metrics, calibration, decisions, field test, training history."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcurate.operators import balance as B
from sparkcurate.operators import calibration as C
from sparkcurate.operators import decision as D
from sparkcurate.operators import evaluation as E
from sparkcurate.operators import history as HI
from sparkcurate.plans.catalog import QUERIES

MATRICES = {
    "a": ((10461, 197, 179, 20788), (0.988111, 0.986490, 0.986692, 0.986895)),
    "b": ((10483, 175, 138, 20829), (0.990103, 0.988499, 0.988917, 0.989338)),
    "c": ((10466, 192, 215, 20752), (0.987130, 0.985866, 0.985608, 0.985352)),
    "majority": ((0, 20, 0, 80), (0.8, 0.5, 0.444444, 0.4)),
}


def test_confusion_matrix_fixtures(spark):
    rows = []
    for model, (m, _) in MATRICES.items():
        rows += [(model, t, p, n) for (t, p), n in zip(((0, 0), (0, 1), (1, 0), (1, 1)), m) if n]
    counts = spark.createDataFrame(rows, "model string, label_idx int, pred int, n bigint")
    for r in E.headline_of_counts(counts).collect():
        got = tuple(round(r[c], 6) for c in ("accuracy", "balanced_accuracy", "f1_macro", "precision_macro"))
        assert got == MATRICES[r["model"]][1]


def test_class_only_predicted_counts_in_macro_not_balanced(spark):
    preds = spark.createDataFrame([("m", 0, 0), ("m", 0, 2), ("m", 1, 1)], "model string, label_idx int, pred int")
    r = E.headline(preds).first()
    assert r["balanced_accuracy"] == pytest.approx(0.75)
    assert r["recall_macro"] == pytest.approx(0.5)
    assert E.confusion_matrix(preds).count() == 9


def test_auc(spark):
    rows = [("ties", 1, 0.5), ("ties", 0, 0.5), ("ties", 1, 0.9), ("ties", 0, 0.1), ("one", 1, 0.3), ("one", 1, 0.4)]
    df = spark.createDataFrame(rows, "model string, label_idx int, score double")
    got = {r["model"]: r["roc_auc"] for r in E.roc_auc(df, 3).collect()}
    assert got == {"ties": 0.875, "one": None}


def scores_table(spark, rows):
    return spark.createDataFrame(
        [(k, "m", "val", y, z) for k, (y, z) in enumerate(rows)],
        "id bigint, model string, split string, label_idx int, logits array<double>",
    )


def overconfident(n=800, seed=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        z = rng.gauss(0, 1.6)
        y = int(rng.random() < 1 / (1 + math.exp(-z)))
        rows.append((y, [0.0, 4.0 * z]))
    return rows


def test_temperature_recovers_scale_and_lowers_error(spark):
    df = scores_table(spark, overconfident()).cache()
    fitted = C.fit_temperature(df, split="val")
    line = fitted.first()
    assert 3.2 < line["temperature"] < 5.0 and not line["at_bound"]
    record = C.calibration_rows(df, fitted).first()
    assert record["ece_after"] < record["ece_before"] / 2
    before = C.predictions(df).select("id", "pred")
    after = C.predictions(df, line["temperature"]).select("id", F.col("pred").alias("later"))
    assert before.join(after, "id").filter("pred <> later").count() == 0
    t = line["temperature"]
    curve = {r["temperature"]: r["nll"] for r in C.nll_curve(df, [1.0, t * 0.9, t, t * 1.1]).collect()}
    assert min(curve, key=curve.get) == t
    with pytest.raises(Exception, match="calibration reads test only"):
        C.fit_temperature(df, split="test")


def test_temperature_of_noise_hits_the_bound(spark):
    line = C.fit_temperature(scores_table(spark, [(k % 2, [0.0, (1 - 2 * (k % 2)) * 3.0]) for k in range(40)])).first()
    assert line["at_bound"] and line["temperature"] == pytest.approx(1000.0)


@pytest.mark.parametrize("gap", [5, 20, 40, 80, 110])
def test_temperature_of_saturated_logits(spark, gap):
    rows = []
    for k in range(200):
        label, right = k % 2, k % 50 < 41
        logits = [0.0, 0.0]
        logits[label if right else 1 - label] = float(gap)
        rows.append((label, logits))
    line = C.fit_temperature(scores_table(spark, rows)).first()
    assert line["converged"] and not line["at_bound"]
    assert line["temperature"] == pytest.approx(gap / math.log(0.82 / 0.18), rel=0.01)


def test_threshold_and_record_read_validation_only(spark):
    df = scores_table(spark, overconfident(50)).withColumn("split", F.lit("test"))
    with pytest.raises(Exception, match="reads val only"):
        C.pick_threshold(C.predictions(df)).collect()
    with pytest.raises(Exception, match="reads val only"):
        C.calibration_rows(df, C.fit_temperature(df)).collect()


def test_weights_of_absent_classes(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "label_idx int")
    weights = {r["label_idx"]: r["weight"] for r in B.class_weights(rows, "label_idx", [0, 1, 2]).collect()}
    assert weights == {0: 0.0, 1: 0.75, 2: 1.5}
    scores = scores_table(spark, [(1, [0.0, 2.0, 1.0]), (2, [0.0, 0.0, 0.0])])
    known = E.smoothed_loss(scores, B.class_weights(rows, "label_idx"), 3).first()["loss"]
    assert known == pytest.approx(E.smoothed_loss(scores, B.class_weights(rows, "label_idx", [0, 1, 2]), 3).first()["loss"])


def test_threshold_cases(spark):
    def pick(pairs):
        df = spark.createDataFrame([("m", float(c), float(k)) for c, k in pairs], "model string, confidence double, correct double")
        r = C.pick_threshold(df).first()
        return round(r["threshold"], 4), round(r["coverage"], 4), round(r["selective_accuracy"], 4)

    assert pick([(0.99, 1)] * 19) == (0.5, 1.0, 1.0)
    assert pick([(0.9, k % 2) for k in range(100)]) == (0.5, 1.0, 0.5)
    assert pick([(0.6, 0)] * 50 + [(0.8, 1)] * 50) == (0.61, 0.5, 1.0)
    assert pick([(0.5, 1)] * 30) == (0.5, 1.0, 1.0)
    # Enough accuracy only where the support is gone.
    assert pick([(0.6, 0)] * 500 + [(0.95, 1)] * 22) == (0.5, 1.0, round(22 / 522, 4))


def test_calibration_bins(spark):
    rows = [("m", c, 1.0) for c in (0.2, 0.4, 1 / 15, 1.0)] + [("m", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "model string, confidence double, correct double")
    assert sorted(r["bin"] for r in C.reliability(df).collect()) == [1, 3, 6, 15]
    ece = C.calibration_error(df).first()["ece"]
    assert ece == pytest.approx((0.8 + 0.6 + 14 / 15 + 0) / 5)


def test_decisions(spark):
    cases = [
        (0.05, [3.0, 0.0], 0.7, "not_a_leaf"),
        (0.10, [math.log(8.0), math.log(2.0)], 0.7, "healthy"),
        (None, [math.log(3.0), math.log(7.0)], 0.7, "anomalous"),
        (0.5, [math.log(6.0), math.log(4.0)], 0.7, "inconclusive"),
        (0.5, [1.0, 1.0], 0.5, "healthy"),
    ]
    for k, (veg, z, tau, want) in enumerate(cases):
        df = spark.createDataFrame([(k, "m", z, veg)], "id int, model string, logits array<double>, vegetation_fraction double")
        calibration = spark.createDataFrame([("m", 1.0, tau)], "model string, temperature double, threshold double")
        r = D.decide(df, calibration).first()
        assert r["label"] == want
        if want == "not_a_leaf":
            assert (r["healthy_prob"], r["anomalous_prob"], r["confidence"]) == (0.0, 0.0, 0.0)
        assert (r["message"] is None) == (want in ("healthy", "anomalous"))
    default = D.decide(df, None).first()
    assert default["label"] == "inconclusive" and not default["is_temperature_scaled"]


def test_admission(spark):
    df = spark.createDataFrame([("image/png", 10), ("text/html", 10), (None, 10), ("image/bmp", 11)], "t string, n int")
    codes = [r["c"] for r in df.select(D.admission(F.col("t"), F.col("n"), 10).alias("c")).collect()]
    assert codes == [None, 415, None, 413]


def test_field_report_skips_undecided_classes(spark):
    rows = [("healthy", "healthy"), ("healthy", "anomalous"), ("anomalous", "inconclusive"), ("nao_folha", "not_a_leaf"), ("nao_folha", "healthy")]
    df = spark.createDataFrame(rows, "truth string, answer string")
    r = E.field_report(df).first()
    assert (r["decided"], r["balanced_accuracy"], r["abstention_rate"]) == (2, 0.5, 0.2)
    assert (r["non_leaves_rejected"], r["non_leaves_diagnosed"]) == (1, 1)
    marks = [x["h"] for x in df.select(E.hit_mark(F.col("truth"), F.col("answer")).alias("h")).collect()]
    assert marks == ["hit", "miss", "n/a", "hit", "miss"]


def test_early_stop(spark):
    f1 = [0.50, 0.60, 0.60, 0.55, 0.58, 0.57]
    rows = [("m", k + 1, v) for k, v in enumerate(f1)] + [("never", k, 0.1 * k) for k in range(5)]
    stopped = HI.early_stop(spark.createDataFrame(rows, "model string, epoch bigint, val_f1 double"), 3)
    got = {r["model"]: tuple(r)[1:] for r in HI.training_summary(stopped).collect()}
    assert got["m"] == (2, 0.60, 5, 5, 1)
    assert got["never"] == (4, 0.4, 4, 5, 0)


def test_history_views(spark):
    rows = [(k, f"2024-01-01 00:00:{k % 30:02d}", "mildio" if k % 2 else "other", k / 100) for k in range(60)]
    df = spark.createDataFrame(rows, "id bigint, t string, predicted_class string, confidence double").withColumn("created_at", F.to_timestamp("t"))
    page = HI.history_page(df, 3, 1).collect()
    assert [r["id"] for r in page] == [29, 58, 28]
    assert {r["predicted_label"] for r in page} == {"Míldio", "other"}
    first = HI.history_page(df, 4).collect()
    later = HI.history_page(df, 3, after=(first[0]["created_at"], first[0]["id"])).collect()
    assert [r["id"] for r in later] == [29, 58, 28]
    assert HI.dashboard(df, 10).first()["n_shown"] == 10 and HI.dashboard(df, None).first()["n_shown"] == 60
    assert HI.find_diagnosis(df, 7).count() == 1 and HI.find_diagnosis(df, 700).count() == 0
    assert HI.delete_diagnoses(df, df.filter("id < 10").select("id")).count() == 50
    with pytest.raises(ValueError):
        HI.history_page(df, 201)


def test_score_batch_with_a_function(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, features array<double>")
    got = {r["id"]: r["logits"] for r in D.score_batch_with(df, lambda x: x * 10.0, 2).collect()}
    assert got == {1: [10.0, 20.0], 2: [30.0, 40.0]}


def test_baseline_fit_is_the_optimum(spark):
    rng = np.random.default_rng(5)
    y = np.repeat([0, 1, 2], [150, 40, 10])
    x = rng.normal(size=(200, 4)) + np.eye(3, 4)[y] * 1.5
    rows = [(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, y))]
    docs = spark.createDataFrame(rows, "id long, features array<double>, label_idx int")
    weights = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 6.0)], "label_idx int, weight double")
    model = D.fit_baseline(docs, weights, max_iter=300)
    scored = D.score_batch(docs, model).orderBy("id").select("logits").collect()
    logits = np.array([r.logits for r in scored])
    w = np.array([0.5, 1.5, 6.0])[y] / np.array([0.5, 1.5, 6.0])[y].sum()
    share = np.exp(logits - logits.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    slope = (w[:, None] * (share - np.eye(3)[y])).T  # of the weighted loss
    coefficients = model.coefficientMatrix.toArray()
    spread = w @ x**2 - (w @ x) ** 2  # the penalty is on features of unit variance
    assert np.abs(slope.sum(1)).max() < 1e-3
    assert np.abs(slope @ x + 0.01 * coefficients * spread).max() < 2e-3
    hit = logits.argmax(1) == y
    assert np.mean([hit[y == k].mean() for k in range(3)]) > 0.7


def test_fit_baseline_scores_all_rows_and_says_which_were_held_out(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["fit_baseline"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert all(r.held_out == (r.id % 2 == 1) for r in rows)


def test_the_fit_is_the_optimum_and_follows_the_labels(spark, tmp_path):
    """The largest entry of the weighted gradient is zero at the coefficients, and is not once the labels of the fit are mixed up."""
    from sparkcurate.plans.catalog import FIT_CLASS

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    mixed = rows.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(10)).cast("int").alias("label"))
    mixed.write.parquet(str(tmp_path / "embeddings.parquet"))
    fit = [r for r in rows.collect() if r.vec_id % 2 == 0]
    x = np.array([[1.0, 8 * r.embedding[0], 8 * r.embedding[1]] for r in fit])
    y = np.array([float(r.label == FIT_CLASS) for r in fit])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def steepest(folder):
        got = QUERIES["fit_baseline_optimum"](spark, folder).first()
        return np.abs((weight * (y - 1 / (1 + np.exp(-x @ [got.b0, got.b1, got.b2])))) @ x).max()

    assert steepest(folder) < 1e-3 < 0.03 < steepest(str(tmp_path))
