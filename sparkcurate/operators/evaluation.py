"""Model evaluation from score tables: every metric is an aggregate per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.operators import calibration as C
from sparkcurate.operators.ranking import prefix_scan
from sparkcurate.session import cut


def confusion_counts(preds: DataFrame) -> DataFrame:
    """``model, label_idx, pred, n`` for the combinations that occur."""
    return preds.groupBy("model", "label_idx", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """Dense matrix over the union of labels seen in truth or prediction, per model."""
    counts = confusion_counts(preds)
    seen = (
        counts.select("model", F.explode(F.array("label_idx", "pred")).alias("c"))
        .groupBy("model")
        .agg(F.collect_set("c").alias("classes"))
    )
    # A row per pair of class numbers: the size of the matrix itself, not of the data.
    cells = seen.select("model", F.explode("classes").alias("label_idx"), "classes").select(
        "model", "label_idx", F.explode("classes").alias("pred")
    )
    return cells.join(counts, ["model", "label_idx", "pred"], "left").fillna(0, ["n"])


def per_class(preds: DataFrame) -> DataFrame:
    """``model, class, support, predicted, hits, precision, recall, f1``; 0 on zero division."""
    return per_class_of_counts(confusion_counts(preds))


def per_class_of_counts(counts: DataFrame) -> DataFrame:
    sides = counts.select(
        "model",
        "n",
        F.explode(
            F.array(
                F.struct(
                    F.col("label_idx").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("label_idx") == F.col("pred"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("pred").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        ).alias("s"),
    )
    sums = sides.groupBy("model", F.col("s.class").alias("class")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")]
    )
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return sums.select(
        "model",
        "class",
        "support",
        "predicted",
        "hits",
        share(hits, predicted).alias("precision"),
        share(hits, support).alias("recall"),
        share(2 * hits, support + predicted).alias("f1"),
    )


def headline(preds: DataFrame) -> DataFrame:
    """``model, n, accuracy, balanced_accuracy, precision_macro, recall_macro, f1_macro``.

    Balanced accuracy averages over classes present in the truth, the macro scores over classes
    present in truth or prediction.
    """
    return headline_of_counts(confusion_counts(preds))


def headline_of_counts(counts: DataFrame) -> DataFrame:
    return per_class_of_counts(counts).groupBy("model").agg(
        F.sum("support").alias("n"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def roc_auc(scored: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """``model, roc_auc`` from ``model, label_idx (0/1), score``: exact, ties averaged, null
    unless both classes occur.

    Equal scores are added up first. How many negatives lie below each score comes from a
    prefix scan over score ranges, so a model with most of the rows is still spread out.
    """
    grouped = scored.groupBy("model", "score").agg(
        F.count(F.when(F.col("label_idx") == 1, 1)).alias("pos"),
        F.count(F.when(F.col("label_idx") == 0, 1)).alias("neg"),
    )
    below = prefix_scan(grouped, ["model"], ["score"], {"neg_below": ("sum", F.col("neg"))}, n_buckets)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return below.groupBy("model").agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def model_comparison(scores: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """One line per model: headline metrics, AUC (two-class tasks), ECE, mean confidence,
    temperature, and ``rank`` by macro F1."""
    known = scores.withColumn("temperature", F.lit(1.0)) if fitted is None else C.with_temperature(
        scores, fitted
    )
    preds = C.predictions(known, F.col("temperature"))
    two_class = preds.filter(F.size("probs") == 2).select(
        "model", "label_idx", F.col("probs")[1].alias("score")
    )
    summary = cut(C.score_summary(preds))
    models = known.groupBy("model").agg(F.first("temperature").alias("temperature"))
    table = (
        headline_of_counts(summary)
        .join(roc_auc(two_class), "model", "left")
        .join(C.error_of_summary(summary), "model")
        .join(models, "model")
    )
    return rank_models(table)


def rank_models(table: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Adds ``rank`` by falling metric; one row per model, so one window is enough."""
    return table.withColumn(
        "rank", F.row_number().over(W.orderBy(F.col(metric).desc(), F.col("model")))
    )


def select_model(scores: DataFrame) -> DataFrame:
    """The model with the best macro F1 on these (validation) scores."""
    return rank_models(headline(C.predictions(scores))).filter("rank = 1").drop("rank")


def fn_fp_ranking(preds: DataFrame, positive: int = 1) -> DataFrame:
    """Models by rising number of missed positives, then of false alarms."""
    truth, guess = F.col("label_idx") == positive, F.col("pred") == positive
    counts = preds.groupBy("model").agg(
        F.count(F.when(truth & ~guess, 1)).alias("false_negatives"),
        F.count(F.when(~truth & guess, 1)).alias("false_positives"),
    )
    order = W.orderBy("false_negatives", "false_positives", "model")
    return counts.withColumn("rank", F.row_number().over(order))


def smoothed_loss(scores: DataFrame, weights: DataFrame, n_classes: int,
                  smoothing: float = K.LABEL_SMOOTHING) -> DataFrame:
    """``model, loss``: class-weighted, label-smoothed cross entropy, averaged by weight.

    ``weights`` has ``label_idx, weight``; a class without a row weighs 0. The weight of every class
    enters the smoothed part with that class, the weight of the true class normalises.
    """
    from sparkcurate.functions import scores as S
    from sparkcurate.functions.let import let

    known = dict(weights.filter(F.col("label_idx").between(0, n_classes - 1)).select("label_idx", "weight").collect())
    w = F.array(*[F.lit(float(known.get(k, 0.0))) for k in range(n_classes)])
    label = F.col("label_idx")

    def row_loss(logp: Column) -> Column:
        own = -F.element_at(w, label + 1) * F.element_at(logp, label + 1)
        spread = -S.total(F.zip_with(w, logp, lambda a, p: a * p))
        return (1.0 - smoothing) * own + (smoothing / n_classes) * spread

    rows = scores.select(
        "model",
        let(S.log_softmax(F.col("logits")), row_loss).alias("loss"),
        F.element_at(w, label + 1).alias("weight"),
    )
    return rows.groupBy("model").agg((F.sum("loss") / F.sum("weight")).alias("loss"))


def epoch_metrics(batches: DataFrame) -> DataFrame:
    """``model, epoch, loss, accuracy`` from per-batch ``loss, n, n_correct``."""
    return batches.groupBy("model", "epoch").agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"),
        (F.sum("n_correct") / F.sum("n")).alias("accuracy"),
    )


def hit_mark(truth: Column, answer: Column) -> Column:
    """hit, miss, or n/a: a leaf without a diagnosis is neither right nor wrong."""
    return (
        F.when(truth == "nao_folha", F.when(answer == "not_a_leaf", "hit").otherwise("miss"))
        .when(answer.isin(*K.LABELS), F.when(answer == truth, "hit").otherwise("miss"))
        .otherwise("n/a")
    )


def field_confusion(rows: DataFrame) -> DataFrame:
    """3x4 table: truth by answer."""
    pivoted = rows.groupBy("truth").pivot("answer", list(K.FIELD_ANSWERS)).agg(F.count(F.lit(1)))
    domain = rows.sparkSession.createDataFrame([(t,) for t in K.FIELD_TRUTHS], "truth string")
    return domain.join(pivoted, "truth", "left").fillna(0)


def field_report(rows: DataFrame) -> DataFrame:
    """One line over ``truth, answer``: accuracies over decided leaves, rates over all rows."""
    truth, answer = F.col("truth"), F.col("answer")
    leaf = truth.isin(*K.LABELS)
    decided = leaf & answer.isin(*K.LABELS)

    def n(condition):
        return F.count(F.when(condition, 1))

    sums = rows.agg(
        F.count(F.lit(1)).alias("total"),
        n(decided).alias("decided"),
        n(leaf & (answer == "inconclusive")).alias("abstained"),
        n(leaf & (answer == "not_a_leaf")).alias("rejected_leaves"),
        n(decided & (truth == answer)).alias("correct"),
        *[n(decided & (truth == t)).alias(f"decided_{t}") for t in K.LABELS],
        *[n(decided & (truth == t) & (answer == t)).alias(f"correct_{t}") for t in K.LABELS],
        n(~leaf).alias("non_leaves"),
        n(~leaf & (answer == "not_a_leaf")).alias("non_leaves_rejected"),
        n(~leaf & answer.isin(*K.LABELS)).alias("non_leaves_diagnosed"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    recalls = F.array_compact(F.array(*[share(f"correct_{t}", f"decided_{t}") for t in K.LABELS]))
    return sums.withColumn("accuracy", share("correct", "decided")).withColumn(
        "balanced_accuracy",
        F.when(
            F.size(recalls) > 0,
            F.aggregate(recalls, F.lit(0.0), lambda acc, x: acc + x) / F.size(recalls),
        ).otherwise(0.0),
    ).withColumn("abstention_rate", share("abstained", "total")).withColumn(
        "leaf_rejection_rate", share("rejected_leaves", "total")
    )


def domain_gap(in_domain: DataFrame, field: DataFrame) -> DataFrame:
    """In-domain minus field balanced accuracy, per model."""
    a = in_domain.select("model", F.col("balanced_accuracy").alias("in_domain"))
    b = field.select("model", F.col("balanced_accuracy").alias("field"))
    return a.join(b, "model").withColumn("gap", F.col("in_domain") - F.col("field"))
