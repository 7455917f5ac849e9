"""Calibration: error, reliability, temperature and the abstention threshold.

``scores`` carries ``id, model, split, label_idx INT, logits ARRAY<DOUBLE>``. Every report is one
aggregate per model; no score table is ever ordered or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.functions import scores as S
from sparkcurate.functions.let import let
from sparkcurate.operators.skew import small_side
from sparkcurate.session import store


def predictions(scores: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """Adds ``probs, pred, confidence, correct``."""
    return (
        scores.withColumn("probs", S.softmax(F.col("logits"), temperature))
        .withColumn("pred", S.argmax(F.col("logits")))
        .withColumn("confidence", F.array_max("probs"))
        .withColumn("correct", (F.col("pred") == F.col("label_idx")).cast("double"))
    )


def _require_split(scores: DataFrame, split: str) -> DataFrame:
    """Calibration may look at one split only; rows of any other stop the job. The check sits on
    the label, which every fit reads, so no plan can drop it."""
    stop = F.raise_error(F.concat(F.lit(f"calibration reads {split} only, found "), F.col("split")))
    guarded = F.when(F.col("split") == split, F.col("label_idx")).otherwise(stop.cast("int"))
    return scores.withColumn("label_idx", guarded)


def reliability(preds: DataFrame, n_bins: int = K.N_CALIBRATION_BINS) -> DataFrame:
    """Per model and non-empty bin: ``bin, center, n, accuracy, mean_confidence``."""
    return (
        preds.withColumn("bin", S.confidence_bin(F.col("confidence"), n_bins))
        .filter("bin is not null")
        .groupBy("model", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("correct").alias("accuracy"),
            F.avg("confidence").alias("mean_confidence"),
        )
        .withColumn("center", (F.col("bin") - 0.5) / n_bins)
    )


def score_summary(
    preds: DataFrame, n_bins: int = K.N_CALIBRATION_BINS, extra: list[str] | None = None
) -> DataFrame:
    """``model, label_idx, pred, bin, n, sum_confidence``, by the columns ``extra`` too: all that the confusion, calibration
    and confidence reports need, from one pass; classes x classes x bins lines per model."""
    return (
        preds.withColumn("bin", S.confidence_bin(F.col("confidence"), n_bins))
        .groupBy("model", "label_idx", "pred", "bin", *(extra or []))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("sum_confidence"))
    )


def calibration_error(preds: DataFrame, n_bins: int = K.N_CALIBRATION_BINS) -> DataFrame:
    """``model, ece``: mean absolute gap between accuracy and confidence, weighted by bin."""
    bins = preds.withColumn("bin", S.confidence_bin(F.col("confidence"), n_bins)).groupBy(
        "model", "bin"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").alias("right"),
        F.sum("confidence").alias("sum_confidence"),
    )
    return _error_of_bins(bins)


def _error_of_bins(bins: DataFrame) -> DataFrame:
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("right") - F.col("sum_confidence")))
    return bins.groupBy("model").agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"))


def error_of_summary(summary: DataFrame) -> DataFrame:
    """``model, ece, mean_confidence`` from a score summary."""
    right = F.sum(F.when(F.col("label_idx") == F.col("pred"), F.col("n")).otherwise(0))
    bins = summary.groupBy("model", "bin").agg(
        F.sum("n").alias("n"), right.alias("right"), F.sum("sum_confidence").alias("sum_confidence")
    )
    means = summary.groupBy("model").agg(
        (F.sum("sum_confidence") / F.sum("n")).alias("mean_confidence")
    )
    return _error_of_bins(bins).join(means, "model")


def mean_confidence(preds: DataFrame) -> DataFrame:
    return preds.groupBy("model").agg(
        F.avg("confidence").alias("mean_confidence"), F.avg("correct").alias("accuracy")
    )


def nll_curve(scores: DataFrame, temperatures: list[float]) -> DataFrame:
    """``model, temperature, nll``: mean negative log-likelihood on a grid of temperatures, all
    of them in one pass over the scores."""
    sums = [
        F.avg(S.neg_log_likelihood(F.col("logits"), F.col("label_idx"), t)).alias(f"_{k}")
        for k, t in enumerate(temperatures)
    ]
    wide = scores.groupBy("model").agg(*sums)
    cells = [
        F.struct(F.lit(float(t)).alias("temperature"), F.col(f"_{k}").alias("nll"))
        for k, t in enumerate(temperatures)
    ]
    return wide.select("model", F.explode(F.array(*cells)).alias("c")).select("model", "c.*")


MIN_BETA, MAX_BETA = 1e-3, 1e3


def newton_step_terms(logits: Column, label: Column, beta: Column) -> Column:
    """``struct<g, h>`` of one row: slope and curvature of its NLL in beta = 1 / temperature."""

    def from_probs(p: Column) -> Column:
        zipped = F.zip_with(p, logits, lambda a, z: a * z)
        return let(
            S.total(zipped),
            lambda mean: F.struct(
                (mean - F.element_at(logits, label + 1)).alias("g"),
                S.total(F.zip_with(p, logits, lambda a, z: a * (z - mean) * (z - mean))).alias("h"),
            ),
        )

    return let(S.softmax(logits, 1.0 / beta), from_probs)


def fit_temperature(scores: DataFrame, tolerance: float = 1e-9, split: str | None = None) -> DataFrame:
    """``model, temperature, steps, at_bound, converged``: the T > 0 with the smallest mean NLL.

    The NLL is convex in beta = 1 / T, so its slope has one zero. Each step is one aggregate per model
    that returns slope and curvature; the sign of the slope narrows a bracket around the zero, and
    the next beta is Newton's where it falls inside, else the bracket's geometric middle, so
    saturated scores without usable curvature are halved down to their optimum. It ends when the
    bracket, or Newton's step, is within ``tolerance``, which is always reached. Scores that carry
    no signal push beta to its bound, which ``at_bound`` reports. Betas travel as a table of a row per
    model; ``split`` stops the job at rows of any other split.
    """
    if split:
        scores = _require_split(scores, split)
    spark = scores.sparkSession
    rows = scores.select("model", "label_idx", "logits").persist()
    try:
        state = {r["model"]: [MIN_BETA, MAX_BETA, 1.0] for r in rows.select("model").distinct().collect()}
        steps, done = dict.fromkeys(state, 0), {}
        while len(done) < len(state):
            table = [(m, beta) for m, (_, _, beta) in sorted(state.items()) if m not in done]
            betas = small_side(spark.createDataFrame(table, "model string, beta double"))
            terms = newton_step_terms(F.col("logits"), F.col("label_idx"), F.col("beta"))
            means = rows.join(betas, "model").select("model", terms.alias("t")).groupBy("model").agg(
                F.avg("t.g").alias("g"), F.avg("t.h").alias("h")
            )
            for model, g, h in means.collect():
                low, high, beta = state[model]
                steps[model] += 1
                if g == 0 or (beta == MIN_BETA and g > 0) or (beta == MAX_BETA and g < 0):
                    done[model] = beta
                    continue
                low, high = (low, beta) if g > 0 else (beta, high)
                moved = beta - g / h if h > 0 else 0.0
                if not low < moved < high:
                    # An end of the bracket that no step has looked at is a bound: look at it now.
                    bound = MIN_BETA if g > 0 else MAX_BETA
                    beyond = moved <= MIN_BETA or moved >= MAX_BETA
                    moved = bound if bound in (low, high) and h > 0 and beyond else (low * high) ** 0.5
                if abs(moved - beta) <= tolerance * beta or high - low <= tolerance * low:
                    done[model] = moved
                state[model] = [low, high, moved]
    finally:
        rows.unpersist()
    fitted = [(m, 1.0 / b, steps[m], b in (MIN_BETA, MAX_BETA), True) for m, b in sorted(done.items())]
    return spark.createDataFrame(
        fitted, "model string, temperature double, steps int, at_bound boolean, converged boolean"
    )


def with_temperature(scores: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds ``temperature`` per model, 1 where none was fitted."""
    known = fitted.select("model", "temperature")
    return scores.join(small_side(known), "model", "left").withColumn(
        "temperature", F.coalesce("temperature", F.lit(1.0))
    )


def pick_threshold(
    preds: DataFrame,
    target: float = K.TARGET_SELECTIVE_ACCURACY,
    min_rows: int = K.MIN_SUPPORT_ROWS,
    min_share: float = K.MIN_SUPPORT_SHARE,
    split: str | None = "val",
) -> DataFrame:
    """``model, threshold, coverage, selective_accuracy``: the smallest threshold of 0.50 … 0.99
    whose decided rows are at least ``target`` correct and numerous enough; otherwise 0.5 with
    full coverage and overall accuracy.

    Where ``preds`` says which split its rows are of, rows of another than ``split`` stop the job.
    Rows are counted by the highest threshold they reach, at most 51 lines per model, and the
    running totals over those lines give every threshold at once.
    """
    if split and "split" in preds.columns:
        stop = F.raise_error(F.concat(F.lit(f"a threshold reads {split} only, found "), F.col("split")))
        preds = preds.withColumn("correct", F.when(F.col("split") == split, F.col("correct")).otherwise(stop.cast("double")))
    by_step = preds.withColumn("k", threshold_reached()).groupBy("model", "k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("right")
    )
    return threshold_of_steps(by_step, target, min_rows, min_share)


N_STEPS, FIRST_STEP, STEP = 50, 0.50, 0.01


def threshold_reached() -> Column:
    """Number of the highest threshold that the confidence reaches, -1 for none."""
    return F.coalesce(S.threshold_step(F.col("confidence"), FIRST_STEP, STEP, N_STEPS), F.lit(-1))


def threshold_of_steps(by_step: DataFrame, target: float, min_rows: int, min_share: float) -> DataFrame:
    """The threshold from ``model, k, n, right``, a line per model and highest threshold reached."""
    start, step = FIRST_STEP, STEP
    totals = by_step.groupBy("model").agg(F.sum("n").alias("n_all"), F.sum("right").alias("right_all"))
    # One line per model and threshold that some row ends at, plus the gaps below them.
    reached = by_step.filter("k >= 0").select(
        "model", "n", "right", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("k")
    ).groupBy("model", "k").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    ok = reached.join(totals, "model").filter(
        (F.col("n") >= F.greatest(F.lit(float(min_rows)), F.lit(min_share) * F.col("n_all")))
        & (F.col("right") / F.col("n") >= target)
    )
    best = ok.groupBy("model").agg(F.min(F.struct("k", "n", "right")).alias("b"))
    joined = totals.join(best, "model", "left")
    found = F.col("b").isNotNull()
    return joined.select(
        "model",
        F.when(found, F.lit(start) + F.col("b.k") * F.lit(step)).otherwise(0.5).alias("threshold"),
        F.when(found, F.col("b.n") / F.col("n_all")).otherwise(1.0).alias("coverage"),
        F.when(found, F.col("b.right") / F.col("b.n"))
        .otherwise(F.col("right_all") / F.col("n_all"))
        .alias("selective_accuracy"),
    )


def calibration_rows(
    scores: DataFrame, fitted: DataFrame | None = None, split: str | None = "val"
) -> DataFrame:
    """One calibration record per model, rounded as it is stored; rows of another split stop the job.
    Two passes over the scores, raw and tempered; all else comes from their stored summaries, at most
    classes x classes x bins x thresholds lines per model."""
    if split and "split" in scores.columns:
        scores = _require_split(scores, split)
    fitted = fit_temperature(scores) if fitted is None else fitted
    before = store(score_summary(predictions(scores)), "summary-raw")
    tempered = predictions(with_temperature(scores, fitted), F.col("temperature"))
    after = store(score_summary(tempered.withColumn("k", threshold_reached()), extra=["k"]), "summary-tempered")
    right = F.sum(F.when(F.col("label_idx") == F.col("pred"), F.col("n")).otherwise(0)).cast("double")
    steps = after.groupBy("model", "k").agg(F.sum("n").alias("n"), right.alias("right"))
    accuracy = after.groupBy("model").agg((right / F.sum("n")).alias("accuracy"))
    threshold = threshold_of_steps(steps, K.TARGET_SELECTIVE_ACCURACY, K.MIN_SUPPORT_ROWS, K.MIN_SUPPORT_SHARE)
    return (
        fitted.select("model", F.round("temperature", 6).alias("temperature"))
        .join(threshold, "model")
        .join(error_of_summary(before).select("model", F.col("ece").alias("ece_before")), "model")
        .join(error_of_summary(after).select("model", F.col("ece").alias("ece_after")), "model")
        .join(accuracy, "model")
        .select(
            "model",
            "temperature",
            F.round("threshold", 4).alias("threshold"),
            F.round("ece_before", 6).alias("ece_before"),
            F.round("ece_after", 6).alias("ece_after"),
            F.round("accuracy", 6).alias("val_accuracy"),
            F.round("coverage", 4).alias("coverage_at_threshold"),
            F.round("selective_accuracy", 4).alias("selective_accuracy"),
        )
    )
