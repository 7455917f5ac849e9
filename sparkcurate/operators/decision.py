"""From scores to answers: vegetation gate, calibrated softmax, abstention."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.functions import scores as S
from sparkcurate.operators.skew import small_side


def with_calibration(rows: DataFrame, calibration: DataFrame | None) -> DataFrame:
    """Adds ``temperature`` and ``threshold`` of the row's model; 1 and 0.70 without a record."""
    if calibration is None:
        found = rows.withColumn("temperature", F.lit(1.0)).withColumn(
            "threshold", F.lit(K.DEFAULT_THRESHOLD)
        )
        return found
    known = calibration.select("model", "temperature", "threshold")
    return rows.join(small_side(known), "model", "left").withColumn(
        "temperature", F.coalesce("temperature", F.lit(1.0))
    ).withColumn("threshold", F.coalesce("threshold", F.lit(K.DEFAULT_THRESHOLD)))


def binary_answer(
    probs: Column, threshold: Column, vegetation: Column | None, temperature: Column,
    min_vegetation: float = K.MIN_VEGETATION,
) -> Column:
    """Struct ``label, confidence, healthy_prob, anomalous_prob, vegetation_fraction,
    is_temperature_scaled, message`` for calibrated two-class probabilities.

    Too little vegetation wins over everything and zeroes the probabilities; then a confidence
    under the threshold abstains; a tie is healthy. A null vegetation share skips the gate.
    """
    veg = F.lit(None).cast("double") if vegetation is None else vegetation
    no_leaf = F.coalesce(veg < min_vegetation, F.lit(False))
    healthy, anomalous = probs[0], probs[1]
    confidence = F.greatest(healthy, anomalous)
    unsure = confidence < threshold
    label = (
        F.when(no_leaf, "not_a_leaf")
        .when(unsure, "inconclusive")
        .when(healthy >= anomalous, "healthy")
        .otherwise("anomalous")
    )
    before, after = K.INCONCLUSIVE_MESSAGE
    percent = F.bround(confidence * 100).cast("int").cast("string")
    message = F.when(no_leaf, K.NOT_A_LEAF_MESSAGE).when(
        unsure, F.concat(F.lit(before), percent, F.lit(after))
    )

    def shown(value: Column) -> Column:
        return F.when(no_leaf, 0.0).otherwise(value)

    return F.struct(
        label.alias("label"),
        shown(confidence).alias("confidence"),
        shown(healthy).alias("healthy_prob"),
        shown(anomalous).alias("anomalous_prob"),
        veg.alias("vegetation_fraction"),
        (temperature != 1.0).alias("is_temperature_scaled"),
        message.alias("message"),
    )


def decide(
    rows: DataFrame, calibration: DataFrame | None = None, vegetation: str | None = "vegetation_fraction",
    min_vegetation: float = K.MIN_VEGETATION,
) -> DataFrame:
    """``id, model`` and the answer's fields for rows of ``id, model, logits``."""
    ready = with_calibration(rows, calibration).withColumn(
        "_probs", S.softmax(F.col("logits"), F.col("temperature"))
    )
    answer = binary_answer(
        F.col("_probs"), F.col("threshold"), F.col(vegetation) if vegetation else None,
        F.col("temperature"), min_vegetation,
    )
    return ready.select("id", "model", answer.alias("a")).select("id", "model", "a.*")


def decide_raw(rows: DataFrame) -> DataFrame:
    """The plain softmax answer: no temperature, gate or abstention."""
    probs = rows.withColumn("_p", S.softmax(F.col("logits")))
    healthy, anomalous = F.col("_p")[0], F.col("_p")[1]
    return probs.select(
        "id",
        "model",
        F.when(healthy >= anomalous, "healthy").otherwise("anomalous").alias("label"),
        F.greatest(healthy, anomalous).alias("confidence"),
        healthy.alias("healthy_prob"),
        anomalous.alias("anomalous_prob"),
    )


def decide_multiclass(
    rows: DataFrame, classes: tuple | list, threshold: float = K.DEFAULT_THRESHOLD
) -> DataFrame:
    """Top class of the raw softmax with all scores as a map; ``accepted`` is false when a
    positive threshold is not reached."""
    names = F.array(*[F.lit(c) for c in classes])
    scored = rows.withColumn("_p", S.softmax(F.col("logits")))
    confidence = F.array_max("_p")
    accepted = (confidence >= threshold) if threshold > 0 else F.lit(True)
    return scored.select(
        "id",
        "model",
        names[S.argmax(F.col("_p"))].alias("predicted_class"),
        confidence.alias("confidence"),
        F.map_from_arrays(names, F.col("_p")).alias("scores"),
        accepted.alias("accepted"),
    )


def admission(content_type: Column, length: Column, max_bytes: int = K.MAX_UPLOAD_BYTES) -> Column:
    """415 for an unlisted content type (none at all passes), 413 for too many bytes, else null."""
    typed = content_type.isNotNull() & (content_type != "")
    return F.when(typed & ~content_type.isin(*K.ALLOWED_CONTENT_TYPES), 415).when(
        length > max_bytes, 413
    )


def truth_of_folder(folder: Column) -> Column:
    """Truth named by a field-test folder, any case; null for an unknown folder."""
    out = None
    for name, truth in K.TRUTH_ALIASES.items():
        hit = F.lower(folder) == name
        out = F.when(hit, truth) if out is None else out.when(hit, truth)
    return out


def fit_baseline(
    features: DataFrame, weights: DataFrame, max_iter: int = 30, reg: float = 0.01, tol: float = 1e-6
):
    """A class-weighted multinomial logistic regression over ``features ARRAY<DOUBLE>`` and
    ``label_idx``; it produces the logits tables the calibration jobs start from."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    table = features.join(small_side(weights.select("label_idx", "weight")), "label_idx").select(
        array_to_vector(F.col("features")).alias("features"),
        F.col("label_idx").cast("double").alias("label"),
        "weight",
    )
    model = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter,
        regParam=reg, tol=tol, family="multinomial",
    )
    return model.fit(table)


def score_batch(features: DataFrame, model) -> DataFrame:
    """Adds ``logits ARRAY<DOUBLE>`` from a fitted MLlib classifier."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = features.withColumn("_vector", array_to_vector(F.col("features")))
    model = model.copy({model.featuresCol: "_vector"})
    return model.transform(ready).withColumn("logits", vector_to_array("rawPrediction")).drop(
        "_vector", "rawPrediction", "probability", "prediction"
    )


def score_batch_with(features: DataFrame, score, n_classes: int) -> DataFrame:
    """Adds ``logits`` from any function of a 2-d float array to a 2-d array of scores; Spark
    hands it one Arrow batch at a time."""
    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        matrix = np.asarray(score(np.stack(batch.to_list())), dtype=float)
        if matrix.shape != (len(batch), n_classes):
            raise ValueError(f"scores have shape {matrix.shape}")
        return pd.Series(list(matrix), index=batch.index)

    return features.withColumn("logits", run(F.col("features")))
