"""Decision history, dashboard, model catalogue and training history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.operators.ranking import into_buckets, prefix_scan
from sparkcurate.session import store


def with_display_label(rows: DataFrame, column: str = "predicted_class") -> DataFrame:
    """Adds ``predicted_label``; an id without a display label shows as itself."""
    pairs = F.create_map(*[F.lit(x) for pair in K.CLASS_LABELS.items() for x in pair])
    return rows.withColumn("predicted_label", F.coalesce(pairs[F.col(column)], F.col(column)))


def history_page(
    diagnoses: DataFrame, limit: int = K.HISTORY_LIMIT, offset: int = 0, after: tuple | None = None
) -> DataFrame:
    """One page of the list view, newest first, equal times by falling id. ``after``, the ``(created_at,
    id)`` of the last row of the page before, costs the same on every page; ``offset`` sorts all the
    rows it skips."""
    if not 0 < limit <= K.HISTORY_MAX_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1..{K.HISTORY_MAX_LIMIT} and offset >= 0")
    columns = [
        c
        for c in (
            "id", "created_at", "model_name", "predicted_class", "confidence", "demo_mode",
            "original_filename",
        )
        if c in diagnoses.columns
    ]
    if after is not None:
        created_at, last_id = F.lit(after[0]), F.lit(after[1])
        older = F.col("created_at") < created_at
        diagnoses = diagnoses.filter(older | ((F.col("created_at") == created_at) & (F.col("id") < last_id)))
    page = (
        diagnoses.select(*columns)
        .orderBy(F.col("created_at").desc(), F.col("id").desc())
        .offset(offset)
        .limit(limit)
    )
    return with_display_label(page)


def find_diagnosis(diagnoses: DataFrame, diagnosis_id: int) -> DataFrame:
    return with_display_label(diagnoses.filter(F.col("id") == diagnosis_id))


def delete_diagnoses(diagnoses: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The history without the ids listed in ``tombstones``, to be written as the new table."""
    return diagnoses.join(tombstones.select("id").distinct(), "id", "left_anti")


def dashboard(diagnoses: DataFrame, latest: int | None = K.HISTORY_MAX_LIMIT) -> DataFrame:
    """Count per predicted class over the latest rows (all of them for None), with their number and
    mean confidence in percent on every line."""
    window = diagnoses.select("predicted_class", "confidence")
    if latest is not None:
        newest = diagnoses.orderBy(F.col("created_at").desc(), F.col("id").desc())
        window = newest.limit(latest).select("predicted_class", "confidence")
    per_class = window.groupBy("predicted_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence")
    )
    from pyspark.sql import Window as W

    everything = W.partitionBy()
    return with_display_label(
        per_class.select(
            "predicted_class",
            "n",
            F.sum("n").over(everything).alias("n_shown"),
            (100.0 * F.sum("confidence").over(everything) / F.sum("n").over(everything)).alias(
                "mean_confidence_pct"
            ),
        )
    )


def model_catalogue(weights: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Every model of the catalogue with label and ``has_weights``; the number of ready models is on
    every line. ``weights`` lists ``model`` names that have a weights file; ``descriptions``, a table
    of ``model, description``, adds the caller's own texts."""
    spark = weights.sparkSession
    catalogue = spark.createDataFrame(
        list(K.MODEL_LABELS.items()), "model string, label string"
    )
    if descriptions is not None:
        catalogue = catalogue.join(descriptions.select("model", "description"), "model", "left")
    from pyspark.sql import Window as W

    there = weights.select("model").distinct().withColumn("_there", F.lit(True))
    return (
        catalogue.join(there, "model", "left")
        .withColumn("has_weights", F.coalesce("_there", F.lit(False)))
        .drop("_there")
        .withColumn("n_ready", F.count(F.when(F.col("has_weights"), 1)).over(W.partitionBy()))
    )


def evaluable_models(models: DataFrame, weights: DataFrame) -> DataFrame:
    """Models that have a weights file; the others are skipped."""
    return models.join(weights.select("model").distinct(), "model", "left_semi")


def explode_history(logs: DataFrame) -> DataFrame:
    """``model, epoch, …`` rows from training logs that hold an array of epoch records."""
    return logs.filter("history is not null").select("model", F.explode("history").alias("h")).select(
        "model", "h.*"
    )


def early_stop(history: DataFrame, patience: int, epoch: str = "epoch", metric: str = "val_f1") -> DataFrame:
    """Adds ``position, improved, misses, kept`` to each epoch of each model.

    An epoch improves when its metric is strictly above all earlier ones and above -1. Training
    stops at the first epoch with ``patience`` misses since the last improvement; later epochs
    are not kept. Three running aggregates over one cut of the epochs into buckets, so one model may
    hold any share of the rows. What is stored between them is model, epoch, metric and the aggregates; other
    columns are joined back at the end, which takes (model, epoch) to be unique.
    """
    keys = ["model", epoch]
    rest = [c for c in history.columns if c not in (*keys, metric)]
    cut_once = into_buckets(history.select(*keys, metric), epoch)
    scan = lambda df, aggs: prefix_scan(df, ["model"], [epoch], aggs)
    first = scan(cut_once, {"_seen": ("count", F.lit(1)), "_best": ("max", F.col(metric))})
    marked = first.withColumn("position", F.col("_seen") + 1).withColumn(
        "improved", F.col(metric) > F.coalesce("_best", F.lit(-1.0))
    )
    second = scan(store(marked), {"_last": ("max", F.when(F.col("improved"), F.col("position")))})
    since = F.col("position") - F.coalesce("_last", F.lit(0))
    counted = second.withColumn("misses", F.when(F.col("improved"), F.lit(0)).otherwise(since))
    third = scan(store(counted), {"_stops": ("count", F.when((F.col("misses") >= patience), 1))})
    done = third.withColumn("kept", F.col("_stops") == 0).drop("_seen", "_best", "_last", "_stops", "_bucket")
    if not rest:
        return done
    return history.join(done.drop(metric), keys).select(*history.columns, "position", "improved", "misses", "kept")


def training_summary(stopped: DataFrame, epoch: str = "epoch", metric: str = "val_f1") -> DataFrame:
    """Per model: best epoch and its metric, last epoch kept, epochs kept and cut."""
    kept = F.col("kept")
    best = F.when(kept & F.col("improved"), F.struct(F.col("position"), F.col(epoch).alias("e"), F.col(metric).alias("m")))
    return stopped.groupBy("model").agg(
        F.max(best).alias("b"),
        F.max(F.when(kept, F.col(epoch))).alias("last_epoch"),
        F.count(F.when(kept, 1)).alias("n_kept"),
        F.count(F.when(~kept, 1)).alias("n_cut"),
    ).select(
        "model",
        F.col("b.e").alias("best_epoch"),
        F.col("b.m").alias("best_metric"),
        "last_epoch",
        "n_kept",
        "n_cut",
    )
