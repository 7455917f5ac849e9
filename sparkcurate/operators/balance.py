"""Counts per split and label, alerts, class weights, sufficiency and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcurate import constants as K


def _domain(spark: SparkSession, columns: dict[str, tuple]) -> DataFrame:
    """All combinations of a few fixed names, as a small table."""
    rows = [()]
    for values in columns.values():
        rows = [r + (v,) for r in rows for v in values]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def dense_counts(rows: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    """Counts over every combination of the named values, absent ones as 0."""
    counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return _domain(rows.sparkSession, columns).join(counts, list(columns), "left").fillna(0, ["n"])


def _ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def split_label_counts(rows: DataFrame) -> DataFrame:
    """Per split and in total: healthy, anomalous, total, ratio (null when a label is missing)."""
    cells = dense_counts(rows, {"split": K.SPLITS, "label": K.LABELS})
    wide = cells.rollup("split").agg(
        F.sum(F.when(F.col("label") == "healthy", F.col("n")).otherwise(0)).alias("healthy"),
        F.sum(F.when(F.col("label") == "anomalous", F.col("n")).otherwise(0)).alias("anomalous"),
    )
    return wide.select(
        F.coalesce("split", F.lit("TOTAL")).alias("split"),
        "healthy",
        "anomalous",
        (F.col("healthy") + F.col("anomalous")).alias("total"),
        _ratio(F.col("healthy"), F.col("anomalous")).alias("ratio"),
    )


def dataset_alerts(
    rows: DataFrame, min_per_class: int = K.MIN_PER_CLASS, max_ratio: float = K.MAX_TRAIN_RATIO
) -> DataFrame:
    """``alert, split, label, n, ratio``: empty and low cells, an unbalanced train split (label is
    the dominant one), and labels that are rare over all splits together."""
    cells = dense_counts(rows, {"split": K.SPLITS, "label": K.LABELS})
    low = cells.filter(F.col("n") < min_per_class).select(
        F.when(F.col("n") == 0, "empty").otherwise("low").alias("alert"),
        "split",
        "label",
        "n",
        F.lit(None).cast("double").alias("ratio"),
    )
    train = split_label_counts(rows).filter("split = 'train'")
    skewed = train.filter(F.col("ratio") > max_ratio).select(
        F.lit("unbalanced").alias("alert"),
        "split",
        F.when(F.col("healthy") > F.col("anomalous"), "healthy").otherwise("anomalous").alias("label"),
        F.greatest("healthy", "anomalous").alias("n"),
        F.col("ratio"),
    )
    rare = (
        cells.groupBy("label")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") < min_per_class)
        .select(
            F.lit("collect_more").alias("alert"),
            F.lit(None).cast("string").alias("split"),
            "label",
            "n",
            F.lit(None).cast("double").alias("ratio"),
        )
    )
    return low.unionByName(skewed).unionByName(rare)


def total_alerts(
    rows: DataFrame, min_per_class: int = K.MIN_PER_CLASS, max_ratio: float = K.MAX_TRAIN_RATIO
) -> DataFrame:
    """The variant on grand totals: balance over all splits, a missing class, and cells that hold
    something but too little."""
    cells = dense_counts(rows, {"split": K.SPLITS, "label": K.LABELS})
    total = split_label_counts(rows).filter("split = 'TOTAL'")
    healthy, anomalous = F.col("healthy"), F.col("anomalous")
    kind = (
        F.when((healthy == 0) & (anomalous == 0), "dataset_empty")
        .when((healthy == 0) | (anomalous == 0), "class_missing")
        .when(F.col("ratio") > max_ratio, "unbalanced")
        .otherwise("balanced")
    )
    named = F.when(kind == "class_missing", F.when(healthy == 0, "healthy").otherwise("anomalous")).when(
        kind == "unbalanced", F.when(healthy > anomalous, "healthy").otherwise("anomalous")
    )
    whole = total.select(
        kind.alias("alert"), F.lit(None).cast("string").alias("split"), named.alias("label"),
        F.col("total").alias("n"), "ratio",
    )
    low = cells.filter((F.col("n") > 0) & (F.col("n") < min_per_class)).select(
        F.lit("low").alias("alert"), "split", "label", "n", F.lit(None).cast("double").alias("ratio")
    )
    return whole.unionByName(low)


def missing_cells(rows: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    """The required combinations that hold no row."""
    return dense_counts(rows, columns).filter("n = 0").drop("n")


def require_cells(rows: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    """One line ``ok``, failing the job with the list of missing cells when there are any."""
    names = F.concat_ws("/", *columns)
    listed = missing_cells(rows, columns).agg(F.sort_array(F.collect_list(names)).alias("missing"))
    stop = F.raise_error(F.concat(F.lit("missing: "), F.concat_ws(", ", "missing")))
    return listed.select(F.when(F.size("missing") == 0, F.lit(True)).otherwise(stop).alias("ok"))


def class_distribution(rows: DataFrame, by: str = "label") -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def class_weights(rows: DataFrame, by: str = "label", classes: list | None = None) -> DataFrame:
    """Per class ``n``, ``weight`` = total / (present classes * n); the ratio of the largest to the
    smallest present class repeats on every line. ``classes`` adds a line with weight 0 for each of
    them that has no row."""
    counts = class_distribution(rows, by)
    if classes is not None:
        wanted = F.explode(F.array(*map(F.lit, classes)).cast(T.ArrayType(rows.schema[by].dataType))).alias(by)
        absent = rows.sparkSession.range(1).select(wanted).join(counts, by, "left_anti")
        counts = counts.unionByName(absent.withColumn("n", F.lit(0).cast("bigint")))
    everything = W.partitionBy()
    present = F.when(F.col("n") > 0, F.col("n"))
    weight = F.sum("n").over(everything) / (F.count(present).over(everything) * present)
    return counts.select(
        by,
        "n",
        F.coalesce(weight, F.lit(0.0)).alias("weight"),
        (F.max(present).over(everything) / F.min(present).over(everything)).alias("max_min_ratio"),
    )


def loss_weights(rows: DataFrame) -> DataFrame:
    """One line: weights ``total / 2n`` for healthy and anomalous, 1 and 1 when either is absent,
    and their ratio (infinite then)."""
    h = F.count(F.when(F.col("label") == "healthy", 1))
    a = F.count(F.when(F.col("label") == "anomalous", 1))
    counts = rows.agg(h.alias("h"), a.alias("a"))
    both = (F.col("h") > 0) & (F.col("a") > 0)
    whole = F.col("h") + F.col("a")
    return counts.select(
        F.when(both, whole / (2 * F.col("h"))).otherwise(1.0).alias("healthy_weight"),
        F.when(both, whole / (2 * F.col("a"))).otherwise(1.0).alias("anomalous_weight"),
        F.when(both, F.greatest("h", "a") / F.least("h", "a")).otherwise(float("inf")).alias("ratio"),
    )


def sufficiency_tier(n: Column) -> Column:
    return (
        F.when(n == 0, "empty")
        .when(n < K.INSUFFICIENT_BELOW, "insufficient")
        .when(n < K.ACCEPTABLE_BELOW, "acceptable")
        .otherwise("ok")
    )


def class_sufficiency(rows: DataFrame, classes: tuple, by: str = "label") -> DataFrame:
    """Every class of the task with its count, share in percent, flag and tier."""
    counts = dense_counts(rows, {by: tuple(classes)})
    total = F.sum("n").over(W.partitionBy())
    return counts.select(
        by,
        "n",
        F.when(total > 0, 100.0 * F.col("n") / total).otherwise(0.0).alias("pct"),
        (F.col("n") < K.INSUFFICIENT_BELOW).alias("insufficient"),
        sufficiency_tier(F.col("n")).alias("tier"),
    )


def source_class_counts(rows: DataFrame, by: str = "label") -> DataFrame:
    """Counts per source and class with the source's own total (class null)."""
    return rows.rollup("source", by).agg(F.count(F.lit(1)).alias("n")).filter("source is not null")


def source_pivot(rows: DataFrame) -> DataFrame:
    """Images per source and split, one column per split."""
    return (
        rows.groupBy("source").pivot("split", list(K.SPLITS)).agg(F.count(F.lit(1))).fillna(0, list(K.SPLITS))
    )


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources in one table, each row tagged with its source's name."""
    tagged = [df.withColumn("tag", F.lit(name)) for name, df in sources.items()]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    return out
