"""Leakage between splits, label conflicts, and the gate that stops a leaking dataset.

Rows carry ``id, path, group_id, split, label``. Reports are two aggregates, rows to groups and
groups to one line; partial aggregation makes a huge group no harder than a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.operators.skew import HOT_ROWS, attach


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def group_profile(rows: DataFrame) -> DataFrame:
    """Per group: rows per split, whether labels contradict, and its first train path."""
    split = F.col("split")
    return rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[_count(split == s).alias(s) for s in K.SPLITS],
        (F.min("label") != F.max("label")).alias("conflict"),
        F.min(F.when(split == "train", F.col("path"))).alias("train_path"),
    )


def verdict(leaked_pct: Column) -> Column:
    return (
        F.when(leaked_pct >= K.GRAVE_LEAK_PCT, "GRAVE")
        .when(leaked_pct >= K.MODERATE_LEAK_PCT, "MODERADO")
        .otherwise("OK")
    )


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def leakage_report(
    rows: DataFrame,
    listed: DataFrame,
    max_distance: int = K.MAX_HAMMING_DISTANCE,
    denominator: str = "listed",
) -> DataFrame:
    """One line: redundancy, leaked test and val rows, contradictory groups, verdict.

    ``rows`` are the readable, grouped files; ``listed`` all files of the splits with an
    ``orbit`` that is null when unreadable. Percentages divide by the listed files of the split,
    or by the readable ones with ``denominator="readable"``. The verdict looks at test only.
    """
    groups = group_profile(rows)
    has_train = F.col("train") > 0
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_images"),
        F.count(F.lit(1)).alias("n_distinct_photos"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"readable_{s}") for s in ("test", "val")],
        *[
            F.coalesce(F.sum(F.when(has_train, F.col(s))), F.lit(0)).alias(f"leaked_{s}")
            for s in ("test", "val")
        ],
        _count(F.col("conflict")).alias("label_conflict_groups"),
    )
    files = listed.agg(
        _count(F.col("orbit").isNull()).alias("n_corrupted"),
        *[_count(F.col("split") == s).alias(f"listed_{s}") for s in ("test", "val")],
    )
    one = F.lit(1).alias("_one")
    line = totals.withColumn("_one", one).join(files.withColumn("_one", one), "_one")

    def part(split: str) -> Column:
        whole = F.col(f"{denominator}_{split}")
        leaked = F.col(f"leaked_{split}")
        return F.struct(
            whole.alias("total"),
            leaked.alias("leaked"),
            F.round(_pct(leaked, whole), 2).alias("leaked_pct"),
        ).alias(split)

    return line.select(
        F.lit(max_distance).alias("max_distance"),
        "n_images",
        "n_distinct_photos",
        F.round(_pct(F.col("redundant"), F.col("n_images")), 2).alias("redundancy_pct"),
        "largest_group",
        "n_corrupted",
        part("test"),
        part("val"),
        "label_conflict_groups",
        verdict(_pct(F.col("leaked_test"), F.col(f"{denominator}_test"))).alias("verdict"),
    )


def flat_report(report: DataFrame) -> DataFrame:
    """The report with its two structs spread into columns."""
    parts = [
        F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("test", "val") for c in ("total", "leaked", "leaked_pct")
    ]
    plain = [c for c in report.columns if c not in ("test", "val")]
    return report.select(*plain, *parts)


def leak_matrix(rows: DataFrame) -> DataFrame:
    """For each ordered pair of splits: rows of the first whose group also lies in the second."""
    groups = group_profile(rows)
    cells = [
        F.struct(
            F.lit(a).alias("split"),
            F.lit(b).alias("also_in"),
            F.when(F.col(b) > 0, F.col(a)).otherwise(0).alias("n"),
        )
        for a in K.SPLITS
        for b in K.SPLITS
        if a != b
    ]
    return (
        groups.select(F.explode(F.array(*cells)).alias("c"))
        .groupBy("c.split", "c.also_in")
        .agg(F.sum("c.n").alias("n_rows"))
    )


def leaked_rows(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Test and val rows whose group also holds a train row."""
    groups = group_profile(rows).filter("train > 0").select("group_id", "n")
    held_out = rows.filter(F.col("split").isin("test", "val"))
    return attach(held_out, groups, "group_id", "id", "n", "left_semi", hot_rows)


def clean_test(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Test rows whose group holds no train row."""
    groups = group_profile(rows).filter("train = 0").select("group_id", "n")
    return attach(rows.filter("split = 'test'"), groups, "group_id", "id", "n", "left_semi", hot_rows)


def leak_examples(rows: DataFrame, k: int = 15, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Up to ``k`` leaked test files, by path, each with the first train file of its group."""
    groups = group_profile(rows).filter("train > 0").select("group_id", "train_path", "n")
    tests = rows.filter("split = 'test'").select("id", "group_id", F.col("path").alias("test_path"))
    pairs = attach(tests, groups, "group_id", "id", "n", hot_rows=hot_rows)
    return pairs.orderBy("test_path").limit(k).select("test_path", "train_path")


def label_conflicts(rows: DataFrame) -> DataFrame:
    """Groups whose files carry more than one label."""
    return (
        rows.groupBy("group_id")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.countDistinct("label").alias("n_labels"),
        )
        .filter("n_labels > 1")
    )


def drop_conflicts(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of the groups that agree on one label."""
    agreed = (
        rows.groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .filter("lo = hi")
        .select("group_id", "n")
    )
    return attach(rows, agreed, "group_id", "id", "n", "left_semi", hot_rows)


REPORT_METRICS = (
    "n_images", "n_distinct_photos", "redundancy_pct", "largest_group", "n_corrupted",
    "test_total", "test_leaked", "test_leaked_pct", "val_total", "val_leaked", "val_leaked_pct",
    "label_conflict_groups",
)


def compare_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two one-line reports side by side: ``metric, before, after, change``."""

    def tall(report: DataFrame, value: str) -> DataFrame:
        pairs = ", ".join(f"'{m}', cast({m} as double)" for m in REPORT_METRICS)
        return flat_report(report).selectExpr(
            f"stack({len(REPORT_METRICS)}, {pairs}) as (metric, {value})"
        )

    joined = tall(before, "before").join(tall(after, "after"), "metric")
    return joined.withColumn("change", F.col("after") - F.col("before"))


def audit_gate(report: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """The report with ``passed`` and ``warning``: passed only on verdict OK; a missing or empty
    metadata table means the split was not made by groups."""
    has_metadata = metadata is not None and not metadata.isEmpty()
    warning = F.lit(None if has_metadata else "no split metadata: the split may not be group-aware")
    return report.withColumn("passed", F.col("verdict") == "OK").withColumn(
        "warning", warning.cast("string")
    )


def require_ok(report: DataFrame) -> DataFrame:
    """The report, failing the job when it is read with any verdict but OK."""
    stop = F.raise_error(F.concat(F.lit("the split still leaks: "), F.col("verdict")))
    return report.withColumn(
        "verdict", F.when(F.col("verdict") == "OK", F.col("verdict")).otherwise(stop)
    )


def split_metadata(
    listed: DataFrame, groups: DataFrame, assigned: DataFrame,
    max_distance: int = K.MAX_HAMMING_DISTANCE, seed: int = K.SPLIT_SEED,
) -> DataFrame:
    """Long table ``section, split, item, n`` of everything the split report holds.

    ``listed``: all files; ``groups``: readable files with group_id; ``assigned``: files kept,
    with split, label and source.
    """
    from sparkcurate.operators.grouping import group_stats

    none = F.lit(None).cast("string")

    def lines(df: DataFrame, values: dict[str, Column]) -> DataFrame:
        """A line for each value of a one-row table."""
        cells = [F.struct(F.lit(k).alias("section"), v.cast("double").alias("n")) for k, v in values.items()]
        return df.select(F.explode(F.array(*cells)).alias("c")).select(
            "c.section", none.alias("split"), none.alias("item"), "c.n"
        )

    stats, n, corrupt = group_stats(groups), F.col("n"), F.col("corrupt")
    files = listed.agg(F.count(F.lit(1)).alias("n"), _count(F.col("orbit").isNull()).alias("corrupt"))
    conflicts = label_conflicts(groups).agg(F.count(F.lit(1)).alias("n"))

    def cell(section: str, item: Column, group: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.alias("item"), group.alias("g"))

    # One pass over the files kept: each cell counts for its split's groups, its label and its source.
    group = F.col("group_id")
    cells = (
        assigned.groupBy("split", "label", "source", "group_id").agg(F.count(F.lit(1)).alias("n"))
        .select("split", "n", F.explode(F.array(
            cell("groups_per_split", none, group),
            cell("images_per_split", F.col("label"), F.lit(None).cast(assigned.schema["group_id"].dataType)),
            cell("sources_per_split", F.col("source"), F.lit(None).cast(assigned.schema["group_id"].dataType)),
        )).alias("c"))
        .groupBy("c.section", "split", "c.item").agg(F.sum("n").alias("files"), F.countDistinct("c.g").alias("groups"))
        .select(
            "section", "split", "item",
            F.when(F.col("section") == "groups_per_split", F.col("groups")).otherwise(F.col("files")).cast("double").alias("n"),
        )
    )
    return (
        lines(files, {
            "seed": F.lit(seed), "max_hamming_distance": F.lit(max_distance), "n_images_staging": n, "n_corrupted_dropped": corrupt,
        })
        .unionByName(lines(conflicts, {"n_conflicted_groups_dropped": n}))
        .unionByName(lines(stats, {
            "n_distinct_photos": F.col("n_groups"), "redundancy_pct": F.round("redundancy_pct", 2),
            "largest_group": F.col("largest_group"),
        }))
        .unionByName(cells)
    )
