"""File listings, class maps, annotations, logs, and the report and manifest sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcurate import constants as K
from sparkcurate.functions import text as X
from sparkcurate.session import store


def list_files(spark: SparkSession, root: str, extensions=K.IMAGE_EXTENSIONS) -> DataFrame:
    """``path, length, modificationTime`` of all files below ``root`` with one of the extensions,
    in any case. The bytes are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    return found.select(path.alias("path"), "length", "modificationTime").filter(
        X.has_extension(F.col("path"), extensions)
    )


def parse_split_path(files: DataFrame) -> DataFrame:
    """Adds ``split, label, name`` from ``…/<split>/<label>/<name>``."""
    parts = X.path_parts(F.col("path"))
    return files.select(
        *files.columns,
        F.element_at(parts, -3).alias("split"),
        F.element_at(parts, -2).alias("label"),
        F.element_at(parts, -1).alias("name"),
    )


def class_map_rows(json_text: DataFrame) -> DataFrame:
    """``folder, class`` rows of JSON objects in column ``value``; keys with a leading
    underscore are comments."""
    parsed = F.from_json(F.col("value"), T.MapType(T.StringType(), T.StringType()))
    pairs = json_text.select(F.explode(parsed).alias("folder", "class"))
    return pairs.filter(~F.col("folder").startswith("_"))


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    return class_map_rows(spark.read.text(path, wholetext=True))


def yaml_names(content: Column) -> Column:
    """Class names of a detection dataset's description: an inline list ``names: [a, b]`` or a
    block list with a ``- name`` per line, quotes dropped; null when there is none."""
    inline = F.regexp_extract(content, r"(?m)^names:\s*\[([^\]]*)\]", 1)
    block = F.regexp_extract(content, r"(?m)^names:[ \t]*\r?\n((?:[ \t]*-[^\n]*(?:\n|$))+)", 1)
    items = F.when(inline != "", F.split(inline, ",")).when(
        block != "", F.transform(F.split(F.trim(block), r"\r?\n"), lambda s: F.regexp_replace(s, r"^\s*-", ""))
    )
    clean = F.transform(items, lambda s: F.regexp_replace(F.trim(s), r"^['\"]|['\"]$", ""))
    return F.filter(clean, lambda s: s != "")


def annotation_names(yaml_files: DataFrame) -> DataFrame:
    """``dataset, class_id, class_name`` from ``dataset, value``."""
    return yaml_files.select("dataset", F.posexplode(yaml_names(F.col("value"))).alias("class_id", "class_name"))


def read_annotations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Class names and annotation lines of all detection datasets below ``root``, where a dataset
    is a direct child directory: ``(dataset, class_id, class_name)`` and ``(dataset, labels_dir,
    stem, line)``. Blank lines are dropped; a file of blank lines leaves one null line,
    and an empty one none: its images drop out for want of an annotation either way."""
    # As the file system itself writes it, scheme and host included: that is how file paths come back.
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found_at = files.makeQualified(hadoop)
    qualified = found_at.toString().rstrip("/")
    base = re.sub("^file:/+", "/", found_at.toUri().toString().rstrip("/"))  # escaped, as file paths are

    def whole(pattern: str) -> DataFrame:
        found = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern)
            .text(qualified, wholetext=True)
        )
        path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
        below = F.substring(path, F.lit(len(base) + 2), F.length(path))
        return found.select(F.split(below, "/")[0].alias("dataset"), path.alias("path"), "value")

    names = annotation_names(whole("data.yaml"))
    texts = whole("*.txt").filter(F.element_at(F.split("path", "/"), -2) != "")
    lines = texts.select(
        "dataset",
        F.regexp_replace("path", "/[^/]*$", "").alias("labels_dir"),
        X.file_stem(F.col("path")).alias("stem"),
        F.explode_outer(
            F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
        ).alias("line"),
    )
    return names, lines


HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("best_val_f1", T.DoubleType()),
        T.StructField("best_epoch", T.IntegerType()),
        T.StructField("elapsed_s", T.DoubleType()),
        T.StructField(
            "history",
            T.ArrayType(
                T.StructType(
                    [T.StructField("epoch", T.IntegerType())]
                    + [
                        T.StructField(c, T.DoubleType())
                        for c in (
                            "train_loss", "train_acc", "val_loss", "val_acc", "val_bal_acc",
                            "val_f1_macro", "lr",
                        )
                    ]
                )
            ),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history that lies at ``path``: decisions where there are folders by day (``append_history``), training logs
    elsewhere."""
    days = spark._jvm.org.apache.hadoop.fs.Path(path, "day=*")
    by_day = days.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(days)
    return _read_decisions(spark, path) if by_day else _read_logs(spark, path)


def _read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Training logs, one JSON file per model; an unreadable one gives a row of nulls."""
    return (
        spark.read.schema(HISTORY_SCHEMA)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .json(path)
    )


def hash_plan(files: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files split into those the hash store knows (with their orbit, null = corrupt) and those
    still to be hashed. A file is known by path, length and whole-second change time."""
    key = ["path", "length", "mtime_s"]
    keyed = files.withColumn("mtime_s", F.unix_timestamp("modificationTime"))
    known = store.select(*key, "orbit").dropDuplicates(key)
    return keyed.join(known, key), keyed.join(known.select(*key), key, "left_anti")


# --- sinks ------------------------------------------------------------------------------------


def write_report(report: DataFrame, path: str) -> None:
    """A one-line or few-line report as one JSON file: its rows meet in one task only after the work."""
    report.repartition(1).write.mode("overwrite").json(path)


def write_csv(table: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header; its rows meet in one task only after the work."""
    table.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_field_rows(rows: DataFrame, path: str) -> None:
    """One CSV line per field photo; the photos are many, so the files stay as Spark wrote them."""
    rows.select(
        "path",
        "truth",
        "answer",
        F.format_string("%.4f", "confidence").alias("confidence"),
        F.when(F.col("veg_fraction").isNotNull(), F.format_string("%.3f", "veg_fraction"))
        .otherwise("")
        .alias("veg_fraction"),
        "hit",
    ).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The dataset as a table of paths, laid out by split and label; file bytes are not copied.
    Rows are first dealt out within their split and label, so a large label gets many files of
    even size and a small one few."""
    (
        manifest.repartition("split", "label", F.pmod(F.xxhash64("path"), F.lit(64)))
        .write.mode("overwrite")
        .partitionBy("split", "label")
        .parquet(path)
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_groups(groups: DataFrame, path: str) -> None:
    """The group of each path, and the group's key where there is one."""
    kept = [c for c in ("path", "group_id", "group_key") if c in groups.columns]
    groups.select(*kept).write.mode("overwrite").parquet(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """``path, group_id`` and, where it was written, ``group_key``."""
    return spark.read.parquet(path)


def append_diagnoses(rows: DataFrame, path: str) -> None:
    """Adds decisions to the history table; ``scores`` travels as JSON text."""
    out = rows.withColumn("scores_json", F.to_json("scores")).drop("scores")
    out.write.mode("append").parquet(path)


def read_diagnoses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn(
        "scores", F.from_json("scores_json", T.MapType(T.StringType(), T.DoubleType()))
    )


def append_history(rows: DataFrame, path: str) -> None:
    """Adds decisions to a history that lies in folders by day of ``created_at``, so that a delete need not rewrite all
    of it; ``scores``, where there are any, travel as JSON text. Rows are dealt by ranges of day and id:
    a task writes few days, and a day of any size is shared by several tasks."""
    if "scores" in rows.columns:
        rows = rows.withColumn("scores_json", F.to_json("scores")).drop("scores")
    dated = rows.withColumn("day", F.to_date("created_at"))
    dated.repartitionByRange("day", "id").write.mode("append").partitionBy("day").parquet(path)


def _read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The history, with ``day``; a filter on it leaves the other days' files unread."""
    rows = spark.read.parquet(path).withColumn("day", F.col("day").cast("date"))
    if "scores_json" not in rows.columns:
        return rows
    scores = F.from_json("scores_json", T.MapType(T.StringType(), T.DoubleType()))
    return rows.withColumn("scores", scores).drop("scores_json")


def delete_history(spark: SparkSession, path: str, tombstones: DataFrame) -> int:
    """Deletes the ids in ``tombstones`` from the history at ``path`` and returns how many days it touched.

    Only days that hold such an id are rewritten, by dynamic partition overwrite; files of the others stay as they are.
    The ids are looked up over the column ``id`` alone. What is left of the touched days is first written
    to the shared folder, so a run that is lost on the way can be repeated: ids already gone are
    no longer found. Listed in the driver are days, never rows.
    """
    rows = spark.read.parquet(path).withColumn("day", F.col("day").cast("date"))
    gone = tombstones.select("id").distinct()
    hit = rows.select("id", "day").join(gone, "id", "left_semi").select("day").distinct()
    touched = [row["day"] for row in hit.collect()]
    if not touched:
        return 0
    in_touched = F.col("day").isin([day for day in touched if day is not None])
    if None in touched:
        in_touched = in_touched | F.col("day").isNull()
    left = store(rows.filter(in_touched).join(gone, "id", "left_anti"), "history-left")
    still = {row["day"] for row in left.select("day").distinct().collect()}
    again = left.repartitionByRange("day", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    again.partitionBy("day").parquet(path)
    for day in set(touched) - still:  # no row is left to overwrite them with
        folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"day={day or '__HIVE_DEFAULT_PARTITION__'}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(touched)
