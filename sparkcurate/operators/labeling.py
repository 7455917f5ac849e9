"""Labels from folder names and annotation files, with a full trail of what was decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.functions import text as X
from sparkcurate.functions.let import let
from sparkcurate.operators.skew import HOT_ROWS, attach, small_side
from sparkcurate.session import store


def deciding_dir(path: Column) -> Column:
    """``struct<label, folder>`` of the directory nearest to the root whose name has a label,
    ``ignore`` included; null when no directory below the source has one."""
    dirs = X.inner_dirs(path)
    decided = let(
        dirs,
        lambda ds: F.filter(
            F.transform(
                ds,
                lambda d, i: F.struct(
                    X.infer_label(d).alias("label"),
                    F.concat_ws("/", F.slice(ds, 1, i + 1)).alias("folder"),
                ),
            ),
            lambda s: s["label"].isNotNull(),
        ),
    )
    return F.get(decided, F.lit(0))


def label_from_path(path: Column) -> Column:
    return deciding_dir(path)["label"]


def skipped_source(source: Column) -> Column:
    """Whether a source is left out of staging: listed by name, by prefix, or staged by its keep list alone."""
    return source.isin(*K.SKIP_SOURCES, K.KEEP_LIST_SOURCE) | source.startswith(K.SKIP_SOURCE_PREFIX)


def flat_name(path: Column) -> Column:
    """``source__dirs_joined_file``: the whole relative path below the source in one name."""
    parts = X.path_parts(path)
    return F.concat(parts[0], F.lit("__"), F.concat_ws("_", F.slice(parts, 2, F.size(parts))))


def with_shortcut_flag(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``source`` and ``shortcut``: the source has a direct healthy/ or anomalous/ folder."""
    first_dir = F.get(X.inner_dirs(F.col("path")), F.lit(0))
    rows = files.withColumn("source", X.path_parts(F.col("path"))[0])
    flags = rows.groupBy("source").agg(
        F.coalesce(F.max(first_dir.isin(*K.LABELS)), F.lit(False)).alias("shortcut"),
        F.count(F.lit(1)).alias("n"),
    )
    return attach(rows, flags, "source", "path", "n", hot_rows=hot_rows)


def label_files(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``source, shortcut, label, folder, status``.

    Sources with the binary shortcut count only files directly inside healthy/ and anomalous/;
    all others take the label of the deciding directory. ``status`` is one of labelled, ignored,
    unlabelled, outside_shortcut.
    """
    dirs = X.inner_dirs(F.col("path"))
    direct = (F.size(dirs) == 1) & F.get(dirs, F.lit(0)).isin(*K.LABELS)
    flagged = with_shortcut_flag(files, hot_rows).withColumn(
        "_found",
        F.when(
            F.col("shortcut"),
            F.when(
                direct,
                F.struct(F.get(dirs, F.lit(0)).alias("label"), F.get(dirs, F.lit(0)).alias("folder")),
            ),
        ).otherwise(deciding_dir(F.col("path"))),
    )
    label = F.col("_found.label")
    status = (
        F.when(label == "ignore", "ignored")
        .when(label.isNotNull(), "labelled")
        .when(F.col("shortcut"), "outside_shortcut")
        .otherwise("unlabelled")
    )
    return (
        flagged.withColumn("label", F.when(label != "ignore", label))
        .withColumn("folder", F.col("_found.folder"))
        .withColumn("status", status)
        .drop("_found")
    )


def unrecognized_dirs(labelled: DataFrame) -> DataFrame:
    """Leaf directories with files but no label: ``source, folder, n_images``.

    A directory is a leaf when no other directory of the listing lies below it. The work is on
    distinct directories, not on files.
    """
    dirs = X.inner_dirs(F.col("path"))
    folders = store(
        labelled.groupBy(
            "source", F.concat_ws("/", dirs).alias("folder"), F.size(dirs).alias("depth")
        ).agg(F.count(F.when(F.col("status") == "unlabelled", 1)).alias("n_images"))
    )
    above = (
        folders.filter("depth > 1")
        .select("source", F.split("folder", "/").alias("parts"), "depth")
        .select("source", "parts", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
        .select("source", F.concat_ws("/", F.slice("parts", 1, F.col("k"))).alias("folder"))
        .distinct()
    )
    return (
        folders.filter("depth > 0 and n_images > 0")
        .join(above, ["source", "folder"], "left_anti")
        .select("source", "folder", "n_images")
    )


def label_audit(labelled: DataFrame) -> DataFrame:
    """Long table ``source, folder, label, n_images, status``: every folder that gave a label,
    every leaf that gave none, and per source what was dropped without a trace otherwise."""
    labelled = store(labelled)
    assigned = (
        labelled.filter("status = 'labelled'")
        .groupBy("source", "folder", "label")
        .agg(F.count(F.lit(1)).alias("n_images"))
        .withColumn("status", F.lit("assigned"))
    )
    leaves = unrecognized_dirs(labelled).select(
        "source",
        "folder",
        F.lit(None).cast("string").alias("label"),
        "n_images",
        F.lit("unrecognized").alias("status"),
    )
    return assigned.unionByName(leaves)


def status_counts(labelled: DataFrame) -> DataFrame:
    """Files per source and status: also shows those that vanish without a line in the audit
    (ignored folders, loose files above a labelled level, files beside a binary shortcut)."""
    return labelled.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n_images"))


def class_roots(paths: DataFrame) -> DataFrame:
    """Per source, the shallowest directory holding a child directory named ``crop___condition``
    (first by path among equals). The source directory itself may be the one; a source without
    any does not appear."""
    parts = X.path_parts(F.col("path"))
    dirs = paths.select(F.slice(parts, 1, F.size(parts) - 1).alias("dirs")).distinct()
    parents = dirs.select(
        "dirs", F.explode(F.sequence(F.lit(1), F.greatest(F.size("dirs") - 1, F.lit(1)))).alias("k")
    ).filter(F.get("dirs", F.col("k")).contains("___"))
    found = parents.groupBy(F.col("dirs")[0].alias("source")).agg(
        F.min(
            F.struct(
                (F.col("k") - 1).alias("depth"),
                F.concat_ws("/", F.slice("dirs", 1, F.col("k"))).alias("root"),
            )
        ).alias("r")
    )
    return found.select("source", F.col("r.root").alias("root"), F.col("r.depth").alias("depth"))


def keep_first(files: DataFrame, dest: str = "dest", order: str = "path") -> DataFrame:
    """One row per destination, the first by path, with the number of ``collisions`` it won."""
    others = [c for c in files.columns if c not in (dest, order)]
    best = files.groupBy(dest).agg(
        F.min(F.struct(order, *others)).alias("_best"), F.count(F.lit(1)).alias("_n")
    )
    return best.select(
        dest, "_best.*", (F.col("_n") - 1).alias("collisions")
    )


def copy_plan(planned: DataFrame, existing: DataFrame, dest: str = "dest") -> DataFrame:
    """Rows still to be written: those whose destination does not exist yet."""
    return planned.join(existing.select(dest).distinct(), dest, "left_anti")


def copy_counts(planned: DataFrame, existing: DataFrame, dest: str = "dest") -> DataFrame:
    """One line: ``copied, skipped``."""
    marked = planned.join(
        existing.select(dest).distinct().withColumn("_there", F.lit(True)), dest, "left"
    )
    return marked.agg(
        F.count(F.when(F.col("_there").isNull(), 1)).alias("copied"),
        F.count("_there").alias("skipped"),
    )


def join_class_map(files: DataFrame, class_map: DataFrame, classes=K.CLASS_NAMES) -> DataFrame:
    """Files of mapped folders whose class is known."""
    return files.join(small_side(class_map.filter(F.col("class").isin(*classes))), "folder")


def find_annotations(images: DataFrame, lines: DataFrame) -> DataFrame:
    """Each image with its annotation lines (null when there is none).

    ``images``: ``dataset, image, labels_dir_1, labels_dir_2, stem``, ``lines``: ``dataset,
    labels_dir, stem, line``. The second directory counts only when the first does not exist; a
    directory exists if a file of it is listed, be it an empty one (``lines`` then has a null line).
    There are few directories: their list is counted, then sent to the images.
    """
    existing = lines.select("dataset", F.col("labels_dir").alias("labels_dir_1")).distinct()
    located = images.join(
        small_side(existing.withColumn("_first", F.lit(True))), ["dataset", "labels_dir_1"], "left"
    ).withColumn(
        "labels_dir",
        F.when(F.col("_first"), F.col("labels_dir_1")).otherwise(F.col("labels_dir_2")),
    )
    return located.join(lines, ["dataset", "labels_dir", "stem"], "left").select(
        "dataset", "image", "line"
    )


def class_id(line: Column) -> Column:
    """First token of an annotation line when it is an integer."""
    token = F.split(F.trim(line), r"\s+")[0]
    return F.when(token.rlike(r"^[+-]?[0-9]{1,9}$"), token).cast("int")


def annotation_labels(found: DataFrame, names: DataFrame) -> DataFrame:
    """``dataset, image, outcome``: anomalous if any box is, healthy if all are, else dropped.

    ``found`` has one row per image and line; ``names`` maps ``dataset, class_id`` to
    ``class_name``. No line, no integer id, an unlisted id or a name without a label all drop
    the image; a dataset none of whose names has a label drops out as a whole.
    """
    label = X.infer_label(F.col("class_name"))
    known = names.select("dataset", "class_id", F.when(label.isin(*K.LABELS), label).alias("box"))
    usable = known.filter("box is not null").select("dataset").distinct()
    boxes = (
        found.join(small_side(usable), "dataset", "left_semi")
        .withColumn("class_id", class_id(F.col("line")))
        .join(small_side(known), ["dataset", "class_id"], "left")
    )
    has_id = F.col("class_id").isNotNull()
    per_image = boxes.groupBy("dataset", "image").agg(
        F.count(F.when(has_id, 1)).alias("n"),
        F.count(F.when(has_id & F.col("box").isNull(), 1)).alias("unknown"),
        F.count(F.when(F.col("box") == "anomalous", 1)).alias("anomalous"),
    )
    outcome = (
        F.when((F.col("n") == 0) | (F.col("unknown") > 0), "dropped")
        .when(F.col("anomalous") > 0, "anomalous")
        .otherwise("healthy")
    )
    return per_image.select("dataset", "image", outcome.alias("outcome"))
