"""Tables of the library's own shapes, derived from the given parquet tables."""

from __future__ import annotations

from functools import cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcurate.functions import hashing as H
from sparkcurate.functions import text as X

GRID_CELLS = 72


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_cores(df: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out over the cores. One file of a few megabytes is one task however
    long its rows take; a scan of more than ``SMALL_SCAN`` bytes, by the optimizer's own estimate, has
    enough tasks and stays where it is."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if int(str(size)) < SMALL_SCAN else df


SMALL_SCAN = 256 << 20
CACHED_WORDS = 200_000
_LETTERS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Cells(dict):
    """The cell of each word, its md5 modulo 72, worked out where it is asked for first."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = cell = int(md5(word).hexdigest()[:8], 16) % GRID_CELLS
        return cell


@cache
def _cells() -> Cells:
    return Cells()


def text_hash(text: Column) -> Column:
    """Difference hash of a text's words ``[a-z0-9]+`` counted over a grid of 8 x 9 cells: one pass over each
    text in Arrow batches, bits and all; null for texts without a word. No word is shuffled."""
    return _hashes(F.lower(text))


@F.arrow_udf(T.LongType())
def _hashes(lowered: pa.Array) -> pa.Array:
    cell = _cells().__getitem__
    counts = np.zeros((len(lowered), GRID_CELLS), np.int64)
    none = np.ones(len(lowered), bool)
    for row, text in enumerate(lowered):
        if text.is_valid and (words := text.as_py().encode("utf-8", "surrogatepass").translate(_LETTERS).split()):
            counts[row] = np.bincount(np.fromiter(map(cell, words), np.int64, len(words)), minlength=GRID_CELLS)
            none[row] = False
    grid = counts.reshape(-1, 8, 9)
    bits = (grid[:, :, 1:] > grid[:, :, :-1]).reshape(-1, 64)
    return pa.array(np.packbits(bits, axis=1).view(">i8")[:, 0].astype(np.int64), mask=none)


def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: id, path, source, label, n_chars, and a one-hash orbit made from the
    8x9 word grid of the whole text. A text without a word counts as an unreadable file (null
    orbit)."""
    docs = fill_cores(
        table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    )
    odd = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 1
    label = F.when(odd, "anomalous").otherwise("healthy")
    name = F.concat("source", F.lit("__"), F.format_string("%08d", "doc_id"), F.lit(".txt"))
    hashed = docs.withColumn("_hash", text_hash(F.col("text")))
    named = hashed.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("staging/"), label, F.lit("/"), name).alias("path"),
        "source",
        label.alias("label"),
        "n_chars",
        F.col("_hash"),
    )
    return named.withColumn("orbit", F.when(F.col("_hash").isNotNull(), F.array("_hash"))).drop("_hash")


def square_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 grids with the eight hashes of the square's moves: ``id, orbit``."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rows.select("id", H.grid_orbit(F.col("embedding"), 8).alias("orbit"))


OUTER_DIRS = ("raw", "color", "Lettuce_diseases", "background", "train_set", "Healthy_crops", "images")
CLASS_DIRS = (
    "Tomato___healthy", "Tomato___Late_blight", "Pepper,_bell___healthy",
    "Corn_(maize)___Cercospora_leaf_spot Gray_leaf_spot", "Potato___Early_blight",
    "Apple___Apple_scab", "Shepherd_purse", "spotlight", "unhealthy", "weed_healthy",
    "Squash___Powdery_mildew", "Strawberry___Leaf_scorch", "misc", "grape leaf black rot",
    "Apple leaf",
)
SUFFIXES = (".jpg", ".JPG", ".png", ".bmp", ".tif", ".tiff", ".webp", ".txt", ".gif")


def source_number() -> Column:
    return F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a raw file lake: ``id, path, folder, n_chars, lang``. Every fifth source has
    direct healthy/ and anomalous/ folders, the others one or two levels of class folders."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    k = F.col("doc_id")
    pick = lambda names, n: X.lit_strings(names)[(k % n).cast("int")]
    short = source_number() % 5 == 0
    dirs = (
        F.when(short & (k % 3 == 0), F.when(k % 2 == 0, "healthy").otherwise("anomalous"))
        .when(short & (k % 3 == 1), "healthy/extra")
        .when(k % 11 == 0, pick(OUTER_DIRS, 7))
        .otherwise(F.concat(pick(OUTER_DIRS, 7), F.lit("/"), pick(CLASS_DIRS, 15)))
    )
    return docs.select(
        k.alias("id"),
        F.concat("source", F.lit("/"), dirs, F.lit("/"), k.cast("string"), pick(SUFFIXES, 9)).alias("path"),
        pick(CLASS_DIRS, 15).alias("folder"),
        "source",
        "n_chars",
        "lang",
    )


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label: ``id, path, source, label, label_idx, toxic, n_chars``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    name = F.concat("source", F.lit("__"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        name.alias("path"),
        "source",
        F.when(F.col("quality") == 1, "healthy").otherwise("anomalous").alias("label"),
        F.col("quality").cast("int").alias("label_idx"),
        F.col("toxic").cast("int").alias("toxic"),
        "n_chars",
    )


SCORE_MODELS = (("m_len", 1.0, 6.0), ("m_sharp", 3.0, 7.0), ("m_flat", 0.3, 9.0))


def scores2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-class scores of three simple models of text length; truth is quality."""
    models = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b"))
            for m, a, b in SCORE_MODELS
        ]
    )
    rows = labelled_docs(spark, sf_dir).withColumn("m", F.explode(models))
    return rows.select(
        "id",
        F.col("m.model").alias("model"),
        F.when(F.col("id") % 2 == 0, "val").otherwise("test").alias("split"),
        "label_idx",
        "toxic",
        F.array(F.lit(0.0), F.col("m.a") * (F.log("n_chars") - F.col("m.b"))).alias("logits"),
    )


def veg_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, vegetation_fraction``: the share of a-z letters in the whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    letters = F.length(F.regexp_replace(F.lower("text"), "[^a-z]", ""))
    return docs.select(F.col("doc_id").alias("id"), (letters / F.col("n_chars")).alias("vegetation_fraction"))


def scores10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class scores: 40 x dot product of odd vectors with the class means of the even ones.

    The means are the model: classes x dimensions numbers, whatever the size of the table.
    """
    rows = table(spark, sf_dir, "embeddings")
    means = (
        rows.filter("vec_id % 2 = 0")
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("center"))
        .orderBy("label")
        .collect()
    )
    dots = []
    for row in means:
        center = F.expr("array(" + ", ".join(f"double('{x!r}')" for x in row["center"]) + ")")
        products = F.zip_with(F.col("embedding"), center, lambda a, b: a.cast("double") * b)
        dots.append(40.0 * F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x))
    return rows.filter("vec_id % 2 = 1").select(
        F.col("vec_id").alias("id"),
        F.lit("c10").alias("model"),
        F.lit("val").alias("split"),
        F.col("label").cast("int").alias("label_idx"),
        F.array(*dots).alias("logits"),
    )


MODEL_NAMES = ("mobilenet_v2", "resnet50", "efficientnet_b0", "vit_b_16")


def diagnoses(events: DataFrame) -> DataFrame:
    """Events as decision history; works on a batch and on a stream."""
    predicted = (
        F.when(F.col("event_type") == "view", "saudavel")
        .when(F.col("event_type") == "click", "mildio")
        .otherwise(F.col("event_type"))
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        X.lit_strings(MODEL_NAMES)[(F.col("user_id") % 4).cast("int")].alias("model_name"),
        predicted.alias("predicted_class"),
        (F.col("value") / (F.col("value") + 50.0)).alias("confidence"),
        F.lit(True).alias("demo_mode"),
    )


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training history: a user is a model, the event number its epoch."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("model"), F.col("event_id").alias("epoch"), F.col("value").alias("val_f1")
    )


BOX_NAMES = ("Healthy", "Downy_mildew", "Bacterial", "Thing")


def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as annotation lines: two events make an image, a few lines are blank, broken or name an
    unlisted class: ``dataset, labels_dir, stem, line``."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    number = (
        F.when(F.col("event_type").isin("view", "purchase"), "0")
        .when(F.col("event_type") == "click", "1")
        .when(F.col("event_type") == "signup", "2")
        .when(F.col("value") < 10, "abc")
        .when(F.col("value") < 20, "9")
        .otherwise("3")
    )
    image = F.floor(F.col("event_id") / 2).cast("bigint")
    dataset = F.concat(F.lit("boxes"), (image % 3).cast("string"))
    line = F.concat(number, F.lit(" 0.5 0.5 0.1 0.1"))
    return events.select(
        dataset.alias("dataset"),
        F.when(image % 2 == 0, F.concat(dataset, F.lit("/train/labels")))
        .otherwise(F.concat(dataset, F.lit("/labels/train")))
        .alias("labels_dir"),
        F.concat(F.lit("img"), image.cast("string")).alias("stem"),
        F.when(F.col("value") < 2, "").otherwise(line).alias("line"),
    )


def box_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images those lines belong to, with both places their annotations may lie in."""
    events = table(spark, sf_dir, "events").select("event_id").filter("event_id % 2 = 0")
    image = F.floor(F.col("event_id") / 2).cast("bigint")
    dataset = F.concat(F.lit("boxes"), (image % 3).cast("string"))
    return events.select(
        dataset.alias("dataset"),
        image.alias("image"),
        F.when(image % 2 == 0, F.concat(dataset, F.lit("/train/labels")))
        .otherwise(F.concat(dataset, F.lit("/train2/labels")))
        .alias("labels_dir_1"),
        F.concat(dataset, F.lit("/labels/train")).alias("labels_dir_2"),
        F.concat(F.lit("img"), image.cast("string")).alias("stem"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as RGB pixels: ``id, r, g, b`` in 0..255, a pixel for each three numbers of the vector
    and one for what is left over, whose missing channels are 0."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    level = lambda x: F.least(F.floor(F.abs(x.cast("double")) * 1000.0), F.lit(255)).cast("double")
    triples = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 3).cast("int")),
        lambda k: F.struct(
            *[
                level(F.coalesce(F.get("embedding", (k * 3 + c).cast("int")), F.lit(0.0))).alias(name)
                for c, name in enumerate("rgb")
            ]
        ),
    )
    return rows.select(F.col("vec_id").alias("id"), F.explode(triples).alias("p")).select("id", "p.*")


def vector_scores(rows: DataFrame) -> DataFrame:
    """Embeddings as rows to decide on: ``id, model, logits, vegetation_fraction``. The logits are the sums
    of the vector's two halves, the fraction its mean size, in whole thousandths of each number so
    that sums are exact; works on a batch and on a stream."""
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000.0).cast("bigint"))
    half = F.floor(F.size("embedding") / 2).cast("int")
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        F.col("vec_id").alias("id"),
        F.lit("stream").alias("model"),
        F.array(
            add(F.slice(whole, F.lit(1), half)) / 200.0,
            add(F.slice(whole, half + 1, F.size("embedding"))) / 200.0,
        ).alias("logits"),
        (add(F.transform(whole, lambda x: F.abs(x))) / F.size("embedding") / 500.0).alias("vegetation_fraction"),
    )


def text_images(spark: SparkSession, sf_dir: str, width: int = 48) -> DataFrame:
    """Documents as pictures: ``id, image``, the bytes of the whole text as BGR pixels, row by row
    and padded to full rows."""
    docs = fill_cores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length("text")
    height = F.greatest(F.ceil(size / (width * 3)), F.lit(1)).cast("int")
    data = F.rpad(F.encode("text", "UTF-8"), height * (width * 3), F.unhex(F.lit("20")))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.struct(
            F.lit("").alias("origin"),
            height.alias("height"),
            F.lit(width).alias("width"),
            F.lit(3).alias("nChannels"),
            F.lit(16).alias("mode"),
            data.alias("data"),
        ).alias("image"),
    )
