"""Incremental twins of the batch jobs: decide, hash, and count as files arrive.

Each writes to a table and keeps its progress in a checkpoint of its own; with
``availableNow`` it takes what is there and stops, and the next run goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkcurate.operators import decision as D


def read_table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None):
    """The table ``name`` of ``folder`` as it arrives, with the schema of what is there: one file of that name, or a
    folder of that name to which files are added."""
    table = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(table).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(table)
    return reader.option("pathGlobFilter", name).parquet(folder)


def decide_stream(
    rows: DataFrame, out: str, checkpoint: str, calibration: DataFrame | None = None, **options
) -> StreamingQuery:
    """Gate, calibrate, abstain, append: stateless, so the batch plan runs on the stream."""
    return (
        D.decide(rows, calibration, **options)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: Name of the hash of a row's key, by which every file of a hash store is sorted.
KEY_HASH = "key_hash"
#: Keys of a batch up to which they are looked up by value; more are joined.
LOOK_UPS = 1_000
#: Rows of a page: what one look-up reads at least.
PAGE_ROWS = 500


#: Rows of a file of a hash store, at most.
FILE_ROWS = 200_000


def write_hashes(rows: DataFrame, store: str, key: list[str], n_rows: int) -> None:
    """Appends to a hash store: files that hold separate ranges of the keys' hashes, sorted by hash in small pages, so that
    a key is found from the smallest and largest values of files and pages. ``n_rows`` is how many rows there
    may be; hashes are even, so equal ranges are files of equal size without looking at the rows first."""
    n_files = max(1, -(-n_rows // FILE_ROWS))
    above = F.shiftright(KEY_HASH, 32) + F.lit(2**31)  # the upper half, from 0 on
    dealt = rows.withColumn(KEY_HASH, F.xxhash64(*key)).repartitionById(n_files, (above * n_files / 2**32).cast("int"))
    sink = dealt.sortWithinPartitions(KEY_HASH).write.mode("append").option("parquet.page.row.count.limit", PAGE_ROWS)
    sink.parquet(store)


def known_keys(spark: SparkSession, store: str, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The keys in the store that may be among ``wanted``. Up to ``LOOK_UPS`` of them are sent to the scan by value,
    which then reads only the pages they can lie in; more are joined by hash."""
    known = spark.read.parquet(store)
    codes = wanted.select(F.xxhash64(*key).alias(KEY_HASH)).distinct()
    few = [row[0] for row in codes.limit(LOOK_UPS + 1).collect()]
    if len(few) > LOOK_UPS:
        return known.join(codes, KEY_HASH, "left_semi").select(*key)
    # Lists of ten reach the pages as single values; a longer list would as its smallest and largest only.
    tens = [F.col(KEY_HASH).isin(few[i : i + 10]) for i in range(0, len(few), 10)]
    while len(tens) > 1:  # a balanced tree: a long chain of "or" would be as deep as it is long
        tens = [a | b for a, b in zip(tens[::2], tens[1::2])] + tens[len(tens) & ~1 :]
    return known.filter(tens[0] if tens else F.lit(False)).select(*key)


def merge_hashes(spark: SparkSession, store: str, out: str, key: list[str]) -> None:
    """A store of many small batches, written anew with few files that hold separate ranges of key hashes.
    Meant for a pause between two runs, after which ``out`` takes the store's place."""
    rows = spark.read.parquet(store)
    write_hashes(rows.drop(KEY_HASH), out, key, rows.count())


def hash_stream(files: DataFrame, store: str, checkpoint: str, hasher, key=("path", "length", "mtime_s")):
    """Hash what the store does not know yet and append it, batch by batch.

    ``hasher`` maps a batch to ``key`` plus ``orbit``. A batch that is replayed after a crash
    finds its own rows in the store and adds nothing. A small batch reads the pages its keys can lie in and the
    files' footers, whatever the store holds; ``merge_hashes`` keeps the number of files low.
    """
    key = list(key)

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        todo = batch.dropDuplicates(key)
        if there:
            todo = todo.join(known_keys(spark, store, batch, key), key, "left_anti")
        write_hashes(hasher(todo), store, key, batch.count())

    return (
        files.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dashboard_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running count and mean confidence per class over *all* rows seen (the batch dashboard
    shows the latest 200). The state is a line per class; each trigger rewrites the table."""
    counts = rows.groupBy("predicted_class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence")
    )

    def run(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: Parts that each keep their own newest rows; a number of the stream, not to be changed once it runs.
LATEST_PARTS = 16
#: Stands for a missing time or id, which counts as the oldest, as in the batch dashboard.
MISSING = -(2**63)
LATEST = "part int, at long, id long, predicted_class string, confidence string"


def _newest(batches: Iterator[pa.RecordBatch], latest: int) -> Iterator[pa.RecordBatch]:
    """The newest rows of a partition."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        held = rows.sort_by([("at", "descending"), ("id", "descending")]).slice(0, latest).combine_chunks()
    if held is not None:
        yield from held.to_batches()


def latest_stream(rows: DataFrame, out: str, checkpoint: str, latest: int) -> StreamingQuery:
    """Keeps the ``latest`` newest decisions of all that ever arrived, for ``read_latest``.

    Rows ``id, created_at, predicted_class, confidence`` (id a whole number), in any order: a late row takes the place it
    would have had. The newest rows are among the newest of each part of the ids, so every part holds its
    own ``latest`` rows as state and no task sees all. Before the shuffle each input partition leaves out all but
    its newest rows, so a long backlog moves only ``latest`` rows a partition. Touched parts are
    overwritten in ``out``; a trigger that is replayed after a crash writes the same parts again.
    """
    coded = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(LATEST_PARTS)).cast("int").alias("part"),
        F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(MISSING)).alias("at"),
        F.coalesce(F.col("id").cast("long"), F.lit(MISSING)).alias("id"),
        F.col("predicted_class").cast("string").alias("predicted_class"),
        F.col("confidence").cast("double").cast("string").alias("confidence"),
    )
    names = ["at", "id", "predicted_class", "confidence"]

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            held += zip(*(frame[name].tolist() for name in names))
            held = sorted(held, key=lambda row: row[:2], reverse=True)[:latest]
        columns = tuple(map(list, zip(*held)))
        state.update(columns)
        yield pd.DataFrame({"part": key[0], **dict(zip(names, columns))})

    kept = coded.mapInArrow(lambda batches: _newest(batches, latest), LATEST).groupBy("part").applyInPandasWithState(
        keep, LATEST, "at array<long>, id array<long>, predicted_class array<string>, confidence array<string>",
        "update", GroupStateTimeout.NoTimeout,
    )

    def run(batch: DataFrame, _: int) -> None:
        touched = batch.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        touched.partitionBy("part").parquet(out)

    spark = rows.sparkSession
    spark.createDataFrame([], LATEST).write.mode("append").partitionBy("part").parquet(out)  # there is a table from the start
    return (
        kept.writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """What ``latest_stream`` holds: the newest rows of all are among these, which are at most ``LATEST_PARTS`` times
    as many as asked for. The columns are those the dashboard takes."""
    known = lambda name: F.when(F.col(name) != MISSING, F.col(name))
    return spark.read.schema(LATEST).parquet(out).select(
        known("id").alias("id"), F.timestamp_micros(known("at")).alias("created_at"), "predicted_class",
        F.col("confidence").cast("double").alias("confidence"),
    )
