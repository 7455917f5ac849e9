"""Streams equal their batch twins, and a restarted hash stream adds nothing twice."""

from pyspark.sql import functions as F

from sparkcurate.operators import decision as D
from sparkcurate.operators import history as HI
from sparkcurate.plans import adapters as A
from sparkcurate.plans import catalog as Q
from sparkcurate.streaming import jobs as ST

FOLDER = "/root/testdata/sf0.001"


def test_decide_stream_is_batch(spark, tmp_path):
    stream = A.vector_scores(ST.read_table_stream(spark, FOLDER, "embeddings.parquet"))
    ST.decide_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = D.decide(A.vector_scores(A.table(spark, FOLDER, "embeddings")))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_table_stream_takes_a_file_and_a_folder_of_files(spark, tmp_path):
    """A table of many files is a folder of the table's name; files that are added to it arrive later."""
    folder, rows = str(tmp_path / "in"), A.table(spark, FOLDER, "embeddings")
    rows.repartition(3).write.parquet(f"{folder}/embeddings.parquet")

    def run(folder, name):
        stream = A.vector_scores(ST.read_table_stream(spark, folder, "embeddings.parquet", max_files=2))
        out = str(tmp_path / f"out-{name}")
        ST.decide_stream(stream, out, str(tmp_path / f"cp-{name}")).awaitTermination()
        return spark.read.parquet(out)

    want = D.decide(A.vector_scores(rows))
    for got in (run(folder, "many"), run(FOLDER, "one")):
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    rows.limit(7).withColumn("vec_id", F.lit(-1).cast("bigint")).write.mode("append").parquet(f"{folder}/embeddings.parquet")
    assert run(folder, "many").count() == want.count() + 7


def test_table_of_many_files_is_hashed(spark, tmp_path):
    rows = A.table(spark, FOLDER, "embeddings").select("vec_id", "embedding")
    rows.repartition(3).write.parquet(str(tmp_path / "in" / "embeddings.parquet"))
    stream = ST.read_table_stream(spark, str(tmp_path / "in"), "embeddings.parquet")
    hasher = lambda batch: batch.select("vec_id", F.array(F.xxhash64("embedding")).alias("orbit"))
    ST.hash_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp"), hasher, key=("vec_id",)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "store")).select("vec_id", "orbit")
    want = hasher(rows.dropDuplicates(["vec_id"]))
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_short_vectors_do_not_end_the_hash_stream(spark, tmp_path):
    """Cells that a vector lacks set no bit, like null ones."""
    whole = [float(i * 37 % 64) for i in range(64)]
    rows = [(1, whole), (2, whole[:40]), (3, []), (4, whole[:40] + [None] * 24), (5, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r[0]: list(r)[1:] for r in Q.stream_hash(spark, str(tmp_path)).collect()}
    assert got[2] == got[4] != got[1] and got[3] == [0] * 8 and got[5] == [0] * 8 and len(got) == 5
    want = got[1][0] & ~((1 << 7 * 3) - 1)  # the first five rows of cells
    assert got[2][0] == want


def test_hash_stream_resumes(spark, tmp_path):
    lake, store = tmp_path / "lake", str(tmp_path / "store")
    files = spark.range(10).select(
        F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("length"), F.lit(1).cast("bigint").alias("mtime_s")
    )
    files.coalesce(1).write.parquet(str(lake))
    hasher = lambda batch: batch.withColumn("orbit", F.when(F.col("length") != 3, F.array("length")))

    def run(progress):
        stream = spark.readStream.schema(files.schema).parquet(str(lake))
        ST.hash_stream(stream, store, str(tmp_path / progress), hasher).awaitTermination()
        return spark.read.parquet(store)

    assert run("one").count() == 10
    assert run("one").count() == 10
    assert run("lost").count() == 10
    files.withColumn("length", F.col("length") + 100).coalesce(1).write.mode("append").parquet(str(lake))
    final = run("one")
    assert final.count() == 20 and final.filter("orbit is null").count() == 1


def test_a_small_batch_reads_little_of_a_large_store(spark, tmp_path):
    """The pages that a look-up of 100 keys reads stay as few while the store grows tenfold."""
    key = ["path", "length"]

    def rows(n):
        return spark.range(n).select(
            F.concat(F.lit("/lake/some/folder/picture-"), F.col("id"), F.lit(".jpg")).alias("path"),
            F.col("id").alias("length"), F.array(*[F.xxhash64("id", F.lit(i)) for i in range(8)]).alias("orbit"),
        )

    def look_up(store, wanted):
        """Keys found, and rows of the pages that the scan had to read for them."""
        may_be = ST.known_keys(spark, store, wanted, key)
        found = spark.createDataFrame(may_be.collect(), "path string, length long").join(wanted, key, "left_semi").count()
        leaves = may_be._jdf.queryExecution().executedPlan().collectLeaves()
        return found, leaves.head().metrics().apply("numOutputRows").value()

    wanted = spark.createDataFrame(
        [(f"/lake/some/folder/picture-{i}.jpg", i) for i in [*range(50), *range(10**9, 10**9 + 50)]], "path string, length long"
    )
    read = {}
    for n in (150_000, 1_500_000):
        store = str(tmp_path / f"store{n}")
        ST.write_hashes(rows(n), store, key, n)
        found, read[n] = look_up(store, wanted)
        assert found == 50
    assert read[1_500_000] < 1.5 * read[150_000] and read[1_500_000] <= 100 * ST.PAGE_ROWS, read
    many = rows(3_000).select("path", "length")
    assert ST.known_keys(spark, store, many, key).join(many, key, "left_semi").count() == 3_000  # beyond the look-ups: a join
    merged = str(tmp_path / "merged")
    ST.merge_hashes(spark, store, merged, key)
    assert look_up(merged, wanted)[0] == 50 and spark.read.parquet(merged).count() == 1_500_000
    assert ST.known_keys(spark, store, wanted.limit(0), key).count() == 0


def test_dashboard_stream_counts_all_rows(spark, tmp_path):
    stream = A.diagnoses(ST.read_table_stream(spark, FOLDER, "events.parquet"))
    ST.dashboard_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert got == A.table(spark, FOLDER, "events").count()


def test_latest_stream_is_the_batch_dashboard(spark, tmp_path):
    lake, out, progress = (str(tmp_path / name) for name in ("lake", "out", "progress"))
    schema = "id long, created_at timestamp, predicted_class string, confidence double"

    def rows(low, high, at):
        return spark.range(low, high).select(
            "id", F.timestamp_seconds(at).alias("created_at"), F.concat(F.lit("c"), F.col("id") % 3).alias("predicted_class"),
            F.when(F.col("id") % 11 != 0, 1 / (F.col("id") + 1)).alias("confidence"),
        )

    def arrives(more):
        more.write.mode("append").parquet(lake)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(lake)
        ST.latest_stream(stream, out, progress, 20).awaitTermination()
        got, want = (HI.dashboard(t, 20) for t in (ST.read_latest(spark, out), spark.read.schema(schema).parquet(lake)))
        look = lambda t: sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in t.collect()), key=str)
        assert look(got) == look(want) and sum(r[1] for r in look(got)) == min(20, spark.read.parquet(lake).count())

    missing = spark.createDataFrame([(7_000, None, None, 0.5)], schema)
    arrives(rows(0, 5, F.col("id")).unionByName(missing))  # fewer than the latest, one without a time
    arrives(rows(100, 900, F.col("id") % 50))  # many ties in time
    arrives(rows(2_000, 2_300, F.lit(10)))  # late, and too old to count
    arrives(rows(3_000, 3_007, F.lit(49)))  # late, but still among the latest
    assert ST.read_latest(spark, out).count() <= 20 * ST.LATEST_PARTS
    ST.latest_stream(spark.readStream.schema(schema).parquet(lake), str(tmp_path / "twin"), str(tmp_path / "own"), 20).awaitTermination()
    newest = lambda t: t.orderBy(F.desc("created_at"), F.desc("id")).limit(20)
    one, two = newest(ST.read_latest(spark, out)), newest(ST.read_latest(spark, str(tmp_path / "twin")))  # in steps, at once
    assert one.count() == two.count() == 20 and one.exceptAll(two).count() == 0
    empty = tmp_path / "empty"
    empty.mkdir()
    ST.latest_stream(spark.readStream.schema(schema).parquet(str(empty)), str(tmp_path / "none"), str(tmp_path / "n"), 20).awaitTermination()
    assert ST.read_latest(spark, str(tmp_path / "none")).count() == 0
