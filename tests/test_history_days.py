"""A history in folders by day: deletes rewrite the touched days only."""

from pathlib import Path

from pyspark.sql import functions as F

from sparkcurate.sources import files as FS


def test_a_delete_leaves_other_days_untouched(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.range(1_000).select(
        "id", F.expr("if(id = 999, null, timestamp '2024-01-01' + make_interval(0, 0, 0, int(id % 10)))").alias("created_at"),
        F.create_map(F.lit("a"), F.col("id") / 3).alias("scores"),
    )
    FS.append_history(rows.filter("id < 500"), path)
    FS.append_history(rows.filter("id >= 500"), path)

    def state():
        return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("part-*.parquet")}

    def ids():
        return {r[0] for r in FS.read_history(spark, path).select("id").collect()}

    def gone(condition):
        before = state()
        touched = FS.delete_history(spark, path, rows.filter(condition).select("id"))
        same = {f for f, at in state().items() if before.get(f) == at}
        return touched, {Path(f).parent.name for f in before} - {Path(f).parent.name for f in same}

    assert ids() == set(range(1_000))
    assert gone("id in (3, 13, 27)") == (2, {"day=2024-01-04", "day=2024-01-08"})
    assert ids() == set(range(1_000)) - {3, 13, 27}
    assert gone("id in (3, 13)") == (0, set())  # once more: nothing is left to do
    assert gone("id % 10 = 5") == (1, {"day=2024-01-06"})  # a whole day
    assert gone("id = 999") == (1, {"day=__HIVE_DEFAULT_PARTITION__"})  # without a time
    assert gone("id > 5000") == (0, set())
    want = {i for i in range(999) if i % 10 != 5} - {3, 13, 27}
    assert ids() == want
    kept = FS.read_history(spark, path).join(rows.select("id", F.col("scores").alias("was")), "id")
    assert kept.filter("scores['a'] = was['a']").count() == len(want)
    assert FS.read_history(spark, path).filter("day = date '2024-01-02'").count() == 100
