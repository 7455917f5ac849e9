"""The folder of a job goes with it."""

from pathlib import Path

from sparkcurate.session import job, new_path, store
from sparkcurate.sources import files


def test_job_folder_is_cleared(spark):
    with job(spark) as folder:
        table = store(spark.range(5).toDF("id"))
        assert table.count() == 5 and table.inputFiles()[0].removeprefix("file:").lstrip("/").startswith(folder.lstrip("/"))
        assert new_path(spark, "x").startswith(folder)
    assert not Path(folder).exists() and not new_path(spark, "x").startswith(folder)


def test_groups_keep_their_key(spark, tmp_path):
    groups = spark.createDataFrame([("a.jpg", 1, "k", 5), ("b.jpg", 1, "k", 6)], "path string, group_id bigint, group_key string, x int")
    files.write_groups(groups, str(tmp_path / "g"))
    assert sorted(map(tuple, files.read_groups(spark, str(tmp_path / "g")).collect())) == [("a.jpg", 1, "k"), ("b.jpg", 1, "k")]


def test_annotations_below_a_root_without_scheme(spark, tmp_path):
    for root in ("plain", "with space"):
        labels = tmp_path / root / "set1" / "labels" / "train"
        labels.mkdir(parents=True)
        (labels / "a.txt").write_text("0 1 1 1 1\n\n2 1 1 1 1\n")
        (labels / "empty.txt").write_text("")
        names, lines = files.read_annotations(spark, str(tmp_path / root))
        found = {(r["dataset"], r["stem"], r["line"]) for r in lines.collect()}
        assert {("set1", "a", "0 1 1 1 1"), ("set1", "a", "2 1 1 1 1")} <= found and {d for d, _, _ in found} == {"set1"}
        assert names.count() == 0
