"""Labels from names, paths, annotations; extensions; class maps."""

import pytest
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.functions import text as X
from sparkcurate.operators import labeling as L
from sparkcurate.sources import files as FS


def column(spark, values, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_infer_label(spark):
    cases = {
        "Tomato___healthy": "healthy",
        "Tomato___Late_blight": "anomalous",
        "Septoria_leaf_spot": "anomalous",
        "spotlight": None,
        "Shepherd_purse": "ignore",
        "weed_healthy": "ignore",
        "healthy_spot": "healthy",
        "not_healthy": "healthy",
        "unhealthy": None,
        "diseases": None,
        "saudável": None,
        "": None,
    }
    assert column(spark, cases, X.infer_label) == list(cases.values())


def test_label_from_path_is_nearest_to_root(spark):
    cases = {
        "ds/healthy/late_blight/x.jpg": "healthy",
        "ds/background/healthy/x.jpg": "ignore",
        "healthy/raw/x_blight.jpg": None,
        "ds/x.jpg": None,
        "ds/a/b/rust/x.jpg": "anomalous",
    }
    assert column(spark, cases, L.label_from_path) == list(cases.values())


def test_extensions(spark):
    names = ["a/b.JPG", "a/b.tif", "a/b.webp", "a/b", "a/.jpg", "a.jpg/b.txt", "a/b.tar.png"]
    assert column(spark, names, X.file_extension) == [".jpg", ".tif", ".webp", "", "", ".txt", ".png"]
    assert column(spark, names, lambda c: X.has_extension(c, K.FIELD_EXTENSIONS)) == [
        True, False, True, False, False, False, True,
    ]


def test_source_of(spark):
    assert column(spark, ["pv__a__b.jpg", "a_b.jpg", "__x"], X.source_of) == ["pv", "desconhecido", ""]


def test_shortcut_audit_and_leaves(spark):
    paths = [
        "s1/healthy/a.jpg", "s1/healthy/deep/b.jpg", "s1/rust/c.jpg",
        "s2/x/healthy/d.jpg", "s2/x/e.jpg", "s2/y/f.jpg", "s2/y/g.jpg", "s2/misc/rust/h.jpg", "s2/i.jpg",
    ]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    labelled = L.label_files(files, hot_rows=2)
    got = {r["path"]: (r["label"], r["status"]) for r in labelled.collect()}
    assert got == {
        "s1/healthy/a.jpg": ("healthy", "labelled"),
        "s1/healthy/deep/b.jpg": (None, "outside_shortcut"),
        "s1/rust/c.jpg": (None, "outside_shortcut"),
        "s2/x/healthy/d.jpg": ("healthy", "labelled"),
        "s2/x/e.jpg": (None, "unlabelled"),
        "s2/y/f.jpg": (None, "unlabelled"),
        "s2/y/g.jpg": (None, "unlabelled"),
        "s2/misc/rust/h.jpg": (None, "ignored"),
        "s2/i.jpg": (None, "unlabelled"),
    }
    leaves = [tuple(r) for r in L.unrecognized_dirs(labelled).collect()]
    assert leaves == [("s2", "y", 2)]


def test_annotation_cases(spark):
    names = spark.createDataFrame(
        [("ds", "names: ['Bacterial', Downy_mildew, \"Healthy\", Thing]\n"),
         ("none", "names:\n  - Thing\n  - Other thing\nnc: 2\n")],
        "dataset string, value string",
    )
    names = FS.annotation_names(names)
    assert {(r["dataset"], r["class_id"], r["class_name"]) for r in names.collect()} == {
        ("ds", 0, "Bacterial"), ("ds", 1, "Downy_mildew"), ("ds", 2, "Healthy"), ("ds", 3, "Thing"),
        ("none", 0, "Thing"), ("none", 1, "Other thing"),
    }
    cases = {
        "one": (["0 .1 .2"], "anomalous"),
        "two": (["2 .1"], "healthy"),
        "mixed": (["2 .1", "1 .1"], "anomalous"),
        "unknown": (["2 .1", "3 .1"], "dropped"),
        "unlisted": (["9 .1"], "dropped"),
        "nothing": ([None], "dropped"),
        "bad": (["abc"], "dropped"),
        "bad_and_good": (["abc", "  2 .1"], "healthy"),
        "not_integer": (["2.0 1", "2 1"], "healthy"),
    }
    rows = [("ds", image, line) for image, (lines, _) in cases.items() for line in lines]
    rows.append(("none", "image", "0 .1"))
    found = spark.createDataFrame(rows, "dataset string, image string, line string")
    got = {r["image"]: r["outcome"] for r in L.annotation_labels(found, names).collect()}
    assert got == {image: outcome for image, (_, outcome) in cases.items()}


def test_annotation_directories(spark):
    images = spark.createDataFrame(
        [("ds", "i1", "ds/train/labels", "ds/labels/train", "i1"),
         ("ds", "i2", "ds/val/labels", "ds/labels/val", "i2"),
         ("ds", "i3", "ds/train/labels", "ds/labels/train", "i3")],
        "dataset string, image string, labels_dir_1 string, labels_dir_2 string, stem string",
    )
    lines = spark.createDataFrame(
        [("ds", "ds/train/labels", "i1", "1"), ("ds", "ds/labels/val", "i2", "2"),
         ("ds", "ds/labels/train", "i3", "3")],
        "dataset string, labels_dir string, stem string, line string",
    )
    got = {r["image"]: r["line"] for r in L.find_annotations(images, lines).collect()}
    assert got == {"i1": "1", "i2": "2", "i3": None}


def test_class_map_drops_comments(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"_note": "x", "a": "mildio", "b": "oidio"}')
    rows = FS.read_class_map(spark, str(tmp_path / "map.json")).collect()
    assert {tuple(r) for r in rows} == {("a", "mildio"), ("b", "oidio")}


def test_read_annotations(spark, tmp_path):
    (tmp_path / "ds1/train/labels").mkdir(parents=True)
    (tmp_path / "ds1/data.yaml").write_text("nc: 2\nnames:\n- a\n- b\n")
    (tmp_path / "ds1/train/labels/i1.txt").write_text("0 1 1\n\n 1 2 2\n")
    (tmp_path / "ds1/train/labels/i2.txt").write_text("\n \n")
    (tmp_path / "ds1/train/labels/i3.txt").write_text("")
    names, lines = FS.read_annotations(spark, str(tmp_path))
    assert {tuple(r) for r in names.collect()} == {("ds1", 0, "a"), ("ds1", 1, "b")}
    got = {(r["stem"], r["line"]) for r in lines.collect()}
    assert got == {("i1", "0 1 1"), ("i1", "1 2 2"), ("i2", None)}


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_copy_counts_and_dedupe(spark, hot_rows):
    planned = spark.createDataFrame([("a", "p1"), ("a", "p0"), ("b", "p2")], "dest string, path string")
    first = {r["dest"]: (r["path"], r["collisions"]) for r in L.keep_first(planned).collect()}
    assert first == {"a": ("p0", 1), "b": ("p2", 0)}
    there = planned.filter("dest = 'b'").select("dest")
    assert tuple(L.copy_counts(planned, there).first()) == (2, 1)
    assert {r["dest"] for r in L.copy_plan(planned, there).collect()} == {"a"}
