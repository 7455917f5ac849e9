"""Generated pictures through Spark's image source: hashes, groups, gates, listings, sinks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcurate.operators import grouping as G
from sparkcurate.sources import files as FS
from sparkcurate.sources import images as IM


def bmp(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    row = (w * 3 + 3) // 4 * 4
    body = b"".join(rgb[y, :, ::-1].astype(np.uint8).tobytes().ljust(row, b"\0") for y in range(h - 1, -1, -1))
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack(
        "<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0
    ) + body


def photo(rng) -> np.ndarray:
    coarse = rng.uniform(30, 220, (9, 9))
    plane = IM.resize(coarse, 96, 128) + rng.normal(0, 3, (96, 128))
    return np.repeat(np.clip(plane, 0, 255)[:, :, None], 3, axis=2).astype(np.uint8)


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    """40 photos x 7 files, a broken file and one no decoder here can read."""
    root = tmp_path_factory.mktemp("lake")
    rng = np.random.default_rng(11)
    for k in range(40):
        base = photo(rng)
        bright = np.clip(base * rng.uniform(0.75, 1.35), 0, 255).astype(np.uint8)
        small = np.stack([IM.resize(base[:, :, c], 58, 77) for c in range(3)], axis=2)
        for name, rgb in {
            "base": base, "again": base, "turned": np.rot90(base), "half": np.rot90(base, 2),
            "mirror": base[:, ::-1], "bright": bright, "small": small,
        }.items():
            (root / f"p{k:02d}_{name}.bmp").write_bytes(bmp(rgb))
    (root / "broken.BMP").write_bytes(b"BM not a picture")
    (root / "other.webp").write_bytes(b"RIFF....WEBP")
    (root / "notes.txt").write_text("x")
    return root


def test_read_and_group(spark, lake):
    images = IM.read_images(spark, str(lake))
    assert {r["status"]: r["count"] for r in images.groupBy("status").count().collect()} == {
        "readable": 280, "corrupt": 2, "unsupported": 1,
    }
    name = F.element_at(F.split("path", "/"), -1)
    readable = images.filter("status = 'readable'").withColumn("orbit", IM.orbit_of(F.col("image")))
    rows = readable.select(
        "path", "orbit", F.substring(name, 1, 3).alias("photo"), F.xxhash64("path").alias("id")
    ).cache()
    groups = G.near_dup_groups(rows, 4).cache()
    assert groups.select("group_id").distinct().count() == 40
    impure = groups.groupBy("group_id").agg(F.countDistinct("photo").alias("n")).filter("n > 1")
    assert impure.count() == 0
    kinds = rows.filter("path like '%base%' or path like '%turned%' or path like '%mirror%'")
    per_photo = kinds.groupBy("photo").agg(F.countDistinct(F.array_sort("orbit")).alias("n"))
    assert per_photo.filter("n <> 1").count() == 0


def test_listing_never_opens_files(spark, lake):
    files = FS.list_files(spark, str(lake))
    assert files.count() == 282
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    found = files.filter("path like '%BMP'").first()
    assert found["path"].startswith("/") and not found["path"].startswith("//")


def test_vegetation_gate_colours(spark):
    colours = {
        "green": ((60, 160, 50), 1.0), "dark": ((20, 70, 20), 1.0), "yellow": ((150, 170, 40), 1.0),
        "brown": ((140, 100, 60), 0.0), "grey": ((128, 128, 128), 0.0), "blue": ((40, 80, 200), 0.0),
        "black": ((0, 0, 0), 0.0),
    }
    for rgb, share in colours.values():
        assert IM.green_share(np.full((40, 50, 3), rgb, dtype=np.uint8)) == share


def test_model_input_and_variants(spark, lake):
    images = IM.read_images(spark, str(lake)).filter("path like '%p00_base%'")
    values = images.select(IM.model_input_of(F.col("image")).alias("x")).first()["x"]
    x = np.array(values).reshape(3, 224, 224)
    assert x.shape == (3, 224, 224) and -2.2 < x.min() < x.max() < 2.8
    copies = IM.make_variants(images, 12)
    hashed = copies.select("variant", IM.orbit_of(F.col("image")).alias("orbit"), F.col("variant").cast("bigint").alias("id"))
    assert copies.count() == 12
    assert G.near_dup_groups(hashed, 4).select("group_id").distinct().count() == 1


def test_resampling_rows_sum_to_one():
    for kernel in (IM.lanczos_matrix, IM.triangle_matrix, IM.cubic_matrix):
        for source, target in ((32, 8), (32, 9), (7, 32), (1, 5)):
            assert np.allclose(kernel(source, target).sum(axis=1), 1.0)
    assert IM.difference_hash(np.tile(np.arange(9), (8, 1))) == -1


def test_flat_pictures_hash_to_zero():
    assert set(IM.image_orbit(np.full((20, 30, 3), 77, dtype=np.uint8))) == {0}


def test_sinks_round_trip(spark, tmp_path):
    manifest = spark.createDataFrame(
        [("a", "ds", "train", "healthy"), ("b", "ds", "test", "anomalous")],
        "path string, dataset string, split string, label string",
    )
    FS.write_manifest(manifest, str(tmp_path / "m"))
    assert (tmp_path / "m/split=train/label=healthy").is_dir()
    assert FS.read_manifest(spark, str(tmp_path / "m")).select(*manifest.columns).exceptAll(manifest).count() == 0
    diagnoses = spark.createDataFrame([(1, {"a": 0.5})], "id bigint, scores map<string,double>")
    for _ in range(2):
        FS.append_diagnoses(diagnoses, str(tmp_path / "d"))
    back = FS.read_diagnoses(spark, str(tmp_path / "d"))
    assert back.count() == 2 and back.first()["scores"] == {"a": 0.5}
    FS.write_report(spark.range(1), str(tmp_path / "r"))
    FS.write_csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    rows = spark.createDataFrame([("p", "healthy", "healthy", 0.5, None, "hit")], "path string, truth string, answer string, confidence double, veg_fraction double, hit string")
    FS.write_field_rows(rows, str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).first()["confidence"] == "0.5000"


def test_history_logs(spark, tmp_path):
    from sparkcurate.operators.history import explode_history

    (tmp_path / "good.json").write_text('{"model": "m", "history": [{"epoch": 1, "val_acc": 0.5}, {"epoch": 2}]}')
    (tmp_path / "bad.json").write_text('{"model": ')
    logs = FS.read_history(spark, str(tmp_path))
    assert logs.count() == 2
    assert [(r["model"], r["epoch"]) for r in explode_history(logs).collect()] == [("m", 1), ("m", 2)]


def test_a_decoder_of_ones_own(spark, tmp_path):
    """Formats are told by their first bytes; what a decoder cannot read stays corrupt, others unsupported."""
    def decode(data):
        side = data[12]
        if not side:
            raise ValueError("empty picture")
        return np.full((side, 2 * side, 3), [10, 20, 30], np.uint8)

    good = b"RIFF\0\0\0\0WEBP"
    (tmp_path / "a.webp").write_bytes(good + b"\x04")
    (tmp_path / "named.jpg").write_bytes(good + b"\x02")  # the bytes decide, not the name
    (tmp_path / "bad.webp").write_bytes(good + b"\x00")
    (tmp_path / "other.avif").write_bytes(b"\0\0\0\x20ftypavif")
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nno more")
    (tmp_path / "note.txt").write_bytes(b"text")
    found = IM.read_images(spark, str(tmp_path), {"webp": decode})
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.image.height, r.image.width) for r in found.collect()}
    assert got == {
        "a.webp": ("readable", 4, 8), "named.jpg": ("readable", 2, 4), "bad.webp": ("corrupt", -1, -1),
        "other.avif": ("unsupported", -1, -1), "broken.png": ("corrupt", -1, -1), "note.txt": ("corrupt", -1, -1),
    }
    image = found.filter("path like '%a.webp'").first().image
    assert (IM.as_rgb(image.data, 4, 8, image.nChannels) == [10, 20, 30]).all()
    orbit = found.filter("status = 'readable'").select(IM.orbit_of(F.col("image")).alias("o")).collect()
    assert all(len(r.o) == 8 for r in orbit)
    plain = {r.path.rsplit("/", 1)[1]: r.status for r in IM.read_images(spark, str(tmp_path)).collect()}
    assert plain["a.webp"] == "unsupported" and plain["named.jpg"] == "corrupt"


def test_pixels_are_read_from_arrow(spark):
    """A batch is taken as Arrow holds it, picture by picture; null, empty and unreadable ones have no hash and leave the others'."""
    rng = np.random.default_rng(3)
    pictures = [photo(rng) for _ in range(3)]
    rows = [(k, ("", *p.shape[:2], 3, 16, bytearray(p[:, :, ::-1].tobytes()))) for k, p in enumerate(pictures)]
    rows += [(3, None), (4, ("", -1, -1, -1, -1, bytearray())), (5, ("", 4, 4, 3, 16, None))]
    df = spark.createDataFrame(rows, f"id int, image {IM.IMAGE}").coalesce(1)
    batch = df.toArrow().column("image").combine_chunks()
    found = list(IM._pixels_of(batch))
    assert [p is None for p in found] == [False] * 3 + [True] * 3
    assert all(np.array_equal(p, q) for p, q in zip(found, pictures))
    got = {r.id: (r.d, r.o) for r in df.select("id", IM.dhash_of("image").alias("d"), IM.orbit_of("image").alias("o")).collect()}
    assert {k: o for k, (_, o) in got.items()} == {k: IM.image_orbit(p) if k < 3 else None for k, p in enumerate(pictures + [0] * 3)}
    assert [got[k][0] is None for k in range(6)] == [False] * 3 + [True] * 3
    assert df.filter("id < 3").select(IM.dhash_of("image")).collect() == [(IM.image_dhash(p),) for p in pictures]
