"""Image jobs: hash orbits, vegetation share, model input, and copies for duplicate tests.

Spark decodes and partitions the images (``image`` source); the functions here are small numpy
helpers for one picture, called batch by batch through Arrow.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.functions.hashing import square_moves


#: What the files of a format start with: (offset, bytes) pairs.
MAGIC = {
    "jpeg": ((0, b"\xff\xd8\xff"),), "png": ((0, b"\x89PNG\r\n\x1a\n"),), "gif": ((0, b"GIF8"),), "bmp": ((0, b"BM"),),
    "tiff-le": ((0, b"II*\0"),), "tiff-be": ((0, b"MM\0*"),), "webp": ((0, b"RIFF"), (8, b"WEBP")), "avif": ((4, b"ftypavif"),),
    "heic": ((4, b"ftypheic"),),
}
#: Formats that Spark's own image source can read.
BUILT_IN = ("jpeg", "png", "gif", "bmp", "tiff-le", "tiff-be")
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def format_of(content: Column) -> Column:
    """Name of the format that a file's first bytes tell; null if none does."""
    name = F.lit(None).cast("string")
    for kind, marks in MAGIC.items():
        same = F.lit(True)
        for at, mark in marks:
            same = same & (F.substring(content, at + 1, len(mark)) == F.lit(mark))
        name = F.when(same, kind).otherwise(name)
    return name


def decode_with(decoders: dict[str, Callable[[bytes], np.ndarray]], path: Column, content: Column, kind: Column) -> Column:
    """Spark's image struct from file contents, by the decoder of each file's format: bytes to an RGB array of
    (height, width, 3). Null where there is none for it, or where it fails or returns something else."""

    @F.pandas_udf(IMAGE)
    def decode(paths: pd.Series, contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        rows = []
        for origin, data, name in zip(paths, contents, kinds):
            pixels = None
            if name in decoders:
                try:
                    pixels = np.asarray(decoders[name](bytes(data)))
                except Exception:  # noqa: BLE001  a decoder's error is a corrupt file, whatever its kind
                    pixels = None
            if pixels is None or pixels.ndim != 3 or pixels.shape[2] != 3 or pixels.dtype != np.uint8 or not pixels.size:
                rows.append((origin, -1, -1, -1, -1, b""))
            else:  # 16: three channels of unsigned bytes, blue first
                rows.append((origin, *pixels.shape[:2], 3, 16, pixels[:, :, ::-1].tobytes()))
        return pd.DataFrame(rows, columns=["origin", "height", "width", "nChannels", "mode", "data"])

    return decode(path, content, kind)


def read_images(
    spark: SparkSession, root: str, decoders: dict[str, Callable[[bytes], np.ndarray]] | None = None
) -> DataFrame:
    """``path, image, status``: readable, corrupt (cannot be decoded) or unsupported (no decoder
    for the format here). Nothing is replaced; callers keep the readable ones.

    Spark's image source decodes first. What it cannot read is looked at by its first bytes: a format of ``decoders``
    (named as in ``MAGIC``) is decoded by the caller's function in Arrow batches. Files are read a second
    time only if some were left and decoders are given.
    """
    raw = (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .option("dropInvalid", "false")
        .load(root)
    )
    plain = lambda origin: F.regexp_replace(origin, "^file:/+", "/")
    images = raw.select(plain(F.col("image.origin")).alias("path"), F.col("image").cast(IMAGE).alias("image"))
    failed = F.col("image.height") < 0
    known = images.filter(~failed).withColumn("status", F.lit("readable"))
    left = images.filter(failed)
    if not decoders:
        from sparkcurate.functions.text import file_extension

        foreign = file_extension(F.col("path")).isin(".webp", ".avif", ".heic")
        return images.withColumn(
            "status", F.when(failed & foreign, "unsupported").when(failed, "corrupt").otherwise("readable")
        )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(plain(F.col("path")).alias("path"), "content").join(left.select("path"), "path", "left_semi")
    files = files.withColumn("kind", format_of(F.col("content")))
    decoded = files.withColumn("image", decode_with(decoders, F.col("path"), F.col("content"), F.col("kind")))
    foreign = F.col("kind").isNotNull() & ~F.col("kind").isin(*BUILT_IN, *decoders)
    status = F.when(F.col("image.height") >= 0, "readable").when(foreign, "unsupported").otherwise("corrupt")
    return known.unionByName(decoded.select("path", "image", status.alias("status")))


def as_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """BGR(A) or grey bytes of Spark's image struct as an RGB array."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, 2::-1]


@lru_cache(maxsize=512)
def lanczos_matrix(source: int, target: int, support: float = 3.0) -> np.ndarray:
    """Rows of windowed-sinc weights that resample ``source`` points to ``target``."""
    scale = source / target
    stretch = max(scale, 1.0)
    centers = (np.arange(target) + 0.5) * scale
    offsets = (np.arange(source)[None, :] + 0.5 - centers[:, None]) / stretch
    weights = np.sinc(offsets) * np.sinc(offsets / support) * (np.abs(offsets) < support)
    return weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=512)
def triangle_matrix(source: int, target: int) -> np.ndarray:
    """Rows of linear weights, widened when shrinking."""
    scale = source / target
    stretch = max(scale, 1.0)
    centers = (np.arange(target) + 0.5) * scale
    offsets = (np.arange(source)[None, :] + 0.5 - centers[:, None]) / stretch
    weights = np.clip(1.0 - np.abs(offsets), 0.0, None)
    return weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=512)
def cubic_matrix(source: int, target: int, a: float = -0.5) -> np.ndarray:
    """Rows of cubic convolution weights, widened when shrinking."""
    scale = source / target
    stretch = max(scale, 1.0)
    centers = (np.arange(target) + 0.5) * scale
    x = np.abs((np.arange(source)[None, :] + 0.5 - centers[:, None]) / stretch)
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = (((x - 5) * x + 8) * x - 4) * a
    weights = np.where(x < 1, near, np.where(x < 2, far, 0.0))
    return weights / weights.sum(axis=1, keepdims=True)


def resize(plane: np.ndarray, height: int, width: int, kernel=lanczos_matrix) -> np.ndarray:
    """Separable resample of one channel, one rounding at the end."""
    out = kernel(plane.shape[0], height) @ plane.astype(float) @ kernel(plane.shape[1], width).T
    return np.clip(np.rint(out), 0, 255)


def normalized_gray(rgb: np.ndarray, cut_percent: float = 1.0) -> np.ndarray:
    """Luma stretched to the full range after cutting ``cut_percent`` of pixels at each end."""
    luma = np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(int)
    histogram = np.bincount(luma.ravel(), minlength=256)
    cut = int(luma.size * cut_percent // 100)
    low = int(np.searchsorted(np.cumsum(histogram), cut, side="right"))
    high = 255 - int(np.searchsorted(np.cumsum(histogram[::-1]), cut, side="right"))
    if high <= low:
        return luma.astype(float)
    return np.clip((luma - low) * (255.0 / (high - low)), 0, 255).astype(int).astype(float)


def difference_hash(grid: np.ndarray) -> int:
    """Signed 64-bit hash of an 8x9 grid: right neighbour larger, first pair most significant."""
    bits = np.packbits((grid[:, 1:] > grid[:, :-1]).ravel())
    return int(bits.view(">i8")[0])


@lru_cache(maxsize=1)
def _moves_of_32() -> np.ndarray:
    return np.array(square_moves(32))


def image_orbit(rgb: np.ndarray) -> list[int]:
    """Hashes of the picture under the eight moves of the square: one gather makes all eight views, one
    product resamples them."""
    views = resize(normalized_gray(rgb), 32, 32).ravel()[_moves_of_32()].reshape(8, 32, 32)
    grids = np.clip(np.rint(lanczos_matrix(32, 8) @ views @ lanczos_matrix(32, 9).T), 0, 255)
    bits = np.packbits((grids[:, :, 1:] > grids[:, :, :-1]).reshape(8, 64), axis=1)
    return bits.view(">i8").ravel().tolist()


def image_dhash(rgb: np.ndarray) -> int:
    return difference_hash(resize(normalized_gray(rgb), 8, 9))


def green_share(rgb: np.ndarray) -> float:
    """Share of pixels of the 128x128 picture whose excess green is above the cut."""
    r, g, b = (resize(rgb[:, :, c], 128, 128, cubic_matrix) for c in range(3))
    # The cut is on shares of the three channels; times their sum it needs no division.
    return float(np.count_nonzero(2 * g - r - b > K.EXCESS_GREEN_CUT * (r + g + b)) / r.size)


def model_input(rgb: np.ndarray, shorter: int = 256, side: int = 224) -> np.ndarray:
    """Shorter side to 256 keeping the shape, centre 224x224, ImageNet scaling, channel first."""
    height, width = rgb.shape[:2]
    if height <= width:
        new = (shorter, int(shorter * width / height))
    else:
        new = (int(shorter * height / width), shorter)
    top, left = round((new[0] - side) / 2), round((new[1] - side) / 2)
    planes = [
        (resize(rgb[:, :, c], *new, triangle_matrix)[top : top + side, left : left + side] / 255.0
         - K.IMAGENET_MEAN[c]) / K.IMAGENET_STD[c]
        for c in range(3)
    ]
    return np.stack(planes).astype(np.float32)


def _pixels_of(images: pa.StructArray):
    """RGB arrays of a batch, made one at a time from what Arrow holds."""
    fields = dict(zip((f.name for f in images.type), images.flatten()))
    for data, h, w, c in zip(*(fields[name] for name in ("data", "height", "width", "nChannels"))):
        readable = data.is_valid and h.is_valid and h.as_py() > 0
        yield as_rgb(data.as_buffer(), h.as_py(), w.as_py(), c.as_py()) if readable else None


def _per_image(function, result_type: str, arrow_type: pa.DataType):
    @F.arrow_udf(result_type)
    def run(image: pa.Array) -> pa.Array:
        values = pd.Series([None if p is None else function(p) for p in _pixels_of(image)])
        return pa.Array.from_pandas(values, mask=values.isnull(), type=arrow_type)

    return run


def orbit_of(image: Column) -> Column:
    """``ARRAY<BIGINT>`` of eight hashes, null for an unreadable image."""
    return _per_image(image_orbit, "array<bigint>", pa.list_(pa.int64()))(image)


def dhash_of(image: Column) -> Column:
    return _per_image(image_dhash, "bigint", pa.int64())(image)


def vegetation_of(image: Column) -> Column:
    return _per_image(green_share, "double", pa.float64())(image)


def model_input_of(image: Column) -> Column:
    """``ARRAY<FLOAT>`` of 3*224*224 values."""
    return _per_image(lambda rgb: model_input(rgb).ravel(), "array<float>", pa.list_(pa.float32()))(image)


VARIANT_SCHEMA = (
    "path string, variant int, "
    "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
)


def make_variants(images: DataFrame, n: int = 7) -> DataFrame:
    """Copies ``0 … n-1`` of each picture: the picture itself, the square's moves, then brightness
    and size changes seeded by the path. Copies are made where the picture lies; none is moved."""

    def copy_of(rgb: np.ndarray, k: int, path: str) -> np.ndarray:
        if k < 8:
            turned = np.rot90(rgb, k // 2)
            return turned[:, ::-1] if k % 2 else turned
        random = np.random.default_rng(int(md5(f"{path}:{k}".encode()).hexdigest(), 16))
        if k % 2:
            return np.clip(rgb * random.uniform(0.75, 1.35), 0, 255).astype(np.uint8)
        h, w = max(int(rgb.shape[0] * 0.6), 1), max(int(rgb.shape[1] * 0.6), 1)
        return np.stack([resize(rgb[:, :, c], h, w) for c in range(3)], axis=2).astype(np.uint8)

    def run(batches):
        for batch in batches:
            rows = []
            for path, image in zip(batch["path"], batch["image"]):
                if image["height"] <= 0:
                    continue
                rgb = as_rgb(image["data"], image["height"], image["width"], image["nChannels"])
                for k in range(n):
                    out = copy_of(rgb, k, path)
                    rows.append((path, k, {
                        "origin": f"{path}#{k}", "height": out.shape[0], "width": out.shape[1],
                        "nChannels": 3, "mode": 16, "data": np.ascontiguousarray(out[:, :, ::-1]).tobytes(),
                    }))
            yield pd.DataFrame(rows, columns=["path", "variant", "image"])

    return images.select("path", "image").mapInPandas(run, VARIANT_SCHEMA)
