"""Ranks and running aggregates that need no single-task window.

``Window.partitionBy(label).orderBy(...)`` puts a whole label into one task. Both helpers here
cut the order into buckets first, aggregate per bucket, add the small bucket table up, and only
then look inside a bucket: exact results, and the work per task is one bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcurate.operators.skew import small_side
from sparkcurate.session import store

# Rows that a bucket of a running aggregate is to hold.
BUCKET_ROWS = 200_000
# Cuts that one list of them may have: the order is cut into so many parts at most, and each again.
MOST_CUTS = 1_000


def hash_rank(
    df: DataFrame, by: list[str], hash_col: str, tie: str, out: str = "rank",
    total: str | None = None, hex_digits: int = 4,
) -> DataFrame:
    """1-based rank of ``hash_col`` (a hex digest) inside each ``by`` group, ties by ``tie``.

    Digests are uniform, so their first ``hex_digits`` digits make 16**hex_digits even buckets,
    whatever share of the rows one group holds. ``total`` adds the size of the group.
    """
    bucketed = df.withColumn("_bucket", F.substring(F.col(hash_col), 1, hex_digits))
    sizes = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(W.partitionBy(*by)).alias("_total"),
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(hash_col, tie)
    ranked = bucketed.withColumn("_in", F.row_number().over(inside)).join(
        offsets, [*by, "_bucket"]
    )
    extra = [F.col("_total").alias(total)] if total else []
    return ranked.select(*df.columns, (F.col("_in") + F.col("_before")).alias(out), *extra)


def order_bounds(df: DataFrame, order_col: str, n_buckets: int, error: float | None = None) -> list[float]:
    """At most ``n_buckets`` cut points that split the order evenly, to an eighth of a bucket; plain numbers,
    so that every later use of them, retries included, sees the same cuts."""
    probabilities = [i / n_buckets for i in range(1, n_buckets)]
    clean = df.select(F.col(order_col).cast("double").alias("x")).filter("x is not null")
    cuts = clean.approxQuantile("x", probabilities, error or min(0.001, 1 / (8 * n_buckets))) or [0.0]
    return sorted(set(cuts))


def with_bucket(df: DataFrame, order_col: str, bounds: list[float], out: str = "_bucket"):
    """Bucket number of ``order_col`` between the cuts, rising with the order."""
    splits = [-float("inf"), *bounds, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="_order", outputCol=out, handleInvalid="error")
    return cutter.transform(df.withColumn("_order", F.col(order_col).cast("double"))).drop("_order")


def cuts_below(cuts: Column, value: Column) -> Column:
    """How many of the rising ``cuts`` are at most ``value``, by halving."""
    steps = [1 << k for k in reversed(range((2 * MOST_CUTS).bit_length()))]

    def halve(found: Column, step: Column) -> Column:
        further = found + step
        return F.when((further <= F.size(cuts)) & (F.get(cuts, further - 1) <= value), further).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)


def _parts(df: DataFrame, order_col: str, earlier: list[str], rows: float) -> DataFrame:
    """``_bucket, _cuts``: cuts of ``order_col`` inside each bucket that holds clearly more than ``rows``, and
    a single value of the ``earlier`` columns."""
    value = F.col(order_col).cast("double")
    even = F.percentile_approx(value, [i / MOST_CUTS for i in range(MOST_CUTS + 1)], 10 * MOST_CUTS)
    pieces = F.least(F.lit(MOST_CUTS), F.round(F.col("_n") / rows)).cast("int")
    ends = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.get("_even", F.round(i * MOST_CUTS / pieces).cast("int")))
    above = F.filter(ends, lambda c: c > F.get("_even", F.lit(0)))
    # A value that several cuts fall on gets a bucket of its own: it ends before the next double.
    frequent = F.filter(ends, lambda c, i: c == F.get(ends, i + 1))
    after = F.transform(frequent, lambda c: c + F.greatest(F.abs(c) * 2.0**-52, F.lit(5e-324)))
    sizes = df.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{k}{i}") for i, c in enumerate([value, *earlier]) for k, f in (("low", F.min), ("high", F.max))]
    )
    one_value = [F.col(f"_low{i + 1}") == F.col(f"_high{i + 1}") for i in range(len(earlier))]
    large = sizes.filter((F.col("_n") >= 1.5 * rows) & (F.col("_low0") < F.col("_high0")) & reduce(Column.__and__, one_value, F.lit(True)))
    inside = df.join(small_side(large.select("_bucket", "_n"), MOST_CUTS), "_bucket")
    found = inside.groupBy("_bucket").agg(F.first("_n").alias("_n"), even.alias("_even"))
    return found.select("_bucket", F.array_sort(F.array_distinct(F.concat(above, after))).alias("_cuts"))


def into_buckets(df: DataFrame, order_col: str | list[str], n_buckets: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``, stored: the cut is made once, for any number of scans. Buckets hold about
    ``BUCKET_ROWS`` rows, whatever share of them one group has.

    Up to ``MOST_CUTS`` buckets are one list of quantiles. Beyond, each part of that list is cut by quantiles of its
    own, so buckets stay small at any number of rows and no list is longer. Buckets that hold a single value are cut by
    the next of the order columns, if there is one.
    """
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    df = store(df)
    rows = df.count()
    if n_buckets is None:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n_buckets = max(least, 2, rows // BUCKET_ROWS)
    coarse = with_bucket(df, order[0], order_bounds(df, order[0], min(n_buckets, MOST_CUTS)))
    target = rows / n_buckets
    columns = order if n_buckets > MOST_CUTS or len(order) > 1 else []
    for at, column in enumerate(columns):
        while True:
            cuts = store(_parts(coarse, column, order[:at], target).filter(F.size("_cuts") > 0), "cuts")
            if cuts.isEmpty():
                break
            few = small_side(cuts, MOST_CUTS)
            inside = F.when(F.col("_cuts").isNull(), 0).otherwise(cuts_below(F.col("_cuts"), F.col(column).cast("double")))
            finer = (F.col("_bucket") * (2 * MOST_CUTS + 1) + inside).cast("double")
            coarse = coarse.join(few, "_bucket", "left").withColumn("_bucket", finer).drop("_cuts")
            coarse = store(coarse.select(*df.columns, "_bucket"))
    return coarse


def prefix_scan(
    df: DataFrame,
    by: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, Column]],
    n_buckets: int | None = None,
) -> DataFrame:
    """Aggregates over all rows strictly before each row, inside each ``by`` group.

    ``order`` is numeric and spreads the rows, the first column by itself and the rest where it ties. ``aggs`` maps an
    output name to ``("sum" | "max" | "min" | "count", expression)``. Sums and counts start at
    0, max and min at null. Rows that ``into_buckets`` has cut already are read as they are, twice;
    any others are stored and cut first.
    """
    if "_bucket" in df.columns:
        return _scan(df, by, order, aggs)
    return _scan(into_buckets(df, order, n_buckets), by, order, aggs).drop("_bucket")


def _scan(df: DataFrame, by: list[str], order: list[str], aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    functions = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    keyed = df
    for name, (_, expression) in aggs.items():
        keyed = keyed.withColumn(f"_in_{name}", expression)
    per_bucket = keyed.groupBy(*by, "_bucket").agg(
        *[functions[kind](f"_in_{name}").alias(f"_b_{name}") for name, (kind, _) in aggs.items()]
    )
    buckets_before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    fold = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    offsets = per_bucket.select(
        *by,
        "_bucket",
        *[
            fold[kind](f"_b_{name}").over(buckets_before).alias(f"_o_{name}")
            for name, (kind, _) in aggs.items()
        ],
    )
    rows_before = (
        W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    joined = keyed
    for name, (kind, _) in aggs.items():
        joined = joined.withColumn(f"_w_{name}", functions[kind](f"_in_{name}").over(rows_before))
    joined = joined.join(offsets, [*by, "_bucket"])
    merged = []
    for name, (kind, _) in aggs.items():
        inside, offset = F.col(f"_w_{name}"), F.col(f"_o_{name}")
        if kind in ("sum", "count"):
            merged.append((F.coalesce(inside, F.lit(0)) + F.coalesce(offset, F.lit(0))).alias(name))
        else:
            pick = (inside < offset) if kind == "min" else (inside > offset)
            merged.append(
                F.when(inside.isNull(), offset)
                .when(offset.isNull() | pick, inside)
                .otherwise(offset)
                .alias(name)
            )
    return joined.select(*df.columns, *merged)
