"""Stratified splits, capped and balanced samples, and same-class replacement.

Every random choice is an order by ``md5(seed:key)``, so it survives re-partitioning and retries.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.functions import text as X
from sparkcurate.operators.ranking import hash_rank, prefix_scan
from sparkcurate.operators.skew import HOT_ROWS, attach


#: Numbers that a draw picks from to choose between a slot's two classes.
DRAW_RANGE = 1 << 32


def group_summary(groups: DataFrame) -> DataFrame:
    """Per group: ``group_key`` (smallest path), ``n``, ``label`` (null when contradictory)."""
    same = F.min("label") == F.max("label")
    return groups.groupBy("group_id").agg(
        F.min("path").alias("group_key"),
        F.count(F.lit(1)).alias("n"),
        F.when(same, F.min("label")).alias("label"),
    )


def assign_group_splits(summary: DataFrame, seed: int = K.SPLIT_SEED) -> DataFrame:
    """Adds ``split`` to each group of one label: 70/15/15 per label, sizes rounded half to even,
    at least one group in val and in test, train first in the order."""
    keyed = summary.filter("label is not null").withColumn(
        "_hash", X.seeded_hash(F.col("group_key"), seed)
    )
    ranked = hash_rank(keyed, ["label"], "_hash", "group_key", "_rank", "_n")

    # The test fraction is a difference of doubles on purpose: it decides exact halves.
    def part(fraction):
        return F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction)).cast("bigint"))

    n_val = part(K.VAL_FRACTION)
    n_test = part(1.0 - K.TRAIN_FRACTION - K.VAL_FRACTION)
    # With fewer groups than val + test need, train is empty and val gives way to test.
    n_train = F.greatest(F.col("_n") - n_val - n_test, F.lit(0))
    n_val = F.least(n_val, F.col("_n") - n_test)
    return ranked.withColumn(
        "split",
        F.when(F.col("_rank") <= n_train, "train")
        .when(F.col("_rank") <= n_train + n_val, "val")
        .otherwise("test"),
    ).drop("_hash", "_rank", "_n")


def group_split(groups: DataFrame, seed: int = K.SPLIT_SEED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of groups with one label, plus ``split``; a group never crosses splits."""
    assigned = assign_group_splits(group_summary(groups), seed)
    return attach(
        groups.drop("split"), assigned.select("group_id", "split", "n"), "group_id", "id", "n",
        hot_rows=hot_rows,
    )


def row_split(
    rows: DataFrame, key: str = "path", by: str = "label", seed: int = K.SPLIT_SEED,
    val_fraction: float = K.VAL_FRACTION, test_fraction: float = K.VAL_FRACTION,
) -> DataFrame:
    """Row-level split that ignores groups (it leaks): sizes cut down, at least one, test first."""
    ranked = hash_rank(
        rows.drop("split").withColumn("_hash", X.seeded_hash(F.col(key), seed)),
        [by], "_hash", key, "_rank", "_n",
    )

    def part(fraction):
        return F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction)).cast("bigint"))

    n_test, n_val = part(test_fraction), part(val_fraction)
    return ranked.withColumn(
        "split",
        F.when(F.col("_rank") <= n_test, "test")
        .when(F.col("_rank") <= n_test + n_val, "val")
        .otherwise("train"),
    ).drop("_hash", "_rank", "_n")


def class_cap(
    rows: DataFrame, cap: int, key: str = "path", by: str = "label", seed: int = K.SPLIT_SEED
) -> DataFrame:
    """A random sample of at most ``cap`` rows of each class."""
    hashed = rows.withColumn("_hash", X.seeded_hash(F.col(key), seed))
    return hash_rank(hashed, [by], "_hash", key, "_rank").filter(F.col("_rank") <= cap).drop(
        "_hash", "_rank"
    )


def sample_grid(
    rows: DataFrame, per_label: int = K.SAMPLES_PER_LABEL, key: str = "path", by: str = "label",
    seed: int = K.SPLIT_SEED,
) -> DataFrame:
    """A few random rows per label with their ``slot``. The row_number filter is cut to
    ``per_label`` rows per task before the shuffle (window group limit)."""
    order = W.partitionBy(by).orderBy("_hash", key)
    return (
        rows.withColumn("_hash", X.seeded_hash(F.col(key), seed))
        .withColumn("slot", F.row_number().over(order))
        .filter(F.col("slot") <= per_label)
        .drop("_hash")
    )


def running_index(
    rows: DataFrame, key: str = "path", by: str = "label", seed: int = K.SPLIT_SEED
) -> DataFrame:
    """0-based index of each row inside its class, in the seeded order."""
    hashed = rows.withColumn("_hash", X.seeded_hash(F.col(key), seed))
    return (
        hash_rank(hashed, [by], "_hash", key, "_rank")
        .withColumn("class_index", F.col("_rank") - 1)
        .drop("_hash", "_rank")
    )


def alias_table(weights: list[float]) -> list[tuple[int, int]]:
    """``(threshold, other)`` per class, after Walker: a draw picks a slot evenly and a number below 2**32;
    below the slot's threshold the slot's own class is drawn, else ``other``. Shares are exact to 2**-32."""
    if any(not 0 <= w < float("inf") for w in weights) or not any(weights):
        raise ValueError("weights must be finite, not negative, and not all 0")
    total = sum(map(Fraction, weights))
    share = [Fraction(w) * len(weights) / total for w in weights]
    table = [(DRAW_RANGE, k) for k in range(len(weights))]
    low, high = ([k for k, s in enumerate(share) if (s < 1) == below] for below in (True, False))
    while low and high:
        small, large = low.pop(), high.pop()
        table[small] = (int(share[small] * DRAW_RANGE), large)
        share[large] -= 1 - share[small]
        (low if share[large] < 1 else high).append(large)
    return table


def balanced_resample(
    rows: DataFrame, key: str = "path", by: str = "label", seed: int = K.SPLIT_SEED, weights: dict | None = None
) -> DataFrame:
    """As many draws with replacement as there are rows, and every row of a class equally likely inside it.

    Without ``weights`` every present class is equally likely; with them, classes are drawn in proportion to their
    weight (of ``class_weights``, say), by an alias table, and those without one never. Draw ``k`` picks class and
    position by md5 and is then an equi-join on (class, position): no cumulative weights and no sort over the table.
    Class sizes are one row per class.
    """
    hashed = rows.withColumn("_hash", X.seeded_hash(F.col(key), seed))
    indexed = (
        hash_rank(hashed, [by], "_hash", key, "_rank", "_n")
        .withColumn("_position", F.col("_rank") - 1)
        .drop("_hash", "_rank")
    )
    found = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_class")).orderBy(by).collect()
    n_rows = sum(r["n_class"] for r in found)
    sizes = [r for r in found if weights is None or weights.get(r[by], 0)]
    if not sizes:
        return rows.filter("false").select(F.lit(0).cast("bigint").alias("draw"), *rows.columns)
    names = F.array(*[F.lit(r[by]) for r in sizes])
    counts = F.array(*[F.lit(r["n_class"]) for r in sizes])
    hashed_draw = F.md5(F.concat(F.lit(f"{seed}:draw:"), F.col("id").cast("string")))
    slot = F.pmod(X.hex_number(F.col("_h"), 1, 8), F.lit(len(sizes))).cast("int")
    if weights is not None:
        table = alias_table([weights[r[by]] for r in sizes])
        limits, others = (F.array(*map(F.lit, column)) for column in zip(*table))
        own = X.hex_number(F.col("_h"), 22, 8) < F.get(limits.cast("array<bigint>"), slot)
        slot = F.when(own, slot).otherwise(F.get(others, slot))
    draws = (
        rows.sparkSession.range(n_rows)
        .withColumn("_h", hashed_draw)
        .withColumn("_class", slot)
        .select(
            F.col("id").alias("draw"),
            names[F.col("_class")].alias(by),
            F.pmod(X.hex_number(F.col("_h"), 9, 13), counts[F.col("_class")]).alias("_position"),
        )
    )
    return draws.join(indexed.drop("_n"), [by, "_position"]).drop("_position")


def same_class_fill(rows: DataFrame, index: str, by: str, readable: str, value: str) -> DataFrame:
    """Replacement for unreadable rows: the ``value`` of the next readable row of the same class
    by ``index``, going round to the first one after the last. Readable rows keep their own;
    a class with no readable row gets null. ``index`` is unique and numeric."""
    candidate = F.when(F.col(readable), F.struct(F.col(index).alias("at"), F.col(value).alias("value")))
    backwards = rows.withColumn("_back", -F.col(index))
    scanned = prefix_scan(backwards, [by], ["_back"], {"_next": ("min", candidate)})
    firsts = rows.groupBy(by).agg(F.min(candidate).alias("_first"), F.count(F.lit(1)).alias("_n"))
    filled = attach(scanned, firsts, by, index, "_n")
    used = F.when(F.col(readable), F.col(value)).otherwise(
        F.coalesce(F.col("_next.value"), F.col("_first.value"))
    )
    return filled.withColumn("used", used).drop("_back", "_next", "_first")
