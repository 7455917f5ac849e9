"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task is happy to take.
HOT_ROWS = 1_000_000


# Rows a lookup table may have to be sent to every executor.
SMALL_ROWS = 100_000


def small_side(lookup: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``lookup`` marked for broadcast when a count finds at most ``max_rows`` rows in it, and
    unchanged otherwise: the join is then a shuffle, which Spark splits where keys are hot."""
    return F.broadcast(lookup) if lookup.limit(max_rows + 1).count() <= max_rows else lookup


def attach(
    rows: DataFrame,
    keyed: DataFrame,
    keys: str | list[str],
    spread_on: str | list[str],
    count_col: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``keyed``, a table with one row per key.

    ``keyed[count_col]`` is how many of ``rows`` carry the key; the aggregate that made ``keyed``
    has it for free. Keys above ``hot_rows`` are spread over several salts: their rows are dealt
    out by a hash of ``spread_on`` and their one keyed row is repeated once per salt. At most
    ``len(rows) / hot_rows`` keys can be hot, which bounds both the broadcast list of hot keys
    and the repeated rows. ``count_col`` does not appear in the result.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type: {how}")
    keys = [keys] if isinstance(keys, str) else list(keys)
    spread_on = [spread_on] if isinstance(spread_on, str) else list(spread_on)
    n_salts = F.greatest(F.ceil(F.col(count_col) / F.lit(hot_rows)), F.lit(1)).cast("int")
    hot = keyed.filter(F.col(count_col) > hot_rows).select(*keys, n_salts.alias("_salts"))
    salt = F.when(
        F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*spread_on), F.col("_salts"))
    ).otherwise(F.lit(0))
    left = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", salt.cast("int"))
        .drop("_salts")
    )
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), n_salts - 1))).drop(count_col)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
