"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a digest. Each copy of a document gets a virtual finish
time: the words its source has given so far, this copy included, divided by the source's target. All
copies are put in one global order of finish times and the order is cut where the words reach the
total budget, so every source arrives at its target at about the same time.

Targets: the budget (all words) is shared by weight; a target stops at ``max_epochs`` times its
source's words and what is over goes to the other sources by weight, until none is above.

Scale: only ids, sizes and digests are shuffled, never texts. A running sum is never one task's work:
digests are cut into even buckets inside a source (a source may hold any share of the rows), finish
times into ranges; bucket sums are added up first, and the cut is then searched in one range alone.
DataFrame functions only.

Defined results: null text has size 0; null is a source of its own, last in order; documents without
words are never taken (0 of 0 words); rows with the same id, source and text share one place in the
shuffle and are taken equally often; an empty table gives an empty result; other columns, whatever
their names, pass through ``remix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcurate.operators.skew import small_side
from sparkcurate.session import store

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows that a bucket of the shuffle, or a range of finish times, should hold.
BUCKET_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """The place of a document in the shuffle of its source: a digest of its id and text."""
    part = lambda c: F.coalesce(c, F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), part(doc_id.cast("string")), F.lit(":"), part(F.md5(text))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_no, source_size, target`` from ``source, source_size``, a row per source.

    Sources in order of limit by weight: the first whose share of what is left, by weight among
    those not yet at their limit, does not pass its limit sets the level for itself and all after.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("source_no", F.row_number().over(in_order).cast("long"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("limit", F.col("source_size") * max_epochs)
    )
    by_limit = W.orderBy(F.col("limit").cast("double") / F.col("weight"), "source_no")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    onwards = by_limit.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    left_over = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    level = left_over.cast("double") / F.sum("weight").over(onwards)
    leveled = ranked.withColumn("place", F.row_number().over(by_limit)).withColumn("level", level)
    fits = F.col("level") <= F.col("limit").cast("double") / F.col("weight")
    first = F.min(F.when(fits, F.struct("place", "level"))).over(whole)
    return leveled.withColumn("first", first).select(
        "source", "source_no", "source_size",
        F.when(F.col("place") < F.col("first.place"), F.col("limit").cast("double"))
        .otherwise(F.col("first.level") * F.col("weight")).alias("target"),
    )


def schedule(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source_no, draw, source_size, target, epochs, finish`` for each distinct source and draw in
    ``rows`` (``source, draw, size``): how many copies are taken, and when the first one finishes.

    The cut is one row, found in the one range of finish times in which the budget runs out.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = store(sizes, "mix-sources")
    total, n_rows = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sources = small_side(store(source_targets(sizes.drop("n"), weights, max_epochs), "mix-targets"))
    digits = max(2, math.ceil(math.log(max(n_rows / BUCKET_ROWS, 1), 16)))
    ranges = max(64, math.ceil(n_rows * max_epochs / BUCKET_ROWS))

    same = rows["source"].eqNullSafe(sources["source"])
    units = (
        rows.join(sources, same).groupBy("source_no", "draw", "source_size", "target")
        .agg(F.sum("size").alias("size")).withColumn("bucket", F.substring("draw", 1, digits))
    )
    bucket_sums = units.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = bucket_sums.select(
        "source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")
    )
    inside = W.partitionBy("source_no", "bucket").orderBy("draw").rowsBetween(W.unboundedPreceding, 0)
    placed = units.withColumn("run", F.sum("size").over(inside)).join(offsets, ["source_no", "bucket"])
    placed = placed.select(
        "source_no", "draw", "source_size", "target", "size", (F.col("run") + F.col("before")).alias("given")
    )
    placed = store(placed, "mix-placed")

    wanted = placed.filter("size > 0 and target > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    )
    finish = finish_time(F.col("epoch"))
    copies = wanted.select("size", F.struct(finish.alias("finish"), "source_no", "epoch", "draw").alias("at"))
    copies = copies.withColumn(
        "range", F.floor(F.col("at.finish") / (F.col("at.finish") + 1) * ranges).cast("long")
    )
    sums = copies.groupBy("range").agg(F.sum("size").alias("words"))
    upto = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    crossing = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .filter(F.col("before") + F.col("words") > total).orderBy("range").select("range", "before").first()
    )
    if crossing is None:  # the budget is not reached: nothing is cut off
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), max_epochs).otherwise(0)
    else:
        in_order = W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)
        cut = (
            copies.filter(F.col("range") == crossing["range"])
            .withColumn("run", F.sum("size").over(in_order) + crossing["before"])
            .filter(F.col("run") > total).agg(F.min("at").alias("at")).first()["at"]
        )
        # The double goes in by its bits, not by a printed number.
        edge = F.struct(
            F.lit(float(cut["finish"])).alias("finish"), F.lit(cut["source_no"]).cast("long").alias("source_no"),
            F.lit(cut["epoch"]).cast("int").alias("epoch"), F.lit(cut["draw"]).alias("draw"),
        )
        taken = sum(
            (
                F.when(
                    (F.col("size") > 0) & (F.col("target") > 0)
                    & (F.struct(finish_time(F.lit(e)).alias("finish"), "source_no", F.lit(e).alias("epoch"), "draw") < edge),
                    1,
                ).otherwise(0)
                for e in range(max_epochs)
            ),
            F.lit(0),
        )
    return placed.select(
        "source_no", "draw", "source_size", "target", taken.cast("long").alias("epochs"),
        F.when(F.col("target") > 0, finish_time(F.lit(0))).alias("finish"),
    )


def finish_time(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("given")).cast("double") / F.col("target")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
    weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, finish`` for every row of ``docs``."""
    rows = store(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            draw(F.col(doc_id), F.col(text), seed).alias("draw"),
        ),
        "mix-rows",
    )
    plan = schedule(rows.select("source", "draw", "size"), weights, max_epochs)
    return _with_plan(rows, rows, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "finish"
    )


def _with_plan(rows: DataFrame, sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``source`` and ``draw``) joined to their place in the plan. A draw holds the
    document's id, so a source needs no part in the key beyond telling equal draws apart."""
    names = sized.groupBy("source").count().select("source")
    numbered = store(
        names.select("source", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long").alias("source_no")),
        "mix-names",
    )
    numbered = small_side(numbered)
    keyed = rows.join(numbered, rows["source"].eqNullSafe(numbered["source"])).drop(numbered["source"])
    return keyed.join(plan, ["source_no", "draw"])


def remix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with every row repeated as often as it is taken (0 to ``max_epochs``), same columns."""
    seed = options.pop("seed", "mix")
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"),
        draw(F.col(doc_id), F.col(text), seed).alias("draw"),
    )
    sized = store(wide.select("source", "draw", word_count(F.col(f"row.`{text}`")).alias("size")), "mix-rows")
    plan = schedule(sized, **options).select("source_no", "draw", "epochs")
    repeated = _with_plan(wide, sized, plan.filter("epochs > 0")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))
    )
    return repeated.select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM d GROUP BY source),
w AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS lim FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(lim AS DOUBLE) / weight, source_no) AS place FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM l WHERE level <= CAST(lim AS DOUBLE) / weight),
t AS (SELECT source, source_no, source_size, CASE WHEN l.place < f.place THEN CAST(lim AS DOUBLE) ELSE f.level * weight END AS target FROM l, f),
u AS (SELECT source_no, draw, source_size, target, CAST(sum(size) AS BIGINT) AS size
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
g AS (SELECT *, sum(size) OVER (PARTITION BY source_no ORDER BY draw) AS given FROM u),
c AS (SELECT source_no, draw, size, epoch, CAST(epoch * source_size + given AS DOUBLE) / target AS finish
      FROM g, (VALUES (0), (1), (2)) e(epoch) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, source_no, epoch, draw ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (SELECT source_no, draw, count(*) AS epochs FROM r WHERE run <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(d.size * coalesce(k.epochs, 0) AS BIGINT) AS taken,
       CASE WHEN t.target > 0 THEN CAST(g.given AS DOUBLE) / t.target END AS finish
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN g ON g.source_no = t.source_no AND g.draw = d.draw
LEFT JOIN k ON k.source_no = t.source_no AND k.draw = d.draw
"""
