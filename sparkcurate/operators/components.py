"""Connected components by alternating large-star and small-star steps.

Published as "Connected Components in MapReduce and Beyond" (Kiveris et al., 2014). Every step is
one aggregate and one join over the edge table; no component ever sits in one task.

Before the first shuffle, and on what each round leaves in a partition, ``contract`` replaces a partition's edges by
stars around the smallest node of each piece they hang together in: never more rows, and paths collapse
as far as a partition can see. A hub's rows are dealt over several tasks from an even share of all
rows on, however small the table is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.operators.skew import HOT_ROWS, attach
from sparkcurate.session import cut

#: Edges that a task looks at together.
LOCAL_EDGES = 250_000
#: A node with more than this share of all rows is a hub, unless it has only a few rows.
HUB_SHARE = 1 / 256
FEW_ROWS = 200


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Union-find over edges in the given order: the nodes, the smallest node number of each one's piece,
    and the edges that joined two pieces."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, joined = list(range(len(nodes))), []
    for at, (x, y) in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            joined.append(at)
    for x, up in enumerate(parent):  # a parent is smaller, so its own is settled
        parent[x] = parent[up]
    return nodes, parent, joined


def contract(edges: DataFrame, weight: str | None = None, most: int = LOCAL_EDGES) -> DataFrame:
    """Fewer edges ``(u, v)`` with the components of the given ones, worked out inside partitions.

    Without ``weight``, each piece becomes a star around its smallest node. With it, edges are kept or left
    out whole: a lightest spanning forest joins what the edges up to any weight join.
    """
    names = ["u", "v", *([weight] if weight else [])]

    def shrink(columns: list[np.ndarray]) -> list[np.ndarray]:
        if weight:
            order = np.argsort(columns[2], kind="stable")
            columns = [c[order] for c in columns]
            joined = _forest(*columns[:2])[2]
            return [c[joined] for c in columns]
        nodes, root, _ = _forest(*columns)
        away = np.flatnonzero(np.arange(len(nodes)) != root)
        return [nodes[away], nodes[np.array(root, np.int64)[away]]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def table(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            held.append([batch.column(n).to_numpy() for n in names])
            rows += batch.num_rows
            if rows >= most:
                held = [shrink([np.concatenate(c) for c in zip(*held)])]
                rows = len(held[0][0])
                if rows >= most // 2:  # it does not shrink: on with the rest
                    yield table(held[0])
                    held, rows = [], 0
        if rows:
            yield table(shrink([np.concatenate(c) for c in zip(*held)]))

    return edges.select(*names).mapInArrow(work, edges.select(*names).schema)


def _star(edges: DataFrame, large: bool, hot_rows: int | None) -> DataFrame:
    """One star step over edges ``(u, v)`` with ``u > v``.

    Large star: every neighbour above ``u`` is linked to the smallest node around ``u``.
    Small star: ``u`` and every neighbour below it are linked to the smallest of them.
    Nodes of more than ``hot_rows`` rows are dealt over several tasks; None: there are none.
    """
    down = edges.select("u", "v")
    around = down.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    smallest = around.groupBy("u").agg(
        F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    if hot_rows is None:
        linked = around.join(smallest.drop("n"), "u")
    else:
        linked = attach(around, smallest, "u", "v", "n", hot_rows=hot_rows)
    if large:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(smallest.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def connected_components(
    nodes: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS, local: bool = True
) -> DataFrame:
    """``(node, component)``: the smallest node that can be reached; isolated nodes keep their own.

    ``nodes`` has a column ``node``, ``edges`` has ``a`` and ``b``; both are integers, or texts, which
    go without ``contract``.
    ``local=False`` leaves out ``contract`` and with it all Python workers, for executors short of memory.
    """
    kind = "string" if edges.schema["a"].dataType.typeName() == "string" else "bigint"
    shrunk = contract if local and kind == "bigint" else lambda rows: rows
    ends = edges.filter("a <> b").select(
        F.greatest("a", "b").cast(kind).alias("u"), F.least("a", "b").cast(kind).alias("v")
    )
    current = cut(shrunk(ends).distinct())
    while True:
        n_edges, unsettled, largest = _progress(current)
        if not unsettled:
            break
        # At most 2 / HUB_SHARE nodes are above this, which bounds the list of hubs.
        hub = min(hot_rows, max(FEW_ROWS, int(2 * n_edges * HUB_SHARE)))
        spread_above = hub if largest > hub else None
        stars = _star(_star(current, True, spread_above), False, spread_above)
        current = cut(shrunk(stars).distinct())
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select("node").join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _progress(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges, of nodes that still have two lower ends or one at both sides, and the most rows
    of a node. With no such node left every edge points at the smallest node of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    open_node = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    row = per_node.agg(
        F.coalesce(F.sum("up"), F.lit(0)), F.count(F.when(open_node, 1)), F.coalesce(F.max(F.col("up") + F.col("down")), F.lit(0))
    ).first()
    return row[0], row[1], row[2]
