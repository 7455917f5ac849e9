"""Nearest neighbours by largest inner product, with collision-counting hashing.

Method, after C2LSH and QALSH. Vectors of one norm octave are divided by its largest norm and lifted onto the
unit sphere, sqrt(1 - |x|^2) being the new entry (0 for a query): the largest inner product is then the
smallest distance. Each of ``LINES`` Gaussian projections is kept as a sorted array. A query opens a window
centred on its own projection in each array, counts in how many windows a vector lies, and verifies
every vector that collides in ``ENOUGH`` of them by its inner product. Windows are widened by virtual
rehashing over the same arrays.

A search ends when a vector as far off as the k-th best so far would have been verified with probability
``TARGET``: windows of half-width w hold a vector at distance s with probability 2 * Phi(w / s) - 1 each,
independently, so the chance is a binomial tail; nearer vectors have a better one. Nothing else ends it, and
no number of candidates is capped. Octaves of smaller norms are searched while the product of the norms still
beats the k-th best, which is exact.

Once k vectors are held, the needed width only falls. So the arrays are counted at the width that searches
of this block usually end with, and the step at which the widening ends is found among the best vectors counted
there: the same vectors are returned as by counting at every step. Wide windows are counted by the vectors'
ranks, a byte each, for ``TOGETHER`` queries in one pass.

Scale: vectors are dealt by hash into blocks of ``BLOCK_ROWS``, queries into batches of up to
``BATCH_ROWS``; each pair of block and batch is one task's work, in bounded memory, and gives k rows a
query. Partial results meet in a ranking that keeps k rows a query and task before the shuffle. The
number of batches follows the cores; it changes no result. A stated query set against all rows costs
queries times rows whatever the index, so the shuffle carries a vector once a batch and a query once a block.

Defined results: vectors that are null, zero, empty, hold a null or non-finite entry or have another
length than most take no part. Rows with the query's id are its own and no candidates, also where the id is
repeated; a query id that occurs twice is searched once, by its smallest vector. Other repeated rows are
candidates of their own. Ties go to the smaller id, null ids last; fewer than k candidates are all given.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache
from math import comb
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NEIGHBOURS = 20
LINES = 128
ENOUGH = 80
TARGET = 0.95
#: Half-width of the first windows, on the unit sphere.
FIRST = 0.4
#: Least growth of the windows; at most they double.
GROWN = 1.06
#: Arrays are counted at so many times the width that searches usually end with.
AHEAD = 1.01
#: Queries that are searched side by side.
TOGETHER = 8
BLOCK_ROWS = 1 << 16
BATCH_ROWS = 4096
#: Projections of one array lie within this span of the next one's.
SPAN = 64.0
FOUND = "query_id long, vec_id long, score double"


@cache
def reach(lines: int = LINES, enough: int = ENOUGH, target: float = TARGET) -> float:
    """Half-width, over the distance, at which a vector is verified with probability ``target``."""
    tail = lambda p: sum(comb(lines, i) * p**i * (1 - p) ** (lines - i) for i in range(enough, lines + 1))
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (low, p) if tail(p) >= target else (p, high)
    return NormalDist().inv_cdf((1 + high) / 2)


def norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    top[top == 0] = 1
    return top[:, 0] * np.sqrt(((x / top) ** 2).sum(axis=1))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed from left to right, so that equal vectors have equal scores anywhere."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += x[:, j] * q[j]
    return total


class Octave:
    """Sorted projections of vectors whose norms differ by a factor of two at most."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, size: np.ndarray, lines: np.ndarray):
        self.rows, self.x, self.top = rows, x, float(size.max())
        #: What searches so far ended with, as a guess for the next; the results do not depend on it.
        self.usual, self.searches = 0.0, 0
        unit = x / self.top
        lift = np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))
        projected = np.ascontiguousarray((unit @ lines[:-1] + lift[:, None] * lines[-1]).T)
        order = np.argsort(projected, axis=1)
        self.ranks = np.empty(order.shape, np.uint16 if len(rows) <= 1 << 16 else np.uint32)
        np.put_along_axis(self.ranks, order, np.arange(len(rows), dtype=self.ranks.dtype)[None], 1)
        self.starts = np.arange(len(order)) * len(rows)
        self.span = -(-len(rows) // 255)
        self.coarse = (self.ranks // self.span).astype(np.uint8)
        self.order = order.ravel()
        projected.sort(axis=1)
        self.sorted = (projected + SPAN * np.arange(len(order))[:, None]).ravel()

    def count(self, parts: list[tuple[int, int]]) -> np.ndarray:
        """How often each vector occurs in stretches of the arrays, by walking them."""
        order = self.order
        return np.bincount(np.concatenate([order[a:b] for a, b in parts if a < b] or [order[:0]]), minlength=len(self.rows))

    def count_ranks(self, windows: np.ndarray) -> list[np.ndarray]:
        """The same for one stretch an array, by each vector's rank in it, for several searches at once: cheaper where
        stretches are wide. Ranks are taken in equal spans numbered by a byte; what a stretch has of a span at
        either end is walked. ``windows``: by search, the starts and the ends in the arrays laid end to end."""
        n, span = len(self.rows), self.span
        low, high = windows[:, 0] - self.starts, windows[:, 1] - self.starts
        first, last = -(-low // span), np.where(high < n, high // span, -(-n // span))
        whole = first < last
        # No span has number 255: a stretch without a whole span fits none.
        offset, more = np.where(whole, first, 255).astype(np.uint8), np.where(whole, last - first - 1, 0).astype(np.uint8)
        totals = np.zeros((len(windows), n), np.uint8 if len(self.starts) < 256 else np.uint16)
        above, inside = np.empty(totals.shape, np.uint8), np.empty(totals.shape, bool)
        for line, coarse in enumerate(self.coarse):
            np.subtract(coarse, offset[:, line, None], out=above)
            np.less_equal(above, more[:, line, None], out=inside)
            np.add(totals, inside.view(np.uint8), out=totals)
        left = np.stack([low, np.where(whole, first * span, high)], 2) + self.starts[:, None]
        right = np.stack([np.where(whole, last * span, high), high], 2) + self.starts[:, None]
        edges = np.concatenate([left, right], axis=1).tolist()
        return [total + self.count(rest) for total, rest in zip(totals, edges)]

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where some of the vectors lie in the arrays laid end to end, by array and vector."""
        return self.sorted[self.starts[:, None] + self.ranks[:, rows]]


class Index:
    """The vectors of a block, searched one query at a time."""

    def __init__(self, ids: list[int | None], x: np.ndarray, lines: int = LINES, enough: int = ENOUGH, target: float = TARGET):
        self.ids, self.x, self.enough, self.reach = ids, x, enough, reach(lines, enough, target)
        # Null ids are nobody's own and come last among ties.
        self.keys = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        self.null = np.array([i is None for i in ids], bool)
        drawn = np.random.default_rng(lines).standard_normal((x.shape[1] + 1, lines))
        self.lines = np.clip(drawn, -6, 6)  # keeps projections inside SPAN; beyond 6 there are 2e-9 of all draws
        size = norms(x)
        octave = np.round(np.log2(size))  # norms of one lie in the middle
        self.octaves = [Octave(np.flatnonzero(octave == o), x[octave == o], size[octave == o], self.lines) for o in np.unique(octave)[::-1]]
        self.verified = 0

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int | None, float]]:
        """Up to ``k`` ``(id, inner product)``, best first."""
        return self.search_all([query_id], q[None], k)[0]

    def search_all(self, query_ids: list[int], queries: np.ndarray, k: int) -> list[list[tuple[int | None, float]]]:
        """The same for many queries; ``TOGETHER`` of them go on side by side, so that ranks are read once for all."""
        found: list = [None] * len(query_ids)
        for start in range(0, len(query_ids), TOGETHER):
            ready = {i: None for i in range(start, min(start + TOGETHER, len(query_ids)))}
            runs = {i: self._search(query_ids[i], queries[i], k) for i in ready}
            while ready:
                asked = defaultdict(dict)
                for i, counts in ready.items():
                    try:
                        part, windows = runs[i].send(counts)
                        asked[part][i] = windows
                    except StopIteration as end:
                        found[i] = end.value
                ready = {i: c for part, of in asked.items() for i, c in zip(of, part.count_ranks(np.stack([*of.values()])))}
        return found

    def _search(self, query_id: int, q: np.ndarray, k: int):
        """A search; it yields octaves and windows to be counted by rank, and is sent the counts."""
        size = float(norms(q[None])[0])
        at, scores, best = np.zeros(0, np.int64), np.zeros(0), -np.inf
        slack = 1e-9 * size * max((o.top for o in self.octaves), default=0.0)

        def take(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
            nonlocal at, scores, best
            at, scores = np.concatenate([at, rows]), np.concatenate([scores, found])
            best = _kth(scores, k)
            at, scores = at[scores >= best - slack], scores[scores >= best - slack]
            return scores

        for part in self.octaves:
            if part.top * size < best * (1 - 1e-12):
                break
            own = (self.keys[part.rows] == query_id) & ~self.null[part.rows]
            yield from self._collide(part, q, size, own, take, k, slack)
        exact = inner(self.x[at], q)
        first = np.lexsort((self.null[at], self.keys[at], -exact))[:k]
        return [(self.ids[at[i]], float(exact[i])) for i in first]

    def _collide(self, part: Octave, q: np.ndarray, size: float, own: np.ndarray, take, k: int, slack: float):
        """Hands rows of ``part`` that collide often enough, as windows widen, and their inner products to ``take``, which
        returns the scores that still count."""
        centre = (q / size) @ self.lines[:-1]
        n, lines = len(part.rows), len(centre)
        seen, counts, covered = own.copy(), np.zeros(n, np.int64), 0
        place = centre + SPAN * np.arange(lines)
        # Arrays are laid end to end, so one look-up places all windows.
        ends = np.stack([part.starts, part.starts + n])
        edges = None
        width = FIRST

        def widest(best: float) -> float:
            return self.reach * np.sqrt(max(0.0, 2 - 2 * best / (size * part.top))) if np.isfinite(best) else np.inf

        def opened(width: float):
            """Rows that newly collide, and their scores."""
            nonlocal counts, covered, edges
            new = np.clip(np.searchsorted(part.sorted, np.stack([place - width, place + width])), ends[0], ends[1])
            inside = int((new[1] - new[0]).sum())
            if edges is None or inside - covered > lines * n // 32:
                counts = yield part, new
            else:
                grown = np.concatenate([np.stack([new[0], edges[0]], 1), np.stack([edges[1], new[1]], 1)])
                counts += part.count(grown.tolist())
            edges, covered = new, inside
            fresh = np.flatnonzero((counts >= self.enough) & ~seen)
            seen[fresh] = True
            self.verified += len(fresh)
            return fresh, part.x.take(fresh, axis=0) @ q

        while True:
            fresh, found = yield from opened(width)
            held = take(part.rows[fresh], found)
            needed = widest(_kth(held, k))
            if covered == lines * n or width >= needed:
                return
            if needed < np.inf:
                break
            # A count grows by less than its windows do, so this does not overshoot.
            ahead = np.partition(counts, n - k)[n - k] if n > k else 0
            width *= min(2.0, max(GROWN, self.enough / max(1, ahead)))
        # From here on the width that is needed only falls and steps grow towards it, so the last step is the first that
        # needs no more than one step further. The arrays are counted at the width that searches usually end with;
        # how far the steps go is then settled with the best vectors found there alone.
        least = _kth(held, k) - slack
        fresh, found, spots = np.zeros(0, np.int64), np.zeros(0), np.zeros((lines, 0))

        def open_to(width: float):
            nonlocal fresh, found, spots
            more, theirs = yield from opened(width)
            fresh, found = np.concatenate([fresh, more[theirs >= least]]), np.concatenate([found, theirs[theirs >= least]])
            order = np.argsort(-found)
            fresh, found, spots = fresh[order], found[order], np.zeros((lines, 0))

        def colliding(width: float) -> tuple[np.ndarray, float]:
            """Which of the best collide at a width already opened, and the k-th best score then."""
            nonlocal spots
            while True:
                near = (spots >= (place - width)[:, None]) & (spots < (place + width)[:, None])
                hit = np.flatnonzero(near.sum(axis=0) >= self.enough)
                best, looked = _kth(np.concatenate([held, found[hit]]), k), spots.shape[1]
                if looked == len(fresh) or looked and found[looked - 1] < best - slack:
                    return hit, best
                spots = np.concatenate([spots, part.places(fresh[looked : 2 * looked + 4 * k])], axis=1)

        while True:
            wide = min(needed, max(GROWN * width, part.usual))
            yield from open_to(wide)
            steps = [width]
            while GROWN * steps[-1] <= wide:
                steps.append(GROWN * steps[-1])
            needed = widest(colliding(steps[-1])[1])
            if needed <= GROWN * steps[-1]:
                break
            width = steps[-1]
        while len(steps) > 1 and (before := widest(colliding(steps[-2])[1])) <= GROWN * steps[-2]:
            steps.pop()
            needed = before
        width = max(steps[-1], needed)
        if width > wide:
            yield from open_to(width)
        hit, _ = colliding(width)
        take(part.rows[fresh[hit]], found[hit])
        part.searches += 1
        part.usual += (AHEAD * width - part.usual) / part.searches


def _kth(scores: np.ndarray, k: int) -> float:
    """The k-th largest of the scores, or the least of all numbers."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts).astype(np.float64).reshape(len(column), -1)


def usable(vector: str) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    some = lambda c: c != 0
    v = F.col(vector)
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, some), F.lit(False))


def search(
    vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, row_id: str = "vec_id", vector: str = "embedding",
    block_rows: int = BLOCK_ROWS, batch_rows: int = BATCH_ROWS, lines: int = LINES, enough: int = ENOUGH, target: float = TARGET,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``is_query``, the ``k`` best of all others."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector)).select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q") & F.col("id").isNotNull(), 1)).alias("queries")
    )
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if not most or not most.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == most.d)
    n_blocks = -(-most.n // block_rows)
    spread = max(1, spark.sparkContext.defaultParallelism // n_blocks)
    n_batches = max(-(-most.queries // batch_rows), min(spread, -(-most.queries // 256)))
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    dealt = lambda number, *by: F.pmod(F.xxhash64(*by), F.lit(number)).cast("int")
    stored = rows.select("id", "v", dealt(n_blocks, "id", "v").alias("block"), every(n_batches).alias("batch"))
    asked = rows.filter("q and id is not null").groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select("id", "v", dealt(n_batches, "id").alias("batch"), every(n_blocks).alias("block"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int | None, float]] = []
        if left.num_rows and right.num_rows:
            index = Index(left.column("id").to_pylist(), _matrix(left.column("v")), lines, enough, target)
            queries = right.column("id").to_pylist()
            for query, near in zip(queries, index.search_all(queries, _matrix(right.column("v")), k)):
                found += [(query, other, score) for other, score in near]
        columns = list(zip(*found)) or [[], [], []]
        types = [pa.int64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query_id", "vec_id", "score"])

    pairs = stored.groupBy("block", "batch").cogroup(asked.groupBy("block", "batch")).applyInArrow(find, FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
