"""Near-duplicate edges and groups from perceptual hash orbits.

Input tables carry ``id BIGINT`` and ``orbit ARRAY<BIGINT>``; a null orbit is an unreadable file
and takes part in nothing. Copies with the same signature collapse to one representative before
anything else happens, so a photo that fills a third of the table costs one row from there on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.functions import hashing as H
from sparkcurate.functions.let import let
from sparkcurate.operators.components import LOCAL_EDGES, connected_components, contract
from sparkcurate.operators.skew import HOT_ROWS, SMALL_ROWS, attach
from sparkcurate.session import cut

# Entries one bucket may hold before it is cut finer; pairs are only formed in smaller buckets.
MAX_BUCKET = 2_000

# Hashes that a task compares with as many others, and hashes from which there is more than one task's work.
BLOCK_HASHES, SOME_HASHES = 1 << 17, 1 << 14
# Hashes from which comparing every two costs more than finding the groups of one tolerance after the other.
MANY_HASHES = 1 << 16
# Entries written per hash above which blocks are compared instead, if there are this many times fewer of them.
MANY_ENTRIES, FEWER = 32, 4
# Hashes of a tile, which is compared at once.
TILE = 1 << 7, 1 << 12


def signatures(hashes: DataFrame) -> DataFrame:
    """One row per distinct signature: ``signature, rep`` (smallest id), ``n_files``."""
    return (
        hashes.filter("orbit is not null")
        .groupBy(H.orbit_signature(F.col("orbit")).alias("signature"))
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_files"))
    )


@dataclass(frozen=True)
class Slice:
    """Some bits of a hash, and how many of them two near hashes may differ in to meet here."""

    mask: int
    radius: int

    @property
    def ball(self) -> list[int]:
        """The ways to differ: every choice of up to ``radius`` bits."""
        bits = [1 << i for i in range(H.HASH_BITS) if self.mask >> i & 1]
        return [sum(flip) for r in range(self.radius + 1) for flip in combinations(bits, r)]


# What an entry written costs, in comparisons, and the largest ball that is looked up.
ENTRY_COST = 10
MAX_BALL = 1_000


def search_plan(n: int, max_distance: int) -> tuple[list[Slice], int, float]:
    """The cheapest slices for ``n`` hashes, entries written per hash, and comparisons expected per
    evenly spread hash.

    If two hashes differ in at most ``d`` bits and the slices' radii r fulfil sum(r + 1) > d, they are
    within the radius on some slice: were all exceeded, they would differ in sum(r + 1) bits. Fewer slices are
    wider, so fewer strangers meet, but their balls are larger. For d = 12 there are 35 entries a hash at
    1e4 hashes, 154 at 1e5 and 556 from 1e6 on.
    """
    best = None
    for k in range(1, max_distance + 2):
        radii = [(max_distance + 1) // k - 1 + (i < (max_distance + 1) % k) for i in range(k)]
        parts = [Slice(m, r) for m, r in zip(H.slice_mask(H.FULL_MASK, k), radii)]
        balls = [sum(comb(p.mask.bit_count(), i) for i in range(p.radius + 1)) for p in parts]
        if max(balls) > MAX_BALL:
            continue
        # Each hash is stored once a slice; of two that meet, only the one with the smaller slice looks up.
        entries = k + (sum(balls) - k + 1) // 2
        met = n / 2 * sum(ball / 2 ** p.mask.bit_count() for p, ball in zip(parts, balls))
        if best is None or ENTRY_COST * entries + met < ENTRY_COST * best[1] + best[2]:
            best = (parts, entries, met)
    return best


def slices_of(varying: Column, fan_out: int) -> Column:
    """``ARRAY<BIGINT>``: the set bits of ``varying`` cut into ``fan_out`` runs of even width."""
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(H.HASH_BITS - 1)),
        lambda i: F.getbit(varying, i) == 1,
    )

    def runs(positions: Column) -> Column:
        def one(k: Column) -> Column:
            first = F.floor(F.size(positions) * k / fan_out).cast("int")
            after = F.floor(F.size(positions) * (k + 1) / fan_out).cast("int")
            return F.aggregate(
                F.slice(positions, first + 1, after - first),
                F.lit(0).cast("bigint"),
                lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(fan_out - 1)), one)

    return let(bits, runs)


def near_pairs(
    hashes: DataFrame, max_distance: int, max_bucket: int = MAX_BUCKET, hot_rows: int = HOT_ROWS, forest: bool = False
) -> DataFrame:
    """``(a, b, distance)`` for every two distinct hashes ``h`` within ``max_distance``, named by
    their owners. ``hashes`` has ``h`` (distinct) and ``owner``.

    Every hash is stored under its bits of each slice, and the one with the smaller slice looks the other
    up under all values within the slice's radius (``search_plan``). A pair is kept on the first
    slice that it meets on, so it comes out once. Buckets that hold more than ``max_bucket`` stored hashes leave the
    look-up: whatever meets there is cut finer by ``_cut_finer``. Where a wide distance asks for far more entries a
    hash than there are blocks of ``BLOCK_HASHES``, all pairs of blocks are compared instead
    (``_pairs_of_blocks``). Nothing is skipped or capped. With ``forest`` pairs may be left out whose ends hang
    together by pairs as near or nearer.
    """
    n = hashes.count()
    plan = search_plan(n, max_distance)[0]
    if _by_blocks(n, max_distance):
        return _pairs_of_blocks(hashes, max_distance, max(-(-n // BLOCK_HASHES), min(6, -(-n // SOME_HASHES))), forest)
    big = lambda m: F.lit(H.signed64(m)).cast("bigint")
    stored = hashes.select(
        "h", "owner", F.posexplode(F.array(*[big(p.mask) for p in plan])).alias("slice", "mask")
    ).select("slice", F.col("mask").bitwiseAND(F.col("h")).alias("shared"), "h", "owner")

    def around(number: int) -> Column:
        """The other values of the slice within its radius, above the hash's own."""
        part = plan[number]
        own = F.col("h").bitwiseAND(big(part.mask))
        flips = F.expr("array(" + ", ".join(f"bigint('{H.signed64(m)}')" for m in part.ball[1:]) + ")")
        return F.filter(F.transform(flips, lambda flip: own.bitwiseXOR(flip)), lambda key: key > own)

    asking = stored.withColumn("own", F.lit(True))
    for number, part in enumerate(plan):
        if part.radius:
            asked = hashes.select(F.lit(number).alias("slice"), F.explode(around(number)).alias("shared"), "h", "owner")
            asking = asking.unionByName(asked.withColumn("own", F.lit(False)))
    crowds = stored.groupBy("slice", "shared").agg(F.count(F.lit(1)).alias("n_here")).filter(F.col("n_here") > max_bucket)
    crowds = cut(crowds)
    crowded = not crowds.isEmpty()
    here, there = stored, asking
    if crowded:
        few = crowds.drop("n_here")  # at most n * slices / max_bucket rows
        few = F.broadcast(few) if n * len(plan) < max_bucket * SMALL_ROWS else few
        here, there = (t.join(few, ["slice", "shared"], "left_anti") for t in (stored, asking))
    differ = F.col("x.h").bitwiseXOR(F.col("y.h"))
    distance = F.bit_count(differ)
    first = F.coalesce(*[F.when(F.bit_count(differ.bitwiseAND(big(p.mask))) <= p.radius, F.lit(k)) for k, p in enumerate(plan)])
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("slice", "shared")]
    pairs = (
        there.alias("x").join(here.alias("y"), same[0] & same[1])
        .filter((distance <= max_distance) & (~F.col("own") | (F.col("x.h") < F.col("y.h"))) & (first == F.col("x.slice")))
        .select(
            F.least("x.owner", "y.owner").alias("a"), F.greatest("x.owner", "y.owner").alias("b"),
            distance.cast("int").alias("distance"),
        )
    )
    if not crowded:
        return pairs
    # Keys of different slices share no number: a slice's number is part of its bucket's name.
    meeting = asking.join(few, ["slice", "shared"], "left_semi")
    entries = meeting.select(F.col("slice").cast("bigint").alias("node"), "shared", "h", "owner").distinct()
    return pairs.unionByName(_cut_finer(entries, max_distance, max_bucket, hot_rows)).distinct()


def _by_blocks(n: int, max_distance: int) -> bool:
    """Whether a search within the distance asks for far more entries a hash than there are blocks."""
    n_entries = search_plan(n, max_distance)[1]
    return n_entries > MANY_ENTRIES and n_entries >= FEWER * -(-n // BLOCK_HASHES)


def _pairs_of_blocks(hashes: DataFrame, max_distance: int, n_blocks: int, forest: bool = False) -> DataFrame:
    """Near pairs by comparing every two hashes. Hashes are dealt into blocks and every two blocks, and each block
    with itself, make a task of its own, so a hash is written ``n_blocks`` times and a task holds two blocks. With
    ``forest`` a task gives a lightest spanning forest of its pairs: fewer rows than hashes, however dense they lie."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "owner", "upper", "own")] for b in batches]
        if not held:
            return
        h, owner, upper, own = (np.concatenate(c) for c in zip(*held))
        sides = [np.flatnonzero(~upper), np.flatnonzero(upper | own)]
        found = _close(h.view(np.uint64), *sides, bool(own.any()), max_distance)
        for a, b, distance in _lightest(found, len(h), max_distance) if forest else found:
            a, b = owner[a], owner[b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(distance.astype(np.int32))],
                ["a", "b", "distance"],
            )

    return _dealt(hashes, n_blocks).mapInArrow(work, "a bigint, b bigint, distance int")


def _dealt(hashes: DataFrame, n_blocks: int) -> DataFrame:
    """Hashes dealt into blocks, with a partition for every two blocks and for each with itself: ``h, owner``, whether
    it is of the ``upper`` block, and whether the partition is of one block (``own``)."""
    number = lambda low, high: (high * (high + 1) / 2 + low).cast("int")
    block = F.pmod(F.xxhash64("h"), F.lit(n_blocks)).cast("int")
    dealt = hashes.select(
        "h", F.col("owner").cast("bigint").alias("owner"), block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other"),
    ).select(
        "h", "owner", (F.col("block") > F.col("other")).alias("upper"), (F.col("block") == F.col("other")).alias("own"),
        number(F.least("block", "other"), F.greatest("block", "other")).alias("task"),
    )
    tasks = dealt.repartitionById(n_blocks * (n_blocks + 1) // 2, "task")
    return tasks.select("h", "owner", "upper", "own")


# Hashes of a block where only the pieces they hang together in are asked for, places of a slice's values that are
# looked up by number, and look-ups or comparisons made at once.
LINK_BLOCK, WIDEST, AT_ONCE = 1 << 19, 24, 1 << 20
# What a look-up and a comparison by slices cost, in comparisons by tiles; look-ups beyond which no slices are tried.
LOOK_UP, COMPARE, MOST_LOOK_UPS = 3, 5, 20_000
# Links that one task joins, some 100 bytes each.
LOCAL_LINKS = 2_000_000


def _links_of_blocks(hashes: DataFrame, max_distance: int, n_blocks: int) -> DataFrame:
    """``(u, v)`` that join the ``owner`` numbers of hashes within ``max_distance``, directly or by others. As in
    ``_pairs_of_blocks`` every two blocks make a task; it gives each number's smallest one, where that is another."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "owner", "upper", "own")] for b in batches]
        if not held:
            return
        h, owner, upper, own = (np.concatenate(c) for c in zip(*held))
        names, label = np.unique(owner, return_inverse=True)
        sides = [np.flatnonzero(~upper), np.flatnonzero(upper | own)]
        piece = _linked(h.view(np.uint64), label.astype(np.int32), *sides, bool(own.any()), max_distance)
        away = np.flatnonzero(piece != np.arange(len(piece)))
        yield pa.RecordBatch.from_arrays([pa.array(names[away]), pa.array(names[piece[away]])], ["u", "v"])

    return _dealt(hashes, n_blocks).mapInArrow(work, "u bigint, v bigint")


def _stars(links: DataFrame) -> DataFrame:
    """``(u, v)``: each number's smallest one that it hangs together with, where that is another; found by one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy() for c in ("u", "v")] for b in batches]
        if not held:
            return
        u, v = (np.concatenate(c) for c in zip(*held))
        names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        pieces = _Links(np.arange(len(names), dtype=np.int32))
        pieces.join(*ends.reshape(2, -1))
        away = np.flatnonzero(pieces.piece != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[away]), pa.array(names[pieces.piece[away]])], ["u", "v"])

    return links.coalesce(1).mapInArrow(work, "u bigint, v bigint")


def _linked(
    h: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, max_distance: int
) -> np.ndarray:
    """The smallest label that each label hangs together with by near pairs across ``left`` and ``right``.

    Hashes ask for others until their label is in one piece with the commonest, the anchor. Two hashes that have
    both stopped are in that piece; of any other two, one has asked for all that is near it.
    """
    links = _Links(label)
    if not len(left) or not len(right):
        return links.piece
    asked = _ask(links, h, left, right, max_distance)
    if not same:
        stopped = left[~np.isin(left, asked, assume_unique=True)]
        if len(stopped):
            _ask(links, h, links.open(right), stopped, max_distance)
    return links.piece


class _Links:
    """Labels and the pieces they hang together in, each named by its smallest label."""

    def __init__(self, label: np.ndarray):
        self.label = label
        self.piece = np.arange(label.max(initial=-1) + 1, dtype=np.int32)
        self.anchor: int | None = None
        self.choose_anchor()

    def choose_anchor(self) -> None:
        """The piece of the most places, once and for good: what stops asking does so because of it."""
        if self.anchor is None and len(self.label):
            sizes = np.bincount(self.piece[self.label])
            self.anchor = int(sizes.argmax()) if sizes.max() > 1 else None

    def open(self, places: np.ndarray) -> np.ndarray:
        """Those of the places whose labels aren't in the anchor's piece."""
        if self.anchor is None:
            return places
        return places[self.piece.take(self.label.take(places)) != self.piece[self.anchor]]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Labels at the places ``a`` and ``b`` hang together."""
        a, b = self.piece.take(self.label.take(a)), self.piece.take(self.label.take(b))
        apart = a != b
        if not apart.any():
            return
        roots, ends = np.unique(np.concatenate([a[apart], b[apart]]), return_inverse=True)
        low, (x, y) = np.arange(len(roots)), ends.reshape(2, -1)
        while True:
            x, y = low[x], low[y]
            apart = x != y
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            low[np.maximum(x, y)] = np.minimum(x, y)
            while (low[low] != low).any():
                low = low[low]
        self.piece[roots] = roots[low]
        self.piece = self.piece.take(self.piece)


def _ask(links: _Links, h: np.ndarray, asking: np.ndarray, stored: np.ndarray, max_distance: int) -> np.ndarray:
    """Joins what lies within ``max_distance`` across the places; gives those that have asked for everything."""
    asking = links.open(asking)
    plan = _cheapest(h, asking, stored, max_distance)
    if plan is None:
        return _ask_all(links, h, asking, stored, max_distance)
    tables = []
    for part, shift in plan:
        key = _keys(h[stored], part, shift)
        order = np.argsort(key, kind="stable")
        begins = np.zeros((1 << part.mask.bit_count()) + 1, np.int32)
        np.cumsum(np.bincount(key, minlength=len(begins) - 1), out=begins[1:])
        flips = np.array(part.ball, np.uint64) >> np.uint64(shift)
        tables.append((part, shift, (begins, np.diff(begins) > 0, stored[order], h[stored[order]]), flips.astype(np.int32)))
    for radius in range(max(part.radius for part, _ in plan) + 1):
        for part, shift, table, flips in tables:
            if radius > part.radius:
                continue
            asking = links.open(asking)
            asking = asking[np.argsort(_keys(h[asking], part, shift), kind="stable")]  # neighbours look up neighbours
            ring = flips[np.bitwise_count(flips) == radius]
            at = 0
            while at < len(ring) and len(asking):
                some = ring[at : at + max(1, AT_ONCE // len(asking))]
                at += len(some)
                for low in range(0, len(asking), AT_ONCE):
                    asks = asking[low : low + AT_ONCE]
                    _look_up(links, h, asks, _keys(h[asks], part, shift)[None, :] ^ some[:, None], table, max_distance)
                asking = links.open(asking)
        if radius == 0:
            links.choose_anchor()
    return links.open(asking)


def _look_up(
    links: _Links, h: np.ndarray, asking: np.ndarray, keys: np.ndarray, table: tuple[np.ndarray, ...], max_distance: int
) -> None:
    """Joins the asking places to those near them among what is stored under the keys, a row for each flip."""
    begins, filled, places, there = table
    keys = keys.ravel()
    some = np.flatnonzero(filled.take(keys))
    keys = keys.take(some)
    who, first = asking.take(some % len(asking)), begins.take(keys)
    count = begins.take(keys + 1) - first
    until = np.cumsum(count, dtype=np.int64)
    low = 0
    while low < len(who):
        done = until[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(until, done + AT_ONCE, "right")))
        asks, here, n = who[low:high], first[low:high], count[low:high]
        if low and links.anchor is not None:
            still = links.piece.take(links.label.take(asks)) != links.piece[links.anchor]
            asks, here, n = asks[still], here[still], n[still]
        low = high
        if not len(asks):
            continue
        ends = np.cumsum(n, dtype=np.int64)
        at = np.arange(ends[-1]) + np.repeat(here - (ends - n), n)
        met = np.flatnonzero(np.bitwise_count(np.repeat(h.take(asks), n) ^ there.take(at)) <= max_distance)
        if len(met):
            links.join(asks[np.searchsorted(ends, met, "right")], places.take(at.take(met)))


def _ask_all(links: _Links, h: np.ndarray, asking: np.ndarray, stored: np.ndarray, max_distance: int) -> np.ndarray:
    """As ``_ask``, where each place is compared with every stored one."""
    rows, columns = TILE
    for at in range(0, len(stored), columns):
        some = stored[at : at + columns]
        for low in range(0, len(asking), rows):
            asks = asking[low : low + rows]
            near = np.flatnonzero(np.bitwise_count(h[asks, None] ^ h[None, some]) <= max_distance)
            if len(near):
                i, j = np.divmod(near, len(some))
                links.join(asks[i], some[j])
        if at == 0:
            links.choose_anchor()
        asking = links.open(asking)
    return asking


def _keys(h: np.ndarray, part: Slice, shift: int) -> np.ndarray:
    return ((h & np.uint64(part.mask)) >> np.uint64(shift)).astype(np.int32)


def _cheapest(
    h: np.ndarray, asking: np.ndarray, stored: np.ndarray, max_distance: int
) -> list[tuple[Slice, int]] | None:
    """Slices, each with the place of its lowest bit, by which looking up is cheapest; None: comparing all is cheaper.
    How many are stored around a value is counted for some of the asking hashes; it decides about time only."""
    some = h[asking[:: max(1, len(asking) // 256)]]
    best, least = None, float(len(stored))
    for k in range(-(-H.HASH_BITS // WIDEST), max(max_distance + 1, 3) + 1):
        radii = [(max_distance + 1) // k - 1 + (i < (max_distance + 1) % k) for i in range(k)]
        parts = [Slice(m, r) for m, r in zip(H.slice_mask(H.FULL_MASK, k), radii) if r >= 0]
        sizes = [sum(comb(p.mask.bit_count(), i) for i in range(p.radius + 1)) for p in parts]
        if sum(sizes) > MOST_LOOK_UPS:
            continue
        plan, cost = [(p, (p.mask & -p.mask).bit_length() - 1) for p in parts], 0.0
        for (part, shift), size in zip(plan, sizes):
            there = np.bincount(_keys(h[stored], part, shift), minlength=1 << part.mask.bit_count())
            flips = np.array(part.ball[:: max(1, size // 64)], np.uint64) >> np.uint64(shift)
            around = there[_keys(some, part, shift)[:, None] ^ flips.astype(np.int32)[None, :]]
            cost += size * (LOOK_UP + COMPARE * (around.mean() if around.size else 0))
        if cost < least:
            best, least = plan, cost
    return best


def _close(
    h: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, max_distance: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``h`` of the near pairs across ``left`` and ``right``, tile by tile; with ``same`` both are
    one list, whose pairs come out once."""
    rows, columns = TILE
    x, y = h[left], h[right]
    for low in range(0, len(x), rows):
        for at in range(low if same else 0, len(y), columns):
            apart = np.bitwise_count(x[low : low + rows, None] ^ y[None, at : at + columns])
            i, j = np.divmod(np.flatnonzero(apart <= max_distance), apart.shape[1])
            if same:
                once = i + low < j + at
                i, j = i[once], j[once]
            if len(i):
                yield left[i + low], right[j + at], apart[i, j]


def _lightest(
    pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, max_distance: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A lightest spanning forest of ``pairs`` of the numbers below ``n``. A pair whose ends already hang together by
    others up to its distance is left out as it comes."""
    piece = np.tile(np.arange(n, dtype=np.int32), (max_distance + 1, 1))  # of each number, by distance
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)]
    held: list[list[np.ndarray]] = []
    rows = 0

    def settle() -> list[np.ndarray]:
        a, b, distance = (np.concatenate(c) for c in zip(kept, *held))
        parent, joined = list(range(n)), []
        for level in range(max_distance + 1):
            here = np.flatnonzero(distance == level)
            for at, x, y in zip(here.tolist(), a[here].tolist(), b[here].tolist()):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    joined.append(at)
            root = np.array(parent, np.int32)
            while (root[root] != root).any():
                root = root[root]
            piece[level] = root
        return [c[joined] for c in (a, b, distance)]

    for a, b, distance in pairs:
        new = piece[distance, a] != piece[distance, b]
        if new.any():
            held.append([a[new], b[new], distance[new]])
            rows += len(held[-1][0])
        if rows >= max(LOCAL_EDGES // 4, len(kept[0])):
            kept, held, rows = settle(), [], 0
    yield tuple(settle() if held else kept)


def _cut_finer(entries: DataFrame, max_distance: int, max_bucket: int, hot_rows: int) -> DataFrame:
    """Near pairs among the hashes ``h`` that meet in a bucket ``(node, shared)``.

    Two hashes within ``d`` agree fully on one of any ``d + 1`` slices, so a bucket above ``max_bucket`` is cut
    by the bits that vary inside it, and so on. Where the varying bits are too few for another cut to pay, the
    bucket is a dense cluster of near hashes; its pairs are formed by many tasks, each taking a share of one side.
    """
    fan_out = max_distance + 1
    found = []
    while True:
        sizes = entries.groupBy("node", "shared").agg(
            F.count(F.lit(1)).alias("n_here"), F.bit_or("h").bitwiseXOR(F.bit_and("h")).alias("varying")
        )
        crowded = F.col("n_here") > max_bucket
        if sizes.filter(crowded).isEmpty():
            found.append(_pairs_in_buckets(entries.withColumn("n_shares", F.lit(1)), max_distance))
            break
        part = F.floor(F.bit_count("varying") / fan_out)
        cut_again = crowded & (F.pow(F.lit(2.0), part) > fan_out)
        marked = sizes.filter("n_here > 1").select(
            "node",
            "shared",
            "n_here",
            F.when(cut_again, slices_of(F.col("varying"), fan_out)).alias("slices"),
            F.ceil(F.col("n_here") / max_bucket).cast("int").alias("n_shares"),
        )
        placed = cut(
            attach(entries, marked, ["node", "shared"], "h", "n_here", hot_rows=hot_rows)
        )
        found.append(_pairs_in_buckets(placed.filter("slices is null"), max_distance))
        deeper = placed.filter("slices is not null")
        if deeper.isEmpty():
            break
        # A bucket's number is a hash of its way down; should two ever coincide, their entries
        # merely meet as well and the distance check parts them.
        entries = deeper.select(
            "node", "shared", "h", "owner", F.posexplode("slices").alias("k", "part")
        ).select(
            F.xxhash64("node", "shared", "k").alias("node"),
            F.col("part").bitwiseAND(F.col("h")).alias("shared"),
            "h",
            "owner",
        )
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _pairs_in_buckets(entries: DataFrame, max_distance: int) -> DataFrame:
    """Close pairs inside each bucket. A bucket of several shares has its left side dealt out
    over them and its right side repeated on each."""
    share = F.pmod(F.xxhash64("h"), F.col("n_shares")).cast("int")
    left = entries.select(
        "node", "shared", share.alias("share"), F.col("h").alias("ha"), F.col("owner").alias("oa")
    )
    right = entries.select(
        "node",
        "shared",
        F.explode(F.sequence(F.lit(0), F.col("n_shares") - 1)).alias("share"),
        F.col("h").alias("hb"),
        F.col("owner").alias("ob"),
    )
    distance = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return (
        left.join(right, ["node", "shared", "share"])
        .filter((F.col("ha") < F.col("hb")) & (distance <= max_distance))
        .select(
            F.least("oa", "ob").alias("a"),
            F.greatest("oa", "ob").alias("b"),
            distance.cast("int").alias("distance"),
        )
    )


def representative_edges(
    sigs: DataFrame,
    max_distance: int,
    max_bucket: int = MAX_BUCKET,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(a, b, distance)`` between representatives, closest orientations first.

    Signatures sharing a hash are all linked to the smallest of them, and each distinct hash is
    compared once, on behalf of that smallest one. Every near pair is therefore connected, though
    not necessarily by an edge of its own when several signatures share a hash.
    """
    edges = _edges_with_repeats(sigs, max_distance, max_bucket, hot_rows)
    return edges.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def _edges_with_repeats(
    sigs: DataFrame, max_distance: int, max_bucket: int, hot_rows: int, forest: bool = False,
    owned: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The edges of ``representative_edges``, where representatives that meet with several hashes have one for each;
    ``forest`` as in ``near_pairs``; ``owned`` is ``_owned(sigs)``, where it has been made."""
    if max_distance == 0:
        return sigs.select(
            F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("distance")
        ).filter("false")
    faces, owners = owned or _owned(sigs)
    near = near_pairs(owners.select("h", "owner"), max_distance, max_bucket, hot_rows, forest)
    shared = attach(faces, owners.filter("n > 1"), "h", "rep", "n", hot_rows=hot_rows).select(
        F.col("owner").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("distance")
    )
    return near.unionByName(shared).filter("a <> b")


def _owned(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashes of the signatures, ``h, rep``, and the distinct ones with the smallest signature that has each: ``h,
    owner, n``."""
    faces = sigs.select(F.explode(F.array_distinct("signature")).alias("h"), "rep")
    return faces, cut(faces.groupBy("h").agg(F.min("rep").alias("owner"), F.count(F.lit(1)).alias("n")))


def near_dup_edges(
    hashes: DataFrame,
    max_distance: int = K.MAX_HAMMING_DISTANCE,
    max_bucket: int = MAX_BUCKET,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Edges ``(a, b, distance)`` with ``a < b``: a star inside each signature, and the edges
    between representatives."""
    sigs = cut(signatures(hashes))
    between = representative_edges(sigs, max_distance, max_bucket, hot_rows)
    stars = _with_signature_row(hashes, sigs.filter("n_files > 1"), hot_rows).select(
        F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance")
    )
    return stars.filter("a <> b").unionByName(between)


def _with_signature_row(hashes: DataFrame, keyed: DataFrame, hot_rows: int) -> DataFrame:
    readable = hashes.filter("orbit is not null").withColumn(
        "signature", H.orbit_signature(F.col("orbit"))
    )
    return attach(readable, keyed, "signature", "id", "n_files", hot_rows=hot_rows).drop("signature")


def near_dup_groups(
    hashes: DataFrame,
    max_distance: int = K.MAX_HAMMING_DISTANCE,
    max_bucket: int = MAX_BUCKET,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All columns of the readable rows plus ``group_id``, the smallest id of the group."""
    sigs = cut(signatures(hashes))
    edges = representative_edges(sigs, max_distance, max_bucket, hot_rows)
    found = connected_components(sigs.select(F.col("rep").alias("node")), edges, hot_rows=hot_rows)
    keyed = sigs.join(
        found.select(F.col("node").alias("rep"), F.col("component").alias("group_id")), "rep"
    ).select("signature", "group_id", "n_files")
    return _with_signature_row(hashes, keyed, hot_rows)


def dense_group_ids(groups: DataFrame) -> DataFrame:
    """Adds ``dense_id``: 0, 1, 2, … in order of each group's first id (which names the group)."""
    from sparkcurate.operators.ranking import prefix_scan

    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_scan(sizes, [], ["group_id"], {"dense_id": ("count", F.lit(1))})
    return attach(groups, ranked, "group_id", "id", "n")


def group_stats(groups: DataFrame) -> DataFrame:
    """One row: images, groups, groups with copies, redundant images, largest group, percent."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return stats_of_sizes(sizes)


def stats_of_sizes(sizes: DataFrame, by: list[str] | None = None) -> DataFrame:
    images, redundant = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return sizes.groupBy(*(by or [])).agg(
        images.alias("n_images"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_duplicate_groups"),
        redundant.alias("n_redundant_images"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"),
        F.when(images > 0, 100.0 * redundant / images).otherwise(0.0).alias("redundancy_pct"),
    )


def tolerance_sweep(
    files: DataFrame,
    distances: list[int],
    max_bucket: int = MAX_BUCKET,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per tolerance: groups, impure groups (two labels) and the leaked share of the test files.

    ``files`` has ``id, orbit, split, label``. Edges are found once, for the largest tolerance;
    one components run serves all of them, with the tolerance encoded into the node number. Of more than
    ``MANY_HASHES`` that are compared by blocks, one tolerance's groups are found from those of the one before
    (``_group_by_group``).
    """
    readable = files.filter("orbit is not null")
    count_if = lambda cond: F.count(F.when(cond, 1))
    sigs = cut(
        readable.groupBy(H.orbit_signature(F.col("orbit")).alias("signature")).agg(
            F.count(F.lit(1)).alias("n_files"),
            count_if(F.col("split") == "train").alias("train"),
            count_if(F.col("split") == "test").alias("test"),
            F.min("label").alias("first_label"),
            F.max("label").alias("last_label"),
        )
    )
    # Small numbers of their own, so that a node and a level fit into one number whatever the ids are.
    sigs = cut(sigs.withColumn("rep", F.monotonically_increasing_id()))
    faces, owners = _owned(sigs)
    n = owners.count()
    if n > MANY_HASHES and _by_blocks(n, max(distances)):
        return _leak_lines(_group_by_group(sigs, faces, owners, n, distances, hot_rows))
    width = len(distances)
    # Of the many pairs of a wide tolerance, those of a lightest forest join the same groups at any tolerance. They
    # are chosen where the pairs are found; repeated pairs change no forest, so no pair is shuffled.
    edges = _edges_with_repeats(sigs, max(distances), max_bucket, hot_rows, True, (faces, owners))
    edges = cut(contract(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "distance"), "distance"))
    edges = edges.withColumnsRenamed({"u": "a", "v": "b"})
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(distances)])
    leveled = edges.withColumn("level", F.explode(levels)).filter(
        "distance <= level.d and level.d > 0"
    )
    code = lambda col: (F.col(col) * width + F.col("level.k")).cast("bigint")
    nodes = sigs.withColumn("level", F.explode(levels)).withColumn("node", code("rep"))
    found = connected_components(
        nodes.select("node"), leveled.select(code("a").alias("a"), code("b").alias("b")),
        hot_rows=hot_rows,
    )
    per_group = (
        nodes.join(found, "node")
        .groupBy(F.col("level.d").alias("max_distance"), "component")
        .agg(
            F.sum("n_files").alias("n"),
            F.sum("train").alias("train"),
            F.sum("test").alias("test"),
            F.min("first_label").alias("first_label"),
            F.max("last_label").alias("last_label"),
        )
    )
    return _leak_lines(per_group)


def _leak_lines(per_group: DataFrame) -> DataFrame:
    """A line for each ``max_distance`` of the groups."""
    count_if = lambda cond: F.count(F.when(cond, 1))
    leaked = F.sum(F.when(F.col("train") > 0, F.col("test")).otherwise(0))
    return per_group.groupBy("max_distance").agg(
        F.count(F.lit(1)).alias("n_groups"),
        count_if(F.col("first_label") != F.col("last_label")).alias("n_impure_groups"),
        leaked.alias("leaked_test"),
        F.when(F.sum("test") > 0, 100.0 * leaked / F.sum("test")).otherwise(0.0).alias("leaked_pct"),
    )


def _group_by_group(
    sigs: DataFrame, faces: DataFrame, owners: DataFrame, n: int, distances: list[int], hot_rows: int
) -> DataFrame:
    """The groups at every tolerance, one below the other. Those of a tolerance are the nodes of the next, so only
    hashes of different groups are linked, and what has grown together is carried on as one row."""
    n_blocks = max(-(-n // LINK_BLOCK), min(6, -(-n // SOME_HASHES)))
    groups = sigs.withColumnRenamed("rep", "component").drop("signature")
    hashes = owners.filter("h is not null").select("h", "owner")
    # Signatures that share a hash hang together as soon as there is any tolerance.
    shared = attach(faces, owners.filter("n > 1"), "h", "rep", "n", hot_rows=hot_rows)
    links = shared.select(F.col("rep").alias("u"), F.col("owner").alias("v")).filter("u <> v")
    found = []
    for distance in sorted(set(distances)):
        if distance > 0:
            links = cut(links.unionByName(_links_of_blocks(hashes, distance, n_blocks)).distinct())
            nodes = groups.select(F.col("component").alias("node"))
            if links.count() <= LOCAL_LINKS:
                stars = _stars(links).select(F.col("u").alias("node"), F.col("v").alias("component"))
                moved = nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
            else:
                ends = links.select(F.col("u").alias("a"), F.col("v").alias("b"))
                moved = connected_components(nodes, ends, hot_rows=hot_rows)
            moved = cut(moved)
            groups = cut(
                groups.join(moved.select(F.col("node").alias("component"), F.col("component").alias("into")), "component")
                .groupBy(F.col("into").alias("component"))
                .agg(
                    *[F.sum(c).alias(c) for c in ("n_files", "train", "test")],
                    F.min("first_label").alias("first_label"),
                    F.max("last_label").alias("last_label"),
                )
            )
            held = hashes.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
            named = held.join(moved.select(F.col("node").alias("owner"), F.col("component").alias("into")), "owner")
            hashes = cut(attach(hashes, named, "owner", "h", "n", hot_rows=hot_rows).select("h", F.col("into").alias("owner")))
            links = links.select("u", "v").filter("false")
        found.append(groups.withColumn("max_distance", F.lit(distance)).withColumnRenamed("n_files", "n"))
    return reduce(DataFrame.unionByName, found)
