"""Near-duplicates by weighted MinHash (BagMinHash), for multisets of five-word shingles.

Two texts are linked when the weighted Jaccard similarity of their shingle multisets, sum of minima by
sum of maxima, is at least ``SIMILAR``; classes are the connected components of these links.

Signature. Every shingle spans a Poisson process in time over the weights 0 to its count. Weights are
discretised into pieces (0, 1], (1, 2], (2, 4], (4, 8] and so on; a piece has one process with a rate of
its size, and each of its points has a weight inside the piece, a time and a component. A text sees the
points below its counts; its signature holds, for each component, the earliest point it sees. Two
texts agree on a component with probability equal to their weighted Jaccard similarity, and only
about m ln m points of a text are ever generated, whatever its counts.

Search. ``BANDS`` keys of ``ROWS`` components each put similar texts into common buckets (a pair at the
limit is missed with probability 3e-5). In a bucket the member with the largest buckets overall is the
hub; each text is first verified against one hub, the one it meets most. Buckets that still hold several
components are then verified completely, in blocks of at most 2 * ``BLOCK`` texts: a block task compares
its texts by one product of 0/1 matrices and only emits links. So no pair that shares a bucket
is left out, unless it is already known to be in one class.

Scale: equal multisets are one node from the start, so exact copies never meet. Bucket rows are three
numbers; texts travel only to be verified. Pairs inside a bucket are never written out, and no bucket
or component is collected. A dense bucket costs the square of its texts in block products (about a
microsecond for a thousand pairs) unless its texts are in one class already.

Defined results: texts of one to four words have one shingle, all their words; null texts and texts
without words are alone in their class; rows with the same id are rows of their own; an empty table
gives an empty result; other columns, whatever their names, pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcurate.operators.components import connected_components
from sparkcurate.operators.skew import attach, small_side
from sparkcurate.session import store

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 4
SIZE = BANDS * ROWS
BLOCK = 256
HUB_ROWS = 200
CACHED_WORDS = 150_000
COLUMNS = 20_000  # of a block product at a time

U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


@cache
def _word_hashes() -> dict[bytes, int]:
    return {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = _word_hashes()
    if len(known) > CACHED_WORDS:
        known.clear()
    for word in words:
        if word not in known:
            known[word] = xxhash.xxh64_intdigest(word)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles of a text, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    h = word_hashes(words)
    width = min(SHINGLE, len(words))
    if not width:
        return h
    out = np.full(len(words) - width + 1, U(width), np.uint64)
    for k in range(width):
        out = mix(out * GOLD + h[k : len(h) - width + 1 + k])
    return out


def elements(text: str | None) -> np.ndarray:
    """The multiset of shingles as a sorted set: the second, third... time of a shingle is an element of
    its own, so the Jaccard similarity of sets is the weighted one."""
    s = np.sort(shingles(text))
    if not len(s):
        return s
    first = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.flatnonzero(first)
    time = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return np.sort(np.where(time > 0, mix(s + time.astype(np.uint64) * GOLD), s))


def signatures(bags: list[np.ndarray]) -> np.ndarray:
    """``signature[bag, component]`` of shingle lists; zeros for an empty one."""
    key, owner, count = [], [], []
    for i, bag in enumerate(bags):
        if len(bag):
            k, c = np.unique(bag, return_counts=True)
            key.append(k)
            count.append(c)
            owner.append(np.full(len(k), i, np.int64))
    out = np.zeros((len(bags), SIZE), np.uint64)
    if not key:
        return out
    key, owner, count = np.concatenate(key), np.concatenate(owner), np.concatenate(count)
    # Pieces of weight: 0 is (0, 1], k is (2**(k-1), 2**k]; the last one may reach beyond the count.
    pieces = [(key, owner, count, 0)]
    k, some = 1, np.flatnonzero(count > 1)
    while len(some):
        pieces.append((key[some], owner[some], count[some], k))
        some, k = some[count[some] > 2**k], k + 1
    seed = np.concatenate([mix(p[0] + U(p[3] * int(MIX2) & 0xFFFFFFFFFFFFFFFF)) for p in pieces])
    low = np.concatenate([np.full(len(p[0]), 0.0 if p[3] == 0 else 2.0 ** (p[3] - 1)) for p in pieces])
    width = np.maximum(low, 1.0)
    owner, count = np.concatenate([p[1] for p in pieces]), np.concatenate([p[2] for p in pieces]).astype(float)
    now, drawn = np.zeros(len(seed)), 0
    best = np.full(len(bags) * SIZE, np.inf)
    point = np.zeros(len(bags) * SIZE, np.uint64)
    step = 1
    while len(seed):
        numbers = (np.arange(drawn, drawn + step, dtype=np.uint64) + U(1)) * GOLD
        code = mix(seed[:, None] + numbers)
        gap = -np.log(((code >> U(11)).astype(float) + 0.5) * 2.0**-53) / width[:, None]
        when = now[:, None] + np.cumsum(gap, 1)
        other = mix(code ^ MIX1)
        component = ((other >> U(32)) * U(SIZE)) >> U(32)
        weight = low[:, None] + (other & U(0xFFFFFFFF)).astype(float) * 2.0**-32 * width[:, None]
        row, col = np.nonzero(weight < count[:, None])
        cell = owner[row] * SIZE + component[row, col].astype(np.int64)
        time = when[row, col]
        earlier = time < best[cell]
        row, col, cell, time = row[earlier], col[earlier], cell[earlier], time[earlier]
        np.minimum.at(best, cell, time)
        wins = best[cell] == time
        point[cell[wins]] = code[row[wins], col[wins]]
        latest = best.reshape(len(bags), SIZE).max(1)
        now, drawn = when[:, -1], drawn + step
        left = now < latest[owner]
        seed, low, width, owner, count, now = (x[left] for x in (seed, low, width, owner, count, now))
        step = min(2 * step, max(1, 4_000_000 // max(len(seed), 1)))
    return point.reshape(len(bags), SIZE)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """``key[bag, band]``, different for different bands."""
    bands = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * GOLD + bands[:, :, r])
    return key.view(np.int64)


PRINT = "print1 long, print2 long, n_shingles long, bands array<long>"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``text``, to the same rows with the columns of ``PRINT`` added."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            bags = [shingles(t) for t in batch.column("text").to_pylist()]
            keys = band_keys(signatures(bags))
            one = [int(mix(b).sum(dtype=np.uint64).view(np.int64)) for b in bags]
            two = [int(mix(b ^ MIX2).sum(dtype=np.uint64).view(np.int64)) for b in bags]
            added = [
                pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([len(b) for b in bags], pa.int64()),
                pa.array(list(keys), pa.list_(pa.int64())),
            ]
            names = [c.split()[0] for c in PRINT.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])


def _compare(groups: Iterator[tuple[np.ndarray, ...]], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in each group of ``(node, component, side, elements)``: pairs of different components that
    are similar; where a group has two sides, only pairs across them."""
    for node, component, side, bags in groups:
        n = len(node)
        flat = np.concatenate(bags)
        owner = np.repeat(np.arange(n), [len(b) for b in bags])
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        keep = shared[inverse]
        column, owner = place[inverse][keep], owner[keep]
        size = np.array([len(b) for b in bags], np.int64)
        common = np.zeros((n, n), np.float32)
        for low in range(0, int(shared.sum()), COLUMNS):
            inside = (column >= low) & (column < low + COLUMNS)
            part = np.zeros((n, COLUMNS if n > 8 else min(COLUMNS, int(shared.sum()) - low)), np.float32)
            part[owner[inside], column[inside] - low] = 1
            common += part @ part.T
        common = common.astype(np.int64)
        union = size[:, None] + size[None, :] - common
        similar = (common >= threshold * union - 1e-9) & (component[:, None] < component[None, :])
        if len(set(side.tolist())) > 1:
            similar &= side[:, None] != side[None, :]
        a, b = np.nonzero(similar)
        if len(a):
            yield node[a], node[b]


def _verify_blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows ``key, lo, hi, node, component, side, text`` sorted by group; to links ``a, b``."""

    def groups() -> Iterator[tuple[np.ndarray, ...]]:
        key, rows = None, []

        def done():
            node, component, side, texts = zip(*rows)
            return np.array(node), np.array(component), np.array(side), [elements(t) for t in texts]

        for batch in batches:
            names = ("key", "lo", "hi", "node", "component", "side", "text")
            for k, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if (k, lo, hi) != key:
                    if len(rows) > 1:
                        yield done()
                    key, rows = (k, lo, hi), []
                rows.append(row)
        if len(rows) > 1:
            yield done()

    for a, b in _compare(groups(), threshold):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _verify_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows ``a, b, left, right`` (two texts) to the links among them."""
    for batch in batches:
        good, last, bag = [], None, None
        for i, (left, right) in enumerate(zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())):
            if left != last:
                last, bag = left, elements(left)
            other = elements(right)
            common = len(np.intersect1d(bag, other, assume_unique=True))
            if common >= threshold * (len(bag) + len(other) - common) - 1e-9:
                good.append(i)
        if good:
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``row, id, text`` and the columns of ``PRINT`` for all of ``docs``, in a table in the shared folder;
    ``row`` numbers the rows. With ``whole`` the other columns come along in a struct ``rest``."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest")] if whole else []
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), *rest
    )
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(PRINT).fields])
    return store(rows.mapInArrow(_fingerprints, schema), "near-rows")


#: Bit maps of row numbers that are sent to every executor, at most: 40 MB, for 300 million rows and more.
MAPS = 10_000


def among(rows: DataFrame, wanted: DataFrame, row: str = "row") -> DataFrame:
    """``rows`` whose number ``row`` is in ``wanted``, a table of one column of such numbers. They are looked up in bit
    maps of 32,768 numbers each, so that the rows with their texts stay where they are."""
    number = wanted.columns[0]
    maps = wanted.groupBy(F.bitmap_bucket_number(number).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_map")
    )
    at = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(row)).join(small_side(maps, MAPS), "_bucket")
    return placed.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def classes(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``print1, print2, n_shingles, node, class_id, n`` for each distinct multiset of ``rows``, with the
    smallest id of its class and the number of rows of its own."""
    same = ["print1", "print2", "n_shingles"]
    nodes = store(
        rows.filter("n_shingles > 0").groupBy(*same).agg(F.min("row").alias("node"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n")),
        "near-nodes",
    )
    of_node = among(rows, nodes.select("node"))
    texts = of_node.select(F.col("row").alias("node"), "text")
    keyed = of_node.select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = store(attach(keyed, sizes.withColumn("size", F.col("n")), "key", "node", "n"), "near-buckets")

    score = met.groupBy("node").agg(F.sum("size").alias("score"))
    scored = met.join(score, "node")
    hubs = scored.groupBy("key").agg(
        F.max(F.struct("score", (-F.col("node")).alias("hub"))).alias("top"), F.count(F.lit(1)).alias("n")
    ).select("key", (-F.col("top.hub")).alias("hub"), F.col("top.score").alias("hub_score"), "n")
    meets = attach(met.select("key", "node"), hubs, "key", "node", "n").filter("hub <> node")
    by_hub = meets.groupBy("node", "hub", "hub_score").agg(F.count(F.lit(1)).alias("shared"))
    best = W.partitionBy("node").orderBy(F.desc("shared"), F.desc("hub_score"), "hub")
    chosen = by_hub.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("node", "hub")
    chosen = store(chosen, "near-chosen")
    compared = among(texts, chosen.select("node").unionByName(chosen.select(F.col("hub").alias("node"))), "node")
    # A hub's text goes once to every HUB_ROWS of its members, which are dealt out over its copies.
    members = chosen.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("copies"))
    hub_texts = members.join(compared.select(F.col("node").alias("hub"), F.col("text").alias("left")), "hub").select(
        "hub", "left", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )
    dealt = chosen.join(members, "hub").withColumn("copy", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int"))
    pairs = (
        dealt.select("hub", "copy", "node").join(compared.withColumnRenamed("text", "right"), "node")
        .join(hub_texts, ["hub", "copy"])
        .select(F.col("hub").alias("a"), F.col("node").alias("b"), "left", "right")
    )
    links = store(pairs.mapInArrow(lambda x: _verify_pairs(x, similar), "a long, b long"), "near-links")
    first = connected_components(met.select("node").distinct(), links, local=False)

    placed = store(met.join(first, "node"), "near-placed")
    token = F.xxhash64("node")
    open_sets = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"),
        F.sum(token.cast("decimal(38,0)")).alias("set1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("set2"),
    ).filter("low <> high")
    once = open_sets.groupBy("n", "set1", "set2").agg(F.min("key").alias("key")).select("key", "n")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    open_rows = store(attach(placed, once, "key", "node", "n"), "near-open")
    in_blocks = (
        open_rows
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "component",
            F.col("block").alias("side"),
        )
    )
    ready = in_blocks.join(among(texts, open_rows.select("node"), "node"), "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    more = ready.select("key", "lo", "hi", "node", "component", "side", "text").mapInArrow(
        lambda x: _verify_blocks(x, similar), "a long, b long"
    )
    final = connected_components(nodes.select("node"), links.unionByName(more), local=False)
    labelled = nodes.join(final, "node")
    lowest = labelled.groupBy("component").agg(
        F.min("id").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("nodes")
    )
    return attach(labelled, lowest, "component", "node", "nodes").select(
        *same, "node", "component", "n", "class_id", "class_size"
    )


def labels(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``row, id, component, class_id, class_size`` for every row of ``fingerprints``."""
    found = classes(rows, similar)
    same = ["print1", "print2", "n_shingles"]
    wordy = attach(rows.filter("n_shingles > 0").select("row", "id", *same), found, same, "row", "n").select(
        "row", "id", "component", "class_id", "class_size"
    )
    alone = rows.filter("n_shingles = 0").select(
        "row", "id", F.lit(None).cast("long").alias("component"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return wordy.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``id, component, class_id, class_size`` for every row of ``docs``: ``class_id`` is the smallest id in
    its class, ``component`` is null for rows that are alone for want of words."""
    return labels(fingerprints(docs, id_col, text), similar).drop("row")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; columns as before."""
    rows = fingerprints(docs, id_col, text, whole=True)
    found = store(labels(rows, similar).select("row", "id", "component"), "near-labels")
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("id", "row")).alias("first"))
    kept = first.select("first.row").unionByName(found.filter("component is null").select("row"))
    back = [F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return among(rows, kept).select(*back)
