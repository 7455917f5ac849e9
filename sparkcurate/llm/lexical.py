"""Ranked lexical search by presence masks: the best documents of each item, exactly.

Terms are runs of digits, letters and all characters beyond ASCII, only A-Z lower-cased. The score of a document
sums, over an item's distinct terms, ``w * ((10**9 tf) div (1000 tf + 20 m))`` in whole numbers, where w weighs a
term's rarity and m grows with the document's length (see ``weight`` and ``length_part``).

Method: ``index`` reads every text once and keeps, per document, its length and the counts of those terms that
some item holds. Then, per batch of documents, a term has a bitmap of the documents that hold it. For an item
the bitmaps of its terms are turned into one mask a document, and documents of equal masks form a group. The
largest part that a term gives in the batch, times its weight, summed over a mask, bounds the score of the
whole group, so masks are evaluated by falling bound, and an item is finished in the batch when the next bound is below the
k-th best score so far, which carries over from batch to batch of a task. Nothing below it can enter, so
the ranking is that of all scores.

Scale: documents are read once and the forward index, whose size follows the input, is stored in the shared
folder; counts of documents are one aggregate over it. What the tasks are sent is the items' vocabulary
with its weights, at most ``BLOCK_BYTES`` of item texts a block: a larger benchmark takes several passes. A
task gives k rows an item; they are ranked in two steps, so that no item's rows from all tasks meet at once.

Defined results: null or empty texts hold no term and are no documents for N and L; items without terms have
no rows. Items of one id (repeated, or null) are one item with the terms of all. Repeated documents are
ranked each; of equal scores the smaller doc_id is first, null ids last. Fewer than k documents above 0 are all
given; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcurate.session import store

BEST = 50
BLOCK_BYTES = 8_000_000
#: Documents evaluated before the bound is looked at for the first time; then twice as many, and so on.
STEP = 256
#: Lists that the rows of an item are ranked in before they meet.
LISTS = 16
FOUND = "item int, doc_id long, score long"
INDEX = "struct<n:bigint,terms:array<int>,counts:array<int>>"

_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m = 50 + (50 n N) div L, also where the product leaves 64 bits."""
    if 50 * n_docs * int(n.max(initial=0)) >= 1 << 63:
        n = n.astype(object)
    return (50 + 50 * n * n_docs // total).astype(np.int64)


@dataclass
class Items:
    """A block of items: their ids, and the term numbers of each."""

    ids: list[int | None]
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        merged: dict[int | None, set[int]] = {}
        for item, text in rows:
            numbers = (vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text))
            merged.setdefault(item, set()).update(numbers)
        kept = {item: terms for item, terms in merged.items() if terms}
        return cls(list(kept), [np.array(sorted(t), np.int64) for t in kept.values()], vocabulary)


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items in blocks of about ``BLOCK_BYTES`` of text, dealt by a hash of the id."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = max(1, -(-size // BLOCK_BYTES))
    for block in range(number):
        found = Items.of([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(number)) == block).collect()])
        if found.ids:
            yield found


def index(docs: DataFrame, items: Items, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, terms, counts``: each document's length, and the items' terms it holds with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    @F.arrow_udf(INDEX)
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = shared.value
        for part in parts:
            sizes, ends, terms, counts = [], [0], [], []
            for value in part:
                words = terms_of(value.as_py())
                sizes.append(len(words))
                held = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                terms += [t for t, _ in held]
                counts += [c for _, c in held]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), *lists], ["n", "terms", "counts"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), count(F.col(text).cast("string")).alias("held"))
    return rows.select("doc_id", "held.*")


def document_counts(indexed: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term: one row a term and task, added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["term", "df"])

    found = np.zeros(n_terms, np.int64)
    rows = indexed.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for term, df in rows.collect():
        found[term] = df
    return found


class Batch:
    """Some documents, by term: bitmaps, and each document's part of the score for a term it holds."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, total: int):
        m = length_part(n, n_docs, total)
        order = np.argsort(terms, kind="stable")
        self.size, self.owner = len(n), owner[order]
        tf = counts[order].astype(np.int64)
        self.parts = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.owner])
        self.numbers, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))
        self.most = np.maximum.reduceat(self.parts, self.starts) if len(terms) else self.parts
        self.bitmaps = np.zeros((len(self.numbers), -(-self.size // 8)), np.uint8)
        row = np.repeat(np.arange(len(self.numbers)), self.ends - self.starts)
        np.bitwise_or.at(self.bitmaps, (row, self.owner >> 3), (128 >> (self.owner & 7)).astype(np.uint8))

    def groups(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct masks of the bitmaps ``rows`` as a 0/1 matrix, and the mask of each document."""
        bits = np.unpackbits(self.bitmaps[rows], axis=1, count=self.size)
        masks = np.ascontiguousarray(np.packbits(bits, axis=0).T)
        whole = np.zeros((self.size, -(-masks.shape[1] // 8) * 8), np.uint8)
        whole[:, : masks.shape[1]] = masks
        words = whole.view(np.uint64)
        if words.shape[1] == 1:
            _, first, which = np.unique(words[:, 0], return_index=True, return_inverse=True)
        else:
            _, first, which = np.unique(words, axis=0, return_index=True, return_inverse=True)
        return bits[:, first].T, which.ravel()

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor_score: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores that may be among the ``k`` best, all those of at least ``floor_score`` among
        them, and the number of scores that were worked out."""
        rows = np.searchsorted(self.numbers, terms)
        here = (rows < len(self.numbers)) & (weights > 0)
        here[here] = self.numbers[rows[here]] == terms[here]
        rows, weights = rows[here], weights[here]
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        masks, which = self.groups(rows)
        bounds = masks.astype(np.int64) @ (weights * self.most[rows])
        by_bound = np.argsort(-bounds, kind="stable")
        members = np.argsort(which, kind="stable")
        sizes = np.bincount(which, minlength=len(masks))
        firsts = np.cumsum(sizes) - sizes
        found, scores, done, at, step = [], [], 0, 0, STEP
        while at < len(by_bound) and bounds[by_bound[at]] >= max(1, floor_score):
            upto = at + 1 + int(np.searchsorted(np.cumsum(sizes[by_bound[at:]]), step))
            groups = by_bound[at:upto]
            groups = groups[bounds[groups] >= max(1, floor_score)]
            docs = np.sort(np.concatenate([members[firsts[g] : firsts[g] + sizes[g]] for g in groups.tolist()]))
            at, step = upto, 2 * step
            score = np.zeros(len(docs), np.int64)
            for row, w in zip(rows, weights):
                start, end = self.starts[row], self.ends[row]
                place = np.minimum(start + np.searchsorted(self.owner[start:end], docs), end - 1)
                score += np.where(self.owner[place] == docs, w * self.parts[place], 0)
            found.append(docs)
            scores.append(score)
            done += len(docs)
            if done >= k:
                every = np.concatenate(scores)
                floor_score = max(floor_score, int(np.partition(every, done - k)[done - k]))
        none = np.zeros(0, np.int64)
        docs, score = np.concatenate([none, *found]), np.concatenate([none, *scores])
        keep = score >= max(1, floor_score)
        return docs[keep], score[keep], done


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of each item."""
    spark = docs.sparkSession
    results = []
    for block in blocks(items):
        # Filtered as it is read back: a filter on the function's result would have Spark run it twice.
        indexed = store(index(docs, block, doc_id, text), "lexical-index").filter("n > 0")
        n_docs, total = indexed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = document_counts(indexed, len(block.vocabulary))
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        results.append(_ranked(indexed, block, weights, n_docs, total, k))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)


def _ranked(indexed: DataFrame, block: Items, weights: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    spark = indexed.sparkSession
    shared = spark.sparkContext.broadcast((block.terms, weights))
    last = np.iinfo(np.int64).max

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none, none.astype(bool))] * len(terms)  # ids, scores, whether the id is null
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(last).to_numpy()
            lists = batch.column("terms")
            owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            held = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts")]
            part = Batch(batch.column("n").to_numpy(), owner, *held, n_docs, total)
            for item, wanted in enumerate(terms):
                old = best[item]
                floor_score = int(old[1][-1]) if len(old[1]) == k else 0
                docs, scores, _ = part.best(wanted, weights[wanted], k, floor_score)
                if len(docs):
                    merged = [np.concatenate([a, b]) for a, b in zip(old, (ids[docs], scores, null[docs]))]
                    first = np.lexsort((merged[2], merged[0], -merged[1]))[:k]
                    best[item] = tuple(x[first] for x in merged)
        for item, (ids, scores, null) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), item), pa.int32()), pa.array(ids, pa.int64(), mask=null), pa.array(scores)],
                    ["item", "doc_id", "score"],
                )

    found = indexed.mapInArrow(search, FOUND)
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    spread = found.withColumn("list", F.pmod(F.xxhash64("doc_id"), F.lit(LISTS)))
    few = spread.withColumn("rank", place("item", "list")).filter(F.col("rank") <= k).drop("rank", "list")
    ranked = few.withColumn("rank", place("item")).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
