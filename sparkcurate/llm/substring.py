"""Substring dedup: words covered by a window of ``WINDOW`` words that also starts in a smaller document.

1. Route. The anchor of a window is the smallest hash among its runs of ``GRAM`` words: equal windows have
   equal anchors. Neighbouring windows with one anchor form a run. Only anchors that occur in two
   documents can hold a repeated window; all others are left behind before any text moves.
2. Cut. The stretch of text under each run that is left is dealt by its anchor. Equal stretches are merged
   first and keep the smallest document id. The runs of an anchor with more than ``HOT_RUNS`` of them
   are parted by a second, independent anchor; with more than ``CROWDED_RUNS`` they are dealt window by
   window, by a hash of all its words, so that what stays together is equal and merges.
3. Search. Each shard builds a compressed FM-index of its stretches and streams them through it by
   backward search over a wavelet matrix; the matching statistics, held at ``WINDOW`` words, give each
   window its interval of equal windows, and with it the smallest document in which it starts.
4. Remove. A document gets back which of its windows start in a smaller document, and drops the words
   under them.

Scale: linear in the text; anchors are three numbers; texts move twice (to be cut, to be cleaned) and
stretches once. Shards hold about ``SHARD_WORDS`` words whatever the size of the input, so an index needs a
bounded part of memory. Words are compared as such inside the index; hashes only route.

Defined results: windows are judged on the input, not on what is left; texts under ``WINDOW`` words and
null texts keep everything; a null document id is neither smaller nor larger than any, so such rows
stay whole and remove nothing; rows with the same id do not remove each other's words; repeated
windows inside one document stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcurate.llm.bagminhash import GOLD, U, mix, word_hashes
from sparkcurate.llm.fmindex import FMIndex
from sparkcurate.operators.skew import attach
from sparkcurate.session import store

WINDOW = 50
GRAM = 8
LONGEST_RUN = 128
HOT_RUNS = 5_000
CROWDED_RUNS = 25_000
SHARD_WORDS = 400_000

RUNS = "doc_id long, text_hash long, anchor long, first int, last int"
STRETCHES = "doc_id long, text_hash long, anchor long, first int, stretch binary, part1 long, part2 long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM, salt: int = 0) -> np.ndarray:
    """The smallest hash of ``gram`` words in each window of the word hashes ``h``; every ``salt`` has its
    own, independent ones."""
    g = np.full(max(len(h) - gram + 1, 0), U(gram + salt * 1000), np.uint64)
    for k in range(gram):
        g = mix(g * GOLD + h[k : len(g) + k])
    width, inside = 1, window - gram + 1
    while 2 * width <= inside:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    rest = inside - width
    return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


def runs_of(texts: list[list[bytes]], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(text, anchor, first, last)`` of all runs of windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    h = word_hashes([w for t in texts for w in t])
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    least = anchors(h, window, gram)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.flatnonzero(owner[:n] == owner[window - 1 :])
    anchor, owner, place = least[places], owner[places], places - begin[places]
    new = np.ones(len(places), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    in_run = np.arange(len(places)) - np.repeat(start, np.diff(np.append(start, len(places))))
    start = np.flatnonzero(in_run % LONGEST_RUN == 0)
    end = np.append(start[1:], len(places)) - 1
    return owner[start], anchor[start].view(np.int64), place[start], place[end]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            text, anchor, first, last = runs_of([words_of(t) for t in batch.column("text").to_pylist()])
            ids = batch.select(["doc_id", "text_hash"]).take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(anchor), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                ["doc_id", "text_hash", "anchor", "first", "last"],
            )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their runs to the stretches of text under them."""
    import xxhash

    kind = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in STRETCHES.split(", ")]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        rows = []
        for doc_id, text_hash, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "runs"))):
            words = words_of(text)
            second = anchors(word_hashes(words), salt=1).tolist() if any(run["hot"] == 1 for run in runs) else []
            for run in runs:
                first, last = run["first"], run["last"]
                starts = [first]
                if run["hot"]:
                    starts += [i for i in range(first + 1, last + 1) if run["hot"] > 1 or second[i] != second[i - 1]]
                for first, last in zip(starts, [*(i - 1 for i in starts[1:]), last]):
                    stretch = b" ".join(words[first : last + WINDOW])
                    one = signed(xxhash.xxh64_intdigest(stretch))
                    two = signed(xxhash.xxh64_intdigest(stretch, 1))
                    key = run["anchor"]
                    if run["hot"]:
                        key = one if run["hot"] > 1 else signed((key * 31 + second[first]) & 0xFFFFFFFFFFFFFFFF)
                    rows.append((doc_id, text_hash, key, first, stretch, one, two))
            if len(rows) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind)], names)


def smallest_starts(stretches: list[bytes], first_doc: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For every window of every stretch the smallest document in which it starts, by an FM-index."""
    number: dict[bytes, int] = {}
    words = [s.split(b" ") for s in stretches]
    sizes = np.array([len(w) for w in words], np.int64)
    text = np.zeros(int(sizes.sum()) + len(words), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    for part, end in zip(words, ends):
        text[end - len(part) : end] = [number.setdefault(w, len(number) + 1) for w in part]
    index = FMIndex(text, window)
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    smallest = np.minimum.reduceat(first_doc[owner[index.suffixes]], index.whole)
    out = np.zeros(len(text), np.int64)
    for _, start, low in index.stream(text, ends, sizes):
        out[start] = smallest[index.group(index.whole, low)]
    return [out[end - size : end - window + 1] for end, size in zip(ends, sizes)]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if batches else None
    if table is None or not table.num_rows:
        return
    found = smallest_starts(table.column("stretch").to_pylist(), table.column("doc_id").to_numpy().astype(np.int64))
    sizes = np.array([len(x) for x in found])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    starts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
    columns = [table.column(c).combine_chunks() for c in ("anchor", "part1", "part2", "n")]
    yield pa.RecordBatch.from_arrays([*columns, starts], ["anchor", "part1", "part2", "n", "starts"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept_text, n_words, n_removed = [], [], []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            words = words_of(text)
            change = np.zeros(len(words) + 1, np.int64)
            for part in removed or ():
                at = part["first"] + np.flatnonzero(np.array(part["gone"], bool))
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
            keep = np.cumsum(change[:-1]) == 0
            left = [w for w, k in zip(words, keep) if k] if removed else words
            kept_text.append(b" ".join(left))
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in kept_text], pa.string()),
                pa.array([t.decode("utf-8", "surrogatepass") for t in kept_text], pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` for every row of ``docs``: ``kept`` is what is left
    of the text, its words joined by one space."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    runs = store(
        rows.filter("doc_id is not null and text is not null").select("doc_id", "text_hash", "text").mapInArrow(_runs, RUNS),
        "repeat-runs",
    )
    shared = (
        runs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
        .filter("low < high").select("anchor", "n", F.when(F.col("n") > CROWDED_RUNS, 2).when(F.col("n") > HOT_RUNS, 1).otherwise(0).alias("hot"))
    )
    left = attach(runs, shared, "anchor", ["doc_id", "first"], "n")
    by_doc = left.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("anchor", "first", "last", "hot")).alias("runs"))
    cut = store(
        rows.join(by_doc, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "runs").mapInArrow(_stretches, STRETCHES),
        "repeat-stretches",
    )
    key = ["anchor", "part1", "part2"]
    merged = cut.groupBy(*key, "stretch").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    size = cut.agg(F.coalesce(F.sum(F.octet_length("stretch")), F.lit(0))).first()[0]
    n_shards = max(1, -(-size // (SHARD_WORDS * 6)))
    sharded = merged.select(*key, "stretch", "doc_id", "n").repartition(n_shards, "anchor")
    schema = T.StructType.fromDDL("anchor long, part1 long, part2 long, n long, starts array<long>")
    found = store(sharded.mapInArrow(_shard, schema), "repeat-starts")  # read twice below
    gone = F.transform("starts", lambda x: x < F.col("doc_id"))
    removed = (
        attach(cut.select(*key, "doc_id", "text_hash", "first"), found, key, "doc_id", "n").withColumn("gone", gone)
        .filter(F.exists("gone", lambda x: x)).groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("first", "gone")).alias("removed"))
    )
    cleaned = rows.join(removed, ["doc_id", "text_hash"], "left").select("doc_id", "text", "removed")
    return cleaned.mapInArrow(_cleaned, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
