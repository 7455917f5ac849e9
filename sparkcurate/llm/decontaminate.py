"""Benchmark decontamination by random-walk embedding and bit-sampling LSH.

A benchmark item is found in a document when some stretch of the document is within
``floor(EDITS * n)`` word edits of the item's n words. Words are lower-cased runs of letters and digits,
so case and punctuation do not hide an item.

Search, per item length n: every window of n words is embedded by the walk of Chakraborty, Goldenberg
and Koucky (a copy of the window in which each word is repeated or passed as a hash of step and word
says), which maps edit distance to Hamming distance; keys of ``SAMPLED`` positions of the embedding are
looked up among the keys of the items. Walks and samples are repeated until items under as many edits as
allowed are found at the target recall; the number is measured on mutated items, every item of the
length among them, when the index is built. Where ``MOST_SAMPLES`` a walk miss the target, the length does
without LSH: of k + 1 pieces of an item, k edits leave one whole, so whatever holds a piece is a candidate.
Candidates are then verified exactly by dynamic programming over the words around the window.

Windows that cannot match are not embedded, which loses nothing: each word that occurs in no item needs
an edit of its own, and each edit spoils at most two of the item's n - 1 pairs of neighbouring words, so
a window needs at least n - 1 - 2k pairs that occur in some item of that length. Windows may run over both ends of a
text, by as many words as an item of their length may have lost: those count as words of no item.

Scale: documents are read once, in place, without any shuffle, one pass for each block of items. A block
holds at most ``BLOCK_WORDS`` words of items, which bounds what is sent to the executors whatever the
size of the benchmark: a block's index is built in the driver and sent once to every Python worker, about 64
bytes a word. Each text is searched whole.

Defined results: null or empty texts and items without words match nothing; items shorter than
1 / ``EDITS`` words must occur exactly; repeated documents or items each get their own row; a text that
holds an item several times gets one row with its best place; empty tables give empty results; other
columns pass through ``hits``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDITS = 0.2
TARGET = 0.97
SAMPLED = 3
WALKS = 6
MOST_SAMPLES = 64  # a walk
BLOCK_WORDS = 2_000_000
LONGEST = 3 * 128  # steps drawn at a time
CHUNK = 4_000  # windows embedded at a time
TRIAL_WORDS = 240_000  # words of mutated items embedded at a time
BATCH_CHARS = 4_000_000
HITS = "array<struct<item_id:bigint,distance:int,item_words:int,start:int>>"

_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
OTHER = 0  # a word of no item
BASE = np.uint64(0x2545F4914F6CDD1D)  # of the running sums that tell windows apart
PAD = np.uint32(0xFFFFFFFF)  # the embedding has used up the window


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def allowed(n: int) -> int:
    return int(EDITS * n + 1e-9)


def embed(words: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``out[step, walk, window]``: every walk over ``words[start : start + n]`` of every window, 3 * n
    symbols each. Windows must come in falling order of ``n``."""
    steps = 3 * int(n[0])
    rng = np.random.default_rng(0)
    factors = rng.integers(1, 1 << 31, (WALKS, LONGEST), np.uint32) * np.uint32(2) + np.uint32(1)
    while factors.shape[1] < steps:  # further steps of the same walks
        more = rng.integers(1, 1 << 31, (WALKS, LONGEST), np.uint32) * np.uint32(2) + np.uint32(1)
        factors = np.concatenate([factors, more], 1)
    out = np.full((steps, WALKS, len(starts)), PAD, np.uint32)
    at = np.zeros((WALKS, len(starts)), np.int64)
    active = np.searchsorted(-3 * n, -np.arange(steps), "left")  # windows with 3 * n > step
    for j in range(steps):
        m = active[j]
        a, length = at[:, :m], n[:m]
        symbol = words[starts[:m] + np.minimum(a, length - 1)]
        symbol = np.where(a < length, symbol, PAD)
        out[j, :, :m] = symbol
        a += ((symbol + np.uint32(j + 1)) * factors[:, j, None]) >> np.uint32(31)
    return out


def sample_keys(symbols: np.ndarray, n: int, walk: int, number: int) -> np.ndarray:
    """The ``number``-th sample of positions, hashed to one key for each window."""
    rng = np.random.default_rng([walk, n, number])
    key = np.full(symbols.shape[1], number, np.uint64)
    for place in rng.choice(3 * n, min(SAMPLED, 3 * n), replace=False):
        key = (key ^ symbols[place]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD1B54A32D192ED03)


def running(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sums, unroll``: ``(sums[b] - sums[a]) * unroll[a]`` depends on ``words[a:b]`` only."""
    power = np.cumprod(np.full(len(words), BASE, np.uint64))
    unroll = np.cumprod(np.full(len(words), pow(int(BASE), -1, 1 << 64), np.uint64))
    mixed = (words + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power, dtype=np.uint64)]), unroll


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edits between ``item`` and any stretch of ``region``, and where such a stretch starts."""
    m = len(region)
    ahead = np.arange(m + 1)
    cost, start = np.zeros(m + 1, np.int64), ahead.copy()
    for word in item:
        step = np.concatenate([[1], (region != word).astype(np.int64)])
        diagonal = np.concatenate([[cost[0] + 1], cost[:-1] + step[1:]])
        new = np.minimum(diagonal, cost + 1)
        from_diagonal = np.concatenate([[start[0]], start[:-1]])
        origin = np.where(diagonal <= cost + 1, from_diagonal, start)
        # Words of the region that are skipped: the best earlier cell plus the distance to it.
        relative = new - ahead
        least = np.minimum.accumulate(relative)
        leader = np.maximum.accumulate(np.where(relative == least, ahead, 0))
        cost, start = least + ahead, origin[leader]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end])


class Index:
    """Items by length with their keys; small enough to be sent to every executor."""

    def __init__(self, items: list[tuple[int, str]], target: float = TARGET):
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        by_length: dict[int, list[int]] = defaultdict(list)
        for item_id, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
            words = words_of(text)
            if words:
                ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.uint32)
                by_length[len(words)].append(len(self.items))
                self.items.append((item_id, ids))
        self.recall: dict[int, float] = {}
        pairs = [pair_hash(ids[:-1], ids[1:]) for _, ids in self.items]
        flat_pairs = np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)
        #: Marks of the items' word pairs; that others may share a mark only lets more windows through.
        self.shift = np.uint64(64 - max(16, int(len(flat_pairs)).bit_length() + 5))
        self.pairs = np.zeros(1 << (64 - int(self.shift)), bool)
        self.pairs[flat_pairs >> self.shift] = True
        #: Each pair with a bit for every length of the items that hold it; beyond 64 lengths, some share one.
        self.bit = {n: np.uint64(i % 64) for i, n in enumerate(sorted(by_length))}
        bits = [np.full(len(p), np.uint64(1) << self.bit[len(ids)]) for p, (_, ids) in zip(pairs, self.items)]
        self.pair_keys, inverse = np.unique(flat_pairs, return_inverse=True)
        self.pair_lengths = np.zeros(len(self.pair_keys), np.uint64)
        if bits:
            np.bitwise_or.at(self.pair_lengths, inverse, np.concatenate(bits))
        #: length -> (walk, sample, sorted keys, items in that order)
        self.tables: dict[int, list[tuple[int, int, np.ndarray, np.ndarray]]] = {}
        pieces: dict[int, list[tuple[np.uint64, int, int]]] = defaultdict(list)
        for n, members in sorted(by_length.items()):
            samples, self.recall[n] = self._samples(n, members, target)
            if self.recall[n] < target:
                self.recall[n] = 1.0
                bounds = [j * n // (allowed(n) + 1) for j in range(allowed(n) + 2)]
                for i in members:
                    sums, unroll = running(self.items[i][1])
                    for a, b in zip(bounds, bounds[1:]):
                        pieces[b - a].append(((sums[b] - sums[a]) * unroll[a], i, a))
                continue
            flat = np.concatenate([self.items[i][1] for i in members])
            starts = np.arange(len(members)) * n
            tables = []
            symbols = embed(flat, starts, np.full(len(members), n))
            for walk in range(WALKS):
                for s in range(samples):
                    keys = sample_keys(symbols[:, walk], n, walk, s)
                    order = np.argsort(keys, kind="stable")
                    tables.append((walk, s, keys[order], np.array(members)[order]))
            self.tables[n] = tables
        #: words of a piece -> (sorted keys, items and places in them in that order), of lengths without LSH
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, found in pieces.items():
            keys, members, places = (np.array(x, t) for x, t in zip(zip(*found), (np.uint64, np.int64, np.int64)))
            order = np.argsort(keys, kind="stable")
            self.pieces[size] = keys[order], members[order], places[order]

    def _samples(self, n: int, members: list[int], target: float, trials: int = 60) -> tuple[int, float]:
        """Samples a walk that find items under ``allowed(n)`` random edits with the target recall, and
        the recall measured: below the target if ``MOST_SAMPLES`` do not reach it. Every item is tried, few
        items several times; the seed is fixed."""
        k = allowed(n)
        if not k:
            return 1, 1.0
        rng = np.random.default_rng(n)
        trials, step = max(trials, len(members)), max(1, TRIAL_WORDS // n)
        first = np.full(trials, MOST_SAMPLES + 1)
        for low in range(0, trials, step):
            part = first[low : low + step]
            flat, want = [], []
            for t in range(low, low + len(part)):
                item = self.items[members[t % len(members)]][1]
                changed = item.tolist()
                for _ in range(k):
                    kind, place = rng.integers(3), int(rng.integers(max(len(changed), 1)))
                    word = int(rng.integers(len(self.number) + 1))
                    if kind == 0:
                        changed[place : place + 1] = [word]
                    elif kind == 1:
                        changed[place:place] = [word]
                    elif len(changed) > 1:
                        del changed[place]
                changed += rng.integers(len(self.number) + 1, size=n).tolist()
                flat += changed[:n]
                want.append(item)
            starts, lengths = np.arange(len(part)) * n, np.full(len(part), n)
            a = embed(np.array(flat, np.uint32), starts, lengths)
            b = embed(np.concatenate(want), starts, lengths)
            for s in range(MOST_SAMPLES):
                for walk in range(WALKS):
                    same = sample_keys(a[:, walk], n, walk, s) == sample_keys(b[:, walk], n, walk, s)
                    part[same] = np.minimum(part[same], s + 1)
                if (part <= s + 1).all():
                    break
        enough = int(np.sort(first)[int(np.ceil(target * trials)) - 1])
        samples = min(enough, MOST_SAMPLES)
        return samples, float((first <= samples).mean())

    def candidates(self, flat: np.ndarray, weight: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(item, starts)``: windows of ``flat`` whose keys meet an item's. ``weight`` is 1 for words of
        no item and larger than any limit for what parts two texts."""
        before = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])
        known = (flat[:-1] != OTHER) & (flat[1:] != OTHER)
        marks = pair_hash(flat[:-1][known], flat[1:][known])
        known[known] = self.pairs[marks >> self.shift]
        pairs_before = np.concatenate([[0], np.cumsum(known, dtype=np.int32)]).astype(np.int32)
        at = np.flatnonzero(known)
        marks = pair_hash(flat[at], flat[at + 1])
        row = np.minimum(np.searchsorted(self.pair_keys, marks), max(0, len(self.pair_keys) - 1))
        held = np.where(self.pair_keys[row] == marks, self.pair_lengths[row], np.uint64(0)) if len(at) else marks
        sums, unroll = running(flat)
        passed = []
        for n in sorted(self.tables, reverse=True):
            if len(flat) < n:
                continue
            k = allowed(n)
            last = len(flat) - n + 1
            starts = np.flatnonzero(pairs_before[n - 1 :][:last] - pairs_before[:last] >= n - 1 - 2 * k)
            starts = starts[before[starts + n] - before[starts] <= k]
            if len(starts) and n > 1:  # pairs of items of this very length
                own = at[held >> self.bit[n] & np.uint64(1) > 0]
                starts = starts[np.searchsorted(own, starts + n - 1) - np.searchsorted(own, starts) >= n - 1 - 2 * k]
            if len(starts):
                passed.append((np.full(len(starts), n), starts))
        pairs = [*self.whole_pieces(sums, unroll, owner)]
        lengths, starts = (np.concatenate(x) for x in zip(*passed)) if passed else np.zeros((2, 0), np.int64)
        # Of windows with the same words in one text, the first stands for all (runs of one word, say).
        content = (sums[starts + lengths] - sums[starts]) * unroll[starts]
        content ^= (owner[starts] * np.uint64(1024) + lengths.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
        _, firsts = np.unique(content, return_index=True)
        firsts.sort()
        lengths, starts = lengths[firsts], starts[firsts]
        for low in range(0, len(starts), CHUNK):
            some, n_of = starts[low : low + CHUNK], lengths[low : low + CHUNK]
            symbols = embed(flat, some, n_of)
            for n in np.unique(n_of).tolist():
                rows = slice(*np.searchsorted(-n_of, [-n, -n + 1]).tolist())
                for walk, s, keys, members in self.tables[n]:
                    got = sample_keys(symbols[:, walk, rows], n, walk, s)
                    left, right = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                    hit = np.flatnonzero(right > left)
                    if len(hit):
                        size = (right - left)[hit]
                        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        item = members[np.repeat(left[hit], size) + inside]
                        pairs.append(np.unique(item.astype(np.int64) << 40 | np.repeat(some[rows][hit], size)))
        if pairs:
            found = np.unique(np.concatenate(pairs))
            items, places = found >> 40, found & ((1 << 40) - 1)
            cuts = np.flatnonzero(np.diff(items)) + 1
            yield from zip(items[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts))

    def whole_pieces(self, sums: np.ndarray, unroll: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
        """Item and place, as one number, wherever a piece of an item of a length without LSH occurs: where
        the item would start, or the text's first place if that lies before it."""
        for size, (keys, members, places) in self.pieces.items():
            if len(owner) < size:
                continue
            got = (sums[size:] - sums[:-size]) * unroll[: len(owner) - size + 1]
            left, right = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            hit = np.flatnonzero(right > left)
            number = (right - left)[hit]
            inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            row, at = np.repeat(left[hit], number) + inside, np.repeat(hit, number)
            start = np.maximum(at - places[row], np.searchsorted(owner, owner[at], "left"))
            yield np.unique(members[row] << 40 | start)

    def beyond(self, sizes: np.ndarray) -> np.ndarray:
        """By how many words windows may run over an end of texts of ``sizes`` words: as many as the longest
        item may lose of which such a text can hold the rest."""
        lengths = sorted(self.tables)
        limits = np.array([0, *map(allowed, lengths)], np.int64)
        return limits[np.searchsorted(np.array(lengths, np.int64) - limits[1:], sizes, "right")]

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For every text ``(item_id, distance, item_words, start)`` of each item found in it."""
        get = self.number.get
        words = [np.fromiter(map(get, w, repeat(OTHER)), np.uint32, len(w)) for w in map(words_of, texts)]
        sizes = np.array([len(w) for w in words], np.int64)
        pads = self.beyond(sizes)  # fillers before and behind a text, then one word that no window may cross
        widths = sizes + 2 * pads + 1
        blocks = np.cumsum(widths) - widths
        firsts = blocks + pads
        flat = np.zeros(int(widths.sum()), np.uint32)
        for first, w in zip(firsts.tolist(), words):
            flat[first : first + len(w)] = w
        weight = (flat == OTHER).astype(np.int32)
        weight[blocks + widths - 1] = 1 << 20
        best: dict[tuple[int, int], tuple[int, int]] = {}
        there = np.zeros(len(self.number) + 1, bool)
        number = np.repeat(np.arange(len(sizes), dtype=np.uint64), widths)
        for item, places in self.candidates(flat, weight, number):
            ids = self.items[item][1]
            n, k = len(ids), allowed(len(ids))
            owner = np.searchsorted(blocks, places, "right") - 1
            new = np.flatnonzero((np.diff(places) > n) | (np.diff(owner) > 0)) + 1
            for group in np.split(np.arange(len(places)), new):
                text = int(owner[group[0]])
                low = max(int(places[group[0]]) - k, int(firsts[text]))
                high = min(int(places[group[-1]]) + n + 2 * k, int(firsts[text] + sizes[text]))
                region = flat[low:high]
                there[region] = True
                enough = np.count_nonzero(there[ids]) >= n - k
                there[region] = False
                if not enough:  # too few of its words are there at all
                    continue
                distance, start = best_match(ids, region)
                if distance <= k:
                    found = (distance, low + start - int(firsts[text]))
                    best[text, item] = min(best.get((text, item), found), found)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for (text, item), (distance, start) in sorted(best.items()):
            out[text].append((self.items[item][0], distance, len(self.items[item][1]), start))
        return out


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``BLOCK_WORDS`` words, dealt by a hash of id and text."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = max(1, -(-size // (4 * BLOCK_WORDS)))
    for block in range(number):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == block).collect()]


def hits(docs: DataFrame, index: Index, text: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with ``out``: the items of the index that each text holds."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(HITS)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        names = ("item_id", "distance", "item_words", "start")
        for texts in parts:
            found: list = []
            batch, size = [], 0
            for text in texts:
                batch.append(text)
                size += len(text or "")
                if size > BATCH_CHARS:
                    found += index.search(batch)
                    batch, size = [], 0
            found += index.search(batch)
            yield pd.Series([[dict(zip(names, hit)) for hit in row] for row in found])

    return docs.withColumn(out, search(F.col(text).cast("string")))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, item_words, start`` for every document that holds an item."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = None
    for block in blocks(items):
        part = hits(rows, Index(block)).select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, columns as before."""
    name = "_hits"
    while name in docs.columns:
        name += "_"
    for block in blocks(items):
        docs = hits(docs, Index(block), text, name).filter(F.size(name) == 0).drop(name)
    return docs
