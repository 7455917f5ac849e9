"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has context trees of up to ``ORDER`` bytes. A byte costs -log2 of its share among the
bytes seen after the longest context; where it was not seen there, an escape is paid and the next
shorter context is asked, down to 8 bits for any byte (escape method C, no exclusions). The language
with the shortest code for the whole text wins; statistics are frozen after training.

Training takes a bounded sample: ``SAMPLE_BYTES`` bytes a language, or all it has, of texts in order of a
hash of the id; the last one is cut at the bound. Every language with a byte of labelled text is therefore
learned, and the trees are at most that many contexts a language, whatever the corpus: this is the proven
bound of what is collected and broadcast. Every text is scored, over all its bytes.

The trees of all languages are merged into one table by gram: code length and escape of each language
side by side, so that one look-up serves all. A gram that no language knows falls through to the
next shorter context with the escapes paid.

Defined results: null texts and texts without a letter get ``und`` and score 0; without training
texts everything is ``und``; ties go to the first language in order; a null id counts as held out; empty
tables give empty results; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ORDER = 4
SAMPLE_BYTES = 1_500_000
BLOCK = 1 << 20
STEPS = (1_000, 1_000)  # the hash order is narrowed to the bound's place in so many parts at a time
PAD = b"\0" * ORDER


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Documents that are never learned from: crc32 of the id's text is divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def grams(data: np.ndarray) -> np.ndarray:
    """For every byte from the ``ORDER``-th on, it and the ``ORDER`` bytes before it, as one number."""
    n = len(data) - ORDER
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER + 1):
        key <<= np.uint64(8)
        key |= data[k : k + n]
    return key


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frame = batch.to_pandas()
        for lang, texts in frame.groupby("lang")["text"]:
            keys = [grams(np.frombuffer(PAD + t, np.uint8)) for t in texts]
            gram, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n.astype(np.int64)}),
                preserve_index=False,
            )


def training_counts(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """``lang, gram, n`` of the first ``sample_bytes`` bytes of each language in ``docs`` (``doc_id, text,
    lang``), in order of a hash of the id."""
    draw = F.xxhash64("doc_id", F.lit("ppm"))
    usable = docs.filter("text is not null and lang is not null").select(
        "lang", F.encode("text", "utf-8").alias("text"), draw.alias("draw")
    )
    size, place = F.octet_length("text"), F.lit(0).cast("long")
    bound: dict[str, tuple[int, int]] = {}  # lang -> part of the order that the bound lies in, bytes before it
    rows, parts = usable, 1
    for step in STEPS:
        parts *= step
        place = F.pmod("draw", F.lit(STEPS[0])) * (parts // STEPS[0])
        if parts > STEPS[0]:
            place += F.pmod(F.floor(F.col("draw") / STEPS[0]), F.lit(parts // STEPS[0]))
        sums = rows.groupBy("lang", place.cast("long").alias("place")).agg(F.sum(size).alias("bytes")).collect()
        reached = {lang: before for lang, (_, before) in bound.items()}
        bound = {}
        for lang, at, n in sorted(map(tuple, sums)):
            before = reached.get(lang, 0)
            if lang not in bound and before + n > sample_bytes:
                bound[lang] = at, before
            reached[lang] = before + n
        if not sums or not bound:
            break
        part = F.create_map(*[F.lit(x) for lang, (at, _) in bound.items() for x in (lang, at)])[F.col("lang")]
        rows = usable.filter(place.cast("long") == part)
    sample = usable.select("lang", "text")
    if bound:
        before = F.create_map(*[F.lit(x) for lang, (_, n) in bound.items() for x in (lang, n)])[F.col("lang")]
        whole = usable.filter(part.isNull() | (place.cast("long") < part)).select("lang", "text")
        order = W.partitionBy("lang").orderBy("draw", F.xxhash64("text")).rowsBetween(W.unboundedPreceding, -1)
        room = F.lit(sample_bytes) - before - F.coalesce(F.sum(size).over(order), F.lit(0))
        edge = rows.withColumn("room", room).filter("room > 0")
        sample = whole.unionByName(edge.select("lang", F.expr("substring(text, 1, cast(room as int))").alias("text")))
    counted = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return counted.toPandas()


class Index:
    """Places of sorted distinct keys, by hashing into tables of growing number until all are placed."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            bits = max(4, int(len(left)).bit_length() + 1)
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF | 1)
            slot = self.slot(keys[left], factor, bits)
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = left  # the last of several stays
            self.tables.append((factor, bits, table))
            left = left[table[slot] != left]

    @staticmethod
    def slot(keys: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        return ((keys * factor) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of every wanted key, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        factor, bits, table = self.tables[0]
        out = table[self.slot(wanted, factor, bits)]
        miss = np.flatnonzero((self.keys[out] != wanted) & (out >= 0))
        out[self.keys[out] != wanted] = -1
        for factor, bits, table in self.tables[1:]:
            if not len(miss):
                break
            got = table[self.slot(wanted[miss], factor, bits)]
            hit = (got >= 0) & (self.keys[got] == wanted[miss])
            out[miss[hit]] = got[hit]
            miss = miss[~hit]
        return out


@dataclass
class Model:
    langs: list[str]
    grams: list[Index]  # by order: known grams of order + 1 bytes
    costs: list[np.ndarray]  # bits of their last byte, a column for each language
    contexts: list[Index]  # by order: known contexts
    escapes: list[np.ndarray]  # bits of an escape from them; 0 where a language does not know one

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram, by language."""
        cost = np.zeros((len(key), len(self.langs)), np.float32)
        left, part = np.arange(len(key)), key
        for order in range(ORDER, -1, -1):
            part = part & np.uint64((1 << 8 * (order + 1)) - 1)
            place = self.grams[order].find(part)
            known = place >= 0
            if order == ORDER and known.all():
                return self.costs[order][place]
            cost[left[known]] += self.costs[order][place[known]]
            left, part = left[~known], part[~known]
            if not len(left):
                return cost
            context = self.contexts[order].find(part >> np.uint64(8))
            cost[left] += np.where((context >= 0)[:, None], self.escapes[order][context], 0)
        cost[left] += 8
        return cost

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of every text under every language."""
        data = [PAD + t.encode() for t in texts]
        flat = np.frombuffer(b"".join(data), np.uint8)
        sizes = np.array([len(d) for d in data], np.int64)
        starts = np.cumsum(sizes) - sizes
        total = np.zeros((len(texts), len(self.langs)))
        first = 0  # first text of the block
        for at in range(0, len(flat), BLOCK):
            end = min(at + BLOCK, len(flat))
            key = grams(flat[max(at - ORDER, 0) : end])
            offset = max(at, ORDER)  # the byte of the first key
            cost = self.bits(key)
            last = np.searchsorted(starts, end, "left")
            while first < last - 1 and starts[first] + sizes[first] <= at:
                first += 1
            for i in range(first, last):
                a = max(starts[i] + ORDER, at) - offset
                b = min(starts[i] + sizes[i], end) - offset
                if b > a:
                    total[i] += cost[a:b].sum(0, dtype=np.float64)
        return total


def train(counts: pd.DataFrame) -> Model:
    """Merged trees from counts of grams of ``ORDER + 1`` bytes; shorter ones are their endings."""
    langs = sorted(counts["lang"].unique())
    number = {lang: i for i, lang in enumerate(langs)}
    col = counts["lang"].map(number).to_numpy(np.int64)
    gram, n = counts["gram"].to_numpy(np.int64).astype(np.uint64), counts["n"].to_numpy(float)
    model = Model(langs, [], [], [], [])
    below: np.ndarray | None = None
    for order in range(ORDER + 1):
        keys, place = np.unique(gram & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
        seen = np.zeros((len(keys), len(langs)))
        np.add.at(seen, (place, col), n)
        contexts, inside = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.zeros((len(contexts), len(langs)))
        kinds = np.zeros_like(total)
        np.add.at(total, inside, seen)
        np.add.at(kinds, inside, (seen > 0).astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            direct = -np.log2(seen / (total + kinds)[inside])
        if below is None:
            lower = np.full(seen.shape, 8.0)
        else:
            lower = below[model.grams[-1].find(keys & np.uint64((1 << 8 * order) - 1))]
        below = np.where(seen > 0, direct, escape[inside] + lower)
        model.grams.append(Index(keys))
        model.costs.append(below.astype(np.float32))
        model.contexts.append(Index(contexts))
        model.escapes.append(escape.astype(np.float32))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "guess") -> DataFrame:
    """``docs`` with ``out``: struct of ``lang`` and ``score``, the posterior under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            lang, score = np.full(len(texts), None, object), np.zeros(len(texts))
            rows = np.flatnonzero(texts.notna())
            for at in range(0, len(rows), 500):
                some = rows[at : at + 500]
                bits = m.code_lengths([texts.iat[i] for i in some])
                best = bits.argmin(1)
                lang[some] = np.array(m.langs, object)[best]
                score[some] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            yield pd.DataFrame({"lang": lang, "score": score})

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if not model.langs:
        has_letter = F.lit(False)
    read = F.when(has_letter, F.col(text))
    guessed = docs.withColumn(out, guess(read))
    return guessed.withColumn(
        out,
        F.struct(
            F.coalesce(F.col(f"{out}.lang"), F.lit("und")).alias("lang"),
            F.coalesce(F.col(f"{out}.score"), F.lit(0.0)).alias("score"),
        ),
    )


def identify(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for ``docs`` (``doc_id, text, lang``)."""
    rows = docs.select("doc_id", "text", "lang")
    counts = training_counts(rows.filter(~held_out(F.col("doc_id"))), sample_bytes)
    guessed = predict(rows.select("doc_id", "text"), train(counts))
    return guessed.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("guess.lang").alias("lang_pred"),
        F.col("guess.score").alias("score"),
    )
