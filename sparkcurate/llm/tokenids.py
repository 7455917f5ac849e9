"""Token ids in binary, with Elias-Fano encoded document boundaries.

``write_ids`` encodes texts and lays their ids end to end in ascending document order. The file format
is a Parquet table of segments, one row each:

    segment   long            order of the segments: partition << 32 | number in the partition
    n_docs    long            documents in the segment
    n_tokens  long            ids in the segment, end ids included
    doc_ids   array<long>     their document ids, in order
    ids       binary          ids end to end, little-endian, unsigned, ``id_bytes`` each
    id_bytes  int             2 where every id of the vocabulary fits, else 4
    bounds    binary          Elias-Fano code of the n_docs + 1 boundaries inside the segment

Elias-Fano: the low ``floor(log2(u / n))`` bits of every boundary are packed, the high bits are a unary
bit vector; about 2 + log2(u / n) bits a document. Select finds the position of the i-th set bit from
a sample of every 256th one, so one boundary is read without decoding the others and without any
64-bit table. Offsets in the whole array are a segment's own plus what the segments before it hold.

Scale: one range shuffle of the texts by document id; segments are closed at ``SEGMENT_IDS`` ids, so
memory is bounded by that and by the longest single document. Everything is written and read through
Spark, so any file system of the cluster will do. The files survive lost executors; a lost task
writes its own partition again.

Defined results: null text is empty and holds only the end id; a null document id comes first; rows
with the same document id are all kept, in order of a hash of their texts; an empty table gives no
segment; other columns are ignored. Special-token strings in a text are read as the tokenizer reads
them by default.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20
#: Pieces of text whose ids a worker remembers; there are two generations of this size.
CACHED_PIECES = 250_000
SAMPLE = 256
SEGMENTS = "segment long, n_docs long, n_tokens long, doc_ids array<long>, ids binary, id_bytes int, bounds binary"


class EliasFano:
    """A never falling sequence of whole numbers from 0 on, in near-minimal space."""

    def __init__(self, n: int, top: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low, self.high, self.samples = n, top, low, high, samples
        self.low_bits = self.width(n, top)

    @staticmethod
    def width(n: int, top: int) -> int:
        return max(0, (top // max(n, 1)).bit_length() - 1)

    @classmethod
    def of(cls, values: Iterable[int]) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        k = cls.width(n, top)
        bits = ((v[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (v >> np.uint64(k)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        high = np.packbits(unary, bitorder="little")
        low = np.packbits(bits.ravel(), bitorder="little")
        return cls(n, top, low, high, places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.top, len(self.low), len(self.high)], "<u8").tobytes()
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, n_low, n_high = (int(x) for x in np.frombuffer(data, "<u8", 4))
        low = np.frombuffer(data, np.uint8, n_low, 32)
        high = np.frombuffer(data, np.uint8, n_high, 32 + n_low)
        return cls(n, top, low, high, np.frombuffer(data, "<u4", offset=32 + n_low + n_high))

    def __getitem__(self, i: int) -> int:
        """The i-th number: select in the high bits, then the packed low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        ones = int(np.bitwise_count(self.high[byte] >> (at & 7))) - 1  # set bits after the sampled one
        base = at + 1
        while ones < left:
            left -= ones
            byte += 1
            base, ones = byte << 3, int(np.bitwise_count(self.high[byte]))
            if ones >= left:
                break
        if left:
            rest = int(self.high[base >> 3]) >> (base & 7)
            for _ in range(left - 1):
                rest &= rest - 1
            skip = (rest & -rest).bit_length() - 1
            at = base + skip
        value = at - i
        for b in range(self.low_bits):
            bit = i * self.low_bits + b
            value_bit = int(self.low[bit >> 3]) >> (bit & 7) & 1
            value = value if b else value << self.low_bits
            value |= value_bit << b
        return value

    def all(self) -> np.ndarray:
        """The whole sequence."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        k = self.low_bits
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * k].reshape(self.n, k)
        low = bits.astype(np.int64) @ (np.int64(1) << np.arange(k, dtype=np.int64)) if k else 0
        return ((places - np.arange(self.n)) << k) + low


class Memory(dict):
    """Ids of pieces, worked out where they are asked for first; an older generation is still looked up."""

    def __init__(self, learn: Callable[[str], bytes], old: Memory | None = None):
        super().__init__({"": b""})
        self.learn, self.old = learn, {} if old is None else old

    def __missing__(self, piece: str) -> bytes:
        found = dict.get(self.old, piece)
        self[piece] = found = self.learn(piece) if found is None else found
        return found


class Encoder:
    """Texts to packed ids. With byte-level vocabularies, a text is cut before each space, and around lone full
    stops, commas and line breaks, where its tokens surely part, and the ids of pieces seen before are taken from memory; words of letters go
    straight to the library's merges. A text with white space that could join tokens across such a
    cut, or with a special token's string, is encoded in one go, as is every text with others."""

    #: A space before white space, or at the end, may belong to one token with what is around it.
    JOINED = re.compile(r" (?:\s|$)")
    #: A full stop, comma or line break that may be one token with its neighbour, which no text has that is cut there.
    MARKS = re.compile(r"[.,\n](?:(?<=[\W_][.,])|(?<=\s\n)|(?<=[.,])(?=[^\w\s]|_)|(?<=\n)(?=\s))")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.merges = self.tokenizer.model
        self.letters = self._byte_letters()
        self.code = {"<u2": "H", "<u4": "I"}[self.type]
        self.young = Memory(self.learn)

    def _byte_letters(self) -> dict[int, str] | None:
        """The letter that stands for each byte, as the library writes them; None if the tokenizer is not
        a byte-level one that parts words by the usual pattern."""
        from tokenizers import models, pre_tokenizers

        pre = self.tokenizer.pre_tokenizer
        usual = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
        if not usual or self.tokenizer.normalizer or not isinstance(self.merges, models.BPE):
            return None
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = {}
        for point in [*range(0x800), *range(0x800, 0xD800, 61), *range(0x10000, 0x110000, 4093)]:
            char = chr(point)
            letters |= zip(char.encode(), spell(char)[0][0])
        return letters

    def word(self, piece: str) -> bytes:
        """Ids of letters with at most one space before them, which are never parted further."""
        spelled = piece.replace(" ", self.letters[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merges.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.type).tobytes() for e in found]

    @staticmethod
    def parts(piece: str) -> list[str]:
        """Where the tokens of a piece surely part: at a single line break between other characters,
        and between a word of letters and one full stop or comma behind it."""
        out = []
        left, line_break, right = piece.partition("\n")
        if line_break and left and right and not left[-1].isspace() and not right[0].isspace() and "\n" not in right:
            halves = [left, line_break, right]
        else:
            halves = [piece]
        for half in halves:
            if half[-1:] in (".", ",") and half[:-1].removeprefix(" ").isalpha():
                out += [half[:-1], half[-1]]
            else:
                out.append(half)
        return out

    def learn(self, piece: str) -> bytes:
        """The ids of a piece that is not in memory, from those of its parts."""
        if piece.removeprefix(" ").isalpha():
            return self.word(piece)
        parts = self.parts(piece)
        return b"".join(map(self.young.__getitem__, parts)) if len(parts) > 1 else self.direct(parts)[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        for text in texts:
            if not self.letters or "\0" in text or self.JOINED.search(text) or any(s in text for s in self.special):
                out.append(None)
                continue
            if len(self.young) > CACHED_PIECES:
                self.young.old = {}
                self.young = Memory(self.learn, self.young)
            if text[:1] not in ".,\n" and text[-1] != "\n" and not self.MARKS.search(text):
                text = text.replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0")
            pieces = text.replace(" ", "\0 ").split("\0")
            out.append(b"".join(map(self.young.__getitem__, pieces)))
        whole = iter(self.direct([t for t, ids in zip(texts, out) if ids is None]))
        return [next(whole) if ids is None else ids for ids in out]


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _segments(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    end = np.array([end_id], encoder.type).tobytes()
    width = len(end)
    first = TaskContext.get().partitionId() << 32
    number, docs, parts, size = 0, [], [], 0

    def close() -> pa.RecordBatch:
        bounds = np.cumsum([0, *(len(p) // width for p in parts)])
        row = (first | number, len(docs), int(bounds[-1]), docs, b"".join(parts), width, EliasFano.of(bounds).to_bytes())
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                docs.append(doc)
                parts.append(ids + end)
                size += len(ids) // width + 1
                if size >= SEGMENT_IDS:
                    yield close()
                    number, docs, parts, size = number + 1, [], [], 0
    if docs:
        yield close()
    encoder.young.old = {}  # an idle worker holds on to little


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Write the ids of all texts, each followed by ``end_id``, to ``path`` in the format above."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    ordered.mapInArrow(lambda batches: _segments(tokenizer, end_id, batches), SEGMENTS).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bounds = EliasFano.from_bytes(row["bounds"]).all()
            ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["segment"]] * n, pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64()),
                ],
                ["segment", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files at ``path``."""
    files = spark.read.parquet(path)
    docs = files.mapInArrow(_documents, "segment long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    sizes = files.select("segment", "n_tokens", F.shiftright("segment", 32).alias("part"))
    upto = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", upto(W.orderBy("part")).alias("parts_before"))
    inside = sizes.withColumn("inside", upto(W.partitionBy("part").orderBy("segment")))
    starts = inside.join(parts, "part").select("segment", (F.col("inside") + F.col("parts_before")).alias("before"))
    return docs.join(starts, "segment").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the places asked for, to the ids there: two selects a document, no other boundary is decoded."""
    for batch in batches:
        for row in batch.to_pylist():
            bounds = EliasFano.from_bytes(row["bounds"])
            ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
            cuts = [(bounds[place], bounds[place + 1]) for place in row["places"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["doc_ids"][place] for place in row["places"]], pa.int64()),
                    pa.array([low for low, _ in cuts], pa.int64()),
                    pa.array([ids[low:high].astype(np.int64) for low, high in cuts], pa.list_(pa.int64())),
                ],
                ["doc_id", "offset", "ids"],
            )


def look_up(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, offset, ids`` of the documents in the files at ``path`` whose id is in ``wanted`` (a column ``doc_id``), each
    time they are there; ``offset`` counts from the start of their segment. Boundaries are read by select.

    First the document ids alone are scanned for the places of the wanted ones; only segments that hold one are then
    read whole. Ids that are not in the files, and null ones, give no row."""
    files = spark.read.parquet(path)
    there = files.select("segment", F.posexplode("doc_ids").alias("place", "doc_id"))
    places = there.join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    places = places.groupBy("segment").agg(F.sort_array(F.collect_list("place")).alias("places"))
    hit = files.join(places, "segment").select("doc_ids", "ids", "id_bytes", "bounds", "places")
    return hit.mapInArrow(_looked_up, "doc_id long, offset long, ids array<long>")
