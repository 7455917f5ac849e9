"""Binary ids: exact round trips of boundaries, of the encoder and of the files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from sparkcurate.llm import tokenids as K
from sparkcurate.session import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("step", [0, 1, 3, 1000, 10**9])
def test_elias_fano(step):
    rng = random.Random(step)
    for n in (0, 1, 2, 255, 256, 257, 900):
        values = np.cumsum([0] + [rng.randint(0, step) for _ in range(n)])[:n] if n else np.zeros(0, int)
        coded = K.EliasFano.of(values)
        back = K.EliasFano.from_bytes(coded.to_bytes())
        assert (back.all() == values).all()
        assert all(back[i] == values[i] for i in rng.sample(range(n), min(n, 60)))
        if n > 200 and step:
            assert len(coded.to_bytes()) <= n * (2.5 + np.log2(step + 1)) / 8 + 60


def test_encoder_equals_the_library(monkeypatch):
    encoder, rng = K.Encoder(PATH), random.Random(1)
    parts = ["a", "The", "word", " ", "  ", "\n", "\t", ".", ",", "é", "1", "²", "'s", "#", "ß", "\x1c", "日", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    whole = [np.array(e.ids, "<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == whole
    monkeypatch.setattr(K, "CACHED_PIECES", 3)  # generations change with every call
    assert encoder.encode(texts[:500]) == whole[:500]


def test_files(spark, edges, none):
    tokenizer = K.Encoder(PATH).tokenizer
    for docs in (edges, none):
        path = new_path(spark, "ids")
        K.write_ids(docs, path, PATH)
        got = sorted(K.read_documents(spark, path).collect(), key=lambda r: r.start)
        texts = {}
        for r in docs.collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
            texts.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        order = sorted(texts, key=lambda d: (d is not None, d or 0))
        assert [r.doc_id for r in got] == [d for d in order for _ in texts[d]]
        start = 0
        for r in got:
            assert r.start == start and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
            start += r.n_tokens


def test_look_up_by_select(spark, edges, none, monkeypatch):
    tokenizer = K.Encoder(PATH).tokenizer
    path, nothing = new_path(spark, "ids"), new_path(spark, "ids")
    K.write_ids(edges, path, PATH)
    K.write_ids(none, nothing, PATH)
    wanted = spark.createDataFrame([(0,), (6,), (6,), (8,), (4,), (12,), (99,), (None,)], "doc_id long")
    found = sorted((r.doc_id, r.ids) for r in K.look_up(spark, path, wanted).collect())
    texts = [(r.doc_id, r.text or "") for r in edges.collect() if r.doc_id in (0, 6, 8, 4, 12)]
    assert found == sorted((d, tokenizer.encode(t, add_special_tokens=False).ids + [2]) for d, t in texts)
    assert K.look_up(spark, nothing, wanted).count() == 0
    # Boundaries come by select alone.
    monkeypatch.setattr(K.EliasFano, "all", None)
    row = {"bounds": K.EliasFano.of([0, 2, 2, 5]).to_bytes(), "ids": np.arange(5, dtype="<u2").tobytes(), "id_bytes": 2}
    batch = K.pa.RecordBatch.from_pylist([row | {"doc_ids": [7, 8, 9], "places": [0, 1, 2]}])
    (out,) = K._looked_up(iter([batch]))
    assert out.to_pydict() == {"doc_id": [7, 8, 9], "offset": [0, 2, 2], "ids": [[0, 1], [], [2, 3, 4]]}
