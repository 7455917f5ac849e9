"""PPM: code lengths against a plain reading of the counts, held-out accuracy, edge cases."""

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkcurate.llm import langid as I


def plain_bits(train: bytes, text: bytes) -> float:
    counts = [Counter() for _ in range(I.ORDER + 1)]
    for k in range(I.ORDER + 1):
        for i in range(I.ORDER, len(train)):
            counts[k][train[i - k : i], train[i]] += 1
    bits = 0.0
    for i in range(I.ORDER, len(text)):
        for k in range(I.ORDER, -1, -1):
            seen = {s: n for (c, s), n in counts[k].items() if c == text[i - k : i]}
            total, kinds = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits -= math.log2(seen[text[i]] / (total + kinds))
                break
            if total:
                bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def model(samples: dict) -> I.Model:
    frames = []
    for lang, text in samples.items():
        gram, n = np.unique(I.grams(np.frombuffer(I.PAD + text.encode(), np.uint8)), return_counts=True)
        frames.append(pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n}))
    return I.train(pd.concat(frames))


def test_code_lengths_are_exact():
    samples = {"aa": "the cat sat on the mat. the cat ran.", "bb": "der hund sah die katze über der straße"}
    m = model(samples)
    texts = ["the cat", "die straße", "zq~", "", "the the " * 40]
    got = m.code_lengths(texts)
    for j, lang in enumerate(m.langs):
        for i, text in enumerate(texts):
            want = plain_bits(I.PAD + samples[lang].encode(), I.PAD + text.encode())
            assert abs(got[i, j] - want) < 1e-3 * max(1, want)
    whole, I.BLOCK = I.BLOCK, 7
    assert np.allclose(m.code_lengths(texts), got)
    I.BLOCK = whole


def test_index_finds_every_key():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 20_000).astype(np.uint64))
    index = I.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys[:500] + np.uint64(1 << 41)) == -1).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = I.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count()


def test_edges(spark, edges, none):
    found = I.identify(edges)
    assert found.count() == edges.count()
    rows = {r.doc_id: r for r in found.collect()}
    assert {d for d, r in rows.items() if r.lang_pred == "und"} == {0, 1, 2, 9}
    assert rows[None].held_out and all(0 <= r.score <= 1 for r in rows.values())
    assert I.identify(none).count() == 0
    nothing = edges.withColumn("lang", F.lit(None).cast("string"))
    assert I.identify(nothing).filter("lang_pred <> 'und'").count() == 0


def test_a_language_of_one_long_text_is_learned_up_to_the_bound(spark):
    rows = [(i, f"der hund sah die katze {i} ", "de") for i in range(300)] + [(1_000 + i, "xyz " * 5_000, f"l{i}") for i in range(8)]
    docs = spark.createDataFrame([*rows, (2_000, "kurz", "s")], "doc_id long, text string, lang string")
    for bound in (500, 2_000):
        total = I.training_counts(docs, bound).groupby("lang")["n"].sum().to_dict()
        assert total == {"de": bound, "s": 4, **{f"l{i}": bound for i in range(8)}}
