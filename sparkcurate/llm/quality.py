"""Quality rules by weak supervision.

Every rule looks at one text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns estimates how each rule votes on good and on bad texts and how many
texts are good; a text is kept by its posterior probability, so a single unlucky rule does not
discard it as an all-must-pass filter would.

Scale: one Arrow pass measures the texts; Spark counts the patterns with map-side combining. There
are at most 2**a * 3**b patterns for a rules with one kind of vote and b rules with two, a number
fixed by ``RULES`` and independent of the data, so the table that the estimation reads is bounded.
A second pass scores; nothing is stored or shuffled but pattern counts.

Defined results: null or empty text has no words, all measures 0, fails the base rule; long texts
are read whole; repeated rows are judged alike and all counted; an empty table keeps nothing and the
accuracies stay at their starting values; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_ended_lines", "n_upper", "n_letters", "n_distinct_words", "n_exclaims",
]
SCHEMA = T.StructType([T.StructField(name, T.LongType(), False) for name in MEASURES])


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 3:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # three numbers would not fit into 63 bits
        _, pairs = np.unique(pairs, return_inverse=True)
    _, inverse, count = np.unique(
        pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True
    )
    again = count[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 for capitals, 1 for other letters, else 0."""
    return np.fromiter(
        (chr(c).isalpha() + (chr(c).isalpha() and chr(c).isupper()) for c in range(0x110000)), np.uint8, 0x110000
    )


def measure_text(text: str | None) -> tuple[int, ...]:
    """The numbers of ``MEASURES`` for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly BLANKS
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    ended = sum(line.rstrip(BLANKS).endswith((".", "!", "?", '"', ":", ";", ")")) for line in lines)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        ended,
        int(np.count_nonzero(kinds == 2)),
        int(np.count_nonzero(kinds)),
        len(set(words)),
        text.count("!"),
    )


@F.pandas_udf(SCHEMA)
def measure(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in text], columns=MEASURES, dtype="int64")


def _ratio(m: Column, top: str, bottom: str) -> Column:
    return m[top] / F.greatest(m[bottom], F.lit(1))


def _vote(good: Column | None, bad: Column | None) -> Column:
    vote = F.lit(0)
    if good is not None:
        vote = F.when(good, 1).otherwise(vote)
    if bad is not None:
        vote = F.when(bad, -1).otherwise(vote)
    return vote


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


#: name -> vote as a column of the measures. Rules about the make-up of short texts abstain.
RULES = {
    "length": lambda m: _vote(m["n_words"] >= 50, m["n_words"] < 50),
    "word_length": lambda m: _vote(
        _ratio(m, "word_chars", "n_words").between(3.5, 7.0),
        ~_ratio(m, "word_chars", "n_words").between(3.0, 9.0),
    ),
    "symbols": lambda m: _vote(
        _ratio(m, "n_symbols", "n_words") < 0.02, _ratio(m, "n_symbols", "n_words") > 0.1
    ),
    "same_lines": lambda m: _vote(None, m["n_dup_lines"] > 0.3 * m["n_lines"]),
    "same_windows": lambda m: _vote(
        _ratio(m, "n_repeat_words", "n_words") < 0.15, _ratio(m, "n_repeat_words", "n_words") > 0.3
    ),
    "line_ends": lambda m: _vote(
        _ratio(m, "n_ended_lines", "n_lines") > 0.8, _ratio(m, "n_ended_lines", "n_lines") < 0.4
    ),
    "capitals": lambda m: _vote(None, _ratio(m, "n_upper", "n_letters") > 0.3),
    "letters": lambda m: _vote(
        _ratio(m, "n_letters", "word_chars") > 0.9, _ratio(m, "n_letters", "word_chars") < 0.8
    ),
    "variety": lambda m: _vote(
        None, (m["n_words"] >= 50) & (m["n_words"] < 2000) & (_ratio(m, "n_distinct_words", "n_words") < 0.2)
    ),
    "exclaims": lambda m: _vote(None, _ratio(m, "n_exclaims", "n_words") > 0.1),
}


def votes(m: Column) -> list[Column]:
    return [rule(m).cast("int").alias(name) for name, rule in RULES.items()]


def vote_counts(texts: DataFrame, text_col: str = "text") -> pd.DataFrame:
    """Number of texts by vote pattern. Bounded by the rules, not by the data."""
    measured = texts.select(measure(F.col(text_col).cast("string")).alias("m"))
    return measured.select(*votes(F.col("m"))).groupBy(*RULES).count().toPandas()


def estimate(
    counts: pd.DataFrame, prior: float = 0.8, weight: float = 50.0, tolerance: float = 1e-9,
    max_steps: int = 2000,
) -> tuple[float, np.ndarray]:
    """Share of good texts, and ``p[class, rule, vote]``: how often each rule votes bad, abstains or
    votes good on bad (class 0) and on good texts (class 1), by expectation-maximisation.

    Starting values, which are also pseudo-counts of total ``weight``, say that rules are better than
    guesses, so the classes cannot swap. A vote never counts against its own meaning: where the
    counts say otherwise, both classes get the same share and the vote has no say. Patterns are
    sorted first, so reruns agree to the last bit.
    """
    table = counts.sort_values(list(RULES)) if len(counts) else counts
    v = table[list(RULES)].to_numpy(int).reshape(-1, len(RULES))
    n = table["count"].to_numpy(float)
    start = np.repeat(np.array([[0.3, 0.4, 0.3], [0.03, 0.37, 0.6]])[:, None, :], len(RULES), axis=1)
    picked = np.stack([v == vote for vote in (-1, 0, 1)], axis=2).astype(float)
    share, p = prior, start
    for _ in range(max_steps):
        good = posterior(picked, share, p)
        new = np.stack([np.einsum("k,krv->rv", n * q, picked) for q in (1 - good, good)]) + weight * start
        new /= new.sum(2, keepdims=True)
        for vote, low, high in ((0, 1, 0), (2, 0, 1)):  # bad votes are likelier on bad texts, good ones on good
            wrong = new[low, :, vote] > new[high, :, vote]
            new[:, wrong, vote] = new[:, wrong, vote].mean(0)
        new_share = float(np.clip((good @ n + weight * prior) / (n.sum() + weight), 0.02, 0.98))
        moved = max(np.abs(new - p).max(), abs(new_share - share))
        share, p = new_share, new
        if moved < tolerance:
            break
    return share, p


def posterior(picked: np.ndarray, share: float, p: np.ndarray) -> np.ndarray:
    """Probability of class 1 from one-hot votes ``picked[text, rule, vote]``."""
    score = np.log(share / (1 - share)) + np.einsum("krv,rv->k", picked, np.log(p[1] / p[0]))
    return 1 / (1 + np.exp(-score))


def probability(m: Column, share: float, p: np.ndarray) -> Column:
    """Posterior probability that the text is good, as a column of its measures."""
    score = F.lit(float(np.log(share / (1 - share))))
    for rule, says in zip(RULES.values(), np.log(p[1] / p[0])):
        bad, silent, good = (F.lit(float(x)) for x in says)
        vote = rule(m)
        score = score + F.when(vote < 0, bad).when(vote > 0, good).otherwise(silent)
    return 1 / (1 + F.exp(-score))


def judge(
    docs: DataFrame, text_col: str = "text", at_least: float = 0.5,
    measures: str = "_measures", good: str = "_good", kept: str = "_kept",
) -> DataFrame:
    """``docs`` with the measures, the posterior probability and the verdict of each text. A text that
    fails the base rule is never kept. A name that ``docs`` already has is a fault of the caller."""
    taken = {measures, good, kept} & set(docs.columns)
    if taken:
        raise ValueError(f"columns already there: {sorted(taken)}")
    share, p = estimate(vote_counts(docs, text_col))
    out = docs.withColumn(measures, measure(F.col(text_col).cast("string")))
    m = F.col(measures)
    return out.withColumn(good, probability(m, share, p)).withColumn(
        kept, ~base_failed(m) & (F.col(good) >= at_least)
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, columns as before."""
    names = {f"_{x}": f"_{x}" for x in ("measures", "good", "kept")}
    while set(names.values()) & set(docs.columns):
        names = {k: v + "_" for k, v in names.items()}
    judged = judge(
        docs, text_col, measures=names["_measures"], good=names["_good"], kept=names["_kept"]
    )
    return judged.filter(F.col(names["_kept"])).select(*[F.col(f"`{c}`") for c in docs.columns])
