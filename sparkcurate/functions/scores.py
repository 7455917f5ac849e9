"""Score vectors as column expressions: softmax, argmax, likelihoods, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.functions.let import let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _temperature(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Softmax of ``logits / temperature``; the largest logit is subtracted first."""
    t = _temperature(temperature)
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda z: F.exp((z - top) / t)))
    return let(powers, lambda p: let(total(p), lambda s: F.transform(p, lambda e: e / s)))


def log_softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = _temperature(temperature)
    shifted = let(F.array_max(logits), lambda top: F.transform(logits, lambda z: (z - top) / t))
    return let(
        shifted,
        lambda zs: let(
            F.log(total(F.transform(zs, lambda z: F.exp(z)))),
            lambda log_sum: F.transform(zs, lambda z: z - log_sum),
        ),
    )


def argmax(values: Column) -> Column:
    """Position of the largest value, the first one on ties."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def rank_scores(values: Column, names: Column) -> Column:
    """``array<struct<name, score>>`` by falling score; equal scores keep their order."""
    rows = F.transform(
        values,
        lambda v, i: F.struct((-v).alias("key"), i.alias("pos"), names[i].alias("name"), v.alias("score")),
    )
    return F.transform(
        F.array_sort(rows), lambda r: F.struct(r["name"].alias("name"), r["score"].alias("score"))
    )


def neg_log_likelihood(logits: Column, label: Column, temperature: Column | float = 1.0) -> Column:
    return -F.element_at(log_softmax(logits, temperature), label + 1)


def confidence_bin(confidence: Column, n_bins: int = K.N_CALIBRATION_BINS) -> Column:
    """1-based right-closed bin; a confidence of exactly 0 falls in none (null). The float guess
    is corrected against the bin edges themselves."""
    width = F.lit(1.0 / n_bins)
    guess = F.ceil(confidence * n_bins)
    fixed = (
        F.when(confidence <= (guess - 1) * width, guess - 1)
        .when(confidence > guess * width, guess + 1)
        .otherwise(guess)
    )
    return F.when(confidence > 0, F.least(fixed, F.lit(n_bins))).cast("int")


def threshold_step(confidence: Column, start: float = 0.50, step: float = 0.01, n: int = 50) -> Column:
    """Index of the highest threshold ``start + k * step`` the confidence still reaches, null
    below the first. The float guess is corrected against the thresholds themselves."""
    guess = F.floor((confidence - start) / step)
    fixed = (
        F.when(F.lit(start) + (guess + 1) * step <= confidence, guess + 1)
        .when(F.lit(start) + guess * step > confidence, guess - 1)
        .otherwise(guess)
    )
    return F.when(confidence >= start, F.least(fixed, F.lit(n - 1))).cast("int")


def excess_green(r: Column, g: Column, b: Column) -> Column:
    """2g - r - b on channel shares; a black pixel has shares of 0."""
    whole = r + g + b
    safe = F.when(whole == 0, F.lit(1.0)).otherwise(whole)
    return 2.0 * g / safe - r / safe - b / safe
