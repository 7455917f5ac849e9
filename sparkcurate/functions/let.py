"""Evaluate a value once inside a larger expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable, so that an expensive value used
    many times in ``body`` is computed once per row and not once per use."""
    return F.transform(F.array(value), body)[0]
