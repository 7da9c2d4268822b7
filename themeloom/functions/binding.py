"""Evaluate-once helper for expressions used several times inside array functions.

Catalyst inlines a projected column into every place that uses it, also into lambda bodies that
run once per element. A lambda variable is evaluated once, so passing a costly value through a
one-element array keeps it from being computed again per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)
