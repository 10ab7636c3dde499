"""Evaluate a column once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used inside the function of a ``transform`` or ``filter`` is evaluated again for every
    element.  Here it is an element itself, so the function sees a finished value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
