"""Aggregate expressions that ANSI rules would otherwise stop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over pairs; null where a side doesn't vary (the built-in one raises there under ANSI rules)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
