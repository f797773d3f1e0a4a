"""Row expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """Keep the row, with the value, where the value is not null.

    A filter on a computed column is moved below the projection that computes
    it, and the expression is then evaluated by the filter and again by the
    projection, once for every place where it occurs.  Unfolding a list of one
    value or none drops the same rows and leaves one evaluation.
    """
    return F.explode(F.array_compact(F.array(value)))
