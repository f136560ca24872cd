"""A fence for the optimizer around costly columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(docs: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with ``columns`` passed through a one-row generator.

    Spark pushes a filter below the projections it refers to by copying their expressions into it. On
    a chain of document passes that would run every pass again, once per mention. No filter on a
    generator's output moves below the generator.
    """
    rest = [c for c in docs.columns if c not in columns]
    return docs.select(*rest, F.inline(F.array(F.struct(*columns))))
