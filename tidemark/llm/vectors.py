"""Shared by the vector operators: which vectors take part, and different vectors as classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null, empty nor zero and has only finite components; ``vec``
    is the vector in double precision."""
    df = df.withColumn("vec", F.col(vector).cast("array<double>"))
    inf = float("inf")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf))
    return df.where(F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("vec", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, -1) if n else values.reshape(0, 0)
