"""Pooled precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prf(m: Column, p: Column, r: Column) -> dict[str, Column]:
    """In per cent; NULL where undefined, F1 0 where only one side is empty."""
    m = m.cast("double")
    return {"precision": F.try_divide(100 * m, p.cast("double")), "recall": F.try_divide(100 * m, r.cast("double")), "f1": F.try_divide(200 * m, (p + r).cast("double"))}


def pooled(counts: DataFrame, by: list[str], chance: str | None = None) -> DataFrame:
    """Sums by keys (NULL where all are NULL), then precision, recall, F1, and the chance F1."""
    names = ["matches", "predictions", "references", *([chance] if chance else [])]
    rows = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    rows = rows.withColumns(prf(F.col("matches"), F.col("predictions"), F.col("references")))
    return rows.withColumn("chance_f1", F.try_divide(200 * F.col(chance), (F.col("predictions") + F.col("references")).cast("double"))) if chance else rows
