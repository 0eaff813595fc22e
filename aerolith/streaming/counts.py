"""New files of counts are added up by key; counts are additive, so a batch needs no history.

Each batch writes its own folder, named by its number, so that a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("matches", "predictions", "references")


def start(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str]):
    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in NAMES]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(target).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in NAMES])
