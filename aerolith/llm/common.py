"""What the operators share: reading tables, cutting lineage, column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.sources.tables import _held, cut, drop, hold, remove, settled, shared_dir, swept  # noqa: F401

#: The white space of every contract here: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Sorts after every real id, and stands for a null one inside an operator.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in each batch that goes to Python than the default, for rows of whole texts; a smaller setting stays (bytes are bounded by Spark's own)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


#: The columns of documents; a stage sets others aside by place, so that their names can be any.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(c if c in DOCUMENT else f"__c{i}") for i, c in enumerate(docs.columns)])


def back(rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    return rows.select(*[F.col(c if c in DOCUMENT else f"__c{i}").alias(c) for i, c in enumerate(names)], *more)


def order_id(name: str = "doc_id") -> Column:
    """An id to sort and join by: null ids sort last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def original_id(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != LAST_ID, F.col(name)).alias(name)
