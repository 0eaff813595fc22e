"""Catalogue upkeep: pairing files, appending what is new, resuming, asserted lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(paths: DataFrame, pattern: str, name: str) -> DataFrame:
    """key, name: one path for each key that the pattern finds; of several the last in order."""
    key = F.regexp_extract("path", pattern, 1)
    return paths.select(key.alias("key"), "path").where("key <> ''").groupBy("key").agg(F.max("path").alias(name))


def paired_files(images: DataFrame, labels: DataFrame, pattern: str = r"(img\d+)") -> DataFrame:
    return keyed(images, pattern, "image_path").join(keyed(labels, pattern, "label_path"), "key")


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """existing and those rows of incoming whose key it lacks."""
    return existing.unionByName(incoming.join(existing.select(*key), key, "left_anti"))


def missing(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def existing(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return wanted.join(done.select(*key).distinct(), key, "left_semi")


def looked_up(rows: DataFrame, dimension: DataFrame, key: list[str]) -> DataFrame:
    """rows with the dimension's columns; a key that the dimension lacks fails the query."""
    found = rows.join(dimension.withColumn("__there", F.lit(True)), key, "left")
    checked = F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no such key:"), *[F.col(k).cast("string") for k in key])))
    return found.withColumn("__there", checked).where("__there").drop("__there")


def bounds(boxes: DataFrame, by: list[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def size_stats(refs: DataFrame, chips: DataFrame, by: list[str], small_m: float = 5.0) -> DataFrame:
    """References, chips without any, quartiles of the equivalent side (root of the area), share of small ones."""
    side = F.when(F.col("area") > 0, F.sqrt("area"))
    rows = chips.select("chip_id", *by).join(refs.select("chip_id", "area").withColumn("side", side), "chip_id", "left")
    # equal sides are counted before they meet in one task
    rows = rows.groupBy(*by, "side").agg(F.count("area").alias("areas"), F.count("*").alias("n"))
    ends = F.percentile("side", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    sided, small = F.sum(F.when(F.col("side").isNotNull(), F.col("n"))), F.sum(F.when(F.col("side") < small_m, F.col("n")).when(F.col("side").isNotNull(), 0))
    out = rows.groupBy(*by).agg(F.sum("areas").alias("buildings"), F.sum(F.col("n") - F.col("areas")).alias("empty_chips"), ends.alias("q"), (small / sided).alias("share_small"))
    return out.select(*by, "buildings", "empty_chips", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75"))], "share_small")


def all_keys(key: list[str], *tables: DataFrame) -> DataFrame:
    """The keys that occur in any of some tables, each once."""
    out = tables[0].select(*key)
    for t in tables[1:]:
        out = out.unionByName(t.select(*key))
    return out.distinct()


def common_keys(key: list[str], *tables: DataFrame) -> DataFrame:
    """The keys that occur in all of some tables, each once."""
    out = tables[0].select(*key).distinct()
    for t in tables[1:]:
        out = out.intersect(t.select(*key))
    return out


def scene_search(items: DataFrame, bounds: tuple[float, float, float, float], first: str, last: str, cloud: float, limit: int = 60) -> DataFrame:
    """Of a catalogue's items those that meet bounds and a span of days, with less cloud than `cloud`: the `limit` least cloudy.

    items: id, x0, y0, x1, y1, day (text, ISO), cloud. Equally cloudy ones come by id.
    """
    x0, y0, x1, y1 = map(float, bounds)
    meet = (F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0)
    return items.where(meet & F.col("day").between(first, last) & (F.col("cloud") < cloud)).orderBy("cloud", "id").limit(limit)


def settled(rows: DataFrame) -> DataFrame:
    """A small table that several steps read, computed once: checkpointed where the session has a folder for that, else kept in memory or on disk."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.persist()
