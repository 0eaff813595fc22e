"""From raw candidates to kept boxes: prompts, thresholds, clipping, size; grids of settings."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import boxes

CONFIG = "config string, prompt_idx array<int>, score_threshold double, max_size_m double, min_area_m2 double"


def settings(prompt_sets: dict[str, list[int]], thresholds: list[float], max_sizes: list[float], min_areas: list[float]) -> list[tuple]:
    """Every combination as a row of CONFIG, named prompt|t..|max..|min.. ."""
    named = lambda p, t, m, a: f"{p}|t{t:g}|max{m:g}|min{a:g}"
    return [(named(p, t, m, a), idx, float(t), float(m), float(a)) for (p, idx), t, m, a in product(prompt_sets.items(), thresholds, max_sizes, min_areas)]


def grid(spark: SparkSession, prompt_sets: dict[str, list[int]], thresholds: list[float], max_sizes: list[float], min_areas: list[float]) -> DataFrame:
    """The settings as a table; a grid is at most some thousand rows."""
    return spark.createDataFrame(settings(prompt_sets, thresholds, max_sizes, min_areas), CONFIG).coalesce(1)


def colour_variants(reds: list[int], chromas: list[int]) -> list[tuple[str, int, int, int]]:
    """Name (r120_c15), least red, and by how much it must exceed green and blue, of every combination."""
    return [(f"r{red}_c{chroma}", red, chroma, chroma) for red, chroma in product(reds, chromas)]


def parsed_setting(setting) -> list:
    """Parts of a colour setting's name (variant|maxN): the detector's key and the largest size."""
    parts = F.split(setting, r"\|")
    return [F.concat(F.lit("colour-"), parts[0]).alias("detector"), F.regexp_replace(parts[1], "^max", "").cast("double").alias("max_size_m")]


def clip(candidates: DataFrame, extent_m: float | None) -> DataFrame:
    """Boxes cut to the extent; those that are empty then go. It depends on no setting, so it runs once."""
    if extent_m is not None:
        candidates = candidates.withColumns({c: boxes.clipped(F.col(c), extent_m) for c in ("x0", "y0", "x1", "y1")})
    return candidates.where("x1 > x0 and y1 > y0")


def scored(candidates: DataFrame, configs: DataFrame) -> DataFrame:
    """Each candidate with each setting whose threshold the best of its prompts' scores reaches; fits: its size is allowed."""
    prompts = F.when(F.size("prompt_idx") > 0, F.col("prompt_idx")).otherwise(F.raise_error(F.concat(F.lit("no prompts: "), F.col("config"))))
    score = F.array_max(F.transform(prompts, lambda i: F.get(F.col("scores"), i)))
    rows = candidates.crossJoin(F.broadcast(configs))  # a grid's rows, not data's
    rows = rows.withColumn("score", score).where(F.col("score") >= F.col("score_threshold"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fits = (w * h >= F.col("min_area_m2")) & (F.col("max_size_m").isNull() | ((w <= F.col("max_size_m")) & (h <= F.col("max_size_m"))))
    return rows.withColumn("fits", fits)


def in_split(chips: DataFrame, split: str, cities: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Chips of a split, of some cities if any are named, the first `limit` by id if one is set."""
    rows = chips.where(F.col("split") == split)
    rows = rows.where(F.col("city").isin(cities)) if cities else rows
    return rows.orderBy("chip_id").limit(limit) if limit is not None else rows


def counts_of(counts: DataFrame, **values) -> DataFrame:
    """The rows of a table of counts with these values (config, method, iou, ...); folders of other values are not read."""
    for name, value in values.items():
        counts = counts.where(F.col(name) == value)
    return counts


def select_boxes(candidates: DataFrame, configs: DataFrame, extent_m: float | None) -> DataFrame:
    return scored(clip(candidates, extent_m), configs).where("fits").drop("fits")


def removed(candidates: DataFrame, configs: DataFrame, extent_m: float | None, keys: list[str]) -> DataFrame:
    rows = scored(clip(candidates, extent_m), configs)
    return rows.groupBy(*keys).agg(F.count_if("fits").alias("kept"), F.count_if(~F.col("fits")).alias("removed"))
