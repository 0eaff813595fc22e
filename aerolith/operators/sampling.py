"""Splits, samples, strata and scales."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(seed: int, *names: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(n).cast("string") for n in names]).cast("binary"))


def block_split(chips: DataFrame, share: float, seed: int) -> DataFrame:
    """chips with split: whole blocks of each city go to dev or test; of several blocks at least one to either."""
    blocks = chips.select("city", "block").distinct()
    place = F.row_number().over(Window.partitionBy("city").orderBy(_order(seed, "city", "block"), "block"))
    return chips.join(_dealt(blocks.withColumn("place", place), share).select("city", "block", "split"), ["city", "block"])


def _dealt(blocks: DataFrame, share: float) -> DataFrame:
    """Blocks with split: a city's first by place are dev."""
    n = F.count("*").over(Window.partitionBy("city"))
    dev = F.bround(F.col("n") * share).cast("long")
    dev = F.when(F.col("n") > 1, F.least(F.greatest(dev, F.lit(1)), F.col("n") - 1)).otherwise(dev)
    return blocks.withColumn("n", n).withColumn("split", F.when(F.col("place") <= dev, "dev").otherwise("test"))


def block_split_numpy(chips: DataFrame, share: float, seed: int) -> DataFrame:
    """The same, in an order drawn by numpy's generator; of a city only the number of blocks is collected.

    Fixed value, so that draws equal the published ones: a city's generator is seeded by seed + crc32(city).
    """
    numbered = chips.select("city", "block").distinct().withColumn("at", F.row_number().over(Window.partitionBy("city").orderBy("block")) - 1)
    sizes = {r.city: r["count"] for r in numbered.groupBy("city").count().collect()}
    places = [(city, int(at), place + 1) for city, n in sizes.items() for place, at in enumerate(np.random.default_rng(seed + zlib.crc32(city.encode())).permutation(n))]
    drawn = numbered.join(chips.sparkSession.createDataFrame(places, "city string, at int, place int"), ["city", "at"])
    return chips.join(_dealt(drawn, share).select("city", "block", "split"), ["city", "block"])


def subsample(chips: DataFrame, n: int, seed: int) -> DataFrame:
    return chips.orderBy(_order(seed, "chip_id"), "chip_id").limit(n)


def chip_sample(chips: DataFrame, n: int, seed: int, keys: list[str], exact: bool = False) -> DataFrame:
    """n chips of each key in the order of a hash, all of a key that has fewer (with exact: an error then)."""
    by = Window.partitionBy(*keys)
    rows = chips.withColumn("__at", F.row_number().over(by.orderBy(_order(seed, "chip_id"), "chip_id"))).withColumn("__n", F.count("*").over(by))
    if exact:
        short = F.raise_error(F.concat_ws(" ", F.lit("too few chips:"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
        rows = rows.where(F.when(F.col("__n") >= n, True).otherwise(short))
    return rows.where(F.col("__at") <= n).drop("__at", "__n")


def terciles(rows: DataFrame, value: str) -> DataFrame:
    """rows with size_group by the value's thirds; cuts belong to the smaller group."""
    cuts = rows.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("__cuts"))
    at = rows.crossJoin(F.broadcast(cuts))  # one row
    group = F.when(F.col(value) <= F.col("__cuts")[0], "small").when(F.col(value) <= F.col("__cuts")[1], "medium").otherwise("large")
    return at.withColumn("size_group", group).drop("__cuts")


def brightness_scale(pixels: DataFrame, keys: list[str], value: str, q: float = 0.995, step: float = 50.0, every: int = 1, at: str | None = None) -> DataFrame:
    """keys, scale: a high quantile, rounded to steps; of every `every`-th pixel by its number `at`, if that is asked for.

    Values are counted first, so that a task holds a key's distinct values and not its pixels.
    """
    if at is not None:
        pixels = pixels.where(F.col(at) % every == 0)
    counted = pixels.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    rows = counted.groupBy(*keys).agg(F.percentile(value, F.lit(q), F.col("__n")).alias("p"))
    return rows.select(*keys, (F.bround(F.col("p") / step) * step).alias("scale"))


def first_scene(chips: DataFrame, scenes: DataFrame, cell: float) -> DataFrame:
    """chip_id, status, scene: of the sound scenes that contain a chip the least cloudy (unknown last), then least id; without one, 'none'.

    Of scenes with equal bounds only the first can be chosen, and chips with equal bounds choose the same: bounds meet, each once, and
    chips then look up theirs. Scenes' bounds are dealt to the grid cells they touch, so that a chip's meet only those of its cell.
    """
    box = ["x0", "y0", "x1", "y1"]
    first = F.struct(F.col("cloud").isNull().alias("unclouded"), "cloud", F.col("scene_id").isNull().alias("nameless"), "scene_id")
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    s = scenes.where("sound").groupBy(*[F.col(c).alias("s" + c) for c in box]).agg(F.min(first).alias("best"))
    s = s.withColumn("i", F.explode(cells("sx0", "sx1"))).withColumn("j", F.explode(cells("sy0", "sy1")))
    places = chips.select(*box).distinct().withColumn("i", F.floor(F.col("x0") / cell)).withColumn("j", F.floor(F.col("y0") / cell))
    inside = (F.col("sx0") <= F.col("x0")) & (F.col("sy0") <= F.col("y0")) & (F.col("sx1") >= F.col("x1")) & (F.col("sy1") >= F.col("y1"))
    found = places.join(s, ["i", "j"]).where(inside).groupBy(*box).agg(F.min("best").alias("best"))
    own = chips.join(found, box).groupBy("chip_id").agg(F.min("best").alias("best"))
    rows = chips.select("chip_id").join(own, "chip_id", "left").select("chip_id", F.col("best.scene_id").alias("scene"))
    return rows.select("chip_id", F.when(F.col("scene").isNull(), "none").otherwise("ok").alias("status"), "scene")
