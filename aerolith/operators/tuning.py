"""Choosing settings: mean F1, the best, runners-up, the best of each level. Ties go to the config first in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from aerolith.functions import kernels
from aerolith.operators import matching, metrics, selection


def _profile(candidates: DataFrame, configs: list[tuple], extent_m: float | None, keys: list[str]) -> tuple[DataFrame, list[tuple]]:
    """keys, cand_id and box of each clipped candidate with its best score for each prompt set (of which the list is returned too), its longer side and area."""
    prompts = list(dict.fromkeys(tuple(c[1]) for c in configs))
    if not all(prompts):
        raise ValueError("a setting without prompts")
    best = F.array(*[F.array_max(F.array(*[F.get("scores", F.lit(i)) for i in p])) for p in prompts])
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return selection.clip(candidates, extent_m).select(*keys, "cand_id", "x0", "y0", "x1", "y1", best.alias("best"), F.greatest(w, h).alias("side"), (w * h).alias("area")), prompts


def kept_counts(candidates: DataFrame, configs: list[tuple], extent_m: float | None, by: list[str]) -> DataFrame:
    """by, config, predictions of every setting (rows of selection.CONFIG) that keeps any.

    Candidates are counted by how many thresholds, sizes and areas they pass, and only those counts meet the settings.
    """
    rows, prompts = _profile(candidates, configs, extent_m, by)
    thresholds, areas = (sorted({c[k] for c in configs}) for k in (2, 4))
    sizes = sorted({c[3] for c in configs if c[3] is not None})
    passed = lambda values, fits: sum((F.when(fits(F.lit(float(v))), 1).otherwise(0) for v in values), F.lit(0))
    steps = [passed(thresholds, lambda v, i=i: F.col("best")[i] >= v).alias(f"p{i}") for i in range(len(prompts))]
    tally = rows.select(*by, *steps, passed(sizes, lambda v: F.col("side") > v).alias("s"), passed(areas, lambda v: F.col("area") >= v).alias("a"))
    tally = tally.groupBy(*tally.columns).agg(F.count("*").alias("n"))
    table = [(c[0], prompts.index(tuple(c[1])), thresholds.index(c[2]), len(sizes) if c[3] is None else sizes.index(c[3]), areas.index(c[4])) for c in configs]
    grid = candidates.sparkSession.createDataFrame(table, "config string, pn int, tn int, sn int, an int").coalesce(1)
    reached = F.array(*[F.col(f"p{i}") for i in range(len(prompts))])[F.col("pn")]
    met = tally.crossJoin(F.broadcast(grid)).where((reached > F.col("tn")) & (F.col("s") <= F.col("sn")) & (F.col("a") > F.col("an")))  # settings
    return met.groupBy(*by, "config").agg(F.sum("n").alias("predictions"))


def matched_counts(candidates: DataFrame, refs: DataFrame, configs: list[tuple], extent_m: float | None, by: list[str], group: list[str], threshold: float = 0.25) -> DataFrame:
    """by, config, matches of every setting that has any; group: what tells apart the boxes that are matched with each other (with chip_id).

    Edges are found once and go to Python once, where each setting is a mask of them. Asked for is how many pairs there are, not which.
    """
    keys = list(dict.fromkeys([*group, *by]))
    rows, prompts = _profile(candidates, configs, extent_m, keys)
    edge = F.struct(F.col("cand_id").cast("long").alias("cand_id"), F.col("ref_id").cast("long").alias("ref_id"), "best", "side", "area")
    edges = matching.edges(rows, refs).where(F.col("iou") >= threshold).groupBy(*keys).agg(F.collect_list(edge).alias("g"))
    names = pa.array([c[0] for c in configs])

    def counted(batches):
        for batch in batches:
            lists = batch.column("g")
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            values = lists.flatten()
            cand, ref, scores, side, area = (values.field(i) for i in range(5))
            p, r = (kernels._numbered(of, x.to_numpy(zero_copy_only=False)) for x in (cand, ref))
            scores = scores.flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1)
            side, area = side.to_numpy(zero_copy_only=False), area.to_numpy(zero_copy_only=False)
            bins = pa.Table.from_arrays([batch.column(k) for k in by], by).append_column("at", pa.array(np.arange(batch.num_rows))).group_by(by).aggregate([("at", "list")])
            bin_of_row = np.zeros(batch.num_rows, np.int64)
            for i, members in enumerate(bins.column("at_list").to_pylist()):
                bin_of_row[members] = i
            bin_of = np.zeros(int(p.max()) + 1 if len(p) else 0, np.int64)
            bin_of[p] = bin_of_row[of]
            seen: dict[bytes, np.ndarray] = {}
            found = []
            for _, prompt, least, most, area_least in configs:
                fits = (scores[:, prompts.index(tuple(prompt))] >= least) & (area >= area_least)
                fits &= True if most is None else side <= most
                key = np.packbits(fits).tobytes()
                if key not in seen:
                    seen[key] = kernels.most_pairs(p[fits], r[fits], bin_of, bins.num_rows)
                found.append(seen[key])
            out = np.concatenate(found) if found else np.zeros(0, np.int64)
            at = np.tile(np.arange(bins.num_rows), len(configs))
            keep = np.flatnonzero(out)
            config = names.take(pa.array(keep // max(bins.num_rows, 1)))
            cols = [bins.column(k).combine_chunks().take(pa.array(at[keep])) for k in by]
            yield pa.RecordBatch.from_arrays([*cols, config, pa.array(out[keep])], [*by, "config", "matches"])

    schema = T.StructType([*[edges.schema[k] for k in by], T.StructField("config", T.StringType()), T.StructField("matches", T.LongType())])
    return edges.mapInArrow(counted, schema).groupBy(*by, "config").agg(F.sum("matches").alias("matches"))


def sweep(candidates: DataFrame, refs: DataFrame, configs: list[tuple], extent_m: float | None, by: list[str], group: list[str], threshold: float = 0.25) -> DataFrame:
    """by, config, matches, predictions of every setting that keeps any box."""
    found = matched_counts(candidates, refs, configs, extent_m, by, group, threshold)
    return kept_counts(candidates, configs, extent_m, by).join(found, [*by, "config"], "left").fillna(0, ["matches"])


def table(swept: DataFrame, spine: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """by, config, matches, predictions, references, f1 of every setting and every row of by; references: one row, references."""
    rows = spine.crossJoin(F.broadcast(references)).join(swept, [*by, "config"], "left").fillna(0, ["predictions", "matches"])  # one row
    f1 = metrics.prf(F.col("matches"), F.col("predictions"), F.col("references"))["f1"]
    return rows.select(*by, "config", "matches", "predictions", "references", F.round(f1, 9).alias("f1"))


def ranked(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """config, mean_f1, place of each config by its mean F1 over levels."""
    keys = keys or []
    mean = table.groupBy(*keys, "config").agg(F.round(F.avg("f1"), 9).alias("mean_f1"))
    return mean.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("mean_f1"), "config")))


def best(table: DataFrame) -> DataFrame:
    return ranked(table).where("place = 1")


def runners_up(table: DataFrame, first: int = 2, last: int = 5) -> DataFrame:
    return ranked(table).where(F.col("place").between(first, last))


def best_by_level(table: DataFrame) -> DataFrame:
    order = Window.partitionBy("level").orderBy(F.desc_nulls_last("f1"), "config")
    return table.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def at_finest(table: DataFrame) -> DataFrame:
    finest = table.agg(F.min("level").alias("level"))
    return table.join(F.broadcast(finest), "level")  # one row


def frozen(table: DataFrame) -> DataFrame:
    """kind (fixed, runner_up, per_level), level (NULL but for per_level), place, config."""
    none = F.lit(None).cast("double").alias("level")
    rows = ranked(table).where("place <= 5").select(F.when(F.col("place") == 1, "fixed").otherwise("runner_up").alias("kind"), none, "place", "config")
    return rows.unionByName(best_by_level(table).select(F.lit("per_level").alias("kind"), "level", F.lit(1).alias("place"), "config"))


def level_settings(spark: SparkSession, chosen: dict) -> DataFrame:
    """level (decimal), config of a map from levels to settings; its keys may be numbers or text, as YAML and JSON have them."""
    rows = [(str(float(k)), v) for k, v in chosen.items()]
    return spark.createDataFrame(rows, "level string, config string").select(F.col("level").cast("decimal(9,3)").alias("level"), "config")


def with_level_setting(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows with the setting of their level, found by its decimal value; levels without one go."""
    return rows.join(F.broadcast(chosen.withColumnRenamed("level", "__level")), F.col("level").cast("decimal(9,3)") == F.col("__level")).drop("__level")  # some ten levels
