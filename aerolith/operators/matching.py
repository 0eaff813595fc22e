"""Candidate-reference edges and one-to-one matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from aerolith.functions import boxes, kernels

PAIR = T.StructType([T.StructField("cand_id", T.LongType()), T.StructField("ref_id", T.LongType()), T.StructField("iou", T.DoubleType())])


def edges(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """Overlapping pairs of a chip's candidates and references (by box) with their IoU; an equality join on the chip.

    The IoU depends on no setting, so one edge table serves all.
    """
    r = refs.select("chip_id", "ref_id", *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    meet = (F.col("x0") < F.col("rx1")) & (F.col("rx0") < F.col("x1")) & (F.col("y0") < F.col("ry1")) & (F.col("ry0") < F.col("y1"))
    pairs = candidates.join(r, "chip_id").where(meet)
    return pairs.withColumn("iou", boxes.iou(boxes.box(), boxes.box("r"))).where("iou > 0").drop("rx0", "ry0", "rx1", "ry1")


def polygon_edges(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """As edges(), with references that hold rings (exterior, then holes) and their area."""

    @F.pandas_udf("double")
    def overlap(rings: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        rows = zip(rings, zip(x0, y0, x1, y1, strict=True), strict=True)
        return pd.Series([kernels.polygon_in_box_area([[(p["x"], p["y"]) for p in ring] for ring in poly], b) for poly, b in rows], dtype=float)

    r = refs.select("chip_id", "ref_id", "rings", F.col("area").alias("ref_area"), *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    meet = (F.col("x0") < F.col("rx1")) & (F.col("rx0") < F.col("x1")) & (F.col("y0") < F.col("ry1")) & (F.col("ry0") < F.col("y1"))
    pairs = candidates.join(r, "chip_id").where(meet).withColumn("both", overlap("rings", "x0", "y0", "x1", "y1"))
    union = boxes.area(*boxes.box()) + F.col("ref_area") - F.col("both")
    return pairs.withColumn("iou", F.col("both") / F.nullif(union, F.lit(0.0))).where("iou > 0").drop("rx0", "ry0", "rx1", "ry1", "rings", "both", "ref_area")


def matched_pairs(edge_rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, cand_id, ref_id, iou of an optimal matching of each group (a chip's edges: a few thousand at most).

    A batch's groups are solved together, on the list's own arrays.
    """
    struct = F.struct(F.col("cand_id").cast("long").alias("cand_id"), F.col("ref_id").cast("long").alias("ref_id"), "iou")
    groups = edge_rows.where(F.col("iou") >= threshold).groupBy(*keys).agg(F.collect_list(struct).alias("g"))

    def solved(batches):
        for batch in batches:
            lists = batch.column("g")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            values = lists.flatten()
            fields = [values.field(i) for i in range(3)]
            group = np.repeat(np.arange(batch.num_rows), sizes)
            own = kernels.optimal_pairs(group, *(f.to_numpy(zero_copy_only=False) for f in fields))
            at, pick = pa.array(group[own]), pa.array(own)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *[f.take(pick) for f in fields]], [*keys, "cand_id", "ref_id", "iou"])

    schema = T.StructType([*[groups.schema[k] for k in keys], *PAIR.fields])
    return groups.select(*keys, "g").mapInArrow(solved, schema)


def matched_totals(edge_rows: DataFrame, keys: list[str], by: list[str], threshold: float) -> DataFrame:
    """by, matches: how many pairs matched_pairs() has, summed over the groups (keys) that share by. Asked for is how many pairs there are, not which."""
    struct = F.struct(F.col("cand_id").cast("long").alias("cand_id"), F.col("ref_id").cast("long").alias("ref_id"))
    groups = edge_rows.where(F.col("iou") >= threshold).groupBy(*dict.fromkeys([*keys, *by])).agg(F.collect_list(struct).alias("g"))

    def counted(batches):
        for batch in batches:
            lists = batch.column("g")
            group = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            p, r = (kernels._numbered(group, lists.flatten().field(i).to_numpy(zero_copy_only=False)) for i in range(2))
            group_of = np.zeros(int(p.max()) + 1 if len(p) else 0, np.int64)
            group_of[p] = group
            n = kernels.most_pairs(p, r, group_of, batch.num_rows)
            yield from pa.Table.from_arrays([*[batch.column(k) for k in by], pa.array(n)], [*by, "n"]).group_by(by).aggregate([("n", "sum")]).select([*by, "n_sum"]).rename_columns([*by, "matches"]).combine_chunks().to_batches()

    schema = T.StructType([*[groups.schema[k] for k in by], T.StructField("matches", T.LongType())])
    return groups.select(*by, "g").mapInArrow(counted, schema).groupBy(*by).agg(F.sum("matches").alias("matches"))


def star_pairs(edge_rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """As matched_pairs(), in SQL, of those components in which one box touches all others: its best edge is the matching."""
    rows = edge_rows.where(F.col("iou") >= threshold)
    by_c, by_r = Window.partitionBy(*keys, "cand_id"), Window.partitionBy(*keys, "ref_id")
    rows = rows.withColumn("dc", F.count("*").over(by_c)).withColumn("dr", F.count("*").over(by_r))
    rows = rows.withColumn("mc", F.max("dr").over(by_c)).withColumn("mr", F.max("dc").over(by_r)).where("mc = 1 or mr = 1")
    centre = F.when(F.col("mc") == 1, F.struct(F.lit(0).alias("side"), F.col("cand_id").cast("long").alias("id"))).otherwise(F.struct(F.lit(1).alias("side"), F.col("ref_id").cast("long").alias("id")))
    best = Window.partitionBy(*keys, "centre").orderBy(F.desc("iou"), "cand_id", "ref_id")
    return rows.withColumn("centre", centre).withColumn("n", F.row_number().over(best)).where("n = 1").select(*keys, "cand_id", "ref_id", "iou")


def counts(spine: DataFrame, kept: DataFrame, refs: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """matches, predictions, references of every row of the spine; chips with no box of one side or of both stay."""
    p = kept.groupBy(*keys).agg(F.count("*").alias("predictions"))
    m = pairs.groupBy(*keys).agg(F.count("*").alias("matches"), F.sum("iou").alias("total_iou"))
    r = refs.groupBy("chip_id").agg(F.count("*").alias("references"))
    rows = spine.join(p, keys, "left").join(m, keys, "left").join(r, "chip_id", "left")
    return rows.fillna(0, ["predictions", "matches", "references"]).fillna(0.0, ["total_iou"])
