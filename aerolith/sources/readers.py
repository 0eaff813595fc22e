"""Readers: file catalogues, GeoJSON labels, settings, archives of arrays."""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerolith.functions import polygons as polygons_
from aerolith.operators import relational

#: Columns of the result tables.
RESULTS = {
    "curve": "levels double, f1 double, lo double, hi double, chance double",
    "counts": "chip_id string, city string, block string, split string, detector string, method string, config string, level double, iou double, matches long, predictions long, references long, removed long, chance_matches double",
    "tune": "detector string, config string, level double, matches long, predictions long, references long, f1 double",
    "oracle": "chip_id string, block string, city string, detector string, kind string, level double, matches long, predictions long, references long, oracle_matches double",
}
SUMMARY = "map<string, struct<levels: array<double>, break_point: double, break_ci: array<double>, break_found_frac: double, break_point_finest_ref: double, break_ci_finest_ref: array<double>, above_chance_finest: boolean, above_chance_peak: boolean, peak_level: double, peak_f1: double, setting: string>>"
RINGS = "array<array<struct<x:double,y:double>>>"
GEOJSON = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>>>>"


def paths(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Paths below a folder that match a pattern; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")


def city_index(spark: SparkSession, root: str, city: str, image_glob: str, label_glob: str) -> DataFrame:
    """chip_id (city_key), city, image_path, label_path of images that have labels."""
    rows = relational.paired_files(paths(spark, root, image_glob), paths(spark, root, label_glob))
    return rows.select(F.concat_ws("_", F.lit(city), "key").alias("chip_id"), F.lit(city).alias("city"), "image_path", "label_path").orderBy("chip_id")


def index_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="chip_id string, city string, block string, split string, image_path string, label_path string")


def labels(files: DataFrame, width_m: float, height_m: float, least_m2: float = 0.5) -> DataFrame:
    """chip_id, ref_id, rings, area and box of each polygon of GeoJSON files, clipped to the chip.

    files: chip_id, content (text), transform (struct a, b, c, d, e, f: from file units to metres). Multipolygons come apart;
    other geometries go, as do polygons without an area. A polygon that the chip's edge cuts apart becomes several; pieces under
    least_m2 go. Rings that cross themselves are not repaired.
    """
    feature = F.explode(F.from_json("content", GEOJSON)["features"])
    rows = files.select("chip_id", "transform", feature.alias("f")).where("f.geometry.type in ('Polygon', 'MultiPolygon')")
    text = F.col("f.geometry.coordinates")
    points = "array<array<array<double>>>"
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(text, points))).otherwise(F.from_json(text, f"array<{points}>"))
    t = F.col("transform")
    moved = F.transform(
        "polygon",
        lambda ring: F.transform(ring, lambda p: F.struct((t["a"] * p[0] + t["b"] * p[1] + t["c"]).alias("x"), (t["d"] * p[0] + t["e"] * p[1] + t["f"]).alias("y"))),
    )
    rows = rows.select("chip_id", "transform", F.explode(polygons).alias("polygon")).select("chip_id", moved.alias("rings"))

    def clip(batches):
        for batch in batches:
            out = []
            for chip, rings in zip(batch.column("chip_id").to_pylist(), batch.column("rings").to_pylist(), strict=True):
                for piece in polygons_.clipped([[(p["x"], p["y"]) for p in ring] for ring in rings if ring], 0.0, 0.0, width_m, height_m):
                    if (area := polygons_.area(piece)) >= least_m2:
                        x, y = zip(*piece[0], strict=True)
                        out.append((chip, [[{"x": a, "y": b} for a, b in ring] for ring in piece], area, min(x), min(y), max(x), max(y)))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            ring_type = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], ring_type), *[pa.array(c, pa.float64()) for c in cols[2:]]], ["chip_id", "rings", "area", "x0", "y0", "x1", "y1"])

    found = rows.select(F.col("chip_id").cast("string"), "rings").mapInArrow(clip, f"chip_id string, rings {RINGS}, area double, x0 double, y0 double, x1 double, y1 double")
    return found.withColumn("ref_id", F.xxhash64("chip_id", F.to_json("rings")))


def settings(path: str) -> dict:
    """A tree of settings from YAML (a driver-side file)."""
    import yaml

    with open(path) as file:
        return yaml.safe_load(file)


def scale_for(scale_max, city: str) -> float:
    """A brightness scale that is one number or one for each city."""
    value = scale_max.get(city) if isinstance(scale_max, dict) else scale_max
    if not value or value <= 0:
        raise ValueError(f"no scale for {city}")
    return float(value)


def archives(spark: SparkSession, root: str, keys: str = ".*") -> DataFrame:
    """chip_id, key, shape, numbers (as doubles) of the arrays in a folder of .npz files whose whole name fits a pattern; others are not unpacked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(root).select("path", "content")

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as found:
                    rows = [(k, list(found[k].shape), found[k].astype(float).ravel().tolist()) for k in found.files if re.fullmatch(keys, k)]
                chip = path.rsplit("/", 1)[-1].removesuffix(".npz")
                yield pa.RecordBatch.from_arrays([pa.array([chip] * len(rows)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["chip_id", "key", "shape", "numbers"])

    return files.mapInArrow(read, "chip_id string, key string, shape array<int>, numbers array<double>")


def interval_cell(text) -> F.Column:
    """A confidence interval that a CSV cell holds as JSON."""
    return F.from_json(text, "array<double>")


def results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A result table as CSV with a header, by its kind's columns (RESULTS); columns are found by name, what a file lacks is NULL."""
    names = spark.read.csv(path, header=True).columns  # the header alone
    wanted = StructType.fromDDL(RESULTS[kind])
    rows = spark.read.csv(path, header=True, schema=", ".join(f"`{n}` {wanted[n].dataType.simpleString() if n in wanted.names else 'string'}" for n in names))
    return rows.select(*[F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])


def reference_files(spark: SparkSession, root: str) -> DataFrame:
    """chip_id, ref_id (its place in the file), rings of the references that a folder of <chip>.refs.json holds, lists of lists of points."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.refs.json").select(F.col("_metadata.file_name").alias("name"), "value")
    polygons = F.from_json("value", "array<array<array<array<double>>>>")
    rows = files.select(F.regexp_extract("name", r"(.*)[.]refs[.]json$", 1).alias("chip_id"), F.posexplode(polygons).alias("ref_id", "polygon"))
    return rows.select("chip_id", "ref_id", F.transform("polygon", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("rings"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """detector, method, iou, kind and the fields of each series of a summary, whose names are detector|method|iou..|kind."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", SUMMARY)).alias("series", "of"))
    parts = F.split("series", "[|]")
    return rows.select(parts[0].alias("detector"), parts[1].alias("method"), F.regexp_replace(parts[2], "^iou", "").cast("double").alias("iou"), parts[3].alias("kind"), "of.*")


def catalogue_items(spark: SparkSession, path: str) -> DataFrame:
    """id, x0, y0, x1, y1, day, cloud of the items of a catalogue's answer (a GeoJSON feature collection)."""
    kind = "struct<features: array<struct<id: string, bbox: array<double>, properties: struct<datetime: string, `eo:cloud_cover`: double>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    corners = [F.col("f.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("f.id", *corners, F.substring("f.properties.datetime", 1, 10).alias("day"), F.col("f.properties.`eo:cloud_cover`").alias("cloud"))
