"""Images in rows (height, width, bands, pixels as bytes): degrading, masks, components. Kernels run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions import kernels

IMAGE = "height int, width int, bands int, pixels binary"
#: Scene classes that hide the ground: fixed values of the product.
BAD_CLASSES = (0, 1, 3, 8, 9, 10)


def _id(images: DataFrame) -> str:
    return f"chip_id {images.schema['chip_id'].dataType.simpleString()}, "


def arrays(batch):
    for h, w, b, raw in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "bands", "pixels")), strict=True):
        yield np.frombuffer(raw, np.uint8).reshape(h, w, b)


def degraded(images: DataFrame, native_m: float, levels: list[float], methods: list[str], up: str = "cubic", blur: float = 0.5) -> DataFrame:
    """Each image for each method and level, as IMAGE with method and level."""
    for method in methods:
        kernels.degrade(np.zeros((1, 1, 1), np.uint8), 1.0, 1.0, method, up)  # a wrong name fails here, not on an executor

    def apply(batches):
        for batch in batches:
            images_ = list(arrays(batch))
            for method in methods:
                for level in levels:
                    raw = [kernels.degrade(x, native_m, level, method, up, blur).tobytes() for x in images_]
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(raw, pa.binary()), pa.array([method] * n), pa.array([level] * n, pa.float64())], [*names, "pixels", "method", "level"])

    names = ["chip_id", "height", "width", "bands"]
    return images.select(*names, "pixels").mapInArrow(apply, _id(images) + IMAGE + ", method string, level double")


def detected(images: DataFrame, detector: Callable[[np.ndarray], list[tuple]], carry: str = "chip_id long") -> DataFrame:
    """Boxes (and scores) that a function finds in each image: x0, y0, x1, y1, score; the place for a model."""
    names = [c.split()[0] for c in carry.split(", ")]

    def apply(batches):
        for batch in batches:
            found = [(i, *b) for i, x in enumerate(arrays(batch)) for b in detector(x)]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names], *[pa.array([float(f[k]) if f[k] is not None else None for f in found], pa.float64()) for k in range(1, 6)]], [*names, "x0", "y0", "x1", "y1", "score"])

    return images.mapInArrow(apply, carry + ", x0 double, y0 double, x1 double, y1 double, score double")


def colour_rule(red: int, over_green: int, over_blue: int, eight: bool = False, least: int = 1) -> Callable[[np.ndarray], list[tuple]]:
    def find(image: np.ndarray) -> list[tuple]:
        mask = kernels.colour_mask(image, red, over_green, over_blue)
        return [(*b[:4], None) for b in kernels.component_boxes(mask, eight, least)]

    return find


def cached(images: DataFrame, detectors: dict[str, Callable[[np.ndarray], list[tuple]]], native_m: float, levels: list[float], methods: list[str], up: str = "cubic", blur: float = 0.5) -> DataFrame:
    """chip_id, method, level, detector, x0, y0, x1, y1 (metres), score: what every detector finds in every degraded image.

    An image is degraded in the task that has it, and its pixels go no further. Chips without any box have no row.
    """
    for method in methods:
        kernels.degrade(np.zeros((1, 1, 1), np.uint8), 1.0, 1.0, method, up)
    names = ["chip_id", "method", "level", "detector", "x0", "y0", "x1", "y1", "score"]
    types = [pa.string(), pa.float64(), pa.string(), *[pa.float64()] * 5]

    def apply(batches):
        for batch in batches:
            rows = []
            for chip, image in zip(batch.column("chip_id").to_pylist(), arrays(batch), strict=True):
                for method in methods:
                    for level in levels:
                        seen = kernels.degrade(image, native_m, level, method, up, blur)
                        rows += [(chip, method, level, name, *[float(v) * native_m for v in box[:4]], None if box[4] is None else float(box[4])) for name, find in detectors.items() for box in find(seen)]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [batch.schema.field("chip_id").type, *types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return images.select("chip_id", "height", "width", "bands", "pixels").mapInArrow(apply, _id(images) + "method string, level double, detector string, x0 double, y0 double, x1 double, y1 double, score double")


def upsampled(images: DataFrame, height: int, width: int, up: str = "cubic") -> DataFrame:
    """Images of a coarser sensor at the size of the fine ones."""

    def apply(batches):
        for batch in batches:
            raw = [kernels.resized(x, (height, width), up).tobytes() for x in arrays(batch)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("chip_id"), pa.array([height] * n, pa.int32()), pa.array([width] * n, pa.int32()), batch.column("bands"), pa.array(raw, pa.binary())], ["chip_id", "height", "width", "bands", "pixels"])

    return images.select("chip_id", "height", "width", "bands", "pixels").mapInArrow(apply, _id(images) + IMAGE)


def colour_pixels(pixels: DataFrame, red: int, over_green: int, over_blue: int) -> DataFrame:
    """Pixels (r, g, b) that a colour rule takes; all bounds are strict."""
    return pixels.where((F.col("r") > red) & (F.col("r") - F.col("g") > over_green) & (F.col("r") - F.col("b") > over_blue))


def usable(classes, pixels) -> F.Column:
    """Whether a crop is clear and none of its pixels (an array of arrays of bands) is empty, which is what lies outside a scene."""
    return clear(classes) & ~F.exists(pixels, lambda p: F.forall(p, lambda v: v == 0))


def clear(classes) -> F.Column:
    """Whether an array of scene classes has none that hides the ground."""
    return ~F.exists(classes, lambda v: v.isin(*BAD_CLASSES))
