"""Facts that the evaluation operators must reproduce."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import boxes, kernels, polygons
from aerolith.operators import baseline, bootstrap, curves, evaluation, matching, metrics, raster, relational, sampling, selection, tuning
from aerolith.plans import ORACLES, QUERIES
from aerolith.plans import queries as plans
from aerolith.plans.views import Views
from aerolith.sources import rasters, readers, writers
from aerolith.streaming import counts as stream

DATA = "/root/testdata/sf0.01"


def test_more_pairs_before_more_iou():
    # the middle box could take the best edge of all, and then leave two others alone
    pred, ref, iou = np.array([4, 4, 7, 9, 9]), np.array([1, 2, 2, 2, 3]), np.array([0.9, 0.4, 0.95, 0.3, 0.2])
    assert sorted((a, b) for a, b, _ in kernels.optimal_match(pred, ref, iou)) == [(4, 1), (7, 2), (9, 3)]
    assert len(kernels.optimal_match(np.array([0, 1]), np.array([5, 5]), np.array([0.7, 0.7]))) == 1


def test_matching_against_all_matchings():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        w = np.where(rng.random((n, m)) < 0.5, rng.random((n, m)), 0)
        p, r = np.nonzero(w)
        best = (0, 0.0)
        for k in range(min(n, m), 0, -1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    v = w[list(rows), list(cols)]
                    if (v > 0).all():
                        best = max(best, (k, float(v.sum())))
            if best[0]:
                break
        got = kernels.optimal_match(p, r, w[p, r])
        assert len(got) == best[0] and abs(sum(x for *_, x in got) - best[1]) < 1e-9
        assert len({a for a, *_ in got}) == len(got) == len({b for _, b, _ in got})
        if len(p):
            assert kernels.most_pairs(p, r, np.zeros(n, int), 1).tolist() == [best[0]]


def test_prf(spark):
    # fixed values: matches, predictions, references and the published shares
    rows = [(133, 2750, 6769, 4.84, 1.96, 2.79), (26, 334, 13402, 7.78, 0.19, 0.38), (367, 1544, 5819, 23.77, 6.31, 9.97), (481, 1929, 8237, 24.94, 5.84, 9.46), (105, 2081, 1435, 5.05, 7.32, 5.97)]
    df = spark.createDataFrame(rows, "m long, p long, r long, precision_ double, recall_ double, f1_ double")
    for r in df.withColumns(metrics.prf(F.col("m"), F.col("p"), F.col("r"))).collect():
        assert [round(r[c], 2) for c in ("precision", "recall", "f1")] == [r.precision_, r.recall_, r.f1_]
    none = spark.createDataFrame([(0, 0, 0), (0, 5, 0)], "m long, p long, r long").withColumns(metrics.prf(F.col("m"), F.col("p"), F.col("r"))).collect()
    assert none[0].f1 is None and none[1].f1 == 0 and none[1].recall is None


@pytest.mark.parametrize(
    ("gsd", "f1", "floor", "reference", "expected"),
    [
        # 50 at the finest level; 40 then 10 of 50 above the floor: shares 0.8 and 0.2, half is met midway (on a log scale)
        ([0.5, 2.0, 8.0], [54, 44, 14], 4.0, "finest", 4.0),
        # the peak is the second level; from 0.75 to 0.25 of it over a factor of 9
        ([0.2, 0.4, 1.0, 9.0], [12, 80, 60, 20], None, "peak", 3.0),
        # met exactly at a level
        ([1.0, 3.0, 5.0], [36, 30, 18], None, "finest", 5.0),
        # two peaks: the finer one counts, and the fall before it does not
        ([0.1, 0.2, 0.3, 0.6], [70, 20, 70, 35], None, "peak", 10 ** (np.log10(0.1) + 0.7 * (np.log10(0.2) - np.log10(0.1)))),
        ([0.5, 1.0], [9, 9], None, "peak", None), ([0.5, 1.0], [0, 3], None, "finest", None),
        # above the floor nowhere
        ([0.5, 1.0], [3, 2], 5.0, "peak", None),
    ],
)
def test_break_point(spark, gsd, f1, floor, reference, expected):
    df = spark.createDataFrame([("a", float(g), float(v), floor) for g, v in zip(gsd, f1, strict=True)], "k string, level double, f1 double, floor double")
    got = curves.break_point(df, ["k"], reference=reference).collect()[0].break_point
    assert got is None if expected is None else abs(got - expected) < 1e-9


def test_counts_of_the_views(spark):
    # fixed values, found by an independent script
    expected = {1: (8206, 15000, 6468), 2: (8042, 15000, 6332), 3: (7458, 15000, 5873), 4: (6353, 15000, 4470), 5: (4653, 15000, 2174), 6: (2968, 15000, 876), 7: (1860, 15000, 352)}
    rows = QUERIES["q_match_counts"](spark, DATA).collect()
    assert {r.level_id: (r.predictions, r.references, r.matches) for r in rows} == expected


def test_matching_is_optimal_throughout(spark):
    # the fixed values of test_counts_of_the_views
    matches = {0.3: 6468, 0.6: 6332, 0.9: 5873, 1.2: 4470, 2.4: 2174, 5.0: 876, 10.0: 352}
    assert {r.level: r.matches for r in QUERIES["q_pooled_prf"](spark, DATA).collect()} == matches
    f1 = {r.config: r.f1 for r in QUERIES["q_native_level"](spark, DATA).collect()}
    assert len(f1) == 300 and abs(f1["pair|t0.2|max30|min0"] - 200 * 6468 / (8206 + 15000)) < 1e-6
    sums = QUERIES["q_block_sums"](spark, DATA).groupBy("level").agg(F.sum("matches").alias("m")).collect()
    assert {r.level: r.m for r in sums} == matches


def test_matched_again_at_half(spark):
    # at 0.25 two pairs (0.3 and 0.45), at 0.5 the one pair of 0.6, which the first matching passes over
    e = spark.createDataFrame([(1, 1, 1, 1, 0.6), (1, 1, 1, 2, 0.45), (1, 1, 2, 1, 0.3)], "chip_id long, level_id int, cand_id long, ref_id long, iou double")
    assert [matching.matched_pairs(e, plans.GROUP, x).count() for x in (0.25, 0.5)] == [2, 1]


def test_sweep_against_one_setting_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = []
    for chip in range(12):
        for c in range(8):
            x, y, w, h = *rng.uniform(0, 30, 2), *rng.uniform(2, 9, 2)
            rows.append((chip, chip % 2, 1.0 + chip % 2, c, float(x), float(y), float(x + w), float(y + h), rng.random(2).round(2).tolist()))
    cands = spark.createDataFrame(rows, "chip_id long, level_id int, level double, cand_id long, x0 double, y0 double, x1 double, y1 double, scores array<double>")
    refs = spark.createDataFrame([(r[0], 100 + r[3], *(v + float(rng.uniform(-2, 2)) for v in r[4:6]), *(v + float(rng.uniform(-1, 2)) for v in r[6:8])) for r in rows[::2]], "chip_id long, ref_id long, x0 double, y0 double, x1 double, y1 double")
    grid = {"a": [0], "b": [1], "ab": [0, 1]}, [0.2, 0.5], [5.0, 8.0], [0.0, 30.0]
    got = {(r.level, r.config): (r.predictions, r.matches) for r in tuning.sweep(cands, refs, selection.settings(*grid), 34.0, ["level"], plans.GROUP, 0.1).collect()}
    kept = selection.select_boxes(cands, selection.grid(spark, *grid), 34.0)
    pairs = matching.matched_pairs(matching.edges(kept.drop("scores"), refs), ["config", *plans.GROUP, "level"], 0.1).groupBy("level", "config").count().collect()
    m = {(r.level, r.config): r["count"] for r in pairs}
    want = {(r.level, r.config): (r["count"], m.get((r.level, r.config), 0)) for r in kept.groupBy("level", "config").count().collect()}
    assert got == want and len(want) > 30 and any(v for _, v in want.values())
    with pytest.raises(ValueError, match="prompts"):
        tuning.sweep(cands, refs, [("none", [], 0.1, 5.0, 0.0)], 34.0, ["level"], plans.GROUP)
    empty = spark.createDataFrame([("none", [], 0.1, 5.0, 0.0)], selection.CONFIG)
    with pytest.raises(Exception, match="no prompts"):
        selection.select_boxes(cands, empty, 34.0).collect()


def test_select_boxes(spark):
    df = spark.createDataFrame([(1, 1, -5.0, -5.0, 10.0, 10.0, [0.9, 0.1]), (1, 2, 25.0, 25.0, 30.0, 30.0, [0.9, 0.1]), (1, 3, 0.0, 0.0, 15.0, 3.0, [0.1, 0.5])], "chip_id long, cand_id long, x0 double, y0 double, x1 double, y1 double, scores array<double>")
    grid = selection.grid(spark, {"a": [0], "ab": [0, 1]}, [0.5], [12.0], [0.0])
    assert {(r.config, r.cand_id) for r in selection.select_boxes(df, grid, 20.0).collect()} == {("a|t0.5|max12|min0", 1), ("ab|t0.5|max12|min0", 1)}
    gone = {r.config: (r.kept, r.removed) for r in selection.removed(df, grid, 20.0, ["config"]).collect()}
    assert gone == {"a|t0.5|max12|min0": (1, 0), "ab|t0.5|max12|min0": (1, 1)}


def test_polygons(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2)]
    assert kernels.polygon_in_box_area([square, hole], (0, 0, 2, 4)) == 7
    concave = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]
    assert kernels.polygon_in_box_area([concave], (0, 3, 6, 5)) == 8
    rings = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in square],)], "ring array<struct<x:double,y:double>>")
    cx, cy = boxes.ring_centroid(F.col("ring"))
    r = rings.select(boxes.ring_area(F.col("ring")).alias("a"), cx.alias("x"), cy.alias("y")).collect()[0]
    assert (r.a, r.x, r.y) == (16, 2, 2)
    cx, cy = boxes.polygon_centroid(F.col("rings"))
    both = spark.createDataFrame([([[{"x": float(x), "y": float(y)} for x, y in r] for r in (square, hole)],)], "rings array<array<struct<x:double,y:double>>>")
    r = both.select(cx.alias("x"), cy.alias("y"), boxes.sound_ring(F.col("rings")[0]).alias("ok")).collect()[0]
    assert abs(r.x - (16 * 2 - 1.5) / 15) < 1e-9 and r.x == r.y and r.ok
    line = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 2.0}],)], "ring array<struct<x:double,y:double>>")
    assert not line.select(boxes.sound_ring(F.col("ring")).alias("ok")).collect()[0].ok
    # an edge that cuts a concave polygon in two makes two references, and each is held against the least area
    assert sorted(polygons.area(p) for p in polygons.clipped([concave], 0, 3, 6, 5)) == [4, 4]
    frame = [(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (8, 2), (8, 8), (2, 8)]
    assert [polygons.area(p) for p in polygons.clipped(list(frame), 0, 0, 5, 10)] == [32]
    assert sorted(polygons.area(p) for p in polygons.clipped(list(frame), 0, 4, 10, 6)) == [4, 4]
    assert polygons.clipped(list(frame), 3, 3, 7, 7) == [] and [len(p) for p in polygons.clipped(list(frame), -1, -1, 11, 11)] == [2]
    text = '{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0,0],[40,0],[40,40],[0,40]]]}}, {"geometry": null}, {"geometry": {"type": "Point", "coordinates": [1, 1]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[1,1],[2,1],[2,2],[1,2]]], [[[0,0],[0.1,0],[0,0.1]]]]}}]}'
    files = spark.createDataFrame([("c", text, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))], "chip_id string, content string, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>")
    assert sorted(r.area for r in readers.labels(files, 30.0, 20.0).collect()) == [1.0, 600.0]


def test_raster():
    # fixed values: the published levels, and an image's sizes at them
    levels = [0.3, 0.45, 0.6, 0.9, 1.2, 1.8, 2.4, 3.6, 5.0, 10.0]
    assert [kernels.target_pixels(650, 0.3, x) for x in levels] == [650, 433, 325, 217, 163, 108, 81, 54, 39, 20]
    flat = np.full((40, 40, 3), 77, np.uint8)
    board = ((np.indices((40, 40)).sum(0) % 2) * 255).astype(np.uint8)[:, :, None].repeat(3, 2)
    for method in ("area", "blur_resize"):
        assert (np.abs(kernels.degrade(flat, 0.3, 1.2, method).astype(int) - 77) <= 1).all()
        assert (kernels.degrade(board, 0.3, 0.3, method) == board).all()
    assert (np.abs(kernels.degrade(board, 0.3, 1.2, "area") - 127.5) <= 3).all()
    with pytest.raises(ValueError):
        kernels.degrade(flat, 0.3, 1.2, "other")
    # detail goes level by level, by either method
    noise = np.random.default_rng(0).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    for method in ("area", "blur_resize"):
        spread = [kernels.degrade(noise, 0.3, x, method).std() for x in (0.3, 0.6, 1.2, 2.4)]
        assert spread == sorted(spread, reverse=True) and spread[-1] < spread[0] / 3
        assert kernels.degrade(board, 0.3, 1.2, method).std() < 5
    # a coarse sensor's image is bytes before it is enlarged
    ramp = (np.arange(8, dtype=np.uint8)[None, :, None] * 3).repeat(8, 0).repeat(3, 2)
    small = kernels._applied(ramp, kernels._average(8, 2), kernels._average(8, 2))
    assert small[0, :, 0].tolist() == [4, 16] and (kernels.degrade(ramp, 0.3, 1.2, "area") == kernels.resized(small, (8, 8))).all()
    assert kernels.resized(flat, (100, 70)).shape == (100, 70, 3) and (kernels.resized(flat, (100, 70)) == 77).all()
    mask = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0]], bool)
    assert len(kernels.component_boxes(mask)) == 2 and kernels.component_boxes(mask, eight=True) == [(0, 0, 2, 2, 2)]
    image = np.zeros((1, 2, 3), np.uint8)
    image[0, 0], image[0, 1] = (121, 95, 95), (120, 0, 0)
    assert kernels.colour_mask(image, 120, 25, 25).tolist() == [[True, False]]
    assert kernels.colour_mask(image, 120, 26, 25).sum() == 0


def test_bootstrap_and_split(spark):
    chips = spark.createDataFrame([(i, "ab"[i % 2], f"{'ab'[i % 2]}:{i % 14}") for i in range(200)], "chip_id long, city string, block string")
    for split in (sampling.block_split, sampling.block_split_numpy):
        rows = split(chips, 0.3, 5).collect()
        by_block = {}
        for r in rows:
            by_block.setdefault(r.block, set()).add(r.split)
        assert len(rows) == 200 and all(len(s) == 1 for s in by_block.values()) and 0.1 <= sum(r.split == "dev" for r in rows) / 200 <= 0.5
    counts = chips.select("block", F.lit(1.0).alias("level"), F.lit(3).alias("matches"), F.lit(4).alias("predictions"), F.lit(5).alias("references"))
    for drawn in (bootstrap.draws(chips, 50), bootstrap.draws_numpy(chips, 50)):
        reps = bootstrap.replicates(bootstrap.block_sums(counts, ["level"]), drawn, ["level"])
        r = bootstrap.interval(reps, ["level"]).collect()[0]
        assert abs(r.lo - 200 * 3 / 9) < 1e-9 and abs(r.hi - r.lo) < 1e-9 and r.found == 1
    assert len(sampling.subsample(chips, 7, 1).collect()) == 7


def test_null_models(spark):
    kept = spark.createDataFrame([(1, 1, i, 0.0, 0.0, 6.0, 4.0) for i in range(5)], "chip_id long, level_id int, cand_id long, x0 double, y0 double, x1 double, y1 double")
    refs = spark.createDataFrame([(1, i, 10.0 * i, 5.0, 10.0 * i + 2, 7.0) for i in range(3)], "chip_id long, ref_id long, x0 double, y0 double, x1 double, y1 double")
    moved = baseline.relocate_to_refs(kept, refs, ["chip_id", "level_id"], ["cand_id"]).collect()
    centres = [((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2) for r in moved]
    assert len(moved) == 5 and set(centres) == {(1.0, 6.0), (11.0, 6.0), (21.0, 6.0)}
    even = baseline.relocate_uniform(kept, 50.0, ["cand_id"]).collect()
    assert all(abs(r.x1 - r.x0 - 6) < 1e-9 and r.x0 >= 0 and r.x1 <= 50 for r in even)


def test_relocations_go_to_centroids(spark):
    kept = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 2.0, 2.0)], "chip_id long, level_id int, cand_id long, x0 double, y0 double, x1 double, y1 double")
    ring = [{"x": 0.0, "y": 0.0}, {"x": 6.0, "y": 0.0}, {"x": 0.0, "y": 3.0}]
    refs = spark.createDataFrame([(1, 1, 0.0, 0.0, 6.0, 3.0, [ring])], "chip_id long, ref_id long, x0 double, y0 double, x1 double, y1 double, rings array<array<struct<x:double,y:double>>>")
    r = baseline.relocate_to_refs(kept, refs, ["chip_id", "level_id"], ["cand_id"]).collect()[0]
    assert [round(v, 9) for v in (r.x0, r.y0, r.x1, r.y1)] == [1, 0, 3, 2]


def test_as_many_draws_as_published():
    assert (plans.N_BOOT, plans.CHANCE_REPS, plans.ORACLE_REPS, len(plans.settings())) == (2000, 20, 10, 300)


def test_seeds_are_published_ones(spark):
    import zlib

    rows = QUERIES["q_seeds"](spark, "/root/testdata/sf0.001").limit(50).collect()
    assert all(r.seed == zlib.crc32(f"{r.chip_id}|{r.level}|0.25".encode()) and r.oracle_seed == zlib.crc32(f"{r.chip_id}|{r.level}|colour".encode()) for r in rows)


def test_settings_by_name(spark):
    df = spark.createDataFrame([("r120_c15|max195",)], "s string").select(*selection.parsed_setting(F.col("s")))
    assert tuple(df.collect()[0]) == ("colour-r120_c15", 195.0)
    assert selection.colour_variants([100, 120], [15])[1] == ("r120_c15", 120, 15, 15)
    chosen = tuning.level_settings(spark, {"0.3": "a", 1.2: "b"})
    rows = spark.createDataFrame([(0.3,), (1.2,), (5.0,)], "level double")
    assert {(r.level, r.config) for r in tuning.with_level_setting(rows, chosen).collect()} == {(0.3, "a"), (1.2, "b")}


def test_grids_and_comparisons(spark):
    whole = spark.createDataFrame([(c, lv, float(c + lv)) for c in range(3) for lv in range(2)], "chip_id long, level int, v double")
    assert evaluation.complete_grid(whole, "chip_id", ["level"]).count() == 6
    for broken in (whole.where("not (chip_id = 1 and level = 0)"), whole.unionByName(whole.limit(1))):
        with pytest.raises(Exception, match="incomplete grid"):
            evaluation.complete_grid(broken, "chip_id", ["level"]).collect()
    other = whole.withColumn("v", F.when(F.col("chip_id") == 2, F.col("v") + 0.2).when(F.col("chip_id") == 0, F.lit(None)).otherwise(F.col("v") + 0.01)).where("not (chip_id = 1 and level = 1)")
    found = {(r.chip_id, r.level) for r in evaluation.compared(whole, other, ["chip_id", "level"], {"v": 0.05}).collect()}
    assert found == {(0, 0), (0, 1), (1, 1), (2, 0), (2, 1)}
    r = evaluation.agreement(whole, other, ["chip_id", "level"], ["v"]).collect()[0]
    assert (r["groups"], r.v_equal) == (6, 0) and abs(r.v_largest - 0.2) < 1e-9


def test_cache_is_its_steps(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    images = plans.images(v).limit(20)
    rule = raster.colour_rule(120, 25, 25)
    got = raster.cached(images, {"colour": rule}, 0.3, [0.3, 1.2], ["area"]).collect()
    steps = raster.detected(raster.degraded(images, 0.3, [0.3, 1.2], ["area"]), rule, carry="chip_id long, method string, level double").collect()
    assert sorted((r.chip_id, r.level, r.x0, r.y1) for r in got) == sorted((r.chip_id, r.level, r.x0 * 0.3, r.y1 * 0.3) for r in steps) and got
    up = raster.upsampled(images, 20, 30).collect()
    assert all((r.height, r.width, len(r.pixels)) == (20, 30, 1800) for r in up)


def tiff(image, deflate=False, scale=None):
    """A small TIFF: one strip."""
    import struct
    import zlib

    h, w, bands = image.shape
    raw = image.astype("<" + image.dtype.str[1:]).tobytes()
    raw = zlib.compress(raw) if deflate else raw
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [image.dtype.itemsize * 8] * bands), (259, 3, [8 if deflate else 1]), (273, 4, [None]), (277, 3, [bands]), (279, 4, [len(raw)])]
    entries += [(33550, 12, [scale, scale, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 200.0, 0.0])] if scale else []
    data_at = 8 + 2 + 12 * len(entries) + 4
    extra, body = b"", struct.pack("<H", len(entries))
    start = data_at + sum(len(v) * {3: 2, 4: 4, 12: 8}[k] for _, k, v in entries if len(v) * {3: 2, 4: 4, 12: 8}[k] > 4)
    for code, kind, values in entries:
        packed = struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind] }", *[start if v is None else v for v in values])
        if len(packed) > 4:
            packed, extra = struct.pack("<I", data_at + len(extra)), extra + packed
        body += struct.pack("<HHI", code, kind, len(values)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + body + b"\0" * 4 + extra + raw


def test_images_from_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    fine = rng.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    multi = rng.integers(0, 3000, (4, 4, 8)).astype(np.uint16)
    (tmp_path / "fine").mkdir()
    (tmp_path / "fine" / "img1.tif").write_bytes(tiff(fine, scale=0.3))
    (tmp_path / "fine" / "img2.tif").write_bytes(tiff(fine, deflate=True))
    (tmp_path / "img3.ppm").write_bytes(b"P6\n# made\n5 6\n255\n" + fine.tobytes())
    (tmp_path / "multi.tif").write_bytes(tiff(multi))
    np.save(tmp_path / "crop.npy", multi[:, :, :3])
    for root, glob, n in ((tmp_path / "fine", "*.tif", 2), (tmp_path, "*.ppm", 1)):
        rows = rasters.rasters(spark, str(root), glob).collect()
        assert len(rows) == n and all((r.height, r.width, r.bands, bytes(r.pixels)) == (6, 5, 3, fine.tobytes()) for r in rows)
    one = {r.chip_id: r.transform for r in rasters.rasters(spark, str(tmp_path / "fine"), "*.tif").collect()}
    assert tuple(one["img1"]) == (0.3, 0.0, 100.0, 0.0, -0.3, 200.0) and one["img2"] is None
    red = np.clip(np.rint(multi[:, :, [4, 2, 1]] * 255.0 / 2000), 0, 255).astype(np.uint8)
    got = rasters.rasters(spark, str(tmp_path), "multi.tif", 2000.0, rasters.RGB_BANDS).collect()[0]
    assert bytes(got.pixels) == red.tobytes()
    big = rasters.rasters(spark, str(tmp_path), "multi.tif", 2000.0, rasters.RGB_BANDS, (65, 65)).collect()[0]
    assert (big.height, bytes(big.pixels)) == (65, kernels.resized(red, (65, 65)).tobytes())
    assert rasters.rasters(spark, str(tmp_path), "crop.npy", 3000.0).collect()[0].height == 4
    with pytest.raises(Exception, match="scale"):
        rasters.rasters(spark, str(tmp_path), "crop.npy").collect()
    path = spark.createDataFrame([("/d/RGB-PanSharpen/RGB-PanSharpen_img7.tif",)], "p string").select(rasters.multispectral_path(F.col("p")).alias("p"))
    assert path.collect()[0].p == "/d/MUL/MUL_img7.tif"


def test_result_files(spark, tmp_path):
    (tmp_path / "curve.csv").write_text("levels,f1,hi,lo\n0.3,4.5,5,4\n0.6,,,\n")
    rows = readers.results(spark, str(tmp_path / "curve.csv"), "curve").collect()
    assert [(r.levels, r.f1, r.lo, r.hi, r.chance) for r in rows] == [(0.3, 4.5, 4.0, 5.0, None), (0.6, None, None, None, None)]
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "Paris_img1.refs.json").write_text("[[[[0, 0], [4, 0], [4, 4]]], [[[0, 0], [9, 0], [9, 9], [0, 9]], [[1, 1], [2, 1], [2, 2]]]]")
    refs = readers.reference_files(spark, str(tmp_path / "refs")).orderBy("ref_id").collect()
    assert [(r.chip_id, r.ref_id, len(r.rings)) for r in refs] == [("Paris_img1", 0, 1), ("Paris_img1", 1, 2)] and refs[0].rings[0][1].x == 4
    (tmp_path / "summary.json").write_text('{"owl|area|iou0.25|fixed": {"levels": [0.3], "break_point": 2.5, "break_ci": null, "peak_level": 0.9}}')
    r = readers.summary(spark, str(tmp_path / "summary.json")).collect()[0]
    assert (r.detector, r.method, r.iou, r.kind, r.break_point, r.break_ci, r.peak_level) == ("owl", "area", 0.25, "fixed", 2.5, None, 0.9)
    items = [("a", 30, "2020-05-01"), ("b", 5, "2020-06-01"), ("c", 1, "2021-06-01"), ("d", 5, "2020-05-20")]
    features = ",".join('{"id": "%s", "bbox": [0, 0, 10, 10], "properties": {"datetime": "%sT10:00:00Z", "eo:cloud_cover": %d}}' % (i, day, c) for i, c, day in items)
    (tmp_path / "items.json").write_text('{"features": [%s]}' % features)
    found = relational.scene_search(readers.catalogue_items(spark, str(tmp_path / "items.json")), (9, 9, 20, 20), "2020-01-01", "2020-12-31", 20.0)
    assert [r.id for r in found.collect()] == ["b", "d"]
    spark.createDataFrame([("c1", "Paris", "b", "dev", "i", "l")], "chip_id string, city string, block string, split string, image_path string, label_path string").write.csv(str(tmp_path / "index"), header=True)
    assert readers.index_csv(spark, str(tmp_path / "index")).collect()[0].split == "dev"
    table = spark.createDataFrame([("a", 1.26, [1.0, 2.5]), ("b", None, None)], "name string, f1 double, ci array<double>")
    assert "| a | 1.3 | [1.0, 2.5] |" in writers.markdown(table) and "| b | - | - |" in writers.markdown(table)
    writers.report([("Curves", table)], str(tmp_path / "report.md"), "All")
    assert "## Curves" in (tmp_path / "report.md").read_text()
    with pytest.raises(ValueError, match="rows"):
        writers._few(spark.range(50), 40)
    writers.csv(table.drop("ci"), str(tmp_path / "out"))
    writers.summary_json(table, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and spark.read.csv(str(tmp_path / "out"), header=True).columns == ["name", "f1"]
    table.drop("ci").write.parquet(str(tmp_path / "grown"))
    writers.append_missing(spark.createDataFrame([("a", 0.0), ("z", 9.0)], "name string, f1 double"), str(tmp_path / "grown"), ["name"], spark)
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "grown")).collect()) == ["a", "b", "z"]


def test_upkeep_and_files(spark, tmp_path):
    for n in ("img1.tif", "img2.tif", "img10.tif"):
        (tmp_path / n).write_bytes(b"x")
    for n in ("img2.geojson", "img10.geojson"):
        (tmp_path / n).write_text("{}")
    rows = readers.city_index(spark, str(tmp_path), "Paris", "*.tif", "*.geojson").collect()
    assert [r.chip_id for r in rows] == ["Paris_img10", "Paris_img2"]
    assert writers.manifest(spark, str(tmp_path), "*.tif").select("sha256").distinct().count() == 1
    np.savez(tmp_path / "c1.npz", a=np.ones((2, 3)), b=np.zeros(1))
    assert [r.key for r in readers.archives(spark, str(tmp_path), "b|c").collect()] == ["b"]
    assert [tuple(r) for r in readers.archives(spark, str(tmp_path)).select("chip_id", "key", "shape").orderBy("key").collect()] == [("c1", "a", [2, 3]), ("c1", "b", [1])]
    df = spark.createDataFrame([("d", "area", 0.3, 1, 2, 3), ("d", "area", 0.6, 1, 1, 1)], "detector string, method string, level double, matches long, predictions long, references long")
    out = str(tmp_path / "table")
    writers.save(df, out)
    writers.save(df.where("level = 0.6").withColumn("matches", F.lit(9).cast("long")), out)
    assert sorted(r.matches for r in spark.read.parquet(out).collect()) == [1, 9]
    stream.start(spark, out, "matches long, predictions long, references long, detector string, method string, level double", str(tmp_path / "sums"), str(tmp_path / "state"), ["detector"]).awaitTermination()
    assert stream.totals(spark, str(tmp_path / "sums"), ["detector"]).collect()[0].matches == 10
    a, b = (spark.createDataFrame([(i,) for i in x], "k long") for x in ([1, 2], [2, 3]))
    assert relational.append_new(a, b, ["k"]).count() == 3 and relational.missing(b, a, ["k"]).count() == 1
    with pytest.raises(Exception, match="no such key"):
        relational.looked_up(b, a.withColumn("v", F.lit(1)), ["k"]).collect()
    table = spark.createDataFrame([("a", 0.3, 5.0), ("b", 0.3, 5.0), ("a", 0.6, 1.0), ("b", 0.6, 2.0)], "config string, level double, f1 double")
    assert tuning.best(table).collect()[0].config == "b" and {r.level: r.config for r in tuning.best_by_level(table).collect()} == {0.3: "a", 0.6: "b"}
    writers.frozen_yaml(tuning.frozen(table), str(tmp_path / "f.yaml"))
    assert readers.settings(str(tmp_path / "f.yaml"))["per_level"] == {0.3: "a", 0.6: "b"}
    assert raster.BAD_CLASSES == (0, 1, 3, 8, 9, 10) and "| 5.0 |" in writers.markdown(table)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{sf}/{t}')")
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({ORACLES[name].removeprefix('--')})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want))


def test_every_query_but_a_few_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"q_coarse_diag", "q_components", "q_degrade", "q_cache", "q_upsampled"}


def test_edges_need_overlap(spark):
    c = spark.createDataFrame([(1, 1, 0.0, 0.0, 4.0, 4.0), (1, 2, 4.0, 0.0, 8.0, 4.0)], "chip_id long, cand_id long, x0 double, y0 double, x1 double, y1 double")
    r = spark.createDataFrame([(1, 7, 2.0, 0.0, 4.0, 4.0)], "chip_id long, ref_id long, x0 double, y0 double, x1 double, y1 double")
    assert [(e.cand_id, e.iou) for e in matching.edges(c, r).collect()] == [(1, 0.5)]


def test_command_line(spark, tmp_path):
    from aerolith.__main__ import main

    v = Views(spark, "/root/testdata/sf0.001")
    at = {n: str(tmp_path / n) for n in ("candidates", "refs", "chips", "tune", "counts", "curves", "split", "boxes")}
    v.cands.write.parquet(at["candidates"])
    v.refs.write.parquet(at["refs"])
    v.chips.write.parquet(at["chips"])
    settings = tmp_path / "settings.yaml"
    settings.write_text("prompts: {first: [0], pair: [0, 1]}\nthresholds: [0.2, 0.4]\nmax_sizes: [30]\nextent_m: 195\n")
    tables = [f"--{n}={at[n]}" for n in ("candidates", "refs", "chips")] + [f"--settings={settings}"]
    main(["split", "--chips", at["chips"], "--out", at["split"]])
    assert spark.read.parquet(at["split"]).select("split").distinct().count() == 2
    main(["tune", *tables, "--out", at["tune"], "--frozen", str(tmp_path / "frozen.yaml")])
    frozen = readers.settings(str(tmp_path / "frozen.yaml"))
    assert spark.read.parquet(at["tune"]).count() == 28 and frozen["fixed"].split("|")[0] in ("first", "pair") and len(frozen["per_level"]) == 7
    tables[2] = f"--chips={at['split']}"
    main(["evaluate", *tables, "--out", at["counts"], "--split", "test", "--chance", "2", "--config", "pair|t0.2|max30|min0"])
    chips = spark.read.parquet(at["split"]).where("split = 'test'").count()
    assert spark.read.parquet(at["counts"]).count() == chips * 7 * 6 * 2
    main(["report", "--counts", at["counts"], "--out", at["curves"], "--draws", "20", "--markdown", str(tmp_path / "r.md")])
    assert spark.read.parquet(at["curves"]).count() == 42 and "Break points" in (tmp_path / "r.md").read_text()
    images = tmp_path / "images"
    images.mkdir()
    red = np.zeros((12, 12, 3), np.uint8)
    red[2:5, 3:9, 0] = 250
    (images / "img1.tif").write_bytes(tiff(red))
    main(["cache", "--images", str(images), "--levels", "0.3", "--out", at["boxes"]])
    r = spark.read.parquet(at["boxes"]).collect()
    assert [(x.chip_id, x.detector, round(x.x0, 6), round(x.y1, 6)) for x in r] == [("img1", "colour-r120_c25", 0.9, 1.5)]


def joined_rows(df) -> int:
    """The most rows that a join of a frame's plan puts out."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        n = node.metrics().get("numOutputRows") if "Join" in name else None
        children = node.children()
        return max([n.get().value() if n is not None and n.isDefined() else 0, *[walk(children.apply(i)) for i in range(children.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def test_first_scene_meets_equal_bounds_once(spark):
    chips = spark.range(800).selectExpr("id as chip_id", "1D as x0", "1D as y0", "2D as x1", "2D as y1")
    scenes = spark.range(800).selectExpr("id as scene_id", "if(id = 0, null, double(1000 - id)) as cloud", "id <> 799 as sound", "0D as x0", "0D as y0", "3D as x1", "3D as y1")
    out = sampling.first_scene(chips, scenes, 30.0)
    assert joined_rows(out) <= 800
    assert {(r.status, r.scene) for r in out.collect()} == {("ok", 798)} and out.count() == 800


def test_first_scene_takes_unknown_cloud_last(spark):
    chips = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (2, 50.0, 50.0, 51.0, 51.0), (3, 90.0, 90.0, 91.0, 91.0)], "chip_id long, x0 double, y0 double, x1 double, y1 double")
    box = "x0 double, y0 double, x1 double, y1 double"
    scenes = spark.createDataFrame([(1, None, True, 0.0, 0.0, 60.0, 60.0), (2, 5.0, True, 0.0, 0.0, 60.0, 40.0), (3, None, True, 40.0, 40.0, 60.0, 60.0)], f"scene_id long, cloud double, sound boolean, {box}")
    assert sorted(map(tuple, sampling.first_scene(chips, scenes, 30.0).collect())) == [(1, "ok", 2), (2, "ok", 1), (3, "none", None)]


def test_status_hist_meets_equal_bounds_once(spark, tmp_path):
    """Customers and events whose keys give one place and one scene: joins put out a row each, not every pair."""
    spark.range(400).selectExpr("id * 190 + 1 as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(400).selectExpr("id * 1260 as event_id", "double(id) as value", "'click' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    out = QUERIES["q_status_hist"](spark, str(tmp_path))
    assert joined_rows(out) <= 400 and list(map(tuple, out.collect())) == [("none", 400)]
    spark.range(400).selectExpr("id * 190 as c_custkey").write.mode("overwrite").parquet(str(tmp_path / "customer.parquet"))
    out = QUERIES["q_status_hist"](spark, str(tmp_path))
    assert joined_rows(out) <= 400 and list(map(tuple, out.collect())) == [("ok", 400)]


def test_block_counts_sum_what_evaluate_counts(spark):
    """By block the same as chip by chip, of chips without boxes, boxes of no chip and levels without boxes too."""
    names = ["chip_id", "detector", "method", "level_id", "level", "cand_id", "x0", "y0", "x1", "y1", "scores"]
    rows = [(chip, d, "area", level, float(level), i, 9.0 * i, 5.0 * chip, 9.0 * i + 10, 5.0 * chip + 10, [0.1 + 0.2 * i, 0.5]) for chip in (1, 2, 3, 9) for d in "ab" for level in (1, 2) for i in range(4) if (chip, d) != (2, "b")]
    cands = spark.createDataFrame(rows, names)
    chips = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "x", "q"), (4, "y", "r")], "chip_id long, city string, block string")
    refs = spark.createDataFrame([(c, 10 * c + k, 9.0 * k + 1, 5.0 * c, 9.0 * k + 10, 5.0 * c + 9) for c in (1, 2, 4, 9) for k in range(3)], "chip_id long, ref_id long, x0 double, y0 double, x1 double, y1 double")
    configs = spark.createDataFrame([("c", [0, 1], 0.2, 30.0, 0.0)], selection.CONFIG)
    by = ["city", "block", "detector", "method", "config", "level_id", "level", "iou"]
    sums = ["matches", "predictions", "references", "removed", "chance_matches"]
    want = evaluation.evaluate(cands, refs, chips, configs, [0.25, 0.5], 60.0, 4).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])

    def moved(kept):
        return baseline.relocate_uniform(baseline.repeated(kept, 4), 60.0, ["chip_id", "level_id", "cand_id", "rep"])

    axis = cands.select("detector", "method", "level_id", "level").distinct().withColumn("config", F.lit("c"))
    scored = selection.scored(selection.clip(cands, 60.0), configs)
    got = evaluation.block_counts(scored, refs, chips, axis, evaluation.RUN, [0.25, 0.5], moved, 4)
    rounded = lambda df: sorted(tuple(r) for r in df.select(*by, *[F.round(c, 9) for c in sums]).collect())
    assert rounded(got) == rounded(want) and got.count() == 3 * 2 * 2 * 2 and got.agg(F.sum("chance_matches")).first()[0] > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", ["q_evaluate", "q_curve_rows"])
def test_counts_of_an_evaluation_are_made_once(spark, name):
    """What is pooled reads sums by block: not the line items, a time for each branch."""
    assert "lineitem.parquet" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_moved_boxes_stay_with_their_chip(spark):
    """No exchange between the boxes' repetitions and their counts."""
    box = "x0 double, y0 double, x1 double, y1 double"
    kept = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 5.0, 5.0)], f"chip_id long, level_id int, cand_id long, {box}").repartition(7, "chip_id")
    refs = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0)], f"chip_id long, ref_id long, {box}")
    rows = baseline.relocate_uniform(baseline.repeated(kept, 3), 5.0, ["chip_id", "cand_id", "rep"])
    plan = matching.matched_totals(matching.edges(rows, refs.hint("shuffle_hash")), [*plans.GROUP, "rep"], ["level_id"], 0.25)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text[text.index("MapInArrow") : text.index("explode(")] and plan.first().matches == 3


def test_boxes_put_on_references_stay_with_their_chip(spark):
    """No exchange between the boxes' repetitions and their counts, draws with more boxes than references included."""
    box = "x0 double, y0 double, x1 double, y1 double"
    kept = spark.createDataFrame([(1, 1, k, 0.0, 0.0, 5.0, 5.0) for k in range(3)], f"chip_id long, level_id int, cand_id long, {box}").repartition(7, "chip_id")
    refs = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0), (1, 2, 20.0, 0.0, 25.0, 5.0)], f"chip_id long, ref_id long, {box}")
    rows = baseline.relocate_to_refs(baseline.repeated(kept, 4), refs, [*plans.GROUP, "rep"], ["cand_id"])
    plan = matching.matched_totals(matching.edges(rows, refs.hint("shuffle_hash")), [*plans.GROUP, "rep"], ["level_id"], 0.25)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text[text.index("MapInArrow") : text.index("explode(")] and plan.first().matches == 8


def test_uniform_counts_sum_what_evaluate_counts(spark):
    """By block the same as chip by chip: of chips without boxes or references, boxes of no chip, boxes too large, references without a
    box, with an end that is not a number or twice there, names longer than a hash's block."""
    names = ["chip_id", "detector", "method", "level_id", "level", "cand_id", "x0", "y0", "x1", "y1", "scores"]
    far = 10**40  # as text
    rows = [(str(chip), d, "area", level, float(level), i, 9.0 * i, 5.0 * (chip % 7), 9.0 * i + 10 + 25 * (i == 3), 5.0 * (chip % 7) + 10, [0.1 + 0.2 * i, 0.5]) for chip in (1, 2, 3, 9, far) for d in "ab" for level in (1, 2) for i in range(4) if (chip, d) != (2, "b")]
    cands = spark.createDataFrame(rows, names)
    chips = spark.createDataFrame([("1", "x", "p"), ("2", "x", "p"), ("3", "x", "q"), ("4", "y", "r"), (str(far), "y", "s")], "chip_id string, city string, block string")
    spots = [(str(c), 10 * (c % 11) + k, 9.0 * k + 1, 5.0 * (c % 7), 9.0 * k + 10, 5.0 * (c % 7) + 9) for c in (1, 2, 4, 9, far) for k in range(3)]
    spots += [spots[0], ("1", 901, None, 0.0, 9.0, 9.0), ("1", 902, 0.0, 0.0, float("nan"), 9.0), ("2", 903, 9.0, 0.0, 3.0, 60.0)]
    refs = spark.createDataFrame(spots, "chip_id string, ref_id long, x0 double, y0 double, x1 double, y1 double")
    configs = spark.createDataFrame([("c", [0, 1], 0.2, 30.0, 0.0)], selection.CONFIG)
    by = ["city", "block", "detector", "method", "config", "level_id", "level", "iou"]
    sums = ["matches", "predictions", "references", "removed", "chance_matches"]
    want = evaluation.evaluate(cands, refs, chips, configs, [0.25, 0.5], 60.0, 4).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    axis = cands.select("detector", "method", "level_id", "level").distinct().withColumn("config", F.lit("c"))
    got = evaluation.uniform_counts(selection.scored(selection.clip(cands, 60.0), configs), refs, chips, axis, evaluation.RUN, [0.25, 0.5], 60.0, 4)
    rounded = lambda df: sorted(tuple(r) for r in df.select(*by, *[F.round(c, 9) for c in sums]).collect())
    assert rounded(got) == rounded(want) and got.count() == 4 * 2 * 2 * 2 and got.agg(F.sum("chance_matches"), F.sum("removed")).first()[0] > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", ["q_evaluate", "q_curve_rows"])
def test_an_evaluation_writes_no_table_of_boxes(spark, name, monkeypatch):
    """Line items are written once, as they are dealt out; what else is written is counts."""
    from aerolith.sources import tables

    written, cut = {}, tables.cut

    def counted(df, label):
        out = cut(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(tables, "cut", counted)
    QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert written.pop("joined") == items and written.pop("blocks") and "scored" not in written and sum(written.values()) < items, written


def test_texts_are_hashed_as_sql_does(spark):
    """Many endings of texts of all lengths, none and more than a block included; a part of an Arrow array too."""
    import pyarrow as pa

    texts = pa.array(["skipped", "", "1|2|3", "é" * 20, "x" * 50, "x" * 51, "x" * 52, "x" * 70, "1|2|4"])[1:]
    held = kernels.Texts(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(texts.buffers()[2], np.uint8))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts.to_pylist())], "k int, t string")
    for ending in ("|0|x", "|19|y"):
        want = [r.u for r in rows.select("k", boxes.hash_uniform(F.concat("t", F.lit(ending))).alias("u")).orderBy("k").collect()]
        assert held.uniform(ending.encode()).tolist() == want
