"""Queries of single operators: keys and slices, geometry, images, comparison of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions import boxes
from aerolith.operators import evaluation, matching, raster, relational, sampling, selection
from aerolith.plans import queries as Q
from aerolith.plans.registry import query
from aerolith.sources import readers

_split = f"""
, blocks as (select city, block, count(*) over (partition by city) as n, row_number() over (partition by city order by md5('{Q.SEED}|' || city || '|' || block), block) as place from (select distinct city, block from chips) t),
dealt as (select chip_id, city, block, case when place <= case when n > 1 then least(greatest(cast(round_even(n * 0.3, 0) as bigint), 1), n - 1) else cast(round_even(n * 0.3, 0) as bigint) end then 'dev' else 'test' end as split from chips join blocks using (city, block)) """


@query(_split + "select chip_id, city from dealt where split = 'test' and city in ('ASIA', 'EUROPE') order by chip_id limit 200")
def q_in_split(v):
    """The first chips of a split and some cities."""
    return selection.in_split(sampling.block_split(v.chips, 0.3, Q.SEED), "test", ["ASIA", "EUROPE"], 200).select("chip_id", "city")


@query("select level, cast(sum(matches) as bigint) as matches from counts where city = 'ASIA' and level_id = 3 group by 1")
def q_counts_slice(v):
    return selection.counts_of(Q.counts(v), city="ASIA", level_id=3).groupBy("level").agg(F.sum("matches").alias("matches"))


@query("select chip_id from refs union select chip_id from chips")
def q_all_keys(v):
    return relational.all_keys(["chip_id"], v.refs, v.chips)


@query("select chip_id from refs intersect select chip_id from chips")
def q_common_keys(v):
    return relational.common_keys(["chip_id"], v.refs, v.chips)


@query("select chip_id, level_id, matches from counts")
def q_complete_grid(v):
    """Counts of a grid that is known to be whole."""
    return evaluation.complete_grid(Q.counts(v).select("chip_id", "level_id", "matches"), "chip_id", ["level_id"])


@query("select c.level, c.matches, c.predictions from (select level, cast(sum(matches) as bigint) as matches, cast(sum(predictions) as bigint) as predictions from counts group by 1) c order by level desc limit 4")
def q_sorted_limit(v):
    rows = Q.counts(v).groupBy("level").agg(F.sum("matches").alias("matches"), F.sum("predictions").alias("predictions"))
    return rows.orderBy(F.desc("level")).limit(4)


_affine = "struct_pack(a := 0.3::double, b := 0::double, c := 100.0 + c_custkey, d := 0::double, e := -0.3::double, f := 900.0 - c_nationkey)"


def affine():
    zero = F.lit(0.0)
    return F.struct(F.lit(0.3).alias("a"), zero.alias("b"), (100.0 + F.col("c_custkey")).alias("c"), zero.alias("d"), F.lit(-0.3).alias("e"), (900.0 - F.col("c_nationkey")).alias("f"))


@query("""--
select c_custkey as chip_id, round(0.3::double * (400 + c_custkey % 300) / 2 + 100.0::double + c_custkey, 6) as x, round(-0.3::double * (400 + c_custkey % 200) / 2 + 900.0::double - c_nationkey, 6) as y from customer""")
def q_centre(v):
    """Chips' centres in world units."""
    x, y = boxes.centre(affine(), 400 + F.col("c_custkey") % 300, 400 + F.col("c_custkey") % 200)
    return v.table("customer").select(F.col("c_custkey").alias("chip_id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""--
select c_custkey as chip_id, round(0.3::double * 10 + 100.0::double + c_custkey, 6) as x0, round(900.0::double - c_nationkey - 0.3::double * (25 + c_custkey % 7), 6) as y0, round(0.3::double * (30 + c_custkey % 5) + 100.0::double + c_custkey, 6) as x1, round(900.0::double - c_nationkey - 0.3::double * 20, 6) as y1 from customer""")
def q_world_boxes(v):
    """Pixel boxes in world units, corners in order."""
    parts = boxes.to_world(affine(), F.lit(10.0), F.lit(20.0), (30 + F.col("c_custkey") % 5).cast("double"), (25 + F.col("c_custkey") % 7).cast("double"))
    return v.table("customer").select(F.col("c_custkey").alias("chip_id"), *[F.round(p, 6).alias(n) for p, n in zip(parts, ("x0", "y0", "x1", "y1"), strict=True)])


_cx = "(0.1::double + event_id % 80 / 100.0::double)"


@query(f"""--
select event_id, round(({_cx} - 0.05::double) * 650, 6) as x0, round((0.5::double - 0.1::double) * 400, 6) as y0, round(({_cx} + 0.05::double) * 650, 6) as x1, round((0.5::double + 0.1::double) * 400, 6) as y1, round((0.5::double - 0.1::double) * 650, 6) as padded_y0,
round(1.0::double / (1.0::double + exp(-(value - 40.0::double) / 10.0::double)), 9) as score from events""")
def q_decoded(v):
    """Boxes of a detector's raw output: shares of the image by centre and size, scores as logits."""
    cx = F.lit(0.1) + F.col("event_id") % 80 / 100.0
    at = lambda padded: boxes.decoded(cx, F.lit(0.5), F.lit(0.1), F.lit(0.2), F.lit(650.0), F.lit(400.0), padded)
    score = boxes.sigmoid((F.col("value") - 40.0) / 10.0)
    return v.table("events").select("event_id", *[F.round(c, 6).alias(n) for c, n in zip(at(False), ("x0", "y0", "x1", "y1"), strict=True)], F.round(at(True)[1], 6).alias("padded_y0"), F.round(score, 9).alias("score"))


def holed(v):
    """The references as polygons with a hole: a box of 2 by 3 metres, 1 metre from the lower corner."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = lambda x0, y0, x1, y1: F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))
    x0, y0, x1, y1 = boxes.box()
    rows = v.refs.withColumn("rings", F.array(ring(x0, y0, x1, y1), ring(x0 + 1, y0 + 1, x0 + 3, y0 + 4)))
    return rows.withColumn("area", boxes.area(*boxes.box()) - 6)


@query("""select chip_id, ref_id, round(((x1 - x0) * (y1 - y0) * (x0 + x1) / 2 - 6.0::double * (x0 + 2)) / ((x1 - x0) * (y1 - y0) - 6), 6) as x, round(((x1 - x0) * (y1 - y0) * (y0 + y1) / 2 - 6.0::double * (y0 + 2.5::double)) / ((x1 - x0) * (y1 - y0) - 6), 6) as y, true as sound from refs""")
def q_centroid(v):
    """Area centroids of polygons with holes, and whether their exterior can be a polygon's."""
    x, y = boxes.polygon_centroid(F.col("rings"))
    return holed(v).select("chip_id", "ref_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), boxes.sound_ring(F.col("rings")[0]).alias("sound"))


_over = lambda ax0, ay0, ax1, ay1: f"greatest(0, least(k.x1, {ax1}) - greatest(k.x0, {ax0})) * greatest(0, least(k.y1, {ay1}) - greatest(k.y0, {ay0}))"


@query(f""", cut as (select k.chip_id, k.level_id, k.cand_id, r.ref_id, (k.x1 - k.x0) * (k.y1 - k.y0) as a, (r.x1 - r.x0) * (r.y1 - r.y0) - 6 as b, {_over('r.x0', 'r.y0', 'r.x1', 'r.y1')} - {_over('r.x0 + 1', 'r.y0 + 1', 'r.x0 + 3', 'r.y0 + 4')} as common
from kept k join refs r on k.chip_id = r.chip_id and k.x0 < r.x1 and r.x0 < k.x1 and k.y0 < r.y1 and r.y0 < k.y1 where k.level_id = 3)
select chip_id, cand_id, ref_id, round(common / (a + b - common), 9) as iou from cut where round(common / (a + b - common), 9) > 0""")
def q_polygon_iou(v):
    """IoU of boxes with polygons that have holes."""
    rows = matching.polygon_edges(Q.kept(v).where("level_id = 3").select("chip_id", "cand_id", "x0", "y0", "x1", "y1"), holed(v))
    return rows.select("chip_id", "cand_id", "ref_id", F.round("iou", 9).alias("iou")).where("iou > 0")


@query("""--
select event_id as id, cast(value as double) as cloud from (select event_id, value, cast((event_id*37)%180 as double) as x0, cast((event_id*53)%180 as double) as y0, strftime(ts, '%Y-%m-%d') as day from events) t
where x0 <= 90 and x0 + 15 >= 20 and y0 <= 120 and y0 + 15 >= 30 and value < 40 order by value, event_id limit 60""")
def q_scene_search(v):
    """The least cloudy items of a catalogue that meet a place."""
    items = v.table("events").select(F.col("event_id").alias("id"), ((F.col("event_id") * 37) % 180).cast("double").alias("x0"), ((F.col("event_id") * 53) % 180).cast("double").alias("y0"), F.col("value").cast("double").alias("cloud"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    items = items.withColumns({"x1": F.col("x0") + 15, "y1": F.col("y0") + 15})
    return relational.scene_search(items, (20, 30, 90, 120), "0000-01-01", "9999-12-31", 40.0).select("id", "cloud")


_TWICE = "select level, f1 as a, f1 + case when level > 1 then 0.4::double else 0.0005::double end as b from curve"


@query(f", twice as ({_TWICE}) select level, 'f1' as \"column\", round(a, 9) as a, round(b, 9) as b from twice where abs(a - b) > 0.001")
def q_compared(v):
    """Values of two tables that differ by more than a tolerance."""
    ours = Q.curve(v, []).select("level", "f1")
    theirs = ours.withColumn("f1", F.col("f1") + F.when(F.col("level") > 1, 0.4).otherwise(0.0005))
    return evaluation.compared(ours, theirs, ["level"], {"f1": 0.001}).select("level", "column", *Q.r9("a", "b"))


@query("""select count(*) as "groups", count(*) filter (coalesce(s.n, 0) = matches) as matches_equal, max(abs(coalesce(s.n, 0) - matches)) as matches_largest
from counts left join (select chip_id, level_id, count(*) as n from pairs group by all) s using (chip_id, level_id)""")
def q_agreement(v):
    """Two matchers side by side: optimal, and only the components in which a box touches all others."""
    stars = matching.star_pairs(Q.edges(v), Q.GROUP, 0.25)
    theirs = matching.counts(Q.spine(v), Q.kept(v), v.refs, stars, Q.GROUP)
    return evaluation.agreement(Q.counts(v), theirs, Q.GROUP, ["matches"])


@query("""--
select c_custkey as chip_id, round(c_acctbal - 1, 6) as lo, round(c_acctbal + 1, 6) as hi from customer where c_custkey % 3 <> 0 union all select c_custkey, null, null from customer where c_custkey % 3 = 0""")
def q_interval_cells(v):
    """Intervals that a CSV's cells hold as JSON, some of them empty."""
    text = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("["), (F.col("c_acctbal") - 1).cast("string"), F.lit(", "), (F.col("c_acctbal") + 1).cast("string"), F.lit("]")))
    cell = readers.interval_cell(text)
    return v.table("customer").select(F.col("c_custkey").alias("chip_id"), F.round(cell[0], 6).alias("lo"), F.round(cell[1], 6).alias("hi"))


@query("""--
select c_custkey as chip_id, c_custkey % 11 not in (0, 1, 3, 8, 9, 10) and c_nationkey % 11 not in (0, 1, 3, 8, 9, 10) as clear, c_custkey % 11 not in (0, 1, 3, 8, 9, 10) and c_nationkey % 11 not in (0, 1, 3, 8, 9, 10) and c_nationkey <> 0 as usable from customer""")
def q_clear(v):
    """Crops without a class that hides the ground, and without empty pixels."""
    classes = F.array((F.col("c_custkey") % 11).cast("int"), (F.col("c_nationkey") % 11).cast("int"))
    pixels = F.array(F.array(F.col("c_nationkey"), F.col("c_nationkey")), F.array(F.lit(1), F.lit(1)).cast(f"array<{v.table('customer').schema['c_nationkey'].dataType.simpleString()}>"))
    return v.table("customer").select(F.col("c_custkey").alias("chip_id"), raster.clear(classes).alias("clear"), raster.usable(classes, pixels).alias("usable"))


@query()
def q_cache(v):
    """Every image degraded by two methods to three levels and searched by two detectors; tests hold it against the steps one by one."""
    detectors = {"colour-a": raster.colour_rule(120, 25, 25), "colour-b": raster.colour_rule(60, 15, 15, eight=True)}
    return raster.cached(Q.images(v), detectors, 0.3, [0.3, 0.6, 1.2], ["area", "blur_resize"])


@query()
def q_upsampled(v):
    """Images of a coarse sensor at the size of fine ones; tests hold the kernel's invariants."""
    return raster.upsampled(Q.images(v), 20, 20)
