"""Queries over the views, one or more for each operator; registry.ORACLES has SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions import boxes
from aerolith.operators import baseline, bootstrap, curves, matching, metrics, raster, relational, sampling, selection, tuning
from aerolith.plans.registry import query
from aerolith.plans.views import EXTENT, Views, edged, matched

GROUP = ["chip_id", "level_id"]
#: Prompt sets by name, thresholds, sizes, areas: 300 settings.
PROMPTS = {"first": [0], "second": [1], "third": [2], "pair": [0, 1], "outer": [0, 2], "all": [0, 1, 2]}
THRESHOLDS, SIZES, AREAS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7], [10.0, 15.0, 20.0, 25.0, 30.0], [0.0]
#: The levels of the published sweep.
LEVELS = [0.3, 0.45, 0.6, 0.9, 1.2, 1.8, 2.4, 3.6, 5.0, 10.0]
N_BOOT, SEED, CHANCE_REPS, ORACLE_REPS = 2000, 7, 20, 10


def kept(v: Views) -> DataFrame:
    return selection.select_boxes(v.cands, v.setting(), EXTENT)


def edges(v: Views) -> DataFrame:
    return matching.edges(kept(v).select(*GROUP, "level", "cand_id", "x0", "y0", "x1", "y1"), v.refs)


def spine(v: Views) -> DataFrame:
    levels = v.cands.select("level_id", "level").distinct()
    return v.chips.crossJoin(F.broadcast(levels))  # seven levels


def pairs(v: Views, threshold: float = 0.25) -> DataFrame:
    return matching.matched_pairs(edges(v), GROUP, threshold)


def counts(v: Views) -> DataFrame:
    return matching.counts(spine(v), kept(v), v.refs, pairs(v), GROUP)


def curve(v: Views, keys: list[str]) -> DataFrame:
    return metrics.pooled(counts(v), [*keys, "level"]).withColumn("floor", F.lit(None).cast("double"))


def r9(*names: str):
    return [F.round(n, 9).alias(n) for n in names]


@query("select chip_id, level_id, cand_id, x0, y0, x1, y1 from kept")
def q_select_boxes(v):
    return kept(v).select(*GROUP, "cand_id", "x0", "y0", "x1", "y1")


@query("select level_id, count(*) filter (x1 - x0 <= 30 and y1 - y0 <= 30) as kept, count(*) filter (not (x1 - x0 <= 30 and y1 - y0 <= 30)) as removed from scored group by 1")
def q_removed_counts(v):
    return selection.removed(v.cands, v.setting(), EXTENT, ["level_id"])


@query("select chip_id, level_id, cand_id, ref_id, iou from edges")
def q_iou_edges(v):
    return edges(v).select(*GROUP, "cand_id", "ref_id", "iou")


@query("""select level_id, level, cast(sum(matches) as bigint) as matches, cast(sum(predictions) as bigint) as predictions, cast(sum("references") as bigint) as "references", round(sum(total_iou), 6) as total_iou,
round(100.0 * sum(matches)::double / nullif(sum(predictions), 0), 9) as "precision", round(100.0 * sum(matches)::double / nullif(sum("references"), 0), 9) as recall,
round(200.0 * sum(matches)::double / nullif(sum(predictions) + sum("references"), 0), 9) as f1 from counts group by 1, 2""")
def q_match_counts(v):
    rows = counts(v).groupBy("level_id", "level").agg(*[F.sum(c).alias(c) for c in ("matches", "predictions", "references")], F.round(F.sum("total_iou"), 6).alias("total_iou"))
    rows = rows.withColumns(metrics.prf(F.col("matches"), F.col("predictions"), F.col("references")))
    return rows.select("level_id", "level", "matches", "predictions", "references", "total_iou", *r9("precision", "recall", "f1"))


@query("select chip_id, level_id, cand_id, ref_id, iou from pairs")
def q_match_single_star(v):
    return matching.star_pairs(edges(v), GROUP, 0.25).select(*GROUP, "cand_id", "ref_id", "iou")


@query("""select level, cast(sum(matches) as bigint) as matches, cast(sum(predictions) as bigint) as predictions, cast(sum("references") as bigint) as "references",
round(100.0 * sum(matches)::double / nullif(sum(predictions), 0), 9) as "precision", round(100.0 * sum(matches)::double / nullif(sum("references"), 0), 9) as recall,
round(200.0 * sum(matches)::double / nullif(sum(predictions) + sum("references"), 0), 9) as f1 from counts group by 1""")
def q_pooled_prf(v):
    return metrics.pooled(counts(v), ["level"]).select("level", "matches", "predictions", "references", *r9("precision", "recall", "f1"))


_score = "case pr.name when 'first' then s0 when 'second' then s1 when 'third' then s2 when 'pair' then greatest(s0, s1) when 'outer' then greatest(s0, s2) else greatest(s0, s1, s2) end"
_values = lambda xs: ", ".join(f"({x})" for x in xs)
_grid = f""", grid as (select pr.name || '|t' || th.t::double::varchar || '|max' || mx.m::int::varchar || '|min0' as config, pr.name, th.t::double as t, mx.m::double as m
  from (values {_values([f"'{p}'" for p in PROMPTS])}) pr(name), (values {_values(THRESHOLDS)}) th(t), (values {_values(SIZES)}) mx(m)),
chosen as (select pr.config, c.* from clipped c join grid pr on {_score} >= pr.t and x1 - x0 <= pr.m and y1 - y0 <= pr.m) """
_tuned = _grid + ", alledges as materialized " + edged("clipped", "k.chip_id, k.level_id, k.level", 0.25) + """,
chosenedges as (select c.config, e.* from alledges e join chosen c on c.chip_id = e.chip_id and c.level_id = e.level_id and c.cand_id = e.cand_id),
""" + matched("tm", "chosenedges", ["config", "chip_id", "level_id"]) + """,
m2 as (select config, level, sum(n) as m from tm join levels using (level_id) group by 1, 2),
p2 as (select config, level, count(*) as p from chosen group by 1, 2),
tuned as materialized (select g.config, l.level, round(200.0 * coalesce(m2.m, 0)::double / nullif(coalesce(p2.p, 0) + (select count(*) from refs join chips using (chip_id)), 0), 9) as f1
  from grid g cross join levels l left join m2 on m2.config = g.config and m2.level = l.level left join p2 on p2.config = g.config and p2.level = l.level),
ranked as (select *, row_number() over (order by mean_f1 desc, config) as place from (select config, round(avg(f1), 9) as mean_f1 from tuned group by 1) t) """


def settings() -> list[tuple]:
    return selection.settings(PROMPTS, THRESHOLDS, SIZES, AREAS)


def tuned(v: Views) -> DataFrame:
    """config, level, f1 of the grid."""
    swept = tuning.sweep(v.cands, v.refs, settings(), EXTENT, ["level"], GROUP)
    references = v.refs.join(v.chips, "chip_id", "left_semi").agg(F.count("*").alias("references"))
    spine = v.cands.select("level").distinct().crossJoin(F.broadcast(selection.grid(v.spark, PROMPTS, THRESHOLDS, SIZES, AREAS).select("config")))  # levels, settings
    return tuning.table(swept, spine, references, ["level"]).select("config", "level", "f1")


@query(_grid + "select config, level_id, count(*) as kept from chosen group by 1, 2")
def q_grid_sweep(v):
    return tuning.kept_counts(v.cands, settings(), EXTENT, ["level_id"]).withColumnRenamed("predictions", "kept")


@query(_grid.replace("grid as", "grid as materialized") + "select config, chip_id, level_id, cand_id from chosen where config in ('pair|t0.2|max30|min0', 'all|t0.5|max15|min0')")
def q_grid_boxes(v):
    """Whole boxes of two settings at once: candidates crossed with settings."""
    wanted = [c for c in settings() if c[0] in ("pair|t0.2|max30|min0", "all|t0.5|max15|min0")]
    configs = v.spark.createDataFrame(wanted, selection.CONFIG).coalesce(1)
    return selection.select_boxes(v.cands, configs, EXTENT).select("config", *GROUP, "cand_id")


@query(_tuned + "select config, mean_f1 from ranked where place = 1")
def q_freeze_fixed(v):
    return tuning.best(tuned(v)).select("config", "mean_f1")


@query(_tuned + "select config, mean_f1, place from ranked where place between 2 and 5")
def q_runner_up(v):
    return tuning.runners_up(tuned(v)).select("config", "mean_f1", F.col("place").cast("long").alias("place"))


@query(_tuned + "select level, config, f1 from (select *, row_number() over (partition by level order by f1 desc nulls last, config) as rn from tuned) t where rn = 1")
def q_freeze_per_level(v):
    return tuning.best_by_level(tuned(v)).select("level", "config", "f1")


@query(_tuned + "select config, level, f1 from tuned where level = (select min(level) from tuned)")
def q_native_level(v):
    return tuning.at_finest(tuned(v)).select("config", "level", "f1")


_city = """, series as (select city, level, 200.0 * sum(matches)::double / nullif(sum(predictions) + sum("references"), 0) as f1 from counts group by 1, 2)"""


def _break_sql(reference: str, keys: str, source: str, name: str = "breaks", floor: str = "0::double") -> str:
    order = "f1 - floor desc nulls last, level" if reference == "peak" else "level"
    ks = [c.strip() for c in keys.split(",")]
    return f""", {name}_0 as (select *, row_number() over (partition by {keys} order by {order}) as rk from (select *, f1 - floor as above from (select *, {floor} as floor from {source}) f) g),
{name}_1 as (select *, max(case when rk = 1 then level end) over (partition by {keys}) as l0, max(case when rk = 1 then above end) over (partition by {keys}) as a0, max(case when rk = 1 then f1 end) over (partition by {keys}) as f0 from {name}_0),
{name}_2 as (select *, case when f0 > 0 and a0 > 0 then above / a0 end as s from {name}_1),
{name}_3 as (select *, lag(s) over (partition by {keys} order by level) as s0, lag(level) over (partition by {keys} order by level) as g0 from {name}_2),
{name}_4 as (select *, row_number() over (partition by {keys} order by level) as n from {name}_3 where level > l0 and s <= 0.5),
{name} as (select k.*, case when b.level is not null then pow(10.0::double, log10(g0) + (case when s0 = s then 0 else (s0 - 0.5::double) / nullif(s0 - s, 0) end) * (log10(b.level) - log10(g0))) end as break_point
  from (select distinct {keys} from {source}) k left join {name}_4 b on n = 1 and {' and '.join(f'k.{c} = b.{c}' for c in ks)}) """


@query(_city + _break_sql("peak", "city", "series") + "select city, round(break_point, 6) as break_point from breaks")
def q_break_point(v):
    return curves.break_point(curve(v, ["city"]), ["city"]).select("city", F.round("break_point", 6).alias("break_point"))


@query(_city + _break_sql("finest", "city", "series") + "select city, round(break_point, 6) as break_point from breaks")
def q_break_point_finest(v):
    return curves.break_point(curve(v, ["city"]), ["city"], reference="finest").select("city", F.round("break_point", 6).alias("break_point"))


@query(_city + """, p as (select *, row_number() over (partition by city order by f1 desc nulls last, level) as a, row_number() over (partition by city order by f1 - 9 * level desc nulls last, level) as b from series)
select city, max(case when a = 1 then level end) as peak_level, round(max(case when a = 1 then f1 end), 9) as peak_f1, max(case when b = 1 then level end) as peak_above_level from p group by 1""")
def q_peak_fields(v):
    rows = curves.peaks(curve(v, ["city"]).withColumn("floor", 9 * F.col("level")), ["city"])
    return rows.select("city", "peak_level", *r9("peak_f1"), "peak_above_level")


_sums = ', sums as (select block, level, sum(matches) as matches, sum(predictions) as predictions, sum("references") as refs from counts group by 1, 2)'


@query(_sums + 'select block, level, cast(matches as bigint) as matches, cast(predictions as bigint) as predictions, cast(refs as bigint) as "references" from sums')
def q_block_sums(v):
    return bootstrap.block_sums(counts(v), ["level"]).select("block", "level", "matches", "predictions", "references")


_reps = _sums + f""", blocks as (select block, row_number() over (order by block) - 1 as place, count(*) over () as n from (select distinct block from sums) t),
drawn as (select boot_id, (cast('0x' || substr(md5(boot_id::varchar || '|' || place::varchar), 1, 8) as bigint) % n) as pick, count(*) as times from blocks, range({N_BOOT}) t(boot_id) group by 1, 2),
reps as (select boot_id, level, 200.0 * sum(times * matches)::double / nullif(sum(times * (predictions + refs)), 0) as f1 from drawn join blocks on pick = place join sums using (block) group by 1, 2)"""


def replicates(v: Views) -> DataFrame:
    sums = bootstrap.block_sums(counts(v), ["level"])
    return bootstrap.replicates(sums, bootstrap.draws(v.chips, N_BOOT), ["level"])


@query(_reps + "select level, round(quantile_cont(f1, 0.025), 6) as lo, round(quantile_cont(f1, 0.975), 6) as hi from reps group by 1")
def q_bootstrap_ci(v):
    rows = bootstrap.interval(replicates(v), ["level"])
    return rows.select("level", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(_reps + _break_sql("peak", "boot_id", "reps") + "select round(quantile_cont(break_point, 0.025), 6) as lo, round(quantile_cont(break_point, 0.975), 6) as hi, count(break_point) / count(*)::double as found from breaks")
def q_bootstrap_break_ci(v):
    rows = curves.break_point(replicates(v).withColumn("floor", F.lit(None).cast("double")), ["boot_id"])
    out = bootstrap.interval(rows, [], "break_point")
    return out.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "found")


@query(_reps.replace(_sums, ", strict as (select * from edges where iou >= cast(0.5 as double)), " + matched("half", "strict", GROUP) + """,
sums as (select block, level, sum(matches) as matches, coalesce(sum(half.n), 0) as m5, sum(predictions) as predictions, sum("references") as refs from counts left join half using (chip_id, level_id) group by 1, 2)""").replace("as f1 from drawn", "as fa, 200.0 * sum(times * m5)::double / nullif(sum(times * (predictions + refs)), 0) as fb from drawn")
+ " select level, round(quantile_cont(fa - fb, 0.025), 6) as lo, round(quantile_cont(fa - fb, 0.975), 6) as hi from reps group by 1")
def q_paired_diff(v):
    """F1 at IoU 0.25 less F1 at 0.5 (matched again), on shared resamples."""
    strict = pairs(v, 0.5).groupBy(*GROUP).agg(F.count("*").alias("m5"))
    rows = counts(v).join(strict, GROUP, "left").fillna(0, ["m5"])
    sums = bootstrap.block_sums(rows, ["level"], [*bootstrap.COUNTS, "m5"])
    reps = bootstrap.paired(sums, bootstrap.draws(v.chips, N_BOOT), ["level"], bootstrap.COUNTS, ["m5", "predictions", "references"])
    out = bootstrap.interval(reps, ["level"], "diff")
    return out.select("level", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_u = "cast('0x' || substr(md5(chip_id::varchar || '|' || level_id::varchar || '|' || cand_id::varchar || '|' || rep::varchar || '|{}'), 1, 8) as bigint)::double / 4294967296.0::double"


@query(f""", m as (select *, {_u.format('x')} * greatest(0.0::double, 195.0::double - (x1 - x0)) as nx, {_u.format('y')} * greatest(0.0::double, 195.0::double - (y1 - y0)) as ny from kept, range(2) t(rep))
select chip_id, level_id, cand_id, cast(rep as int) as rep, round(nx, 6) as x0, round(ny, 6) as y0, round(nx + (x1 - x0), 6) as x1, round(ny + (y1 - y0), 6) as y1 from m""")
def q_chance_uniform(v):
    rows = baseline.relocate_uniform(baseline.repeated(kept(v), 2), EXTENT, [*GROUP, "cand_id", "rep"])
    return rows.select(*GROUP, "cand_id", "rep", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""
, spots as (select chip_id, row_number() over (partition by chip_id order by md5(chip_id::varchar || '|' || ref_id::varchar), ref_id) as spot, count(*) over (partition by chip_id) as n, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from refs),
b as (select k.*, md5(chip_id::varchar || '|' || level_id::varchar || '|' || cand_id::varchar) as draw from kept k),
o as (select b.*, s.n, row_number() over (partition by b.chip_id, level_id order by draw, cand_id) as i from b join (select distinct chip_id, n from spots) s on s.chip_id = b.chip_id),
p as (select *, case when i <= n then i else cast('0x' || substr(draw, 1, 8) as bigint) % n + 1 end as spot from o)
select p.chip_id, level_id, cand_id, round(cx - (x1 - x0) / 2, 6) as x0, round(cy - (y1 - y0) / 2, 6) as y0, round(cx - (x1 - x0) / 2 + (x1 - x0), 6) as x1, round(cy - (y1 - y0) / 2 + (y1 - y0), 6) as y1
from p join spots s on s.chip_id = p.chip_id and s.spot = p.spot""")
def q_oracle_relocate(v):
    rows = baseline.relocate_to_refs(kept(v), v.refs, GROUP, ["cand_id"])
    return rows.select(*GROUP, "cand_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


_box = "greatest(0::double, least({}, 195::double)) as {}"
_chance = f""", moved as (select chip_id, level_id, level, cand_id, rep, {', '.join(_box.format(e, n) for e, n in (('nx', 'x0'), ('ny', 'y0'), ('nx + w', 'x1'), ('ny + h', 'y1')))}
  from (select *, x1 - x0 as w, y1 - y0 as h, {_u.format('x')} * greatest(0.0::double, 195.0::double - (x1 - x0)) as nx, {_u.format('y')} * greatest(0.0::double, 195.0::double - (y1 - y0)) as ny from kept, range({CHANCE_REPS}) t(rep)) q),
movededges as """ + edged("moved", "k.chip_id, k.level_id, k.rep", 0.25) + ", " + matched("cm", "movededges", [*GROUP, "rep"]) + f""",
chance as (select l.level, coalesce(sum(n), 0) / {CHANCE_REPS}.0::double as chance_matches from levels l left join cm using (level_id) group by 1) """


def _null_matches(v: Views, moved: DataFrame, n_rep: int) -> DataFrame:
    rows = selection.clip(moved, EXTENT).select(*GROUP, "rep", "cand_id", "x0", "y0", "x1", "y1")
    found = matching.matched_pairs(matching.edges(rows, v.refs), [*GROUP, "rep"], 0.25)
    return baseline.chance_matches(found, spine(v), GROUP, n_rep)


def chance(v: Views) -> DataFrame:
    moved = baseline.relocate_uniform(baseline.repeated(kept(v), CHANCE_REPS), EXTENT, [*GROUP, "cand_id", "rep"])
    return _null_matches(v, moved, CHANCE_REPS)


def by_level(found: DataFrame) -> DataFrame:
    return found.groupBy("level").agg(F.round(F.sum("chance_matches"), 6).alias("chance_matches"))


@query(_chance + "select level, round(chance_matches, 6) as chance_matches from chance")
def q_chance_matches(v):
    """Mean matches of evenly relocated boxes."""
    return by_level(chance(v))


@query(_reps + _chance + """, c as (select level, 200.0 * any_value(chance_matches) / nullif(sum(predictions) + sum("references"), 0) as chance_f1 from counts join chance using (level) group by 1)
select c.level, round(chance_f1, 6) as chance_f1, coalesce(q.lo > c.chance_f1, false) as above_chance from c left join (select level, quantile_cont(f1, 0.025) as lo from reps group by 1) q on q.level = c.level""")
def q_above_chance(v):
    rows = counts(v).join(chance(v).select(*GROUP, "chance_matches"), GROUP)
    floor = metrics.pooled(rows, ["level"], "chance_matches").select("level", "chance_f1")
    return curves.above_chance(replicates(v), floor, ["level"]).join(floor, "level").select("level", F.round("chance_f1", 6).alias("chance_f1"), "above_chance")


def _oracle_sql(group: str, reps: int, kept: str = "kept") -> str:
    """SQL of boxes put on references as baseline.relocate_to_refs puts them; group: what the boxes of a draw share."""
    text = " || '|' || ".join(f"{c.strip()}::varchar" for c in f"{group}, cand_id".split(","))
    return f""", spots as (select chip_id, row_number() over (partition by chip_id order by md5(chip_id::varchar || '|' || ref_id::varchar), ref_id) as spot, count(*) over (partition by chip_id) as spots, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy from refs),
drawnboxes as (select *, md5({text}) as draw from (select {kept}.*, rep from {kept}, range({reps}) t(rep)) k),
placed as (select b.*, s.spots, row_number() over (partition by {', '.join('b.' + c.strip() for c in group.split(','))} order by draw, cand_id) as i from drawnboxes b join (select distinct chip_id, spots from spots) s on s.chip_id = b.chip_id),
spotted as (select *, case when i <= spots then i else cast('0x' || substr(draw, 1, 8) as bigint) % spots + 1 end as spot from placed),
onrefs as (select p.* exclude (x0, y0, x1, y1), {', '.join(_box.format(e, n) for e, n in (('cx - (x1 - x0) / 2', 'x0'), ('cy - (y1 - y0) / 2', 'y0'), ('cx - (x1 - x0) / 2 + (x1 - x0)', 'x1'), ('cy - (y1 - y0) / 2 + (y1 - y0)', 'y1')))}
  from spotted p join spots s on s.chip_id = p.chip_id and s.spot = p.spot),
oracleboxes as (select * from onrefs where x1 > x0 and y1 > y0) """


@query(_oracle_sql("chip_id, level_id, rep", ORACLE_REPS) + ", oe as " + edged("oracleboxes", "k.chip_id, k.level_id, k.rep", 0.25) + ", " + matched("om", "oe", [*GROUP, "rep"])
+ f" select l.level, round(coalesce(sum(n), 0) / {ORACLE_REPS}.0::double, 6) as chance_matches from levels l left join om using (level_id) group by 1")
def q_oracle_matches(v):
    """The same of boxes centred on references."""
    moved = baseline.relocate_to_refs(baseline.repeated(kept(v), ORACLE_REPS), v.refs, [*GROUP, "rep"], ["cand_id"])
    return by_level(_null_matches(v, moved, ORACLE_REPS))


_crc = """, bit8 as (select i, c, 0 as step from (select i, i::ubigint as c from range(256) t(i)) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, step + 1 from bit8 where step < 8),
crc as (select list(c order by i) as tab from bit8 where step = 8) """
_crc32 = "cast(xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({0}, ''), lambda ch: ord(ch)::ubigint)), lambda acc, b: xor(acc >> 8, tab[cast(xor(acc, b) & 255 as bigint) + 1])), 4294967295::ubigint) as bigint)"


@query(_crc + f", s as (select chip_id, level, 'colour' as detector, chip_id::varchar || '|' || level::varchar as stem from chips cross join levels) select chip_id, level, {_crc32.format("stem || '|0.25'")} as seed, {_crc32.format("stem || '|colour'")} as oracle_seed from s, crc")
def q_seeds(v):
    """The published seeds of relocations: crc32 of chip, level and IoU, and for the oracle of chip, level and detector."""
    part = lambda *last: baseline.seed(F.col("chip_id").cast("string"), F.col("level").cast("string"), *map(F.lit, last))
    return spine(v).select("chip_id", "level", part("0.25").alias("seed"), part("colour").alias("oracle_seed"))


@query(f"""
, blocks as (select city, block, count(*) over (partition by city) as n, row_number() over (partition by city order by md5('{SEED}|' || city || '|' || block), block) as place from (select distinct city, block from chips) t)
select chip_id, city, block, case when place <= case when n > 1 then least(greatest(cast(round_even(n * 0.3, 0) as bigint), 1), n - 1) else cast(round_even(n * 0.3, 0) as bigint) end then 'dev' else 'test' end as split
from chips join blocks using (city, block)""")
def q_block_split(v):
    return sampling.block_split(v.chips, 0.3, SEED).select("chip_id", "city", "block", "split")


@query(f"select chip_id from chips order by md5('{SEED}|' || chip_id::varchar), chip_id limit 100")
def q_subsample(v):
    return sampling.subsample(v.chips, 100, SEED).select("chip_id")


@query("select chip_id, ref_id, 'c:' || cast(floor(x0 / 40.0::double) as bigint)::varchar || ':' || cast(floor((y0 - 75) / 40.0::double) as bigint)::varchar as block from refs")
def q_block_key(v):
    return v.refs.select("chip_id", "ref_id", boxes.block_key(F.lit("c"), F.col("x0"), F.col("y0") - 75, 40.0).alias("block"))


_sized = ", sized as (select chip_id, sqrt((x1 - x0) * (y1 - y0)) as side, (x1 - x0) * (y1 - y0) as area from refs), med as (select chip_id, quantile_cont(side, 0.5) as side from sized group by 1 having count(*) >= 5)"


def sided(v: Views) -> DataFrame:
    return v.refs.withColumn("area", boxes.area(*boxes.box())).withColumn("side", F.sqrt("area"))


def chip_sizes(v: Views) -> DataFrame:
    """The median side of chips with five references or more."""
    return sided(v).groupBy("chip_id").agg(F.percentile("side", F.lit(0.5)).alias("side"), F.count("*").alias("n")).where("n >= 5")


_terciles = _sized + ", cuts as (select quantile_cont(side, 1/3.0::double) as a, quantile_cont(side, 2/3.0::double) as b from med), grouped as (select chip_id, side, case when side <= a then 'small' when side <= b then 'medium' else 'large' end as size_group from med, cuts)"


@query(_terciles + " select size_group, count(*) as chips, round(quantile_cont(side, 0.5), 9) as median_side from grouped group by 1")
def q_size_terciles(v):
    rows = sampling.terciles(chip_sizes(v), "side")
    return rows.groupBy("size_group").agg(F.count("*").alias("chips"), F.round(F.percentile("side", F.lit(0.5)), 9).alias("median_side"))


@query(_terciles + """ select size_group, level, round(200.0 * sum(matches)::double / nullif(sum(predictions) + sum("references"), 0), 9) as f1, count(distinct chip_id) as chips from counts join grouped using (chip_id) group by 1, 2""")
def q_size_curves(v):
    rows = counts(v).join(sampling.terciles(chip_sizes(v), "side").select("chip_id", "size_group"), "chip_id")
    n = rows.groupBy("size_group", "level").agg(F.count_distinct("chip_id").alias("chips"))
    return metrics.pooled(rows, ["size_group", "level"]).join(n, ["size_group", "level"]).select("size_group", "level", *r9("f1"), "chips")


@query(_sized + """ select city, count(area) as buildings, count(*) filter (area is null) as empty_chips, round(quantile_cont(side, 0.25), 9) as p25, round(quantile_cont(side, 0.5), 9) as median, round(quantile_cont(side, 0.75), 9) as p75,
round(avg(case when side < 12 then 1.0::double when side is not null then 0.0::double end), 9) as share_small from chips left join sized using (chip_id) group by 1""")
def q_city_sizes(v):
    rows = relational.size_stats(sided(v), v.chips, ["city"], 12.0)
    return rows.select("city", "buildings", "empty_chips", *r9("p25", "median", "p75", "share_small"))


@query(_city + """ select city, round(max(case when level = 0.9 then f1 end), 9) as f1_0_9, round(max(case when level = 2.4 then f1 end), 9) as f1_2_4, round(max(case when level = 5.0 then f1 end), 9) as f1_5_0 from series group by 1""")
def q_per_city_curve(v):
    rows = curve(v, ["city"])
    at = lambda x: F.round(F.max(F.when(F.col("level") == x, F.col("f1"))), 9)
    return rows.groupBy("city").agg(at(0.9).alias("f1_0_9"), at(2.4).alias("f1_2_4"), at(5.0).alias("f1_5_0"))


@query(_sized + """, p as (select level_id, count(*) as predictions, round(quantile_cont((x1 - x0) * (y1 - y0), 0.5), 6) as median_predicted from kept group by 1)
select level_id, predictions, median_predicted, cast(sum(n) as bigint) as matched, (select round(quantile_cont(area, 0.5), 6) from sized) as median_all, (select round(avg(area), 6) from sized) as mean_all,
(select round(avg(case when area > 300 then 1.0::double else 0.0::double end), 9) from sized) as large_all from p join found using (level_id) group by all""")
def q_coarse_sizes(v):
    """At each level predictions, their median area and matches; areas of all references."""
    own = kept(v).withColumn("area", boxes.area(*boxes.box())).groupBy("level_id").agg(F.count("*").alias("predictions"), F.round(F.percentile("area", F.lit(0.5)), 6).alias("median_predicted"))
    hit = pairs(v).groupBy("level_id").agg(F.count("*").alias("matched"))
    large = F.avg((F.col("area") > 300).cast("double"))
    everything = sided(v).agg(F.round(F.percentile("area", F.lit(0.5)), 6).alias("median_all"), F.round(F.avg("area"), 6).alias("mean_all"), F.round(large, 9).alias("large_all"))
    return own.join(hit, "level_id").crossJoin(F.broadcast(everything))  # one row


@query()
def q_coarse_diag(v):
    """Sizes of the references that are matched at each level (which of two equally good matchings is taken is no matter of SQL; tests hold the pairs against brute force)."""
    rows = pairs(v).join(sided(v).select("chip_id", "ref_id", "area"), ["chip_id", "ref_id"])
    big = F.avg((F.col("area") > 300).cast("double"))
    return rows.groupBy("level_id").agg(F.count("*").alias("matched"), F.round(F.percentile("area", F.lit(0.5)), 6).alias("median_area"), F.round(F.avg("area"), 6).alias("mean_area"), F.round(big, 9).alias("share_large"))


_SCENES = """select event_id as scene_id, value as cloud, event_type <> 'error' as sound, cast((event_id*37)%180 as double) as x0, cast((event_id*53)%180 as double) as y0,
cast((event_id*37)%180 + 12 + event_id%9 as double) as x1, cast((event_id*53)%180 + 12 + event_id%7 as double) as y1 from {events}"""
_PLACES = """select c_custkey as chip_id, cast((c_custkey*31)%190 as double) as x0, cast((c_custkey*17)%190 as double) as y0, cast((c_custkey*31)%190 + 6 as double) as x1, cast((c_custkey*17)%190 + 6 as double) as y1 from {customer}"""
_scene = "--\nwith scenes as (" + _SCENES.format(events="events") + "), places as (" + _PLACES.format(customer="customer") + """),
found as (select chip_id, scene_id, row_number() over (partition by chip_id order by cloud, scene_id) as n from places p join scenes s on s.sound and s.x0 <= p.x0 and s.y0 <= p.y0 and s.x1 >= p.x1 and s.y1 >= p.y1),
chosen as (select p.chip_id, case when f.scene_id is null then 'none' else 'ok' end as status, f.scene_id as scene from places p left join found f on f.chip_id = p.chip_id and n = 1) """


def scenes(v: Views) -> DataFrame:
    s = v.spark.sql(_SCENES, events=v.table("events"))
    return sampling.first_scene(v.spark.sql(_PLACES, customer=v.table("customer")), s, 30.0)


@query(_scene + "select * from chosen")
def q_first_scene(v):
    return scenes(v)


@query(_scene + "select status, count(*) as n from chosen group by 1")
def q_status_hist(v):
    return scenes(v).groupBy("status").agg(F.count("*").alias("n"))


@query("select city, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from refs join chips using (chip_id) group by 1")
def q_bounds(v):
    return relational.bounds(v.refs.join(v.chips, "chip_id"), ["city"])


@query("""--
with i as (select regexp_extract(p, '(img[0-9]+)', 1) as key, max(p) as image_path from (select 'rgb/img' || doc_id::varchar || '.tif' as p from documents) t group by 1),
l as (select regexp_extract(p, '(img[0-9]+)', 1) as key, max(p) as label_path from (select 'json/img' || doc_id::varchar || '.geojson' as p from labels) t group by 1)
select key, image_path, label_path from i join l using (key)""")
def q_index_join(v):
    path = lambda t, a, b: v.table(t).select(F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b)).alias("path"))
    return relational.paired_files(path("documents", "rgb/img", ".tif"), path("labels", "json/img", ".geojson"))


@query("""--
select doc_id, 'old' as origin from labels union all select d.doc_id, 'new' from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def q_anti_append(v):
    old, new = (v.table(t).select("doc_id", F.lit(o).alias("origin")) for t, o in (("labels", "old"), ("documents", "new")))
    return relational.append_new(old, new, ["doc_id"])


@query("""--
select doc_id, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def q_semi_existing(v):
    return relational.existing(v.table("documents").select("doc_id", "source"), v.table("labels"), ["doc_id"])


@query("""--
select label, round_even(quantile_cont(v, 0.995) / 50, 0) * 50 as scale from (select label, abs(unnest(embedding))::double * 1000 as v from embeddings) t group by 1""")
def q_brightness_scale(v):
    pixels = v.table("embeddings").select("label", F.explode("embedding").alias("e")).select("label", (F.abs("e").cast("double") * 1000).alias("v"))
    return sampling.brightness_scale(pixels, ["label"], "v")


@query("""--
select event_id, cast(least(255, greatest(0, round_even(value * 255 / 80.0::double, 0))) as int) as pixel from events""")
def q_uint8_scale(v):
    return v.table("events").select("event_id", boxes.to_uint8(F.col("value"), F.lit(80.0)).alias("pixel"))


@query("""--
select c_custkey as chip_id, level, cast(greatest(1, floor((400 + c_custkey % 300) * 0.3::double / level + 0.5::double + 1e-9::double)) as bigint) as size,
round((400 + c_custkey % 300) * 0.3::double / greatest(1, floor((400 + c_custkey % 300) * 0.3::double / level + 0.5::double + 1e-9::double)), 9) as gsd
from customer, (select unnest([0.3, 0.45, 0.6, 0.9, 1.2, 1.8, 2.4, 3.6, 5.0, 10.0])::double as level) t""")
def q_target_size(v):
    rows = v.table("customer").select(F.col("c_custkey").alias("chip_id"), (400 + F.col("c_custkey") % 300).alias("px"), F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("level"))
    size = boxes.target_size(F.col("px"), 0.3, F.col("level"))
    return rows.select("chip_id", "level", size.alias("size"), F.round(boxes.effective_gsd(F.col("px"), 0.3, size), 9).alias("gsd"))


_PIXELS = "select l_orderkey as pixel_id, cast(l_quantity * 5 as int) as r, cast(l_partkey % 256 as int) as g, cast(l_suppkey % 256 as int) as b from {lineitem}"


@query("--\nselect pixel_id, r, g, b from (" + _PIXELS.format(lineitem="lineitem") + ") t where r > 120 and r - g > 25 and r - b > 25")
def q_colour_mask(v):
    return raster.colour_pixels(v.spark.sql(_PIXELS, lineitem=v.table("lineitem")), 120, 25, 25)


def images(v: Views) -> DataFrame:
    """Each vector as an 8 by 8 image: its parts as red, green and blue both none."""
    red = F.transform("embedding", lambda e: F.when(e > 0, F.lit("ff0000")).otherwise(F.lit("000000")))
    rows = v.table("embeddings").where(F.size("embedding") == 64)
    return rows.select(F.col("vec_id").alias("chip_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("bands"), F.unhex(F.array_join(red, "")).alias("pixels"))


@query()
def q_components(v):
    """Connected components of a colour mask; tests hold the kernel against known shapes."""
    return raster.detected(images(v), raster.colour_rule(120, 25, 25)).drop("score")


@query()
def q_degrade(v):
    """Images as coarser sensors see them; tests hold the kernel's invariants."""
    return raster.degraded(images(v), 0.3, [0.3, 0.6, 1.2], ["area", "blur_resize"])
