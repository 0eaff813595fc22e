"""Mixing sources to target weights along a time-varying curriculum (operator 5); DataFrame functions only.

Targets: the corpus' words are shared out by weight (1, 2, 3, 1, ... for sources by code point, null last). A source gets at
most EPOCHS times its words; what is over goes to the others by weight, until none is above. In closed form, a source
is at its limit if, with all sources of a smaller limit per weight at theirs, its share of the rest would reach it.

Curriculum: over training time u in [0, 1] a source's rate follows its schedule, a line through rates at equally spaced
knots, given by source or by weight class (SCHEDULES: light sources early, heavy ones late). The integral up to u, as a
share of the whole and times the target, is the source's cumulative demand: a quadratic in each stretch between knots. A
source's documents, in the order of their ids' MD5, make a stream of words, run through as often as the target
asks; inverting the demand at a copy's first word gives the copy's training position, and copies are range-sorted by
it. The last document of a source's last pass is cut where the target is met.

Prefix sums go by buckets of the MD5 within each source (4096, and 16 times as many for each 16 times LARGE rows), so a
source with most of the rows is no single task.
A null text has size 0. Rows that repeat a doc_id are documents of their own, in the order of their texts' hashes; equal rows are
alike, so it is no matter which is cut. Sources without words have target 0. Null ids go by the MD5 of the empty string. Columns
pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aerolith.llm.common import WORD, apart, back, cut

EPOCHS, WEIGHTS, BUCKET, LARGE = 3, 3, 3, 400_000_000
#: Rates at knots over training time for each weight, from weight 1 on.
SCHEDULES: dict[int | str, tuple[float, ...]] = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}
SOURCE = ["__none", "__source"]


def targets(sizes: DataFrame) -> DataFrame:
    """SOURCE, source_size, weight, target of each source; sizes: SOURCE, source_size."""
    order = Window.orderBy(*SOURCE)
    rows = sizes.withColumn("weight", (F.row_number().over(order) - 1) % WEIGHTS + 1)
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    limit = F.col("source_size") * EPOCHS
    rows = rows.withColumn("limit", limit)
    before = Window.orderBy(F.col("limit") / F.col("weight"), *SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rest", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    rows = rows.withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("full", F.col("limit") * F.col("open") <= F.col("rest") * F.col("weight"))
    rows = rows.withColumn("rest", F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(everything))
    rows = rows.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    share = F.col("rest").cast("double") * F.col("weight") / F.greatest("open", F.lit(1))
    return rows.select(*SOURCE, "source_size", "weight", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def integrated(rates: tuple[float, ...]) -> list[tuple[float, float, float]]:
    """Of each stretch between knots: the share of demand before it, its first rate and its slope, scaled to a whole demand of 1 (over a stretch's own time)."""
    if len(rates) < 2 or min(rates) < 0 or max(rates) <= 0:
        raise ValueError(f"a schedule needs two rates or more, none negative and not all zero: {rates}")
    n = len(rates) - 1
    areas = [(a + b) / 2 for a, b in zip(rates, rates[1:], strict=False)]
    whole = sum(areas)
    return [(sum(areas[:i]) / whole, rates[i] / whole, (rates[i + 1] - rates[i]) / whole) for i in range(n)]


def _inverse(x: Column, rates: tuple[float, ...]) -> Column:
    """The training time by which a share x of the demand of a schedule is due."""
    parts, at = integrated(rates), None
    for i, (before, rate, slope) in enumerate(parts):
        y = x - before if i else x
        root = rate + F.sqrt(F.greatest(F.lit(rate * rate) + 2.0 * slope * y, F.lit(0.0)))
        here = F.coalesce(F.try_divide(2.0 * y, root), F.lit(0.0))
        here = here if len(parts) == 1 else (F.lit(float(i)) + F.least(here, F.lit(1.0))) / len(parts)
        at = here if at is None else F.when(x >= before, here).otherwise(at)
    return at


def position(words: Column, schedules: dict | None = None) -> Column:
    """The training time at which a source's demand reaches so many words; needs target, weight and __source.

    schedules: rates at knots by weight (a number) or, before that, by a source's name.
    """
    x, out = F.least(words.cast("double") / F.col("target"), F.lit(1.0)), None
    schedules = SCHEDULES | (schedules or {})
    for key in sorted(schedules, key=lambda k: isinstance(k, str)):
        holds = F.col("__source") == key if isinstance(key, str) else F.col("weight") == key
        at = _inverse(x, tuple(map(float, schedules[key])))
        out = F.when(holds, at) if out is None else F.when(holds, at).otherwise(out)
    return out


def plan(docs: DataFrame) -> DataFrame:
    """docs with all its columns, then __size, __source_size, __target, __taken, __weight, __before (words of the source's documents before), __source."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    source = F.col("source").cast("string")
    digits = BUCKET + max(0, math.ceil(math.log(max(docs.count(), 1) / LARGE, 16)))  # a count of Parquet rows reads no data
    rows = docs.select("*", size.alias("__size"), key.alias("__key"), F.substring(key, 1, digits).alias("__bucket"), F.xxhash64(F.col("text").cast("string")).alias("__hash"), source.isNull().alias("__none"), F.coalesce(source, F.lit("")).alias("__source"))
    buckets = cut(rows.groupBy(*SOURCE, "__bucket").agg(F.sum("__size").alias("words")), "buckets")
    goals = targets(buckets.groupBy(*SOURCE).agg(F.sum("words").alias("source_size")))
    earlier = Window.partitionBy(*SOURCE).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(goals, SOURCE).drop("words")
    # the text decides among rows of one id (null ids among them), so that reruns agree
    own = Window.partitionBy(*SOURCE, "__bucket").orderBy("__key", "__size", "doc_id", "__hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(offsets, [*SOURCE, "__bucket"]).withColumn("__before", F.col("offset") + F.coalesce(F.sum("__size").over(own), F.lit(0)))
    wanted = F.floor(F.col("target") + 0.5)
    least = F.greatest("source_size", F.lit(1))
    passes = F.floor(wanted / least)
    more = wanted - passes * F.col("source_size")
    taken = passes * F.col("__size") + F.greatest(F.lit(0), F.least(more - F.col("__before"), F.col("__size")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "__size", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), taken.cast("long").alias("__taken"), F.col("weight").alias("__weight"), "__before", "__source", "__hash")


def first_position(schedules: dict | None = None) -> Column:
    at = position(F.col("__before"), schedules)
    return F.when(F.col("__taken") > 0, F.floor(at * 1_000_000).cast("long"))


def query(docs: DataFrame, schedules: dict | None = None) -> DataFrame:
    """The documents in the order of their first copies' positions, those not taken last."""
    rows = plan(docs.select("doc_id", "text", "source"))
    rows = rows.withColumns({"target": F.col("__target"), "weight": F.col("__weight")})
    out = rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), "target", F.col("__taken").alias("taken"), first_position(schedules).alias("first_position"))
    return out.orderBy(F.asc_nulls_last("first_position"), "doc_id")


def mix(docs: DataFrame, schedules: dict | None = None) -> DataFrame:
    """A row for each copy of a document that the mix takes, all columns of docs, then __words (of the copy) and __position; sorted by position."""
    rows = plan(apart(docs)).where("__taken > 0").withColumns({"target": F.col("__target"), "weight": F.col("__weight")})
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("__taken") / F.col("__size")) - 1)).alias("__copy")
    rows = rows.select("*", copies)
    words = F.least("__size", F.col("__taken") - F.col("__copy") * F.col("__size"))
    rows = rows.withColumn("__words", words).withColumn("__position", position(F.col("__copy") * F.col("__source_size") + F.col("__before"), schedules))
    return back(rows.orderBy("__position", "doc_id", "__hash", "__copy"), docs.columns, "__size", "__words", "__position")


def stage(docs: DataFrame, schedules: dict | None = None) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order; one cut short holds its first words, joined by spaces."""
    rows = mix(docs, schedules)
    cut_short = F.col("__words") < F.col("__size")
    start = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("__words").cast("int")), " ")
    rows = rows.withColumn("text", F.when(cut_short, start).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut_short, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
with d as (
  select doc_id, cast(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) as bigint) as size,
         source is null as none, coalesce(source, '') as source, md5(coalesce(cast(doc_id as varchar), '')) as key
  from documents
), s as (
  select none, source, cast(sum(size) as bigint) as source_size from d group by all
), w as (
  select *, (row_number() over (order by none, source) - 1) % 3 + 1 as weight, 3 * source_size as lim from s
), x as (
  select *, sum(source_size) over () as total,
         sum(source_size) over () - coalesce(sum(lim) over (order by lim / cast(weight as double), none, source rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(weight) over () - coalesce(sum(weight) over (order by lim / cast(weight as double), none, source rows between unbounded preceding and 1 preceding), 0) as open
  from w
), y as (
  select *, lim * open <= rest * weight as is_full from x
), z as (
  select *, total - sum(case when is_full then lim else 0 end) over () as r, sum(case when is_full then 0 else weight end) over () as o from y
), t as (
  select none, source, source_size, weight,
         case when is_full then cast(lim as double) else cast(r as double) * cast(weight as double) / cast(greatest(o, 1) as double) end as target
  from z
), c as (
  select d.*, t.source_size, t.weight, t.target,
         cast(coalesce(sum(size) over (partition by d.none, d.source order by key, size, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before,
         cast(floor(target + 0.5) as bigint) as wanted
  from d join t on d.none = t.none and d.source = t.source
), p as (
  select *, wanted // greatest(source_size, 1) as passes from c
), q as (
  select *, passes * size + greatest(0, least(wanted - passes * source_size - before, size)) as taken,
         case weight when 1 then cast(-0.5 as double) when 2 then cast(0 as double) else cast(0.5 as double) end as k,
         least(cast(before as double) / nullif(target, 0), cast(1 as double)) as u
  from p
)
select doc_id, size, source_size, target, cast(taken as bigint) as taken,
       case when taken > 0 then cast(floor(2.0::double * u / ((1.0::double - k) + sqrt((1.0::double - k) * (1.0::double - k) + 4.0::double * k * u)) * 1000000::double) as bigint) end as first_position
from q
"""
