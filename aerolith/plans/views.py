"""The engine's inputs as views of the driver's tables, one text for Spark and for the SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aerolith.sources import tables

CHIPS = """select c.c_custkey as chip_id, r.r_name as city, concat(r.r_name, ':', cast(n.n_nationkey as varchar(10)), ':', c.c_mktsegment) as block
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey"""
REFS = """select o_custkey as chip_id, o_orderkey as ref_id, cast((o_orderkey*37)%150 as double) as x0, cast((o_orderkey*53)%150 as double) as y0,
cast((o_orderkey*37)%150 + 8 + o_orderkey%23 as double) as x1, cast((o_orderkey*53)%150 + 8 + (o_orderkey*7)%19 as double) as y1 from {orders}"""
CANDS = """select r.chip_id, cast(l.l_linenumber as int) as level_id,
case l.l_linenumber when 1 then cast(0.3 as double) when 2 then cast(0.6 as double) when 3 then cast(0.9 as double)
  when 4 then cast(1.2 as double) when 5 then cast(2.4 as double) when 6 then cast(5.0 as double) else cast(10.0 as double) end as level,
case l.l_returnflag when 'A' then 'owlvit' when 'N' then 'owlv2' else 'colour' end as detector,
case l.l_linestatus when 'O' then 'area' else 'blur_resize' end as method,
row_number() over (partition by r.chip_id, l.l_linenumber
  order by l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_shipdate) as cand_id,
r.x0 + ((l.l_partkey*31)%21-10)*l.l_linenumber*l.l_linenumber/cast(16 as double) as x0,
r.y0 + ((l.l_suppkey*17)%21-10)*l.l_linenumber*l.l_linenumber/cast(16 as double) as y0,
r.x1 + ((l.l_partkey*13)%11-5)*l.l_linenumber*l.l_linenumber/cast(16 as double) as x1,
r.y1 + ((l.l_suppkey*29)%11-5)*l.l_linenumber*l.l_linenumber/cast(16 as double) as y1,
l.l_discount*10 as s0, l.l_tax*10 as s1, l.l_quantity/cast(50 as double) as s2
from {lineitem} l join {refs} r on l.l_orderkey = r.ref_id"""
EXTENT = 195.0
#: One setting: the first two prompts, threshold 0.2, at most 30 m, any area.
SETTING = [("pair|t0.2|max30|min0", [0, 1], 0.2, 30.0, 0.0)]
TABLES = ("customer", "nation", "region", "orders", "lineitem")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def chips(self) -> DataFrame:
        return self.spark.sql(CHIPS, customer=self.table("customer"), nation=self.table("nation"), region=self.table("region"))

    @property
    def refs(self) -> DataFrame:
        return self.spark.sql(REFS, orders=self.table("orders"))

    @property
    def cands(self) -> DataFrame:
        rows = self.spark.sql(CANDS, lineitem=self.table("lineitem"), refs=self.refs)
        return rows.withColumn("scores", F.array("s0", "s1", "s2"))

    def joined(self) -> DataFrame:
        """The line items with their order's customer, written as a table; place: their order within an order and level by the columns that number candidates."""
        own = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
        orders = self.table("orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
        rows = self.table("lineitem").join(orders, "l_orderkey")
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*own)))
        return tables.cut(rows.drop("l_extendedprice", "l_shipdate"), "joined")

    def cands_of(self, joined: DataFrame, parted: bool = True) -> DataFrame:
        """The same rows as cands from joined(): line items move by customer without what only numbers them, and stay there; with parted unset, all but cand_id."""
        rows = joined.withColumn("o_orderkey", F.col("l_orderkey"))
        rows = self.spark.sql(REFS.replace(" from {orders}", ", * from {orders}"), orders=rows.repartition("o_custkey") if parted else rows)
        order = ", ".join(f"l.{c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
        text = CANDS.replace(order, "l.l_orderkey, l.place").replace("{lineitem} l join {refs} r on l.l_orderkey = r.ref_id", "{rows} r").replace("l.l_", "r.l_").replace("l.place", "r.place")
        return self.spark.sql(text, rows=rows).withColumn("scores", F.array("s0", "s1", "s2"))

    def setting(self) -> DataFrame:
        from aerolith.operators.selection import CONFIG

        return self.spark.createDataFrame(SETTING, CONFIG).coalesce(1)


def matched(name: str, source: str, keys: list[str]) -> str:
    """SQL of an optimal one-to-one matching of each group of edges (keys, cand_id, ref_id, iou): keys, n (pairs), t (their total IoU).

    Components in which a box touches all others give their best edge; of each of the others all matchings are listed, reference by
    reference, and the one with the most pairs and then the largest total is taken.
    """
    k, of = ", ".join(keys), lambda t: ", ".join(f"{t}.{c}" for c in keys)
    on = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    return f"""{name}_d as (select *, count(*) over (partition by {k}, cand_id) as dc, count(*) over (partition by {k}, ref_id) as dr from {source}),
{name}_s as materialized (select *, max(dr) over (partition by {k}, cand_id) as mc, max(dc) over (partition by {k}, ref_id) as mr from {name}_d),
{name}_star as (select {k}, count(*) as m, sum(iou) as t from (select {k}, max(iou) as iou from {name}_s where mc = 1 or mr = 1 group by {k}, case when mc = 1 then 0 else 1 end, case when mc = 1 then cand_id else ref_id end) g group by {k}),
{name}_e as materialized (select {k}, cand_id, ref_id, iou from {name}_s where not (mc = 1 or mr = 1)),
{name}_l as materialized (select distinct {of('x')}, x.ref_id as a, y.ref_id as b from {name}_e x join {name}_e y on {on('x', 'y')} and x.cand_id = y.cand_id),
{name}_near as (select * from {name}_l union select {of('n')}, n.a, l.b from {name}_near n join {name}_l l on {on('n', 'l')} and n.b = l.a),
{name}_r as materialized (select *, row_number() over (partition by {k}, comp order by ref_id) as place, count(*) over (partition by {k}, comp) as refs from (select {k}, a as ref_id, min(b) as comp from {name}_near group by {k}, a) t),
{name}_o as materialized (select {of('r')}, r.comp, r.place, e.cand_id, e.iou from {name}_e e join {name}_r r on {on('e', 'r')} and e.ref_id = r.ref_id union all select {k}, comp, place, null, null from {name}_r),
{name}_g as (select {k}, comp, cast(0 as bigint) as place, refs, cast([] as bigint[]) as used, cast(0 as bigint) as m, cast(0 as double) as t from {name}_r where place = 1
  union all select {of('g')}, g.comp, g.place + 1, g.refs, case when o.cand_id is null then g.used else list_append(g.used, o.cand_id) end, g.m + case when o.cand_id is null then 0 else 1 end, g.t + coalesce(o.iou, 0)
  from {name}_g g join {name}_o o on {on('g', 'o')} and g.comp = o.comp and o.place = g.place + 1 where o.cand_id is null or not list_contains(g.used, o.cand_id)),
{name} as (select {k}, cast(sum(m) as bigint) as n, sum(t) as t from (select * from {name}_star union all select {k}, m, t from (select *, row_number() over (partition by {k}, comp order by m desc, t desc) as best from {name}_g where place = refs) q where best = 1) u group by {k})"""


def edged(source: str, columns: str, least: float) -> str:
    """SQL of a table's boxes with the references of their chip that they overlap by an IoU of `least` or more."""
    both = "(least(k.x1, r.x1)-greatest(k.x0, r.x0))*(least(k.y1, r.y1)-greatest(k.y0, r.y0))"
    return f"""(select * from (select {columns}, k.cand_id, r.ref_id, {both} / nullif((k.x1-k.x0)*(k.y1-k.y0) + (r.x1-r.x0)*(r.y1-r.y0) - {both}, 0) as iou
  from {source} k join refs r on k.chip_id = r.chip_id and k.x0 < r.x1 and r.x0 < k.x1 and k.y0 < r.y1 and r.y0 < k.y1) t where iou >= cast({least} as double) and iou > 0)"""


#: The views' SQL for the check, each a common table expression.
_bare = {t: t for t in (*TABLES, "refs")}
WITH = "with recursive chips as (" + CHIPS.format(**_bare) + "), refs as (" + REFS.format(**_bare) + "), cands as (" + CANDS.format(**_bare) + """),
clipped as (select * from (select chip_id, level_id, level, detector, method, cand_id, s0, s1, s2,
  greatest(cast(0 as double), least(x0, cast(195 as double))) as x0, greatest(cast(0 as double), least(y0, cast(195 as double))) as y0,
  greatest(cast(0 as double), least(x1, cast(195 as double))) as x1, greatest(cast(0 as double), least(y1, cast(195 as double))) as y1 from cands) t where x1 > x0 and y1 > y0),
scored as (select * from clipped where greatest(s0, s1) >= cast(0.2 as double)),
kept as (select * from scored where x1 - x0 <= 30 and y1 - y0 <= 30),
edges as """ + edged("kept", "k.chip_id, k.level_id, k.level", 0) + """,
deg as (select *, count(*) over (partition by chip_id, level_id, cand_id) as dc, count(*) over (partition by chip_id, level_id, ref_id) as dr from edges where iou >= cast(0.25 as double)),
star as (select *, max(dr) over (partition by chip_id, level_id, cand_id) as mc, max(dc) over (partition by chip_id, level_id, ref_id) as mr from deg),
pairs as (select chip_id, level_id, level, cand_id, ref_id, iou from (select *, row_number() over (partition by chip_id, level_id, case when mc = 1 then 0 else 1 end, case when mc = 1 then cand_id else ref_id end order by iou desc, cand_id, ref_id) as rn
  from star where mc = 1 or mr = 1) t where rn = 1),
valid as (select * from edges where iou >= cast(0.25 as double)),
""" + matched("found", "valid", ["chip_id", "level_id"]) + """,
levels as (select distinct level_id, level from cands),
counts as (select c.chip_id, c.city, c.block, l.level_id, l.level, coalesce(m.n, 0) as matches, coalesce(p.n, 0) as predictions, coalesce(r.n, 0) as "references", coalesce(m.t, 0) as total_iou
  from chips c cross join levels l left join (select chip_id, level_id, count(*) as n from kept group by 1, 2) p on p.chip_id = c.chip_id and p.level_id = l.level_id
  left join found m on m.chip_id = c.chip_id and m.level_id = l.level_id
  left join (select chip_id, count(*) as n from refs group by 1) r on r.chip_id = c.chip_id),
curve as (select level, 200.0 * sum(matches)::double / nullif(sum(predictions) + sum("references"), 0) as f1 from counts group by 1)
"""
