"""The evaluation from the command line: python -m aerolith COMMAND.

Tables are folders of Parquet: candidates (chip_id, level_id, level, detector, method, cand_id, x0, y0, x1, y1, scores), refs
(chip_id, ref_id, x0, y0, x1, y1) and chips (chip_id, city, block, split). Settings are YAML: prompts (name: indices),
thresholds, max_sizes, min_areas, extent_m. cache needs images (see sources/rasters.py) and finds boxes by the colour rule.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import bootstrap, evaluation, raster, sampling, selection, tuning
from aerolith.sources import rasters, readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="aerolith", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *tables: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=text)
        for t in tables:
            sub.add_argument(f"--{t}", required=True)
        sub.add_argument("--out", required=True)
        return sub

    sub = command("split", "deal blocks to dev and test", "chips")
    sub.add_argument("--share", type=float, default=0.3)
    sub.add_argument("--seed", type=int, default=7)
    sub = command("cache", "boxes of degraded images", "images")
    sub.add_argument("--glob", default="*.tif")
    sub.add_argument("--native", type=float, default=0.3)
    sub.add_argument("--scale", type=float)
    sub.add_argument("--levels", type=float, nargs="+", required=True)
    sub.add_argument("--methods", nargs="+", default=["area"])
    sub.add_argument("--reds", type=int, nargs="+", default=[120])
    sub.add_argument("--chromas", type=int, nargs="+", default=[25])
    sub = command("tune", "F1 of every setting and level, and the settings to freeze", "candidates", "refs", "chips", "settings")
    sub.add_argument("--frozen", help="YAML file of the chosen settings")
    sub = command("evaluate", "counts of every chip, run, level and IoU", "candidates", "refs", "chips", "settings")
    sub.add_argument("--split")
    sub.add_argument("--cities", nargs="*")
    sub.add_argument("--limit", type=int)
    sub.add_argument("--ious", type=float, nargs="+", default=[0.25, 0.5])
    sub.add_argument("--chance", type=int, default=20)
    sub.add_argument("--config", help="one setting's name; all of them if not given")
    sub = command("report", "curves and break points of a table of counts", "counts")
    sub.add_argument("--iou", type=float, default=0.25)
    sub.add_argument("--draws", type=int, default=2000)
    sub.add_argument("--by", nargs="+", default=["detector", "method", "config"])
    sub.add_argument("--markdown", help="file of the report")
    sub = command("query", "a registered query over a folder of tables")
    sub.add_argument("name")
    sub.add_argument("--data", required=True)
    return top


def _grid(path: str) -> tuple[list[tuple], float]:
    tree = readers.settings(path)
    return selection.settings(tree["prompts"], tree["thresholds"], tree["max_sizes"], tree.get("min_areas", [0.0])), float(tree["extent_m"])


def _tune(spark: SparkSession, args) -> DataFrame:
    configs, extent = _grid(args.settings)
    candidates, refs, chips = (spark.read.parquet(p) for p in (args.candidates, args.refs, args.chips))
    names = spark.createDataFrame([(c[0],) for c in configs], "config string").coalesce(1)
    spine = candidates.select("level").distinct().crossJoin(F.broadcast(names))  # levels, settings
    references = refs.join(chips, "chip_id", "left_semi").agg(F.count("*").alias("references"))
    out = tuning.table(tuning.sweep(candidates, refs, configs, extent, ["level"], ["chip_id", "level_id"]), spine, references, ["level"])
    if args.frozen:
        writers.frozen_yaml(tuning.frozen(out), args.frozen)
    return out


def _evaluate(spark: SparkSession, args) -> DataFrame:
    configs, extent = _grid(args.settings)
    configs = [c for c in configs if args.config in (None, c[0])]
    if not configs:
        raise ValueError(f"no such setting: {args.config}")
    candidates, refs, chips = (spark.read.parquet(p) for p in (args.candidates, args.refs, args.chips))
    if args.split:
        chips = selection.in_split(chips, args.split, args.cities, args.limit)
    candidates = candidates.join(chips.select("chip_id"), "chip_id", "left_semi")
    return evaluation.evaluate(candidates, refs, chips, spark.createDataFrame(configs, selection.CONFIG).coalesce(1), args.ious, extent, args.chance)


def _report(spark: SparkSession, args) -> DataFrame:
    counts = selection.counts_of(spark.read.parquet(args.counts), iou=args.iou)
    out = evaluation.curve_rows(counts, bootstrap.draws(counts, args.draws), args.by)
    if args.markdown:
        series = out.select(*args.by, "break_peak", F.array("break_peak_lo", "break_peak_hi").alias("break_peak_ci"), "break_finest", "peak_level", "peak_f1", "above_chance_peak").distinct().orderBy(*args.by)
        points = out.select(*args.by, "level", "f1", F.array("f1_lo", "f1_hi").alias("f1_ci"), "chance_f1").orderBy(*args.by, "level")
        writers.report([("Break points", series), ("Curves", points)], args.markdown)
    return out


def _cache(spark: SparkSession, args) -> DataFrame:
    detectors = {f"colour-{name}": raster.colour_rule(r, g, b) for name, r, g, b in selection.colour_variants(args.reds, args.chromas)}
    return raster.cached(rasters.rasters(spark, args.images, args.glob, args.scale), detectors, args.native, args.levels, args.methods)


def _query(spark: SparkSession, args) -> DataFrame:
    from aerolith.plans import QUERIES

    return QUERIES[args.name](spark, args.data)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("aerolith").getOrCreate()
    made = {
        "split": lambda: sampling.block_split(spark.read.parquet(args.chips), args.share, args.seed), "cache": lambda: _cache(spark, args), "tune": lambda: _tune(spark, args),
        "evaluate": lambda: _evaluate(spark, args), "report": lambda: _report(spark, args), "query": lambda: _query(spark, args),
    }
    df = made[args.command]()
    if args.command == "cache":
        writers.save(df, args.out)
    else:
        df.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
