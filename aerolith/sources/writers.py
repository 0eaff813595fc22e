"""Writers: partitioned tables, resumable runs, checksums, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators import relational

PARTS = ("detector", "method", "level")


def save(df: DataFrame, path: str, parts=PARTS) -> None:
    """A table with a folder for each detector, method and level; only folders that df has are replaced."""
    names = [p for p in parts if p in df.columns]
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(path)


def append_missing(df: DataFrame, path: str, key: list[str], spark: SparkSession) -> None:
    """Rows whose key the table lacks."""
    relational.missing(df, spark.read.parquet(path), key).write.mode("append").parquet(path)


def manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def summary_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def frozen_yaml(frozen: DataFrame, path: str) -> None:
    """Chosen settings (some ten rows) as YAML on the driver."""
    import yaml

    rows = _few(frozen)
    tree = {
        "fixed": next((r.config for r in rows if r.kind == "fixed"), None),
        "runner_up": [r.config for r in sorted((r for r in rows if r.kind == "runner_up"), key=lambda r: r.place)],
        "per_level": {float(r.level): r.config for r in rows if r.kind == "per_level"},
    }
    with open(path, "w") as file:
        yaml.safe_dump(tree, file, sort_keys=False)


def _few(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a report; more than `most` are an error, as a report is no place for them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def markdown(df: DataFrame, digits: int = 1, titles: dict[str, str] | None = None) -> str:
    """A report's table; undefined is a dash, an interval of two numbers is [lo, hi]."""

    def show(v) -> str:
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(show(x) for x in v) + "]"
        return "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines = [[(titles or {}).get(c, c) for c in df.columns], ["---"] * len(df.columns), *[[show(v) for v in r] for r in _few(df)]]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in lines)


def report(sections: list[tuple[str, DataFrame]], path: str, title: str = "Results") -> None:
    """A Markdown file of titled tables, on the driver."""
    with open(path, "w") as file:
        file.write(f"# {title}\n" + "".join(f"\n## {name}\n\n{markdown(df)}\n" for name, df in sections))
