"""Writing runs: ordered tables, manifests, resumable work lists, strict JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ordered(df: DataFrame, path: str, *order: str, files: int | None = None) -> None:
    """A table in the order of its key, as sorted ranges; never over one that is there. ``files=1`` for small tables only."""
    held = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    held.sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def manifest(spark: SparkSession, tables: dict[str, str], params: dict, status: str = "ok") -> str:
    """A run's tables as JSON: rows and an order-free hash of the contents of each, the parameters and their hash."""
    files = []
    for name, path in sorted(tables.items()):
        df = spark.read.parquet(path)
        cells = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in sorted(df.columns)])
        r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.md5(cells), 1, 12), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
        files.append({"table": name, "rows": r["n"], "hash": str(r["h"])})
    body = json.dumps(params, sort_keys=True, default=str)
    return json.dumps({"files": files, "params": params, "params_sha256": hashlib.sha256(body.encode()).hexdigest(), "status": status}, sort_keys=True, default=str)


def manifest_differences(listed: list[str], found: list[str]) -> dict[str, list[str]]:
    """Paths listed but not found, and found but not listed."""
    return {"missing": sorted(set(listed) - set(found)), "unlisted": sorted(set(found) - set(listed))}


def remaining(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def finite(c: Column) -> Column:
    """Null in place of what JSON can't say."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def json_rows(df: DataFrame, *key: str) -> DataFrame:
    """``key`` columns and ``json``: each row as JSON with sorted names, infinite and NaN numbers null."""
    kinds = dict(df.dtypes)
    cols = [(finite(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c)) for c in sorted(df.columns)]
    return df.select(*key, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def forbidden(rows: DataFrame, words: list[str]) -> DataFrame:
    """Rows whose JSON has one of ``words``; an export with any must not leave."""
    return rows.where(F.lower("json").rlike("|".join(words)))


def csv_with_notes(df: DataFrame, path: str, notes: dict[str, str], *order: str) -> None:
    """A CSV as text whose first lines, marked by #, say where it comes from; one file, for tables of a page's size."""
    head = df.sparkSession.createDataFrame([(i, f"# {k}: {v}") for i, (k, v) in enumerate(notes.items())] + [(len(notes), ",".join(df.columns))], "o long, value string")
    lines = df.orderBy(*order).select((F.monotonically_increasing_id() + len(notes) + 1).alias("o"), F.to_csv(F.struct(*df.columns)).alias("value"))
    head.unionByName(lines).coalesce(1).sortWithinPartitions("o").select("value").write.mode("errorifexists").text(path)
