"""What several operators of this subpackage share: checkpoints, components of a graph, running totals."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Only a local session may leave it unset, as in tests,
    and gets a temporary one."""
    context = spark.sparkContext
    if (held := context._jsc.sc().getCheckpointDir()).isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="marlstone-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that all executors share, so a lost executor costs nothing.

    Spark would go on to multiply the estimated sizes of what came before in every later join, digits doubling with each round of a
    loop; so the result is taken up anew, without them.
    """
    scratch(df.sparkSession)
    held = df.checkpoint(eager=True)._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), df.sparkSession)


def pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes, so that what is made from it stays small too; a longer row stands alone."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder that all executors share, and read again: for large tables smaller than ``cut``, and
    read by column."""
    path = f"{scratch(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that a task no longer needs back to the system: a worker lives on, and would keep it for tasks of any kind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_columns(df: DataFrame, schema: T.StructType, function: Callable[[list[pa.Array]], list], *columns: str, most: int = 8 << 20) -> DataFrame:
    """Rows of ``columns`` through ``function``, which takes and returns whole Arrow columns, about ``most`` bytes at a time."""
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        for batch in (piece for whole in batches for piece in pieces(whole, most)):
            made = function([batch.column(i) for i in range(batch.num_columns)])
            yield pa.RecordBatch.from_arrays([x.cast(wanted.field(n).type) if isinstance(x, pa.Array) else pa.array(x, wanted.field(n).type) for x, n in zip(made, names, strict=True)], schema=wanted)
            del made, batch
        release()

    return df.select(*columns).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has two long columns, the ends of each edge; loops, repeats and nulls are ignored. Returns ``node`` and ``root``, the
    smallest node of its component, one row for each node that has an edge to another.

    Every round lets each node point to its smallest neighbour, follows the pointers to the ends of their trees and contracts each
    tree to its end. A node that is no local minimum vanishes, so the nodes at least halve; the smallest of a component never
    vanishes. All state stays in the shared checkpoint folder; the driver sees counts only.
    """
    a, b = edges.columns[:2]
    left = cut(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    )
    done: DataFrame | None = None
    while left.count():
        both = left.union(left.select("b", "a"))
        point = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
        while True:
            further = point.select(F.col("node").alias("at"), F.col("root").alias("next"))
            jumped = cut(point.join(further, point.root == further["at"]).select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            point = jumped.drop("moved")
            if not jumped.where("moved").count():
                break
        ends = (point.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        joined = left
        for end, x in zip(ends, "ab", strict=True):
            joined = joined.join(end, x)
        left = cut(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct())
        if done is None:
            done = point
        else:
            after = point.select(F.col("node").alias("root"), F.col("root").alias("later"))
            done = cut(done.join(after, "root", "left").select("node", F.coalesce("later", "root").alias("root")))
    return done if done is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def small(df: DataFrame, rows: int, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with each row's place in ``order``, from 0, without bringing all rows together: sorted ranges, then their counts."""
    held = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = held.groupBy("_part").count()
    earlier = counts.select(F.col("_part").alias("_other"), F.col("count").alias("_n"))
    before = counts.join(F.broadcast(earlier), F.col("_other") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return held.withColumn(name, own).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
