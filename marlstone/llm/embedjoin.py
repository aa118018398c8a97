"""Embedding near-duplicates by an epsilon grid order join.

Vectors of length one are at most ``eps`` apart if and only if their cosine reaches the bound. They are sorted by the grid cells (of side
``eps``) of their leading principal dimensions; the sorted sequence is cut into blocks, and pairs of blocks whose boxes are further
apart than ``eps`` are skipped before any vector moves. Neighbouring blocks form a stretch; a block moves once for each pair of
stretches in which it has a partner. Inside a pair of blocks the two sequence intervals are halved again and again and joined
recursively, skipping distant halves, down to small tiles that are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import components, cut, map_columns

#: Vectors of a block (fewer if they are long: about 2 MB), and of the tiles at which the recursion ends.
BLOCK, TILE = 4096, 512
#: Leading principal dimensions that order the vectors and bound their distance.
LEADING = 8
#: Dimensions whose grid cells bring near boxes together, and the least side of these cells (coordinates are within 1).
MEETING, SIDE = 2, 1 / 16


def usable(vector: Column) -> Column:
    """Whether a vector can link: there, not empty, without nulls, NaN or infinities, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of lists as rows of doubles, zeros after shorter ones, and each one's length."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out, lengths


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal(vectors: DataFrame, width: int) -> np.ndarray:
    """The leading principal dimensions as columns, from sums over all vectors (width x width numbers reach the driver)."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def run(columns: list[pa.Array]) -> list:
        rows = np.c_[unit(matrix(columns[0], width)[0]), np.ones(len(columns[0]))]
        return [np.arange((width + 1) ** 2, dtype=np.int32), (rows.T @ rows).ravel()]

    sums = np.zeros((width + 1) ** 2)
    for r in map_columns(vectors, schema, run, "embedding").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    sums = sums.reshape(width + 1, width + 1)
    n = max(sums[-1, -1], 1)
    mean = sums[-1, :-1] / n
    _, axes = np.linalg.eigh(sums[:-1, :-1] / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :LEADING].copy()


BLOCKS = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType())), T.StructField("data", T.BinaryType())]
)


def packed(nodes: np.ndarray, counts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, single: bool = False) -> bytes:
    """A block in bytes, its components as floats if they came as such."""
    return np.concatenate([np.array([len(nodes), rows.shape[1], single]), nodes, counts, lengths]).astype(np.int64).tobytes() + rows.astype(np.float32 if single else np.float64).tobytes()


class Block:
    """A block's nodes, how many rows each has, lengths, unit vectors and principal coordinates."""

    def __init__(self, data: bytes, axes: np.ndarray):
        n, width, single = np.frombuffer(data, np.int64, 3).tolist()
        self.nodes, self.counts, self.lengths = np.frombuffer(data, np.int64, 3 * n, 24).reshape(3, n)
        self.units = unit(np.frombuffer(data, np.float32 if single else np.float64, n * width, 24 + 24 * n).reshape(n, width).astype(np.float64))
        self.places = self.units @ axes


def block_size(width: int) -> int:
    return min(BLOCK, max(TILE, (2 << 20) // (8 * width)))


def ranges(n: int, width: int) -> int:
    """Sorted ranges of about two blocks each."""
    return max(1, -(-n // (2 * block_size(width))))


def blocks(vectors: DataFrame, n: int, width: int, axes: np.ndarray, eps: float) -> DataFrame:
    """The vectors in epsilon grid order, at most ``BLOCK`` to a row, with the box of each block's principal coordinates. The upper half
    of ``block`` is the place of its range in that order."""
    leading, most = axes.shape[1], block_size(width)
    single = vectors.schema["embedding"].dataType.elementType == T.FloatType()
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("embedding", vectors.schema["embedding"].dataType), T.StructField("cells", T.ArrayType(T.LongType()))])

    def cells(columns: list[pa.Array]) -> list:
        at = np.floor(unit(matrix(columns[2], width)[0]) @ axes / eps).astype(np.int64)
        return [columns[0], columns[1], columns[2], list(at)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted, part, k = to_arrow_schema(BLOCKS), TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, k
            while held and (sum(b.num_rows for b in held) >= most or last):
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                own, rest = table.slice(0, most), table.slice(most)
                held = [rest] if rest.num_rows else []
                rows, lengths = matrix(own.column(2), width)
                place = unit(rows) @ axes
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([(part << 32) + k], [place.min(axis=0)], [place.max(axis=0)], [packed(own.column(0).to_numpy(), own.column(1).to_numpy(), lengths, rows, single)]), wanted, strict=True)], schema=wanted)
                k += 1

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from full(False)
        yield from full(True)

    ordered = map_columns(vectors, schema, cells, "node", "n", "embedding")
    keys = [F.col("cells")[i] for i in range(leading)] + [F.xxhash64("node"), F.col("node")]
    ordered = ordered.repartitionByRange(ranges(n, width), *keys).sortWithinPartitions(*keys)
    return ordered.select("node", "n", "embedding").mapInArrow(pack, BLOCKS)


def apart(low_a, high_a, low_b, high_b) -> float:
    """The least distance of two boxes."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(np.sqrt((gap * gap).sum()))


def joined(a: bytes, b: bytes, same: bool, axes: np.ndarray, eps: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``met`` for two packed blocks, or for one and itself if ``same``."""
    one = Block(a, axes)
    return met(one, one if same else Block(b, axes), eps, least)


def met(a: Block, b: Block, eps: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the vectors of two blocks (which may be the same): ``nodes``, how many rows each links to in the other block, and the smallest
    node that it reaches over links between the two; only those with links."""
    same, places = a is b, (a.places, b.places)
    nodes_a, counts_a, lengths_a, units_a = a.nodes, a.counts, a.lengths, a.units
    nodes_b, counts_b, lengths_b, units_b = b.nodes, b.counts, b.lengths, b.units
    base = 0 if same else len(nodes_a)
    links = np.zeros(len(nodes_a) + (0 if same else len(nodes_b)), np.int64)
    label = np.arange(len(links))

    def join_labels(i: np.ndarray, j: np.ndarray) -> None:
        while True:
            differ = label[i] != label[j]
            if not differ.any():
                return
            i, j = i[differ], j[differ]
            x, y = label[i], label[j]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]

    def recurse(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and a0 > b0:
            return  # its mirror image is done
        pa_, pb = places[0][a0:a1], places[1][b0:b1]
        if apart(pa_.min(axis=0), pa_.max(axis=0), pb.min(axis=0), pb.max(axis=0)) > eps * (1 + 1e-9):
            return
        if max(a1 - a0, b1 - b0) > TILE:
            # Halves lie at multiples of the same sizes in both, so that in one block a tile meets itself or none of its own.
            ha, hb = a0 + half(a1 - a0), b0 + half(b1 - b0)
            for x0, x1 in ((a0, ha), (ha, a1)):
                for y0, y1 in ((b0, hb), (hb, b1)):
                    if x0 < x1 and y0 < y1:
                        recurse(x0, x1, y0, y1)
            return
        linked = units_a[a0:a1] @ units_b[b0:b1].T >= least
        linked &= lengths_a[a0:a1, None] == lengths_b[None, b0:b1]
        diagonal = same and a0 == b0
        if diagonal:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        links[a0:a1] += linked @ counts_b[b0:b1]
        if not diagonal:
            links[base + b0 : base + b1] += counts_a[a0:a1] @ linked
        i, j = np.nonzero(linked)
        join_labels(i + a0, j + b0 + base)

    recurse(0, len(nodes_a), 0, len(nodes_b))
    nodes = nodes_a if same else np.concatenate([nodes_a, nodes_b])
    some = np.flatnonzero(links)
    return nodes[some], links[some], nodes[label[some]]


def half(n: int) -> int:
    """The largest power of two times TILE below n, or n if it is a tile already."""
    size = TILE
    while size * 2 < n:
        size *= 2
    return min(size, n)


def near_boxes(box: DataFrame, dimensions: int, eps: float) -> DataFrame:
    """Pairs ``a`` <= ``b`` of blocks whose boxes (``block``, ``low``, ``high``) are at most ``eps`` apart, each pair once.

    Boxes meet in cells of their first dimensions, one of them in its own cells and the cells beside them; a pair counts in the first
    cell that both have. Cells are as wide as ``eps`` at least, so near boxes always meet, and few for each box.
    """
    side, meeting = max(eps * (1 + 1e-6), SIDE), min(MEETING, dimensions)
    edge = lambda c, d: F.floor(F.col(c)[d] / side)

    def cells(name: str, beside: int) -> DataFrame:
        out = box.select(F.col("block").alias(name), F.col("low").alias(f"low_{name}"), F.col("high").alias(f"high_{name}"), *[x.alias(f"{c}_{name}{d}") for d in range(meeting) for c, x in (("from", edge("low", d) - beside), ("to", edge("high", d) + beside))])
        for d in range(meeting):
            out = out.withColumn(f"cell{d}", F.explode(F.sequence(f"from_{name}{d}", f"to_{name}{d}")))
        return out

    gap = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    distance = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))
    found = cells("a", 0).join(cells("b", 1), [f"cell{d}" for d in range(meeting)]).where("a <= b")
    for d in range(meeting):
        found = found.where(F.col(f"cell{d}") == F.greatest(f"from_a{d}", f"from_b{d}"))
    return found.where(distance <= eps * (1 + 1e-9)).select("a", "b")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row for each row of ``vectors``: ``id``, ``n_links``, ``component_id``, ``kept``.

    Rows link if their vectors' cosine, in doubles, is ``least`` or more; ``n_links`` counts the other rows linked directly, equal ones
    included; ``component_id`` is the smallest id reachable, the own one included; ``kept`` says that it is the own one. Vectors that
    are null, empty, zero or hold nulls, NaN or infinities link with nothing, nor do vectors of different lengths. Equal vectors are
    compared once. Null ids are passed over for the smallest; rows may repeat; an empty table returns no rows.
    """
    eps = float(np.sqrt(max(1e-12, 2 - 2 * least)))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    unique = cut(rows.where(usable(F.col("embedding"))).groupBy("embedding").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()))
    size = unique.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("w")).first()
    none = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not size["n"]:
        return none
    width = size["w"]
    axes = principal(unique, width)
    packs = cut(blocks(unique, size["n"], width, axes, eps))
    stretch = min(8, max(1, ranges(size["n"], width) // 32))  # ranges: many tasks first, then fewer moves
    of = lambda c: F.floor(F.shiftright(c, 32) / stretch)
    pairs = near_boxes(packs.select("block", "low", "high"), axes.shape[1], eps)
    moves = pairs.select(of("a").alias("s"), of("b").alias("t"), F.explode(F.array("a", "b")).alias("block")).distinct()
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "links", "root")])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, second = (k.as_py() for k in key)
        held = {k: Block(data, axes) for k, data in sorted(zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True))}
        place = lambda k: (k >> 32) // stretch
        made = [met(held[x], held[y], eps, least) for x in held if place(x) == first for y in held if x <= y and place(y) == second]
        return pa.table({f.name: np.concatenate([m[i] for m in made]) for i, f in enumerate(schema)})

    found = cut(moves.join(packs.select("block", "data"), "block").groupBy("s", "t").applyInArrow(run, schema))
    groups = components(found.select("node", "root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    each = unique.join(links, "node", "left").join(groups, "node", "left").select("embedding", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    each = cut(each)
    smallest = each.groupBy("root").agg(F.min("least").alias("component_id"))
    each = each.join(smallest, "root").select("embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    component = F.coalesce("component_id", "id")
    return rows.join(each, "embedding", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
