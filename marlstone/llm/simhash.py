"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprints are 64-bit SimHashes of word shingles. Two link if at most ``distance`` bits differ, and linked ones form groups. The
search for links cuts the 64 bits into m partitions with thresholds t_1..t_m (each -1 or more) that add up to ``distance - m + 1``:
two fingerprints that link differ in at most t_i bits of some partition i. Bits that go together share a partition, the thresholds
come from dynamic programming over estimated candidate counts, and m is the one whose best thresholds cost least.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import components, cut, map_columns

BITS = 64
SEED = 42
#: What a probe row costs (written, sorted and read) against the comparison of one candidate.
PROBE_COST = 40.0


def simhash(text: str | None, shingle: int) -> int:
    """The fingerprint of one text, signed: bit b is 1 if more than half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    last = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, n, 1 << 16):  # bounded memory for very long texts
        piece = np.ascontiguousarray(hashes[start : start + (1 << 16)])
        counts += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, *more: str) -> DataFrame:
    """``id``, ``fingerprint`` (signed long) and the long columns ``more`` of each row. A null text counts as empty; the empty text's
    fingerprint is 0."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "fingerprint", *more)])

    def run(columns: list[pa.Array]) -> list:
        ids, texts, *others = columns
        return [ids.cast(pa.int64()), np.fromiter((simhash(t.as_py(), shingle) for t in texts), np.int64, len(texts)), *others]

    return map_columns(docs, schema, run, id_col, text_col, *more)


def together(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how many have both: 64 x 64 numbers from all rows."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(columns: list[pa.Array]) -> list:
        values = columns[0].to_numpy(zero_copy_only=False).astype(np.int64)
        bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        return [np.arange(BITS * BITS + 1, dtype=np.int32), np.append((bits.T @ bits).ravel(), len(values)).astype(np.int64)]

    sums = map_columns(prints, schema, run, "fingerprint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for row in sums:
        flat[row["i"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlation(n: int, both: np.ndarray) -> np.ndarray:
    """How strongly each pair of bits goes together or against each other, 0 to 1."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.where(spread > 0, (both / max(n, 1) - np.outer(p, p)) / spread, 0.0)
    return np.abs(phi)


def grouped(phi: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` partitions of nearly equal width; each takes the bit next that goes best with those it has."""
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        spare = sorted(left)
        seed = max(spare, key=lambda b: (phi[b, spare].sum(), -b))
        own = [seed]
        left.discard(seed)
        while len(own) < width:
            best = max(sorted(left), key=lambda b: (phi[b, own].mean(), -b))
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Dynamic programming: how many of ``units`` each partition gets so that the costs add up to the least.

    ``costs[i][u]``: the cost of partition i with u units, that is with threshold u - 1; no units, no probing.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picks) in best.items():
            for u, c in enumerate(own):
                if used + u <= units and (used + u not in then or cost + c < then[used + u][0]):
                    then[used + u] = (cost + c, [*picks, u])
        best = then
    return best[units]


def plan(prints: DataFrame, distance: int) -> list[tuple[int, int]]:
    """Partitions as (mask, threshold), those with threshold -1 left out.

    Candidates of threshold 0 are counted exactly over all fingerprints (the squares of how often each value occurs); for higher
    ones that count is scaled by how much likelier a random pair differs in so many bits of the partition.
    """
    n, both = together(prints)
    if n < 2:
        return [(-1, 0)]  # there is no pair to find
    phi, p = correlation(n, both), np.diag(both) / n
    schemes = {m: grouped(phi, m) for m in range(2, distance + 2)}
    masks = sorted({mask(bits) for parts in schemes.values() for bits in parts})
    values = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("x")).groupBy("x.k", "x.v").count()
    squares = {masks[r["k"]]: float(r["s"]) for r in values.groupBy("k").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect()}
    least, found = float("inf"), []
    for parts in schemes.values():
        costs = []
        for bits in parts:
            differ = np.array([1.0])
            for b in bits:  # how many bits of a random pair differ, bits taken as independent
                q = 2 * p[b] * (1 - p[b])
                differ = np.convolve(differ, [1 - q, q])
            within = np.cumsum(differ)
            own = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(bits), r) for r in range(min(t, len(bits)) + 1))
                scale = within[min(t, len(within) - 1)] / max(within[0], 1e-300)
                own.append(n * probes * PROBE_COST + min(squares[mask(bits)] * scale, float(n) * n))
            costs.append(own)
        cost, units = allocate(costs, distance + 1)
        if cost < least:
            least, found = cost, [(mask(bits), u - 1) for bits, u in zip(parts, units, strict=True) if u]
    return found


def flips(part: int, threshold: int) -> list[int]:
    bits = [b for b in range(BITS) if part >> b & 1]
    return [mask(list(c)) for r in range(threshold + 1) for c in combinations(bits, r)]


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs ``a``, ``b`` of fingerprints whose components are the groups of all that differ in at most ``distance`` bits.

    ``prints``: distinct ``fingerprint`` and ``n``, how many rows have each. First every bucket (equal value in a partition) links
    its members to a few of its own, the most frequent fingerprint among them; that is linear in the rows and joins most of a
    group of near copies. Then every fingerprint probes the buckets within the partition's threshold, and a pair counts only if it
    is not joined yet, so a group of n near copies does not return its n * n pairs. No bucket has a cap.
    """
    parts = plan(prints, distance)
    here = lambda c: F.array(*[F.struct(F.lit(k).alias("part"), F.col(c).bitwiseAND(F.lit(m)).alias("value")) for k, (m, _) in enumerate(parts)])
    held = prints.select("fingerprint", "n", F.explode(here("fingerprint")).alias("x")).select("x.part", "x.value", "fingerprint", "n")
    mixed = F.xxhash64("fingerprint")
    few = held.groupBy("part", "value").agg(
        F.array_distinct(F.array(F.max(F.struct("n", "fingerprint"))["fingerprint"], F.min("fingerprint"), F.max("fingerprint"), F.min(F.struct(mixed, "fingerprint"))["fingerprint"], F.max(F.struct(mixed, "fingerprint"))["fingerprint"])).alias("few")
    ).where(F.size("few") > 1)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    first = held.join(few, ["part", "value"]).select("fingerprint", F.filter("few", lambda x: (x != F.col("fingerprint")) & (F.bit_count(x.bitwiseXOR(F.col("fingerprint"))) <= distance)).alias("to")).select(F.col("fingerprint").alias("a"), F.explode("to").alias("b"))
    first = cut(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    joined = components(first)
    known = cut(prints.join(joined, prints.fingerprint == joined.node, "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root")))
    index = known.select(F.explode(here("fingerprint")).alias("x"), F.col("fingerprint").alias("b"), F.col("root").alias("root_b")).select("x.part", "x.value", "b", "root_b")
    ways = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fingerprint").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(f)).alias("value")) for k, (m, t) in enumerate(parts) for f in flips(m, t)])
    probes = known.select(F.explode(ways).alias("x"), F.col("fingerprint").alias("a"), F.col("root").alias("root_a")).select("x.part", "x.value", "a", "root_a")
    on = (probes.part == index.part) & (probes.value == index.value) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & near("a", "b")
    return first.union(probes.join(index, on).select("a", "b"))


def rooted(prints: DataFrame, distance: int) -> DataFrame:
    """``prints`` (distinct ``fingerprint``, ``n``, ``least``) with ``root``, the fingerprint that stands for its group."""
    groups = components(links(prints.select("fingerprint", "n"), distance))
    return prints.join(groups, prints.fingerprint == groups.node, "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 4) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``fingerprint`` (signed long), ``component_id``.

    ``component_id`` is the smallest id among the rows whose fingerprints are reachable over links of at most ``distance`` differing
    bits, the row's own included; two groups share one only if the same id stands in both. Null texts count as empty, empty texts have
    fingerprint 0 and link like any other, repeated rows each return a row, null ids are passed over when the smallest is sought, and
    an empty table returns no rows. Other columns are never looked at. Copies meet by their fingerprint: a group is as many rows as it
    has different ones.
    """
    each = cut(fingerprints(docs, id_col, text_col, shingle))
    prints = cut(each.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = rooted(prints, distance)
    smallest = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(found.join(smallest, "root").select("fingerprint", "component_id"))
    return each.join(named, "fingerprint").select("id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 4) -> DataFrame:
    """Of each group of ``near_duplicates`` exactly one row of ``docs``, with all its columns: that of the smallest id.

    Rows are told apart by all their columns (128 bits of hashes), not by their ids: an id that stands in two groups stays in both, a
    null id counts as larger than all, rows of one id in one group are ordered by hash, and of rows equal in every column one stays.
    Repeated rows come together before they are shuffled. Null and empty texts form a group; an empty table returns no rows.
    """
    names = docs.columns
    own = [F.xxhash64(F.lit(k), *[F.to_json(F.struct(c)) if t.startswith(("map", "variant")) else F.col(c) for c, t in docs.dtypes], *[F.col(c).isNull() for c in names]) for k in (1, 2)]
    marked = docs.select(F.struct(*names).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), own[0].alias("key"), own[1].alias("key2"))
    each = cut(fingerprints(marked, "id", "text", shingle, "key", "key2"))
    prints = cut(each.groupBy("fingerprint").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "key2")).alias("least"), F.count(F.lit(1)).alias("n")))
    stay = cut(rooted(prints, distance).groupBy("root").agg(F.min("least").alias("least")).select("least.key", "least.key2"))
    once = marked.groupBy("key", "key2").agg(F.first("row").alias("row"))
    return once.join(stay, ["key", "key2"], "left_semi").select("row.*")
