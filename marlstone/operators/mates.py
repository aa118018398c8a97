"""How many wallets of its own scope each wallet is linked with, without a row for a pair, let alone for a pair and scope.

Wallets are dealt into blocks. Each pair of blocks meets in one task, which gets a row for each wallet with its counterparties and scopes,
pairs the wallets through the counterparties, one at a time, and counts the others' scopes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task holds two blocks of about so many wallets; so many blocks there are at least.
BLOCK_ROWS, BLOCKS = 60_000, 2


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def counted(cell: pa.Table) -> pa.Table:
    left, right = cell.filter(cell["left"]), cell.filter(pc.invert(cell["left"]))

    def coded(name: str) -> tuple[np.ndarray, ...]:
        """Of each side the values as numbers, row by row, and how many a row has; how many different ones there are."""
        sides = [x[name].combine_chunks() for x in (left, right)]
        values = [pc.list_flatten(x) for x in sides]
        codes = pa.concat_arrays([x if isinstance(x, pa.Array) else x.combine_chunks() for x in values]).dictionary_encode()
        numbers, sizes = codes.indices.to_numpy(zero_copy_only=False), [pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in sides]
        return numbers[: len(values[0])], sizes[0], numbers[len(values[0]) :], sizes[1], len(codes.dictionary)

    out = {"wallet": pa.array([], "string"), "scope": pa.array([], "string"), "linked": pa.array([], "int64")}
    if not len(left) or not len(right):
        return pa.table(out)
    mine, my_sizes, theirs, their_sizes, n = coded("counterparties")
    holders = np.repeat(np.arange(len(right)), their_sizes)[np.argsort(theirs, kind="stable")]
    held = np.bincount(theirs, minlength=n)
    first = np.cumsum(held) - held
    scopes, n_scopes, other_scopes, n_other, most = coded("scopes")
    begins = np.cumsum(n_other) - n_other
    names = pa.concat_arrays([x["wallet"].combine_chunks() for x in (left, right)]).dictionary_encode().indices.to_numpy()
    counts, at, of = [], 0, 0
    for i in range(len(left)):
        own = mine[at : at + my_sizes[i]]
        others = np.unique(holders[spans(first[own], held[own])])
        others = others[names[len(left) + others] != names[i]]
        counts.append(np.bincount(other_scopes[spans(begins[others], n_other[others])], minlength=most)[scopes[of : of + n_scopes[i]]])
        at, of = at + my_sizes[i], of + n_scopes[i]
    linked = np.concatenate(counts)
    kept = np.flatnonzero(linked)
    flat = pc.list_flatten(left["scopes"].combine_chunks())
    wallets = left["wallet"].combine_chunks().take(pa.array(np.repeat(np.arange(len(left)), n_scopes)[kept]))
    return pa.table({"wallet": wallets, "scope": flat.take(pa.array(kept)), "linked": pa.array(linked[kept], "int64")})


def linked_mates(links: DataFrame, members: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``scope``, ``wallet``, ``linked``: the other wallets of the scope that share a counterparty; wallets without any are left out.

    ``links``: wallet, counterparty, each once, counterparties of bounded fan; ``members``: scope, wallet, each once.
    """
    blocks = max(BLOCKS, -(-members.agg(F.approx_count_distinct("wallet")).first()[0] // block_rows))
    own = links.groupBy("wallet").agg(F.collect_list("counterparty").alias("counterparties")).join(members.groupBy("wallet").agg(F.collect_list("scope").alias("scopes")), "wallet")
    block = F.pmod(F.xxhash64("wallet"), F.lit(blocks))
    places = F.array(*[F.struct(c.alias("cell"), F.lit(side).alias("left")) for j in range(blocks) for c, side in ((block * blocks + j, True), (block + j * blocks, False))])
    dealt = own.withColumn("_p", F.explode(places)).select("_p.cell", "_p.left", "wallet", "counterparties", "scopes")
    cells = dealt.groupBy("cell").applyInArrow(counted, "wallet string, scope string, linked bigint")
    return cells.groupBy("scope", "wallet").agg(F.sum("linked").alias("linked"))
