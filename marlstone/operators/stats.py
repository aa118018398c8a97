"""Ranking quality, bootstrap over units, quantiles, and the choice of weights."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.signals import SIGNALS
from marlstone.session import held


def auc(df: DataFrame, group: list[str], score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """The chance that a positive row outranks a negative one, ties half, null below everything; null without one of either.

    Counts of each different score are added up along the ranking; no pairs are made. ``weight`` counts a row so many times.
    """
    w = F.col(weight) if weight else F.lit(1)
    value = F.coalesce(F.col(score), F.lit(float("-inf")))
    per = df.groupBy(*group, value.alias("_s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(F.lit(0))).alias("_p"), F.sum(F.when(F.col(label) == 1, F.lit(0)).otherwise(w)).alias("_q"))
    below = F.coalesce(F.sum("_q").over(Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_won", F.col("_p") * (below * 2 + F.col("_q")))  # doubled, so that it stays whole
    sums = per.groupBy(*group).agg(F.sum("_won").alias("_w"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    return sums.select(*group, F.try_divide(F.col("_w").cast("double"), (2 * F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"), "n_pos", "n_neg")


def weight_grid(usable: list[str]) -> dict[str, dict[str, float]]:
    """Equal weights, each usable signal left out, each doubled; all normalised, those without weight left out."""
    base = {s: 1.0 if s in usable else 0.0 for s in SIGNALS}
    named = {"W0": base} | {f"LOO_{s}": base | {s: 0.0} for s in usable} | {f"DBL_{s}": base | {s: 2.0} for s in usable}
    return {name: {s: v / sum(w.values()) for s, v in w.items()} for name, w in named.items() if sum(w.values()) > 0}


def totals_by_config(components: DataFrame, grid: dict[str, dict[str, float]]) -> DataFrame:
    """``config``, ``wallet``, ``score`` of every weight set over ``components`` (wallet and a column for each signal)."""
    out = []
    for name, w in grid.items():
        total = F.lit(0.0)
        for s in SIGNALS:
            total = total + F.lit(w[s]) * F.coalesce(s, F.lit(0.0))
        out.append(F.struct(F.lit(name).alias("config"), total.alias("score")))
    return components.withColumn("_c", F.explode(F.array(*out))).select("wallet", "_c.config", "_c.score", *[c for c in components.columns if c in ("label", "unit")])


def draws(units: list[tuple[int, str]], rounds: int, seed: int) -> list[tuple[int, int, str, int]]:
    """For each round, units of either label drawn with replacement, as many as there are: (round, label, unit, times). The same for
    every weight set, which makes the comparison paired; ``units`` are few (labelled by hand)."""
    rnd, out = random.Random(seed), []
    sides = {k: [u for label, u in sorted(units) if label == k] for k in (1, 0)}
    for b in range(rounds):
        for label, own in sides.items():
            times: dict[str, int] = {}
            for _ in own:
                u = rnd.choice(own)
                times[u] = times.get(u, 0) + 1
            out += [(b, label, u, n) for u, n in sorted(times.items())]
    return out


def won_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of scores, by config: twice the pairs that rows of unit u win against rows of unit v, ties half, and each unit's rows (the
    other unit is null). ``at`` is the config's least score in the range."""
    if not (batches := list(batches)):
        return
    rows = pa.Table.from_batches(batches)
    for config in pc.unique(rows["config"]).to_pylist():
        own = rows.filter(pc.equal(rows["config"], config)).combine_chunks()
        scores, place = np.unique(own["score"].to_numpy(), return_inverse=True)
        coded = own["unit"].combine_chunks().dictionary_encode()
        names, unit = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        n, positive = own["n"].to_numpy(), own["label"].to_numpy() == 1
        order = np.flatnonzero(positive)[np.argsort(unit[positive], kind="stable")]  # of each unit together
        winners, begins = np.unique(unit[order], return_index=True)
        out = [(names[u], None, int(x)) for u, x in zip(winners, np.add.reduceat(n[order], begins) if len(order) else [], strict=True)]
        for i in np.unique(unit[~positive]):
            against = ~positive & (unit == i)
            here = np.zeros(len(scores), dtype=np.int64)
            here[place[against]] = n[against]
            out.append((None, names[i], int(here.sum())))
            if len(order):
                won = np.add.reduceat(n[order] * (2 * np.cumsum(here) - here)[place[order]], begins)  # twice those below, once those equal
                out += [(names[u], names[i], int(x)) for u, x in zip(winners, won, strict=True)]
        u, v, x = zip(*out, strict=True)
        yield pa.record_batch({"config": pa.array([config] * len(out), "string"), "at": pa.array([scores[0]] * len(out), "double"), "u": pa.array(u, "string"), "v": pa.array(v, "string"), "n": pa.array(x, "int64")})


def won_across(ranges: pa.Table) -> pa.Table:
    """One config's ``won_within``, added up along its ranges: rows win twice against all of the ranges below."""
    place = lambda r: (r[0] != r[0], 0.0 if r[0] != r[0] else r[0])  # noqa: E731 (no number is above all)
    rows = sorted(zip(*[ranges[c].to_pylist() for c in ("at", "u", "v", "n")], strict=True), key=place)
    below = dict.fromkeys((v for _, u, v, _ in rows if u is None), 0)
    won = {(u, v): 0 for u in {u for _, u, v, _ in rows if v is None} for v in below}
    for _, part in itertools.groupby(rows, key=place):
        part = list(part)
        for _, u, v, n in part:
            if v is None:
                for other, m in below.items():
                    won[u, other] += 2 * n * m
            elif u is not None:
                won[u, v] += n
        for _, u, v, n in part:
            if u is None:
                below[v] += n
    us, vs = zip(*won, strict=True) if won else ((), ())
    return pa.table({"config": pa.array([ranges["config"][0].as_py()] * len(won), "string"), "u": pa.array(us, "string"), "v": pa.array(vs, "string"), "won": pa.array(won.values(), "int64")})


def won_by_units(totals: DataFrame) -> DataFrame:
    """``config``, ``u``, ``v``, ``won``: twice the pairs of a positive row of unit u and a negative one of unit v that the positive
    outranks, ties half. Rows are counted in sorted ranges of scores, so no row multiplies by units and no task holds a config; equal
    scores lie in one range, as one row for each unit and label."""
    value = F.coalesce("score", F.lit(float("-inf"))).alias("score")
    counted = totals.where("label IN (0, 1)").groupBy("config", value, F.col("label").cast("int").alias("label"), "unit").agg(F.count(F.lit(1)).alias("n"))
    ranges = counted.repartitionByRange("config", "score").mapInArrow(won_within, "config string, at double, u string, v string, n bigint")
    return ranges.groupBy("config").applyInArrow(won_across, "config string, u string, v string, won bigint")


def bootstrap(totals: DataFrame, rounds: int = 2000, seed: int = 1) -> DataFrame:
    """Paired cluster bootstrap of the gain in AUC over W0: ``config``, ``p05``, ``p50``, ``p95``, ``mean``.

    A round draws units, so its AUC is a sum over pairs of units, counted once; the rows themselves don't multiply by the rounds. ``totals``
    is read three times.
    """
    units = [(r["label"], r["unit"]) for r in totals.select("label", "unit").distinct().collect()]
    drawn = totals.sparkSession.createDataFrame(draws(units, rounds, seed), "round int, label int, unit string, times long")
    side = lambda label, unit, times: F.broadcast(drawn.where(F.col("label") == label).select("round", F.col("unit").alias(unit), F.col("times").alias(times)))
    half = won_by_units(totals).join(side(1, "u", "t"), "u").groupBy("config", "round", "v").agg(F.sum(F.col("won") * F.col("t")).alias("won"))
    won = half.join(side(0, "v", "t"), ["round", "v"]).groupBy("config", "round").agg(F.sum(F.col("won") * F.col("t")).alias("won"))
    rows = totals.groupBy("config", "label", "unit").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.join(F.broadcast(drawn), ["label", "unit"]).groupBy("config", "round").agg(*[F.sum(F.when(F.col("label") == k, F.col("n") * F.col("times"))).alias(c) for k, c in ((1, "n_pos"), (0, "n_neg"))])
    per = held(sizes.join(won, ["config", "round"], "left").select("config", "round", F.try_divide(F.col("won").cast("double"), (2 * F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc")))
    base = per.where("config = 'W0'").select("round", F.col("auc").alias("base"))
    gains = per.join(base, "round").withColumn("gain", F.col("auc") - F.col("base"))
    ordered = gains.groupBy("config").agg(F.sort_array(F.collect_list("gain")).alias("g"))
    return ordered.select("config", *[quantile(F.col("g"), q).alias(n) for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))], (F.aggregate("g", F.lit(0.0), lambda s, x: s + x) / F.size("g")).alias("mean"))


def quantile(ordered: Column, q: float) -> Column:
    """The element at floor(q n) of a sorted array, the last at most."""
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.lit(q) * F.size(ordered)).cast("int")))


def quantile_up(ordered: Column, q: float) -> Column:
    """The element at ceil(q (n - 1))."""
    return F.get(ordered, F.least(F.size(ordered) - 1, F.ceil(F.lit(q) * (F.size(ordered) - 1)).cast("int")))


def quartile(ordered: Column, k: int) -> Column:
    """The element at k times a quarter of n, the quarter rounded down."""
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) / 4).cast("int") * k))


def chosen(results: list[dict], grid: dict[str, dict[str, float]]) -> str:
    """The weight set whose gain is above 0 at 5 %, the surest of them, then the one nearest to W0; else W0."""
    far = lambda name: sum(abs(grid[name][s] - grid["W0"][s]) for s in SIGNALS)
    better = [r for r in results if r["config"] != "W0" and r["p05"] is not None and r["p05"] > 0]
    return min(better, key=lambda r: (-r["p05"], far(r["config"])))["config"] if better else "W0"


def completeness(windows: DataFrame) -> DataFrame:
    """Pooled over clean windows (``exercised``, ``misses``, ``fills``, ``tool``): bound on the missing rate, share not exercised, tools."""
    from marlstone.functions.numeric import missing_rate_bound

    used = F.col("exercised")
    sums = windows.agg(F.sum(F.when(used, F.col("fills"))).alias("fills"), F.sum("misses").alias("misses"), (F.count(F.when(~used, 1)) / F.count(F.lit(1))).alias("unexercised"), F.countDistinct("tool").alias("tools"))
    return sums.select("fills", "misses", F.when(F.col("misses") == 0, missing_rate_bound(F.col("fills"))).alias("rate_p95"), "unexercised", "tools")


def sampled_windows(spans: list[tuple[str, int, int]], n: int, width: int, seed: int) -> list[tuple[str, int, int]]:
    """Seeded windows of ``width`` seconds, ``n`` for each (market, first, last): starts are uniform over its time."""
    rnd = random.Random(seed)
    return [(m, s, s + width) for m, a, b in spans for s in sorted(rnd.randint(a, max(a, b - width)) for _ in range(n))]


def projection(costs: DataFrame, group: list[str], cost: str, units: int) -> DataFrame:
    """What ``units`` more would cost: by the mean, and by the 50 % and 90 % quantiles."""
    held = costs.groupBy(*group).agg(F.sort_array(F.collect_list(F.col(cost).cast("double"))).alias("c"))
    mean = F.aggregate("c", F.lit(0.0), lambda s, x: s + x) / F.size("c")
    return held.select(*group, (mean * units).alias("mean"), (quantile_up(F.col("c"), 0.5) * units).alias("p50"), (quantile_up(F.col("c"), 0.9) * units).alias("p90"))
