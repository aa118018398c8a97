"""Column expressions: exact money, scales and tails."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE, PRICE, MONEY = "decimal(20,6)", "decimal(12,10)", "decimal(38,16)"


def size(c: str | Column = "size") -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(SIZE)


def stake(size_: str | Column = "size", price: str | Column = "price") -> Column:
    """Size times price without rounding: the narrow types make the product decimal(33,16)."""
    return size(size_) * (F.col(price) if isinstance(price, str) else price).cast(PRICE)


def money(value: float | str) -> Column:
    """A threshold, compared in decimal."""
    return F.lit(str(value)).cast(MONEY)


def signed_size(side: str = "side", size_: str = "size") -> Column:
    return F.when(F.col(side) == "BUY", size(size_)).otherwise(-size(size_))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def log_scale(x: Column, floor: float, cap: float) -> Column:
    """0 up to ``floor``, 1 from ``cap`` on, logarithmic between; null counts as 0."""
    x = x.cast("double")
    return F.when(x.isNull() | (x <= floor), F.lit(0.0)).otherwise(clip01(F.log10(x / floor) / F.log10(F.lit(cap / floor))))


def ramp_down(x: Column, full: float, none: float) -> Column:
    """1 up to ``full``, 0 from ``none`` on, straight between."""
    return F.when(x <= full, F.lit(1.0)).when(x >= none, F.lit(0.0)).otherwise((F.lit(float(none)) - x) / (none - full))


def graded(n: Column, full: float) -> Column:
    """Grows with the logarithm of a count and reaches 1 at ``full``."""
    return F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log1p(F.lit(float(full))))


def minus_log10(p: Column) -> Column:
    """-log10 of a probability, at most 300, never a negative zero."""
    return -F.log10(F.greatest(p, F.lit(1e-300))) + F.lit(0.0)


def distribution(p: np.ndarray) -> np.ndarray:
    """The distribution of a sum of independent 0/1 variables: halves are convolved, so that n of them take few steps."""
    if len(p) > 64:
        half = len(p) // 2
        return np.convolve(distribution(p[:half]), distribution(p[half:]))
    out = np.ones(1)
    for q in p:
        out = np.append(out * (1 - q), 0.0) + np.append(0.0, out * q)
    return out


def tails(ps: list[np.ndarray], ks: np.ndarray) -> np.ndarray:
    """P(X >= k) of each row. Rows of up to 64 variables of like number take each step together; a missing variable is one that is never 1."""
    out = np.empty(len(ps))
    sizes = np.array([len(p) for p in ps], dtype=int)
    order = np.argsort(sizes, kind="stable")
    short = order[sizes[order] <= 64]
    for i in order[len(short) :]:
        out[i] = distribution(ps[i])[max(0, ks[i]) :].sum()
    for part in (short[i : i + 1024] for i in range(0, len(short), 1024)):
        most = int(sizes[part[-1]])
        q = np.zeros((len(part), most))
        q[np.arange(most) < sizes[part, None]] = np.concatenate([ps[i] for i in part])
        held = np.zeros((len(part), most + 1))
        held[:, 0] = 1.0
        for j in range(most):
            one = held[:, :-1] * q[:, j : j + 1]
            held *= 1 - q[:, j : j + 1]
            held[:, 1:] += one
        out[part] = [held[r, max(0, ks[i]) : sizes[i] + 1].sum() for r, i in enumerate(part)]
    return np.where(ks <= 0, 1.0, np.clip(out, 0.0, 1.0))


def tail(probabilities: Column, k: Column) -> Column:
    """P(X >= k) for the sum X of independent 0/1 variables, exactly: 1 for k = 0, null for null. Arrow batches; the work grows with the
    square of a row's variables, in numpy's loops."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def upper(ps: pd.Series, ks: pd.Series) -> pd.Series:
        known = (ps.notna() & ks.notna()).to_numpy()
        out = np.full(len(ps), np.nan)
        if known.any():
            out[known] = tails([np.asarray(p, dtype=float) for p in ps[known]], ks[known].to_numpy().astype(int))
        return pd.Series(out).where(known, None).astype("float64")

    return upper(probabilities, k)


def missing_rate_bound(n: Column) -> Column:
    """The rate of misses that n clean samples leave open at 95 %."""
    return F.lit(1.0) - F.pow(F.lit(0.05), F.lit(1.0) / n)


def samples_needed(rate: float = 0.01, left: float = 0.05) -> int:
    """Clean samples until misses at ``rate`` are ruled out but for a chance of ``left``."""
    import math

    return math.ceil(math.log(left) / math.log(1 - rate))


def ordered_sum(key: Column, value: Column) -> Column:
    """A sum of doubles in the order of ``key``, so that it never depends on partitions."""
    return F.aggregate(F.sort_array(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), F.lit(0.0), lambda s, x: s + x["v"])


def seconds(ts: str | Column) -> Column:
    """A time as whole seconds since 1970 (UTC sessions)."""
    return F.floor(F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) / 1_000_000)
