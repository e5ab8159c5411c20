"""Column arithmetic of the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.96
#: What a finding of a severity costs.
SEVERITY_WEIGHTS = {"blocker": 1.0, "major": 0.4, "minor": 0.1}
#: Fixed value: the bias of what may not be attended to.
MASKED = -3.4028234663852886e38


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval, (0, 0) without trials."""
    p, m = ratio(hits, n), F.when(n == 0, F.lit(1)).otherwise(n).cast("double")
    d = 1 + Z * Z / m
    mid, half = (p + Z * Z / (2 * m)) / d, Z * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m)) / d
    zero = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(c)
    return zero(F.greatest(F.lit(0.0), mid - half)), zero(F.least(F.lit(1.0), mid + half))


def weight_of(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, w in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, F.lit(w)).otherwise(out)
    return out


def linear(distance: Column, lam: float, depth: int | None = None) -> Column:
    """-lam * d, over the depth if one is given."""
    return -lam * (distance / depth if depth else distance)


def p_adic(distance: Column, lam: float, depth: int | None = None, p: float = 2.0) -> Column:
    return -lam * (1 - F.pow(F.lit(p), -(distance / depth if depth else distance)))


KERNELS = {"linear": linear, "padic": p_adic}


def kernel(name: str, distance: Column, lam: float, depth: int | None = None) -> Column:
    if name not in KERNELS:
        raise ValueError(f"unknown kernel: {name}")
    return KERNELS[name](distance, lam, depth)


def common_prefix(a: Column, b: Column, depth: int | None = None) -> Column:
    """Levels that two paths share from the root; a level of -1 equals nothing. With the depth that both have it is plain comparisons."""
    if depth:
        shared = F.lit(0)
        for k in reversed(range(depth)):
            x, y = F.get(a, F.lit(k)), F.get(b, F.lit(k))
            shared = F.when((x == y) & (x >= 0), shared + 1).otherwise(0)
        return shared
    same = F.zip_with(a, b, lambda x, y: ((x == y) & (x >= 0)).cast("int"))
    start = F.struct(F.lit(1).alias("go"), F.lit(0).alias("n"))
    return F.aggregate(same, start, lambda s, e: F.struct((s["go"] * e).alias("go"), (s["n"] + s["go"] * e).alias("n")), lambda s: s["n"])


def distance(a: Column, b: Column, depth: int | None = None) -> Column:
    return (F.lit(depth) if depth else F.size(a)) - common_prefix(a, b, depth)
