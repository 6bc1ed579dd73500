"""Scalar column helpers. Every helper returns a JVM-side Column expression
(no Python UDF), so projections stay inside whole-stage codegen."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float = 0.0, hi: float = 10.0) -> Column:
    """``np.clip``: null stays null."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c.cast("double"))))


def out_of_range(c, lo: float = 0.0, hi: float = 10.0) -> Column:
    """True when the value lies outside ``[lo, hi]``."""
    c = col(c)
    return (c < F.lit(float(lo))) | (c > F.lit(float(hi)))


def fill0(c) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def safe_div(a, b) -> Column:
    """``a / b`` with a zero divisor giving null (ANSI mode raises otherwise)."""
    return col(a) / F.nullif(col(b), F.lit(0))


def is_missing(c) -> Column:
    return col(c).isNull().cast("int")


def log1p0(c) -> Column:
    return F.log1p(fill0(c))


def right_closed_bins(c, edges: Sequence[float], labels: Sequence | None = None,
                      include_lowest: bool = False) -> Column:
    """``pd.cut``: bins ``(e0, e1], (e1, e2], ...``; outside or null -> null.
    ``include_lowest`` closes the first bin on the left as well."""
    c = col(c)
    labels = list(range(len(edges) - 1)) if labels is None else list(labels)
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        lower = (c >= F.lit(lo)) if (include_lowest and i == 0) else (c > F.lit(lo))
        cond = lower & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return expr


def digitize(c, edges: Column) -> Column:
    """``np.digitize(x, edges)`` for increasing edges: count of edges <= x."""
    c = col(c)
    return F.size(F.filter(edges, lambda e: e <= c))


def int_class(c, lo: int = 0, hi: int = 10) -> Column:
    """Nearest integer (half to even, like numpy) clipped to ``[lo, hi]``."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(col(c), 0))).cast("int")


def r(c, digits: int = 8) -> Column:
    """Round for engine-independent comparison of float outputs."""
    return F.round(col(c).cast("double"), digits)


def seeded_key(id_col, seed: int) -> Column:
    """First 32 bits of ``md5(id ':' seed)`` as a non-negative long; portable
    to any SQL engine with md5 (DuckDB: ``('0x'||substr(md5(..),1,8))::BIGINT``)."""
    s = F.concat(col(id_col).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")
