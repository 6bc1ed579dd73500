"""Joins of a statistics table back onto a wide row table.

One path for every size: an equi-join. The statistics table is stored once and measured;
it is broadcast when its rows take at most ``BROADCAST_BYTES`` in memory, else the join
shuffles, and adaptive execution may split skewed partitions. Rows without a key match
nothing; in the shuffled form they are spread over all tasks instead of meeting in one.
Tables whose size is bounded by construction (one row per split, per fold or per
bin) use ``attach_bounded`` and skip the check.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.sources.scratch import stored

#: Most bytes of a broadcast statistics table, as rows in memory.
BROADCAST_BYTES = 64 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """Size of a row in memory, about: 24 bytes and 8 a column, and the bytes of its texts."""
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields
            if isinstance(f.dataType, T.StringType)]
    return sum(text, F.lit(24 + 8 * len(df.columns)))


def checked_small(stats: DataFrame) -> tuple[DataFrame, bool]:
    """Store ``stats`` (an aggregate is then computed once) and say whether it may be broadcast."""
    table = stored(stats, "statistics")
    size = table.agg(F.sum(row_bytes(table).cast("long")).alias("n")).first()["n"] or 0
    return table, size <= BROADCAST_BYTES


def left_lookup(df: DataFrame, keys: Sequence[Column], table: DataFrame, table_keys: Sequence[str],
                small: bool) -> DataFrame:
    """Left join of ``table`` (unique ``table_keys``, never null) on key expressions of ``df``.

    The columns of ``table`` other than its keys are added."""
    names = [f"__t{i}" for i in range(len(table_keys))]
    t = table.withColumnsRenamed(dict(zip(table_keys, names)))
    cond = F.lit(True)
    if small:
        for k, n in zip(keys, names):
            cond = cond & (k == F.col(n))
        return df.join(F.broadcast(t), cond, "left").drop(*names)
    own = [f"__k{i}" for i in range(len(keys))]
    x = df.withColumns({o: k for o, k in zip(own, keys)})
    # a row without a key matches nothing and may land anywhere: where follows from its own
    # content, so a map task that runs again deals its rows out as before
    lost = reduce(lambda a, b: a | b, [F.col(o).isNull() for o in own])
    told = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    x = x.withColumn("__salt", F.when(lost, F.pmod(F.xxhash64(*told) if told else F.lit(0), F.lit(65536)).cast("int"))
                     .otherwise(F.lit(-1)))
    t = t.withColumn("__tsalt", F.lit(-1))
    for o, n in zip(own, names):
        kind = dict(t.dtypes)[n]
        x = x.withColumn(o, F.coalesce(F.col(o).cast(kind), F.lit("0").cast(kind)))
        cond = cond & (F.col(o) == F.col(n))
    return x.join(t, cond & (F.col("__salt") == F.col("__tsalt")), "left").drop(*own, *names, "__salt", "__tsalt")


def attach(df: DataFrame, stats: DataFrame, on, how: str = "left") -> DataFrame:
    stats, small = checked_small(stats)
    return df.join(F.broadcast(stats) if small else stats, on=on, how=how)


def attach_bounded(df: DataFrame, stats: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a table whose row count is bounded by construction (splits, folds, bins)."""
    return df.join(F.broadcast(stats), on=on, how=how)


def attach_scalar_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row as typed literals.

    The aggregate is computed (one small job, its result is one row) and its
    values are inlined into the projection: no join is planned at all (a join on
    a constant key would be planned as a nested-loop / cross join)."""
    row = one_row.first()
    fields = one_row.schema.fields
    vals = row.asDict() if row is not None else {f.name: None for f in fields}
    return df.select("*", *[F.lit(vals[f.name]).cast(f.dataType).alias(f.name) for f in fields])


def coverage(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows of ``a`` missing from ``b`` and vice versa (left-anti both ways)."""
    keys = list(keys)
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    only_a = ka.join(kb, keys, "left_anti").agg(F.count(F.lit(1)).alias("only_left"))
    only_b = kb.join(ka, keys, "left_anti").agg(F.count(F.lit(1)).alias("only_right"))
    return attach_scalar_row(only_a, only_b)


# ---- literal lookups: a handful of entries (splits, given mappings) ------------------

def sql_value(v) -> str:
    """SQL text of a Python scalar, exact for doubles (shortest round-trip repr)."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}L"
    if isinstance(v, float):
        if math.isnan(v):
            return "double('NaN')"
        if math.isinf(v):
            return "double('Infinity')" if v > 0 else "double('-Infinity')"
        return f"({v!r}D)"
    if isinstance(v, str):
        return f"cast(X'{v.encode('utf-8').hex()}' as string)"
    raise TypeError(f"unsupported literal {v!r}")


def sql_double(v) -> str:
    return "cast(NULL as double)" if v is None else f"cast({sql_value(float(v))} as double)"


def sql_map(pairs) -> str:
    """``map(k1, v1, ...)`` from (Python key, SQL value text) pairs."""
    return "map(" + ", ".join(f"{sql_value(k)}, {v}" for k, v in pairs) + ")"


def lookup(pairs, key: Column, value_type: str) -> Column:
    """Value of ``key`` in a literal map of Python (key, value) scalars (null when absent)."""
    pairs = list(pairs)
    if not pairs:
        return F.lit(None).cast(value_type)
    if value_type == "double":
        vals = [(k, sql_double(v)) for k, v in pairs]
    else:
        vals = [(k, f"cast({sql_value(v)} as {value_type})") for k, v in pairs]
    return F.expr(sql_map(vals))[key]
