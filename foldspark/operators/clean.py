"""Cleaning, category handling, projections and row predicates."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.functions import exprs as X
from foldspark.operators.joins import checked_small, left_lookup
from foldspark.sources.scratch import stored

# The alias dictionaries of the source workload (country spellings).
COUNTRY_ALIASES = {"Spain": "Ispanya", "South Korea": "Guney Kore", "Sweden": "Isvec"}
COUNTRY_ALIASES_NOTEBOOK = {"İspanya": "Spain", "Güney Kore": "South Korea", "İsveç": "Sweden"}

# literal maps are inlined up to this many entries; larger dictionaries are joined
_LITERAL_MAP_LIMIT = 2000


def normalize_aliases(df: DataFrame, column: str, aliases: Mapping | DataFrame) -> DataFrame:
    """Replace spellings by their canonical value; unknown and null stay.

    A small Python mapping becomes a literal map lookup (no join). A dictionary
    given as a DataFrame ``(alias, canonical)`` is left-joined; the planner
    broadcasts it when its size allows, otherwise it is a shuffle join.
    """
    c = F.col(column)
    if isinstance(aliases, Mapping):
        if len(aliases) <= _LITERAL_MAP_LIMIT:
            if not aliases:
                return df
            m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
            return df.withColumn(column, F.coalesce(m[c], c))
        aliases = df.sparkSession.createDataFrame(list(aliases.items()), "alias string, canonical string")
    d = aliases.toDF("__alias", "__canonical")
    return (df.join(d, c == F.col("__alias"), "left")
              .withColumn(column, F.coalesce(F.col("__canonical"), c))
              .drop("__alias", "__canonical"))


def distinct_levels(df: DataFrame, cols: Sequence[str], where=None) -> DataFrame:
    """``(col, level, n)``: non-null levels of several columns, stacked and
    de-duplicated in one aggregate (partial aggregation before the shuffle)."""
    src = df.where(where) if where is not None else df
    long = src.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("level")) for c in cols
    ])).alias("kv")).select("kv.col", "kv.level").where(F.col("level").isNotNull())
    return long.groupBy("col", "level").agg(F.count(F.lit(1)).alias("n"))


def ranked_levels(levels: DataFrame, n_parts: int | None = None) -> DataFrame:
    """Add ``code`` = 0-based rank of ``level`` inside its ``col`` without a
    single-partition window: range-partition by (col, level) so partitions are
    ordered, number rows inside each partition, and add the count of all rows in
    earlier partitions (a prefix sum over one row per partition) minus the
    column's first rank."""
    n_parts = n_parts or int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored: the offsets and the rows must come from one evaluation of the ranges
    part = stored(levels.repartitionByRange(n_parts, "col", "level")
                        .withColumn("__pid", F.spark_partition_id()), "levels")
    w_in = Window.partitionBy("__pid").orderBy("col", "level")
    part = part.withColumn("__rn", F.row_number().over(w_in))
    counts = part.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    prefix = counts.select("__pid", (F.coalesce(F.sum("__c").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__off"))
    ranked = part.join(F.broadcast(prefix), "__pid").withColumn("__g", F.col("__off") + F.col("__rn") - 1)
    first = ranked.groupBy("col").agg(F.min("__g").alias("__first"))
    return (ranked.join(F.broadcast(first), "col")
                  .select("col", "level", (F.col("__g") - F.col("__first")).cast("int").alias("code"), "n"))


def category_levels(df: DataFrame, cols: Sequence[str], where=None) -> DataFrame:
    """Dictionary ``(col, level, code, n)`` of the levels seen in ``df`` (optionally
    filtered); code = 0-based rank of the sorted level (pandas category codes)."""
    return ranked_levels(distinct_levels(df, cols, where))


def _dictionary(df: DataFrame, cols: Sequence[str], train_col: str) -> tuple[DataFrame, bool]:
    """Train-level dictionary ``(col, level, code, n)``, stored, and whether it may be broadcast."""
    return checked_small(ranked_levels(distinct_levels(df, cols, F.col(train_col))))


def align_categories(df: DataFrame, cols: Sequence[str], train_col: str = "is_train") -> DataFrame:
    """Keep only levels seen in train rows; other levels (test-only) -> null."""
    table, small = _dictionary(df, cols, train_col)
    out = df
    for c in cols:
        d = table.where(F.col("col") == c).select("level", F.col("level").alias("__seen"))
        out = left_lookup(out, [F.col(c).cast("string")], d, ["level"], small).withColumn(
            c, F.when(F.col("__seen").isNotNull(), F.col(c))).drop("__seen")
    return out


def category_codes(df: DataFrame, cols: Sequence[str], train_col: str = "is_train",
                   suffix: str = "") -> DataFrame:
    """Level -> integer code from the train dictionary; missing/unseen -> null."""
    table, small = _dictionary(df, cols, train_col)
    out = df
    for i, c in enumerate(cols):
        d = table.where(F.col("col") == c).select("level", F.col("code").alias(f"__code{i}"))
        out = left_lookup(out, [F.col(c).cast("string")], d, ["level"], small)
    codes = {c: F.col(f"__code{i}").alias(c + suffix) for i, c in enumerate(cols)}
    if suffix:
        return out.select(*[F.col(c) for c in df.columns], *codes.values())
    return out.select(*[codes.get(c, F.col(c)) for c in df.columns])


def unseen_levels(df: DataFrame, cols: Sequence[str], train_col: str = "is_train") -> DataFrame:
    """``(col, level)`` present in test rows but not in train rows (left-anti)."""
    test_lv = distinct_levels(df, cols, ~F.col(train_col)).select("col", "level")
    train_lv = distinct_levels(df, cols, F.col(train_col)).select("col", "level")
    return test_lv.join(train_lv, ["col", "level"], "left_anti")


def missing_as_level(df: DataFrame, cols: Sequence[str], level: str = "missing") -> DataFrame:
    """P5: null category becomes its own level."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(level)).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("id", "target")) -> list[str]:
    """Every column but the excluded ones, in table order."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (), skip_tinyint: bool = False) -> list[str]:
    """Numeric columns by schema (``skip_tinyint`` drops 0/1 flag columns)."""
    ex = set(exclude)
    out = []
    for f in df.schema.fields:
        if f.name in ex or not isinstance(f.dataType, _NUMERIC):
            continue
        if skip_tinyint and isinstance(f.dataType, T.ByteType):
            continue
        out.append(f.name)
    return out


def fill_constant(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """P8."""
    return df.select(*[F.coalesce(F.col(c), F.lit(value)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """P12."""
    return df.na.drop(subset=list(subset))


def seeded_sample(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """Repeatable sample of ``n`` rows: the ``n`` smallest seeded hashes of the
    id (a top-n, planned as TakeOrderedAndProject: each task keeps n rows)."""
    return (df.withColumn("__h", X.seeded_key(id_col, seed))
              .orderBy(F.col("__h"), F.col(id_col)).limit(n).drop("__h"))


def in_range(c, lo: float, hi: float):
    """Inclusive range predicate."""
    return X.col(c).between(F.lit(lo), F.lit(hi))


def clip_columns(df: DataFrame, cols: Sequence[str], lo: float = 0.0, hi: float = 10.0) -> DataFrame:
    """P18."""
    return df.select(*[X.clip(c, lo, hi).alias(c) if c in cols else F.col(c) for c in df.columns])
