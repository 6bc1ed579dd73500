"""CSV scan with an explicit schema and pandas-style missing tokens.

Spark's CSV reader keeps ``NA`` / ``None`` / ``null`` as strings and turns ``NaN``
into a double NaN. The source workload reads with pandas, where these tokens are
missing values. So every column is read as a string, the token list is mapped
to null, then the declared type is applied; doubles never carry NaN.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# pandas' default missing-value tokens.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                  "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _typed(raw: DataFrame, schema: T.StructType, tokens) -> list[tuple[T.StructField, Column, Column]]:
    """``(field, value, text)``: each column with its tokens mapped and its type applied (null where it cannot be)."""
    tok = F.array(*[F.lit(t) for t in tokens])
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        text = F.when(c.isNull() | F.array_contains(tok, c), F.lit(None)).otherwise(c)
        v = text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            d = text.try_cast("double")
            v = F.coalesce(v, F.when((d == F.floor(d)) & (F.abs(d) < 2.0 ** 53), d).try_cast(f.dataType))
        out.append((f, v, text))
    return out


#: Column of the raw scan that holds a record whose number of fields is not the header's.
_BROKEN = "__broken_record"


def _raw(spark: SparkSession, path: str, schema: T.StructType, header: bool, multiline: bool) -> DataFrame:
    """All columns as text under the names of the header, which is read once; ``_BROKEN`` holds unreadable records."""
    def reader():
        # quotes are doubled inside quotes, as pandas reads and writes them
        return spark.read.option("header", header).option("multiLine", multiline).option("escape", '"')

    names = reader().csv(path).columns if header else [f.name for f in schema.fields]
    lacking = [f.name for f in schema.fields if f.name not in names]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}; its header is {', '.join(names)}")
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BROKEN]])
    # every file's header is held against the first one's; whole records are parsed, else a wrong
    # number of fields goes unnoticed
    return (reader().schema(text).option("enforceSchema", False).option("columnPruning", False)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
             tokens=MISSING_TOKENS, malformed: str = "fail", multiline: bool = True) -> DataFrame:
    """Typed CSV scan; missing tokens -> null; NaN never survives in doubles.

    Columns are found by the header's names, in any order; further ones are ignored, a lacking one is
    an error, and so is a file whose header differs from the first file's. Without a header they go by place.
    Tokens must match exactly (`` NA `` is text, as in pandas). Integers may be written
    as doubles (``34.0``, as pandas does in columns with gaps) if they are integral. Any
    other text in a typed column, or a record with another number of fields, fails the read; with
    ``malformed="null"`` the value becomes null. ``read_csv_quarantined`` sets such rows aside.
    ``multiline`` allows line breaks in quotes; a file is then one task, so large inputs come in many files.
    """
    cols = []
    raw = _raw(spark, path, schema, header, multiline)
    for f, v, text in _typed(raw, schema, tokens):
        if malformed == "fail":
            v = F.when(F.col(_BROKEN).isNotNull(), F.raise_error(F.concat(
                F.lit("cannot read the record "), F.col(_BROKEN))).cast(f.dataType)).when(
                text.isNotNull() & v.isNull(), F.raise_error(F.concat(
                    F.lit(f"column {f.name}: cannot read "), text)).cast(f.dataType)).otherwise(v)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = F.nanvl(v, F.lit(None).cast(f.dataType))
        cols.append(v.alias(f.name))
    return raw.select(*cols)


def read_csv_quarantined(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                         tokens=MISSING_TOKENS, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 with a quarantine: ``(rows, quarantine)``. A row that cannot be read goes to ``quarantine`` as
    ``(reason, record)``: ``fields`` with the raw record, or ``column <name>`` with the row's texts as JSON."""
    raw = _raw(spark, path, schema, header, multiline)
    typed = _typed(raw, schema, tokens)
    reason = F.when(F.col(_BROKEN).isNotNull(), F.lit("fields"))
    for f, v, text in typed:
        reason = reason.when(text.isNotNull() & v.isNull(), F.lit(f"column {f.name}"))
    told = F.coalesce(F.col(_BROKEN), F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns if c != _BROKEN])))
    null = {f.name: F.nanvl(v, F.lit(None).cast(f.dataType)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else v
            for f, v, _ in typed}
    good = raw.where(reason.isNull()).select(*[v.alias(n) for n, v in null.items()])
    return good, raw.select(reason.alias("reason"), told.alias("record")).where("reason is not null")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN in float columns into null once, at the source (Spark ``avg`` would
    otherwise return NaN where pandas skips the value)."""
    return df.select(*[F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def load_and_clean(spark: SparkSession, train_path: str, test_path: str, schema: T.StructType,
                   target: str, alias_col: str | None = None, aliases=None) -> DataFrame:
    """S3: train and test in one table with ``is_train``, aliases normalised."""
    from foldspark.operators.clean import normalize_aliases
    tr = read_csv(spark, train_path, schema).withColumn("is_train", F.lit(True))
    te_schema = T.StructType([f for f in schema.fields if f.name != target])
    te = read_csv(spark, test_path, te_schema).withColumn(target, F.lit(None).cast("double")) \
        .withColumn("is_train", F.lit(False))
    df = tr.unionByName(te)
    if alias_col and aliases:
        df = normalize_aliases(df, alias_col, aliases)
    return df
