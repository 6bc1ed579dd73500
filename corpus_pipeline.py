"""The corpus pipeline over ``documents``: language ID, near-duplicates, repeated spans, benchmark leaks, source mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read back as the next stage's ``docs``. A stage works on all rows that its predecessor
kept. All but the last return the columns of ``docs``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import decontaminate, jaccard_join, mixing, ppm_langid, span_dedup
from foldspark.llm.common import stored
from foldspark.sources.tables import table

#: A text whose best language model needs more bits a byte than its raw bytes is in no learned language.
MOST_BITS = 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID. Rejects null texts, texts without a letter and texts that no learned
    language explains; a null ``lang`` becomes the predicted language."""
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    found = ppm_langid.predict(docs, ppm_langid.train(docs), keep=names).toDF(*own, "lang_pred", "score", "bits")
    kept = found.where((F.col("lang_pred") != ppm_langid.UNKNOWN) & (F.col("bits") <= MOST_BITS))
    return kept.select(*[(F.coalesce(c, "lang_pred") if name == "lang" else F.col(c)).alias(name)
                         for c, name in zip(own, names)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join. Of each component the document with the smallest id stays; a
    document without words is a component of its own. Of several rows with the id that stays, the one with the
    smallest text stays. Rows without an id cannot be the smallest of a component: of those with one
    text one stays, unless a row with an id has that text."""
    names = docs.columns
    found = jaccard_join.jaccard_join(docs)
    ids = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    row = F.struct(F.col("text").alias("first"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def one(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.min(row).alias("__row")).select(
            *[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)])

    # the semi join has dealt the rows out by id already
    kept = one(docs.join(ids, F.col("doc_id") == F.col("__id"), "left_semi"), "doc_id")
    lost = docs.where("doc_id is null")
    if lost.isEmpty():
        return kept
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    known = docs.where("doc_id is not null").select(digest.alias("__known"))
    lost = lost.withColumn("__digest", digest).join(known, F.col("__digest") == F.col("__known"), "left_anti")
    return kept.unionByName(one(lost, "__digest"))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup. Repeated sentences go from the text; ``n_chars`` follows the new text.
    A document that has lost all its words goes."""
    kinds = dict(docs.dtypes)
    out = span_dedup.dedup_spans(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(
            F.col("n_chars")).cast(kinds["n_chars"]))
    return out.select(*[f"`{c}`" for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination. Rows with a verified test item go, whatever their id; rows with null text stay."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights. Rows that the mix does not take go; the others come with
    ``size, source_size, target, taken`` and ``copies``, the number of times to repeat them. Rows with the same id and
    text, null or not, are taken together or not at all; columns of these names are replaced."""
    return mixing.mix_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: Language trees and sentence spans are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
