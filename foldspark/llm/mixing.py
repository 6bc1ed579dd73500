"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a budget of words. Whole repeats of a source are taken outright;
the rest of its budget is met by keeping the documents whose hash lies below a
threshold. The threshold is found without sorting documents: sizes are summed per
(source, hash bucket), the buckets that fit the budget whole are kept, and only
the one boundary bucket of each source is refined by its next hash digits. The
thresholds are nested: a larger budget keeps a superset of the documents.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import stored

#: Hash digits per level (hexadecimal) and levels; 4096 buckets, refined four times (60 bits).
DIGITS, LEVELS = 3, 5
#: Weights by rank of the source, repeating. Fixed values of the query.
WEIGHTS = (1, 2, 3)
#: No document is repeated more often than this. Fixed value of the query.
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of the whole text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Sources by code point, null last, weigh ``weights``, repeating, and share the sum
    of all sizes; a target stops at ``most`` times its source's size and the excess
    is shared again by weight among the others until no target is above. This is
    water filling: with sources in order of size to weight, a source is capped
    exactly if its cap is at most its share of what the caps before it leave. The
    windows run over one row per source, not over documents.
    """
    n = len(weights)
    ranked = sizes.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % n + 1).cast("int"))
    w = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    w = (w.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
          .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
          .withColumn("open", F.sum("weight").over(after))
          .withColumn("capped", F.col("cap").cast("decimal(18,0)") * F.col("open").cast("decimal(18,0)")
                      <= F.col("left").cast("decimal(18,0)") * F.col("weight").cast("decimal(18,0)")))
    # the uncapped sources are a suffix of the order; the first of them fixes the common share
    first = F.max(F.when(~F.col("capped"), F.struct(F.col("open"), F.col("left")))).over(Window.partitionBy())
    return w.withColumn("s", first).select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
            (F.col("s.left") * F.col("weight")).cast("double") / F.col("s.open")).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame, levels: int = LEVELS, digits: int = DIGITS) -> DataFrame:
    """``source, below``: a document of the source is kept if its ``h`` is less than ``below``.

    ``docs``: ``source, size, h`` (hash as hexadecimal text of ``levels * digits``
    digits or more); ``budgets``: ``source, budget`` in words. At each level one
    aggregation sums the sizes by (source, next digits) over the documents in the
    sources' boundary buckets only. Sources are compared null-safe. The kept
    words never exceed the budget and fall short of it by less than the
    words that share the boundary hash prefix of the last level.
    """
    state = budgets.select("source", F.col("budget").cast("double").alias("room"), F.lit("").alias("prefix"))
    for _ in range(levels):
        inside = docs.join(state, docs["source"].eqNullSafe(state["source"])
                           & docs["h"].startswith(state["prefix"])).select(
            docs["source"], "size", F.substring("h", F.length("prefix") + F.lit(1), F.lit(digits)).alias("bucket"))
        hist = inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        cum = hist.withColumn("upto", F.sum("words").over(run))
        cum = cum.withColumnRenamed("source", "src")
        # the boundary bucket is the first that overshoots; none: everything below fits
        step = cum.join(state, cum["src"].eqNullSafe(state["source"])).where("upto > room").groupBy("source").agg(
            F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("used"))).alias("b"))
        state = stored(state.withColumnRenamed("source", "src0").join(
            step, F.col("src0").eqNullSafe(F.col("source")), "left").select(
            F.col("src0").alias("source"),
            (F.col("room") - F.coalesce("b.used", F.lit(0))).alias("room"),
            F.when(F.col("b").isNull(), F.concat("prefix", F.lit("g"))).otherwise(
                F.concat("prefix", "b.bucket")).alias("prefix")), "mix-thresholds")
    return state.select("source", F.col("prefix").alias("below"))


def hash_of(doc_id: Column, text: Column) -> Column:
    """``DIGITS * LEVELS`` hexadecimal digits from a document's id and text; nulls hash like empty texts."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit(""))))
    return F.substring(F.md5(own), 1, DIGITS * LEVELS)


def plan_sources(rows: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, levels: int = LEVELS) -> DataFrame:
    """``src, source_size, target, whole, below``, a stored row a source, for rows ``source, size, h``: each document
    is taken ``whole`` times, and once more if its ``h`` is less than ``below``."""
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
                     .withColumn("whole", F.when(F.col("source_size") > 0,
                                                 F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
                     .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")),
                     "mix-targets")
    below = thresholds(rows, targets.select("source", "budget"), levels)
    plan = targets.join(below.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return stored(plan.select(F.col("source").alias("src"), "source_size", "target", "whole", "below"), "mix-plan")


def taken(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``rows`` with their source's plan and ``copies``, how often each is taken."""
    copies = F.least(F.lit(most), F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
    return rows.join(plan, rows["source"].eqNullSafe(plan["src"])).withColumn("copies", copies.cast("int"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (words taken, repeats counted) and ``copies``.

    Reads ``doc_id, text, source`` only. A document is taken ``floor(target /
    source_size)`` times, once more if its hash (of its id and text) lies below its
    source's threshold. Null text and text without words: size 0, taken 0. Null source:
    a source of its own, last in order. A source without words has target 0. Rows with the
    same id and text follow each other by a number that the stored table gives them, so the
    threshold can fall between two of them; how many are taken does not depend on their order. An empty
    table gives an empty result.
    """
    own = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                      hash_of(F.col("doc_id"), F.col("text")).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = stored(own.withColumn("h", F.concat("h", F.substring(F.md5(F.col("row").cast("string")), 1, DIGITS * LEVELS))),
                  "mix-sizes").drop("row")
    out = taken(rows, plan_sources(rows, weights, most, 2 * LEVELS), most)
    return out.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mix_rows(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The documents that the mix takes, all their columns and ``size, source_size, target, taken, copies``.

    The rows of ``docs`` are read twice and never shuffled: the plan has a row a source. Rows that share id and text are
    taken or left together. Columns of ``docs`` with these names are replaced."""
    new = ["size", "source_size", "target", "taken", "copies"]
    keep = [c for c in docs.columns if c not in new]
    hashed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("source").alias("source"),
                         word_count(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))
    plan = plan_sources(stored(hashed.select("source", "size", "h"), "mix-sizes"), weights, most)
    out = taken(hashed, plan, most).where("copies > 0").withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *new)
