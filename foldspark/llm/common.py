"""Helpers that several operators share: the shared folder, tables that cut lineage, components."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foldspark.sources.scratch import discard, release, shared_path, stored  # noqa: F401  (used by the operators)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(a, b)``.

    ``component`` is the smallest node reachable. Rounds of large-star and
    small-star rewrite the edge table until it is a set of stars: every step is a
    ``min`` per node with map-side combine and an equi-join that adaptive
    execution splits when one node holds many edges. Each round's table is written
    to the shared folder. Null ends and self-loops add nothing; repeated
    edges count once.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
                        ).select("e.u", "e.v")

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a is not null and b is not null and a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    cur = stored(tidy(edges.select("a", "b")), name)
    last = None
    while True:
        # large star: every larger neighbour of u points at the smallest of u and its neighbours
        near = both(cur)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        mid = stored(tidy(large), name)
        # small star: u and its smaller neighbours point at the smallest of them
        low = mid.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = mid.withColumnRenamed("a", "u").join(low, "u")
        new = tidy(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                   .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        # the table's count and checksum come out of the job that writes it
        seen = Observation()
        new = stored(new.observe(seen, F.count("*").alias("n"),
                                 F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), name)
        sign = (seen.get["n"], seen.get["h"])
        discard(cur)
        discard(mid)
        cur = new
        if sign == last:
            break
        last = sign
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
