"""Connected components by alternating large and small stars; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyte.llm.shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge (a, b): root is the smallest vertex that v reaches.

    Each vertex points at the least of its neighbours (large star: the larger neighbours move there; small star: the
    smaller ones do) until nothing changes, which takes a number of rounds logarithmic in the vertices. Edges with a
    null end are left out; loops make no row; repeated edges do no harm.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = None
    while (at := state(now)) != before and at[0]:
        before = at
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        old, now = now, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old, large)
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("v"), F.col("v").alias("root")).distinct())
