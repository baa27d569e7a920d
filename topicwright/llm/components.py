"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for each end v of edges (u, v): c is the least vertex that edges lead to.

    Each round every vertex takes the least label of itself, its neighbours and
    its label's label; rounds end when none changes. Tables are written to the
    shared folder after each round; only the number of changes reaches the
    driver. Edges with a null end are left out.
    """
    both = materialise(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u is not null and v is not null").distinct(), "edges")
    table = labels = materialise(both.groupBy("u").agg(F.min("v").alias("c")).select(F.col("u").alias("v"), F.least("u", "c").alias("c")), "labels")
    while True:
        near = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("c").alias("near"))
        up = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        # the old label's vertex hears of the new one, so that trees merge at their roots
        joined = labels.join(near, "v").join(up, "c")
        best = joined.select("v", "c", F.least("near", "up", "c").alias("best"))
        roots = best.groupBy("c").agg(F.min("best").alias("root")).select(F.col("c").alias("v"), "root")
        after = materialise(best.join(roots, "v", "left").select("v", F.least("best", F.coalesce("root", "best")).alias("c"), (F.least("best", F.coalesce("root", "best")) < F.col("c")).alias("moved")), "labels")
        labels = after.select("v", "c")
        discard(table)
        table = after
        if after.filter("moved").isEmpty():
            discard(both)
            return labels
