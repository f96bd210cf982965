"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) long. Returns (node, root): each node that has a link, with the smallest node it reaches.

    Every round hangs neighbours on the smallest neighbour they know; both stars keep the components as they are.
    A star of any size is only ever a min aggregate and a join on its centre, so hot nodes are not gathered.
    Rounds are logarithmic in the longest path; each is written to the shared folder. Null ends and loops are ignored.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "cc-small")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    leaves = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return materialize(leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "cc-roots")
