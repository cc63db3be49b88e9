"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """`node`, `root` (smallest node reachable) for every node of the links (`a`, `b`).

    Every round each node takes the smallest root among its neighbours and then the root of that
    root, until nothing changes. Minima are combined before the shuffle, and rounds are written, so a
    node with very many links stays spread and a lost executor costs one round at most.
    """
    both = stored(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    roots = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        .select("node", F.least("node", "root").alias("root")), "roots")
    while True:
        near = (
            both.join(roots, F.col("b") == F.col("node"))
            .groupBy("a").agg(F.min("root").alias("near"))
        )
        hooked = stored(
            roots.join(near, F.col("node") == F.col("a"))
            .select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "hooked")
        above = hooked.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = stored(
            hooked.join(above, F.col("root") == F.col("up"), "left")
            .select("node", "old", F.least("root", "top").alias("root")), "roots")
        changed = jumped.where("old <> root").limit(1).count()
        roots = jumped.select("node", "root")
        if not changed:
            return roots
