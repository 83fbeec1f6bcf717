"""Connected components of a large edge list, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import discard, stage


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge; root is the smallest node of its component.

    Alternating large-star and small-star rounds: every round hangs each node's
    larger, then its smaller-or-equal neighbours on its smallest neighbour, until
    nothing moves, which takes a number of rounds logarithmic in the node count.
    Only a minimum is kept per node (a map-side aggregate), so a hub's neighbours
    never meet in one task; a hub's rows in the join are split by AQE.  Each
    round's edges are written to the shared folder, and the round before is deleted.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, path = stage(now, "edges")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u hang on m
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u's smaller neighbours, and u itself, hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        nxt, nxt_path = stage(small.where("u <> v").distinct(), "edges")
        moved = nxt.join(now, ["u", "v"], "left_anti").limit(1).count()
        size = moved or now.join(nxt, ["u", "v"], "left_anti").limit(1).count()
        discard(spark, path)
        now, path = nxt, nxt_path
        if not size:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tree = now.groupBy("u").agg(F.min("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return tree.select(F.col("u").alias("node"), "root").unionByName(roots)
