"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list.

    root is the smallest node of the component. Alternates large-star and
    small-star rounds (Kiveris and others, 2014), which hang a node's larger
    neighbours, then its smaller ones, under its smallest neighbour; rounds end
    when the edges stay the same. A hub's neighbours never stand in one row: a
    round is a minimum by node and a join, which Spark can split. Each round's
    edges are written to the shared folder. Nulls and loops link nothing.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = materialize(now, "edges")

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    seen = signature(now)
    while seen[0]:
        # Large star: each node's larger neighbours go under its smallest neighbour or itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours go under the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        now = materialize(small.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        before, seen = seen, signature(now)
        if seen == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
