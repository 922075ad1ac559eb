"""Connected components of links, as joins and aggregations over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import cut, done


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node reachable, for every node of links (a, b) but those that are least themselves; written.

    Large and small stars alternate: neighbours are linked to the least neighbour, first the larger
    ones, then the smaller, until every component is one star. The number of rounds grows with the
    logarithm of the longest path; each round is written, so lineage stays short.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    before, written = None, None
    while True:
        edges = cut(edges, "links")
        if written is not None:
            done(written)
        written = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            stars = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("least")), "stars")
            done(edges)
            return stars
        before = now
        # large star: each node's larger neighbours are linked to the least of the node and its neighbours
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")).withColumnRenamed("a", "node")
        large = both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # small star: each node's smaller neighbours and itself are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "node")
        small = large.join(least, F.col("a") == F.col("node")).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        edges = small.select("e.a", "e.b").filter("a != b").distinct()
