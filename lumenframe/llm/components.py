"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.plans.storage import materialize


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest node it sees; ``both`` regards the larger neighbours as well."""
    seen = edges.union(edges.select(F.col("b"), F.col("a"))) if both else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = seen.join(least, "a")
    if both:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root the smallest node of its component; ``edges`` has columns a, b.

    Every round is written to the shared folder. The rounds end when no edge changes; their number grows with the
    logarithm of the longest path. A node with very many neighbours is combined before the shuffle and its join is a
    plain equi-join that Spark may split.
    """
    now = materialize(edges.where("a <> b").distinct())
    mark = None
    while True:
        now = materialize(_star(_star(now, True), False))
        again = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if again == mark:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(now.select("b", "b").distinct())
        mark = again
