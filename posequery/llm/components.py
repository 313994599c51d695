"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posequery.session import cut


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of its component, for every node of ``links`` (``a, b``).

    Each turn points every node at its smallest neighbour, follows the pointers to their ends and
    contracts the links to those ends.  Tables are written between turns; nothing is collected.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node"), "points")
        while True:
            ends = points.select(F.col("node").alias("to"), F.col("to").alias("end"))
            onward = points.join(ends, "to", "left").select("node", F.coalesce("end", "to").alias("end"), "to")
            if onward.where("end <> to").isEmpty():
                break
            points = cut(onward.select("node", F.col("end").alias("to")), "points")
        if found is None:
            found = points.withColumnRenamed("to", "label")
        else:
            ends = points.select(F.col("node").alias("label"), F.col("to").alias("end"))
            found = cut(found.join(ends, "label", "left").select("node", F.coalesce("end", "label").alias("label")), "labels")
        a = points.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = points.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        ends = edges.join(a, "a").join(b, "b").where("to_a <> to_b")
        edges = cut(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
