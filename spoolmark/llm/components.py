"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolmark.llm.tables import Workspace


def connected_components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the smallest node names it.

    Alternating large and small stars: every node with its neighbours points to
    the smallest of them, first the larger neighbours, then the smaller ones.
    The number of rounds grows with the logarithm of a component's size. Each
    round is a minimum per node, combined before the shuffle, and a join back,
    which adaptive execution splits where one node has very many links. Rounds
    are cut by written tables. Links with a null end are left out; a link of a
    node to itself makes a component of one.
    """
    links = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = work.keep(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    while True:
        both = now.union(now.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                )
            ).alias("s")
        )
        after = work.keep(small.select("s.a", "s.b").where("a <> b").distinct(), "links")
        work.drop(now)
        now = after
        # Done when every node points to one other, which points to none.
        each = now.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        roots = now.select(F.col("b").alias("a"), F.lit(True).alias("root")).distinct()
        if each.join(roots, "a", "left").where("low <> high OR root").isEmpty():
            break
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return found.union(roots).union(alone).groupBy("node").agg(
        F.min("component").alias("component")
    )
