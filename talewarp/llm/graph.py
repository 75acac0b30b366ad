"""Connected components by minimum labels with shortcuts, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sized


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (a, b); label is the smallest node reachable.

    Each round gives a node the smallest label among itself and its neighbours, then
    follows that label once, which halves the length of label chains. Labels are
    checkpointed each round, so lineage stays short and no state is lost with an
    executor. Messages are minimums that Spark pre-aggregates before the shuffle. Tasks
    are as many as the edges need, since every round has its own files.
    Rows with a null end link nothing and name no node; repeated edges count once; no
    edges give no nodes.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    rows = both.count()
    both = sized(both, rows)
    labels = checkpointed(sized(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), rows))
    changed = 1
    while changed:
        sent = sized(both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old")), rows)
        met = sent.unionByName(labels.withColumn("old", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        ahead = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        moved = sized(met, rows).join(ahead, F.col("label") == F.col("via"), "left").select("node", F.least("label", "further").alias("label"), "old")
        moved = checkpointed(sized(moved, rows))
        changed = moved.where("label < old").limit(1).count()
        labels = moved.select("node", "label")
    return labels


def joined_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after further ``edges``: components of components, so only edges between them are followed.

    Nodes that had no label get one if an edge names them.
    """
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab")
    links, rows = edges.count(), labels.count()
    between = sized(sized(edges.join(a, "a", "left"), links).join(b, "b", "left"), links).select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct()
    above = components(between).select(F.col("node").alias("label"), F.col("label").alias("above"))
    new = above.join(sized(labels.select("label").distinct(), rows), "label", "left_anti").select(F.col("label").alias("node"), F.col("above").alias("label"))
    risen = labels.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return checkpointed(sized(risen, rows).unionByName(sized(new, links)))
