"""Connected components by contraction along smallest edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut_lineage, release


def _canonical(edges: DataFrame) -> DataFrame:
    """Every edge once, the smaller end first; of edges that became the same in contraction one original stands for all."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "edge")
    return e.groupBy("a", "b").agg(F.min("edge").alias("edge"))


def spanning_forest(edges: DataFrame, keep_forest: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(labels, forest) of the graph with edges ``(a, b)`` of orderable node ids.

    ``labels`` (node, root) has every node with an edge to another node; ``forest`` (a, b) holds the
    chosen edges between the given nodes: one less than nodes per component, and they connect it. Each
    round every node picks its smallest edge, the picked edges (a forest, as edges are totally ordered)
    are collapsed by pointer doubling, and the remaining edges are renamed and made distinct, so the
    number of nodes with edges at least halves. Every round is written to the shared checkpoint folder,
    and files of rounds that nothing reads any more are deleted. Loops, repeated edges and edges with
    null ends are ignored.
    """
    given = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    left = cut_lineage(_canonical(given.withColumn("edge", F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))))
    labels: DataFrame | None = None
    forest: DataFrame | None = None
    while not left.isEmpty():
        e = F.struct("a", "b", "edge").alias("e")
        ends = left.select(F.col("a").alias("v"), e).unionByName(left.select(F.col("b").alias("v"), e))
        picked = cut_lineage(ends.groupBy("v").agg(F.min("e").alias("e")))
        # v points at the other end; of two nodes that picked the same edge, the smaller one is a root.
        other = F.when(F.col("v") == F.col("e.a"), F.col("e.b")).otherwise(F.col("e.a"))
        back = picked.select(F.col("v").alias("o"), F.col("e.a").alias("oa"), F.col("e.b").alias("ob"))
        up = picked.select("v", other.alias("up"), F.col("e.a").alias("ea"), F.col("e.b").alias("eb"))
        mutual = up.join(back, F.col("up") == F.col("o"))
        root = (F.col("oa") == F.col("ea")) & (F.col("ob") == F.col("eb")) & (F.col("v") == F.col("ea"))
        parent = cut_lineage(mutual.select("v", F.when(root, F.col("v")).otherwise(F.col("up")).alias("up")))
        if keep_forest:
            chosen = picked.select("e.edge.a", "e.edge.b").distinct()
            forest = chosen if forest is None else forest.unionByName(chosen)
        moved = True
        while moved:
            hop = parent.select(F.col("v").alias("up"), F.col("up").alias("top"))
            higher = cut_lineage(parent.join(hop, "up").select("v", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            moved = not higher.where("moved").isEmpty()
            release(parent)
            parent = higher
        named = parent.select(F.col("v").alias("node"), F.col("up").alias("root"))
        if labels is None:
            labels = cut_lineage(named)
        else:
            higher = named.select(F.col("node").alias("root"), F.col("root").alias("top"))
            old, labels = labels, cut_lineage(labels.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
            release(old)
        ra, rb = (named.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab")
        old, left = left, cut_lineage(_canonical(left.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "edge")))
        release(old, parent, *([] if keep_forest else [picked]))
    if labels is None:
        kind = left.schema["a"].dataType
        spark = left.sparkSession
        labels = spark.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
        forest = spark.createDataFrame([], f"a {kind.simpleString()}, b {kind.simpleString()}")
    return labels, forest


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id of its component for every node with an edge."""
    labels, _ = spanning_forest(edges, keep_forest=False)
    low = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(low, "root").select("node", "component")
