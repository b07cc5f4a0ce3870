"""Weighted graphs as edge tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.session import shared_folder


def components(edges: DataFrame) -> DataFrame:
    """node and label (its component's least node) of every node of the edges (a, b), of any ordered type.

    Every node takes the least label around it and then that label's own label of the round before, until nothing
    changes; the second step doubles the reach. One checkpoint a round. No edges give no rows; loops and repeated edges
    do no harm.
    """
    shared_folder(edges.sparkSession)
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    both = edges.select(F.explode(ways).alias("e")).select("e.node", "e.other").distinct().checkpoint()
    labels = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")).checkpoint()
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("l"))
        least = both.join(seen, "other").groupBy("node").agg(F.min("l").alias("l"))
        nearer = labels.join(least, "node").select("node", F.least("label", "l").alias("top"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("top"), F.col("label").alias("further"))
        after = nearer.join(jump, "top").select("node", F.least("top", "further").alias("label"), "was").checkpoint()
        changed = not after.where("label <> was").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of the edges (src, dst, w); of edges given twice the heavier stays, loops go."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").unionByName(back).where("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, src before dst, with the heaviest weight."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w"))


def strength(edges: DataFrame) -> DataFrame:
    """node, degree and summed weight of symmetric edges."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def strong_edges(edges: DataFrame, least: float = 2) -> DataFrame:
    """Undirected edges of weight ``least`` or more, and each node's strongest edge (ties: the first neighbour)."""
    both = symmetric(edges)
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where("r = 1")
    return undirected(both.where(F.col("w") >= least).unionByName(best.drop("r")))


def neighbours(edges: DataFrame, k: int = 6) -> DataFrame:
    """Each node's k heaviest neighbours with their rank."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return symmetric(edges).withColumn("rank", rank).where(F.col("rank") <= k)


def ego(edges: DataFrame, node: str, first: int = 22, second: int = 3, total: int = 68) -> DataFrame:
    """node, hop: a node, its ``first`` heaviest neighbours, and ``second`` more of each, ``total`` nodes at most."""
    both = symmetric(edges)
    one = both.where(F.col("src") == node).orderBy(F.desc("w"), "dst").limit(first).select("dst", "w")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    two = both.join(one.select(F.col("dst").alias("src")), "src").join(one.select("dst"), "dst", "left_anti").where(F.col("dst") != node).withColumn("r", rank).where(F.col("r") <= second)
    two = two.groupBy("dst").agg(F.max("w").alias("w")).orderBy(F.desc("w"), "dst").limit(max(0, total - first - 1))
    me = both.sparkSession.range(1).select(F.lit(node).alias("node"), F.lit(0).alias("hop"))
    return me.unionByName(one.select(F.col("dst").alias("node"), F.lit(1).alias("hop"))).unionByName(two.select(F.col("dst").alias("node"), F.lit(2).alias("hop")))


def hub_map(edges: DataFrame, hubs: int = 24, partners: int = 5) -> DataFrame:
    """Edges among the ``hubs`` strongest nodes and ``partners`` of each."""
    both = symmetric(edges)
    top = strength(both).orderBy(F.desc("strength"), "node").limit(hubs).select("node")
    theirs = neighbours(edges, partners).join(top.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"))
    shown = top.unionByName(theirs).distinct()
    once = undirected(both)
    return once.join(shown.withColumnRenamed("node", "src"), "src", "left_semi").join(shown.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "w")


def label_propagation(edges: DataFrame, sweeps: int = 30) -> DataFrame:
    """node, label: every node takes its neighbours' heaviest label (ties: the least), all at once, until nothing
    changes or ``sweeps`` are over. A node's own label counts with its heaviest edge, which stops two-node swaps."""
    shared_folder(edges.sparkSession)
    both = symmetric(edges).checkpoint()
    labels = both.groupBy(F.col("src").alias("node")).agg(F.max("w").alias("own")).select("node", F.col("node").alias("label"), "own").checkpoint()
    for _ in range(sweeps):
        votes = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label", "w")
        votes = votes.unionByName(labels.select("node", "label", F.col("own").alias("w"))).groupBy("node", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select("node", F.col("b.label").alias("new"))
        nextl = labels.join(best, "node").select("node", F.col("new").alias("label"), "own", (F.col("label") != F.col("new")).alias("moved")).checkpoint()
        moved = nextl.where("moved").limit(1).count()
        labels = nextl.drop("moved")
        if not moved:
            break
    return labels.select("node", "label")


#: Edges of a graph that is labelled or drawn node by node on the driver, at most.
SMALL_EDGES = 50_000


def _small(edges: DataFrame) -> list[tuple]:
    rows = edges.select("src", "dst", "w").limit(SMALL_EDGES + 1).collect()
    if len(rows) > SMALL_EDGES:
        raise ValueError(f"more than {SMALL_EDGES} edges; take a network's core first, or label_propagation")
    return sorted((r["src"], r["dst"], r["w"]) for r in rows)


def family_labels(edges: DataFrame, sweeps: int = 30) -> DataFrame:
    """node, label of a small graph: nodes in turn, the strongest first (ties in order), take the heaviest label around
    them (ties: the least), and those after them see it at once, until nothing changes or ``sweeps`` are over. The
    result depends on the turns, so it is made on the driver, for networks as they are shown."""
    around: dict = {}
    for a, b, w in _small(undirected(edges)):
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    turns = sorted(around, key=lambda x: (-sum(w for _, w in around[x]), x))
    label = {x: x for x in around}
    for _ in range(sweeps):
        before = dict(label)
        for x in turns:
            votes: dict = {}
            for y, w in around[x]:
                votes[label[y]] = votes.get(label[y], 0) + w
            label[x] = min(votes, key=lambda k: (-votes[k], k))
        if label == before:
            break
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(sorted(label.items()), f"node {kind}, label {kind}")


def chord_arcs(edges: DataFrame, clusters: DataFrame, gap: float = 0.03) -> DataFrame:
    """node, cluster, strength, start, stop: the nodes' arcs around a circle from its top, in radians, as wide as their
    strength (1 at least); clusters (null last) stand together, the strongest node first, ``gap`` apart if there are
    several. clusters: node, cluster; both tables are small."""
    held = clusters.select("node", "cluster").join(strength(symmetric(edges)).select("node", "strength"), "node", "left")
    sized = held.withColumn("strength", F.greatest(F.coalesce("strength", F.lit(0)), F.lit(1)))
    everything = Window.partitionBy(F.lit(0))  # a network as shown
    order = everything.orderBy(F.col("cluster").asc_nulls_last(), F.desc("strength"), "node")
    number = F.dense_rank().over(everything.orderBy(F.col("cluster").asc_nulls_last()))
    placed = sized.withColumns({"_k": number, "_before": F.coalesce(F.sum("strength").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("strength").over(everything)})
    several = F.max("_k").over(everything)
    step = F.when(several > 1, gap).otherwise(0.0)
    unit = (2 * math.pi - step * several) / F.col("_all")
    start = -math.pi / 2 + step * (F.col("_k") - 1) + unit * F.col("_before")
    return placed.select("node", "cluster", "strength", start.alias("start"), (start + unit * F.col("strength")).alias("stop"))


def chord_ribbons(edges: DataFrame, arcs: DataFrame) -> DataFrame:
    """src, dst, w, and each end's slice of its node's arc: slices as wide as the edges' weights, in the order in which
    the other ends stand around the circle, seen from the node."""
    both = symmetric(edges)
    mid = (F.col("start") + F.col("stop")) / 2
    here = arcs.select(F.col("node").alias("src"), mid.alias("m"), "start", ((F.col("stop") - F.col("start")) / F.col("strength")).alias("unit"))
    there = arcs.select(F.col("node").alias("dst"), mid.alias("o"))
    turn = F.atan2(F.sin(F.col("o") - F.col("m")), F.cos(F.col("o") - F.col("m")))
    j = both.join(here, "src").join(there, "dst").withColumn("turn", turn)
    before = F.coalesce(F.sum("w").over(Window.partitionBy("src").orderBy(F.desc("turn"), "dst").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = j.select("src", "dst", "w", (F.col("start") + F.col("unit") * before).alias("a"), (F.col("start") + F.col("unit") * (before + F.col("w"))).alias("b"))
    back = slots.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("a").alias("dst_start"), F.col("b").alias("dst_stop"))
    return slots.where("src < dst").join(back, ["src", "dst"]).select("src", "dst", "w", F.col("a").alias("src_start"), F.col("b").alias("src_stop"), "dst_start", "dst_stop")


def families(labels: DataFrame, least: int = 3, top: int = 8) -> DataFrame:
    """The ``top`` largest labels with ``least`` nodes or more: label, size."""
    return labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least).orderBy(F.desc("size"), "label").limit(top)


def sunflower(nodes: DataFrame, order: list[str], spacing: float = 10.0) -> DataFrame:
    """x and y on a sunflower's spiral by rank; for small node tables (one window over all)."""
    k = F.row_number().over(Window.orderBy(*order)) - 1
    angle = k * F.lit(2.399963229728653)
    return nodes.withColumns({"x": F.sqrt(k) * spacing * F.cos(angle), "y": F.sqrt(k) * spacing * F.sin(angle)})
