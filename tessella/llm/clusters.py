"""Links between nodes that share buckets, found without pairing a bucket out.

In the first round each bucket compares its members with its smallest node, and confirmed
links are merged into components. Then those outside the bucket's largest component (or,
of more than PIVOTS, one for each of PIVOTS slots) are its pivots, and members meet pivots
of other components in a join that lets through only what the nodes' own columns allow.
Two members of one component need no comparison; rounds go on until each bucket's members
that were no pivot are in one component (after one round, but for huge buckets), so no
link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut
from tessella.llm.components import connected

PIVOTS = 1024


def members_of(spread: DataFrame, some: str = "true") -> DataFrame:
    """Nodes of keys that several have, one of them with ``some``: bucket, node, pivot (the key's smallest node); the keys are shuffled once.

    Nodes that link share most of their keys. Keys that the same nodes have are one bucket,
    which is named by its nodes, so nodes meet once and not under each key. Were two buckets to
    get one name, their nodes would meet needlessly; no link depends on it.
    """
    own = Window.partitionBy("bucket")
    nodes = F.struct(F.bit_xor(F.xxhash64("node")).over(own), F.count(F.lit(1)).over(own), F.min("node").over(own), F.max("node").over(own))
    met = spread.select("node", nodes.alias("nodes"), F.max(F.expr(some)).over(own).alias("met")).where("met").select("node", "nodes.*").toDF("node", "mixed", "shared", "pivot", "last").where("pivot < last")
    return met.select(F.xxhash64("mixed", "shared", "pivot", "last").alias("bucket"), "node", "pivot").distinct()


def merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) after some more links (a, b): only the components that these meet are joined."""
    if parts is None:
        return cut(connected(links, "a", "b"))
    part = lambda p: parts.select(F.col("node").alias(p), F.col("component").alias(f"{p}_part"))
    ends = links.join(part("a"), "a", "left").join(part("b"), "b", "left")
    ends = cut(ends.select("a", "b", F.coalesce("a_part", "a").alias("a_part"), F.coalesce("b_part", "b").alias("b_part")))
    moved = cut(connected(ends, "a_part", "b_part")).withColumnRenamed("node", "component").toDF("component", "to")
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_part").alias("component")), F.struct(F.col("b").alias("node"), F.col("b_part").alias("component")))).alias("x")).select("x.*")
    every = parts.unionByName(new).unionByName(new.select(F.col("component").alias("node"), "component")).distinct()
    return cut(every.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def components_of(members: DataFrame, nodes: DataFrame, known: DataFrame, may_link: Callable[[str, str], Column], linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Columns node and component of the nodes that links join.

    ``members`` has bucket, node and pivot (the bucket's smallest node), ``nodes`` what
    ``may_link`` compares (it takes the prefixes of two nodes' columns), ``known`` links
    (a, b) that need no comparison, and ``linked`` confirms pairs (a, b).
    """
    own = [c for c in nodes.columns if c != "node"]

    def side(p: str) -> DataFrame:
        return nodes.select(F.col("node").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in own])

    first = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    tried = cut(first.join(side("a"), "a").join(side("b"), "b").where(may_link("a_", "b_")).select("a", "b"))
    parts = merged(None, linked(tried).unionByName(known))
    # rounds over the buckets whose members are not yet in one component
    state = members.select("bucket", "node", (F.col("node") == F.col("pivot")).alias("done"))
    while True:
        state = state.join(parts, "node", "left").select("bucket", "node", "done", F.coalesce("component", "node").alias("component"))
        # a bucket is settled when one component is left among the members that were no pivot
        open_ = state.where("NOT done")
        left = open_.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        open_ = cut(open_.join(left, "bucket").select("bucket", "node", "component"))
        if open_.isEmpty():
            break
        sizes = open_.groupBy("bucket", "component").count()
        main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("main"), (F.sum("count") - F.max("count")).alias("others"))
        outside = open_.join(main, "bucket").where("component <> main")
        slot = F.when(F.col("others") <= PIVOTS, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(PIVOTS)))
        pivots = cut(outside.groupBy("bucket", slot.alias("slot")).agg(F.min("node").alias("pivot")).select("bucket", "pivot"))
        asked = pivots.join(open_.select("bucket", F.col("node").alias("pivot"), F.col("component").alias("pivot_component")), ["bucket", "pivot"]).join(side("pivot"), "pivot")
        met = open_.join(side("node"), "node").join(asked, "bucket").where((F.col("component") != F.col("pivot_component")) & may_link("node_", "pivot_"))
        pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        new = cut(pairs.join(tried, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            tried = tried.unionByName(new)
            links = linked(new)
            if not links.isEmpty():
                parts = merged(parts, links)
        # where all outside the largest component were pivots, the bucket is settled
        huge = cut(main.where(F.col("others") > PIVOTS).select("bucket"))
        if huge.isEmpty():
            break
        state = open_.join(huge, "bucket").join(pivots.withColumnRenamed("pivot", "node"), ["bucket", "node"], "left_anti").select("bucket", "node", F.lit(False).alias("done"))
    return parts
