"""Distributed union-find: connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """e: a > b in every row."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    j = e.join(least, "a")
    return j.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """edges: (a, b) of one orderable type, in any direction, loops and repeats allowed. Returns (node, component) for
    every node that has an edge to another; component is the least node reached. Each round writes its edges, so a lost
    executor costs a round at most. Rounds end when every node has one edge, to a node that has none."""
    now = scratch.write(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(rounds):
        # a node with two edges, or one whose end has an edge itself, isn't settled
        ends = now.select("a", F.lit(1).alias("out"), F.lit(0).alias("end")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("end")).distinct())
        loose = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("end").alias("end")).where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("end") == 1)))
        if loose.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        new = scratch.write(_small(_large(now).where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "cc")
        scratch.drop(now)
        now = new
    raise RuntimeError("the components didn't settle")


#: Keys up to which they are sent to every executor (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def stars(banded: DataFrame, scratch: Scratch) -> DataFrame:
    """banded: (key, node), distinct. (lead, node), distinct: the nodes that share a key with a lead. Each key that two
    nodes hold has one lead, the node whose keys are held most often in sum, the least of such: among copies of one text
    that is the text they come from, to which they are more similar than to each other. Keys that mostly the same nodes
    hold so become one star."""
    ends = banded.repartition("key").groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"))
    shared = scratch.write(ends.where(F.col("lo") != F.col("hi")), "shared")
    # most keys have two nodes, which are their ends: only the others' nodes are looked up
    many = shared.where(F.col("n") > 2).select("key", "n")
    few = many.count() <= BROADCAST_ROWS
    rest = banded.join(F.broadcast(many), "key") if few else banded.join(many.hint("shuffle_hash"), "key")
    two = shared.where(F.col("n") == 2).select("key", F.explode(F.array("lo", "hi")).alias("node"), "n")
    members = scratch.write(two.unionByName(rest.select("key", "node", "n")), "sized")
    crowd = members.groupBy("node").agg(F.sum("n").alias("crowd"))
    ranked = scratch.write(members.join(crowd, "node").select("key", "node", "crowd"), "ranked")
    lead = ranked.groupBy("key").agg(F.min(F.struct(-F.col("crowd"), "node")).alias("m")).select("key", F.col("m.node").alias("lead"))
    out = scratch.write(ranked.join(lead, "key").where(F.col("lead") != F.col("node")).select("lead", "node").distinct(), "stars")
    scratch.drop(shared, members, ranked)
    return out


#: Nodes of one block of a star that is compared block by block, and the bytes of their texts.
BLOCK, BLOCK_BYTES = 256, 2 << 20
#: Pairs of blocks handed to Python at a time.
BLOCK_ROWS = 8


def link_stars(spokes: DataFrame, score: Callable[[DataFrame], DataFrame], blocks: Callable[[DataFrame], DataFrame], scratch: Scratch, reach: float = 1.0) -> DataFrame:
    """(node, component) of the similarity that score and blocks decide; candidates are the pairs within a star.

    score: (lead, node) -> (lead, node, sim, linked, size, ...), for every spoke once; size is in bytes what a node brings
    to a block, and further columns go to blocks. Spokes that aren't linked, neither to their lead nor through others, are then compared with all other nodes
    of the star: blocks gets rows (lead, i, j, left, right, open, node, c, sim, ...), c the component so far, and
    returns edges between the components of a left and a right node of the same (lead, i, j); two open nodes meet both ways round. Pairs whose sims differ by more than
    reach need no comparison: where sim is a similarity whose complement is a metric, that is exact for
    reach = 1 - threshold. Each pair of a star is decided however many nodes the star holds, by work that grows with the
    spokes left open times the star; pairs that fail are never rows, and links between the same two components are one.
    """
    decided = scratch.write(score(spokes), "decided")
    found = scratch.write(components(decided.where("linked").select(F.col("lead").alias("a"), F.col("node").alias("b")), scratch), "found")
    of = lambda n, c: found.select(F.col("node").alias(n), F.col("component").alias(c))
    # what the blocks are given comes by its spoke, for the stars that are compared alone
    own = [x for x in decided.columns if x not in ("lead", "linked", "size")]
    rest = decided.select("lead", "node", "sim", "size").join(of("node", "c"), "node", "left").join(of("lead", "cl"), "lead", "left")
    rest = scratch.write(rest.select("lead", "node", "sim", "size", F.coalesce("c", "node").alias("c"), F.coalesce("cl", "lead").alias("cl")), "rest")
    open_ = F.col("c") != F.col("cl")
    leads = rest.groupBy("lead").agg(F.max(F.when(open_, F.col("sim"))).alias("most"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    leads = leads.where(F.col("most").isNotNull() & (F.col("lo") != F.col("hi"))).select("lead", "most", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("n"))
    left = rest.drop("size").join(leads, "lead").where(F.col("sim") <= F.col("most") + F.lit(reach))
    if set(own) - {"node", "sim"}:
        left = left.join(decided.drop("sim", "linked", "size"), ["lead", "node"])
    at = F.pmod(F.xxhash64("node", "lead"), F.col("n")).cast("int")
    every = F.sequence(F.lit(0), F.col("n") - 1)
    # an open node is left in its own row of blocks, and each node is right in its own column of them
    cells = F.transform(every, lambda k: F.struct(at.alias("i"), k.alias("j"), F.lit(True).alias("left"), (k == at).alias("right")))
    other = F.transform(every, lambda k: F.struct(k.alias("i"), at.alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    dealt = left.select("lead", "c", *own, open_.alias("open"), F.explode(F.when(open_, F.concat(cells, F.filter(other, lambda x: x["i"] != at))).otherwise(other)).alias("x")).select("lead", "x.*", "open", "c", *own)
    with small_batches(spokes.sparkSession, BLOCK_ROWS):
        more = scratch.write(blocks(dealt).distinct(), "more")
    merged = components(more, scratch).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    alone = merged.select(F.col("component").alias("node"), "component").join(found.select("node"), "node", "left_anti")
    out = scratch.write(found.unionByName(alone).join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "classes")
    scratch.drop(decided, found, rest, more)
    return out
