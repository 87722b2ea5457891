"""Embedding near-dedup (operator 1): NN-descent over a distributed neighbour graph.

Equal vectors are one node. The graph starts from orders of the nodes along random hyperplane codes, cut into blocks of
neighbours, and is refined by local joins: the neighbours of a node, forward and reverse, are each other's candidates,
are scored in one block, and every node keeps its best K. Only lists that hold a new neighbour are joined again, and rounds
stop when the edges over the threshold stop growing. A node whose whole list lies over the threshold is saturated: its
list is enlarged to all that its component of such edges holds, found block by block. Recall is then audited against
brute force, and rounds from further orders follow until it is high enough; a recall that stays too low is an error.
Edges over the threshold, decided in double precision, give links and components. Vectors of each length have a graph
of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, settle, small_batches, table
from .graph import components

THRESHOLD = 0.9
#: The graph holds half-precision copies of the unit vectors; edges are decided from the vectors themselves.
SLACK = 4e-3
K = 8
#: Members of one local join; longer lists are sampled anew each round.
JOIN = 64
ORDERS, BLOCK, PLANES = 10, 96, 62
ROUNDS, LEAST_GAIN = 10, 0.005
#: Members of one block of a saturated component.
CROWD = 512
#: Rounds from further orders follow up to REFINED times while the audit finds less than MIN_RECALL of the links; less
#: than LEAST_RECALL after them is an error.
MIN_RECALL, REFINED, LEAST_RECALL = 0.97, 4, 0.9
#: Queries of the audit, at most (those with the least hashes among ids divisible by 100).
AUDIT = 1024

EDGE = "x long, y long, sim float"


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


class RecallTooLow(RuntimeError):
    """The audit found too few of the links after every round that is allowed."""


def node_of(vec: Column, salt: int = 0) -> Column:
    return F.xxhash64(vec, F.lit(salt))


def lengths(rows: DataFrame) -> list[int]:
    """Lengths of more than one vector, ascending: a model gives vectors of one length, so there are few."""
    return sorted(r["d"] for r in rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().where("count > 1").collect())


def vectors(rows: DataFrame, d: int) -> DataFrame:
    """vec_id, d, node (hash of the vector's bytes), vec (double precision bytes): the rows whose vector can link: not
    null, of length d, finite and not zero."""
    size = F.size("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column("embedding")
            x = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(col), -1)
            ok = np.isfinite(x).all(1) & (np.abs(x).max(1) > 0)
            x = x[ok] + 0.0  # -0.0 and 0.0 are one
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(ok)), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "vec"])

    whole = rows.where((size == d) & ~F.exists("embedding", lambda v: v.isNull())).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return whole.mapInArrow(run, "vec_id long, vec binary").select("vec_id", F.lit(d).alias("d"), node_of(F.col("vec")).alias("node"), "vec")


def distinct_nodes(own: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """own, and its nodes with vec, copies, least vec_id and audited. Where different vectors have one hash, all but the
    least get another, until none do."""
    salt = 0
    while True:
        every = own.groupBy("node").agg(F.first("d").alias("d"), F.min("vec").alias("vec"), F.max("vec").alias("last"), F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.max(F.coalesce(F.pmod("vec_id", F.lit(100)) == 0, F.lit(False))).alias("audited"))
        nodes = scratch.write(every.withColumn("torn", F.col("vec") != F.col("last")).drop("last"), "found")
        torn = nodes.where("torn").select("node", F.col("vec").alias("__first"))
        if torn.isEmpty():
            return own, nodes.drop("torn")
        salt += 1
        moved = F.when(F.col("__first") != F.col("vec"), node_of(F.col("vec"), salt)).otherwise(F.col("node"))
        own = scratch.write(own.join(torn, "node", "left").select("vec_id", "d", moved.alias("node"), "vec"), "own")
        scratch.drop(nodes)


def seed_edges(nodes: DataFrame, first: int, orders: int = ORDERS) -> DataFrame:
    """Neighbours within blocks of each order of the nodes. nodes: node, half."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("half"), np.float16).astype(np.float32)
            for o in range(first, first + orders):
                planes = np.random.Generator(np.random.PCG64([o, x.shape[1]])).standard_normal((x.shape[1], PLANES)).astype(np.float32)
                code = ((x @ planes > 0).astype(np.int64) << np.arange(PLANES, dtype=np.int64)[::-1]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o), pa.int32()), pa.array(code), b.column("node"), b.column("half")], ["o", "code", "node", "half"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table):
            x = _matrix(t.column("half").combine_chunks(), np.float16).astype(np.float32)
            ids = t.column("node").to_numpy()
            s = x @ x.T
            s[ids[:, None] == ids] = -2  # a block where one order ends and the next begins can hold a node twice
            k = min(K, len(ids) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel().astype(np.float32))], ["x", "y", "sim"])

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= BLOCK:
                t = pa.Table.from_batches(held)
                whole = t.num_rows // BLOCK * BLOCK
                for i in range(0, whole, BLOCK):
                    yield out(t.slice(i, BLOCK))
                held = t.slice(whole).to_batches()
        t = pa.Table.from_batches(held) if held else None
        if t is not None and t.num_rows > 1:
            yield out(t)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = nodes.mapInArrow(codes, "o int, code long, node long, half binary")
    found = coded.repartitionByRange(n, "o", "code", "node").sortWithinPartitions("o", "code", "node").select("node", "half").mapInArrow(blocks, EDGE)
    return found.where(F.col("x") != F.col("y"))


def best(edges: DataFrame) -> DataFrame:
    """Each node's K best distinct neighbours. edges: x, y, sim, new."""
    one = edges.groupBy("x", "y").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    lists = one.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "y", "new")), asc=False), 1, K).alias("l"))
    full = F.size("l") >= K
    return lists.select("x", full.alias("full"), F.when(full, F.element_at("l", -1)["sim"]).otherwise(F.lit(-2.0).cast("float")).alias("worst"), "l")


def saturated(near: DataFrame, lists: DataFrame, nodes: DataFrame, low: float, scratch: Scratch) -> DataFrame:
    """Pairs (x, y) over low within each component of near that holds a saturated node."""
    found = scratch.write(components(near.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch), "found")
    full = lists.where(F.col("full") & (F.col("worst") >= low)).select(F.col("x").alias("node"))
    some = found.join(full, "node").groupBy("component").agg(F.lit(1).alias("one")).select("component")
    members = scratch.write(found.join(some, "component"), "members")
    n = members.groupBy("component").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("n"))
    dealt = members.join(n, "component").select("component", "node", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("t"))
    dealt = dealt.select("component", "node", F.least("h", "t").alias("i"), F.greatest("h", "t").alias("j"), (F.col("h") <= F.col("t")).alias("left"), (F.col("h") >= F.col("t")).alias("right"))
    rows = dealt.join(nodes, "node").groupBy("component", "i", "j").agg(F.collect_list(F.struct("left", "right", "node", "half")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            for m in b.column("m"):
                flat = m.values
                ids, left, right = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("node", "left", "right"))
                x = _matrix(flat.field("half"), np.float16).astype(np.float32)
                i, j = np.nonzero(x[left] @ x[right].T >= low)
                a, c = ids[left][i], ids[right][j]
                # in a block against itself each pair comes once
                keep = (a < c) | ((a > c) & ~(np.isin(a, ids[right]) & np.isin(c, ids[left])))
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(c[keep])], ["x", "y"])

    return rows.select("m").mapInArrow(run, "x long, y long")


def local_joins(lists: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Candidates (x, y, sim) that would enter x's list. lists: x, full, worst, l."""
    fwd = lists.select(F.col("x").alias("v"), F.explode("l").alias("e")).select("v", F.col("e.y").alias("id"), F.col("e.new").alias("new"))
    both = fwd.unionByName(fwd.select(F.col("id").alias("v"), F.col("v").alias("id"), "new"))
    deg = both.groupBy("v").agg(F.count("*").alias("deg"), F.max("new").alias("any"))
    u = F.pmod(F.xxhash64("v", "id", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = both.join(deg.where("any"), "v").where(u * F.col("deg") < JOIN).groupBy("v", "id").agg(F.max("new").alias("new"))
    info = nodes.join(lists.select(F.col("x").alias("node"), "worst"), "node").select(F.col("node").alias("id"), "worst", "half")
    rows = some.join(info, "id").groupBy("v").agg(F.collect_list(F.struct("id", "new", "worst", "half")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            col = b.column("m")
            flat = col.flatten()
            offs = col.offsets.to_numpy() - (col.offsets[0].as_py() if len(col) else 0)
            if not len(flat):
                continue
            ids, new, worst = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("id", "new", "worst"))
            x = _matrix(flat.field("half"), np.float16).astype(np.float32)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, z in zip(offs[:-1], offs[1:]):
                s = x[a:z] @ x[a:z].T
                np.fill_diagonal(s, -3)
                i, j = np.nonzero((s > worst[a:z, None]) & (new[a:z, None] | new[None, a:z]))
                out.append((ids[a:z][i], ids[a:z][j], s[i, j]))
            c = [np.concatenate(v) for v in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2].astype(np.float32))], ["x", "y", "sim"])

    return rows.select("m").mapInArrow(run, EDGE)


def exact(pairs: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) with cosine >= threshold in double precision. vecs: node, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            if b.num_rows:
                cos = (_matrix(b.column("va"), np.float64) * _matrix(b.column("vb"), np.float64)).sum(1)
                yield b.select(["a", "b"]).filter(pa.array(cos >= threshold))

    side = lambda n: vecs.select(F.col("node").alias(n), F.col("vec").alias(f"v{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def audit(queries: list[tuple[int, bytes]], nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b), a < b, of the queries by brute force in blocks. queries: at most AUDIT nodes and their vectors."""
    ids = np.array([q[0] for q in queries], np.int64)
    x = np.stack([np.frombuffer(q[1], np.float64) for q in queries]) if queries else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            if b.num_rows and x is not None:
                own = b.column("node").to_numpy()
                i, j = np.nonzero(x @ _matrix(b.column("vec"), np.float64).T >= threshold)
                keep = ids[i] != own[j]
                q, o = ids[i][keep], own[j][keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(q, o)), pa.array(np.maximum(q, o))], ["a", "b"])

    return nodes.select("node", "vec").mapInArrow(run, "a long, b long").distinct()


def descend(nodes: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b), a < b, of distinct nodes over the threshold. nodes: node, vec, half, audited."""
    low = threshold - SLACK
    pick = nodes.where("audited").orderBy(F.xxhash64("node", F.lit(1)), "node").limit(AUDIT)
    queries = [(r["node"], bytes(r["vec"])) for r in pick.select("node", "vec").toLocalIterator()]
    truth = scratch.write(audit(queries, nodes, threshold), "truth")
    wanted, hit = truth.count(), 0
    lists, seen, turn, pairs = None, None, 0, None
    for attempt in range(REFINED):
        seeds = scratch.write(seed_edges(nodes.select("node", "half"), attempt * ORDERS), "seeds")
        over = seeds.where(F.col("sim") >= low).select("x", "y")
        seen = over if seen is None else seen.unionByName(over)
        start = seeds.withColumn("new", F.lit(True))
        new = scratch.write(best(start if lists is None else start.unionByName(_flat(lists, False))), "lists")
        scratch.drop(lists)
        lists, last = new, -1
        for _ in range(ROUNDS):
            turn += 1
            found = scratch.write(local_joins(lists, nodes, turn), "cands")
            new = scratch.write(best(_flat(lists, False).unionByName(found.withColumn("new", F.lit(True)))), "lists")
            scratch.drop(lists, found)
            lists = new
            n = lists.select(F.sum(F.size(F.filter("l", lambda e: e["sim"] >= low)))).first()[0] or 0
            if last >= 0 and n - last <= LEAST_GAIN * last:
                break
            last = n
        near = scratch.write(_flat(lists, False).where(F.col("sim") >= low).select("x", "y").unionByName(seen).distinct(), "near")
        more = saturated(near, lists, nodes, low, scratch)
        with small_batches(nodes.sparkSession, 16):
            pairs = scratch.write(near.unionByName(more).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "over")
        hit = truth.join(pairs, ["a", "b"], "left_semi").count() if wanted else 0
        if hit >= MIN_RECALL * wanted:
            break
    if hit < LEAST_RECALL * wanted:
        raise RecallTooLow(f"{hit} of {wanted} audited links found")
    edges = scratch.write(exact(pairs, nodes.select("node", "vec"), threshold), "edges")
    scratch.drop(lists)
    return edges


def _flat(lists: DataFrame, new: bool) -> DataFrame:
    return lists.select("x", F.explode("l").alias("e")).select("x", F.col("e.y").alias("y"), F.col("e.sim").alias("sim"), F.lit(new).alias("new"))


def link(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    A vector that is null, zero, or holds null or non-finite components links with nothing and is kept; vectors of
    different lengths are never compared. Rows with the same vector are linked to each other, repeated rows included. A
    null vec_id is carried as null and never names a component that has another id. An empty table gives no row. Other
    columns, labels too, are not read.
    """
    scratch = Scratch(rows.sparkSession)
    bound_batches(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = lengths(rows) or [1]
    own = scratch.write(reduce(DataFrame.unionByName, [vectors(rows, d) for d in sizes]), "own")
    own, halves = distinct_nodes(own, scratch)

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            out = [np.frombuffer(v, np.float64).astype(np.float16).tobytes() for v in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "half"])

    nodes = scratch.write(halves.mapInArrow(half, "node long, d int, vec binary, copies long, least long, audited boolean, half binary"), "nodes")
    of = lambda d: nodes.where(F.col("d") == d).select("node", "vec", "half", "audited")
    edges = reduce(DataFrame.unionByName, [descend(of(d), scratch, threshold) for d in sizes])
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    found = components(edges, scratch)
    each = nodes.select("node", "copies", "least").join(links, F.col("node") == F.col("a"), "left").join(found, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c"), "least")
    least = each.groupBy("c").agg(F.min("least").alias("component_id"))
    each = scratch.write(each.join(least, "c").select("node", "n_links", "component_id"), "each")
    got = own.select("vec_id", "node").join(each, "node").select("vec_id", "n_links", "component_id")
    # rows that can't link are what the vectors leave over
    alone = rows.select("vec_id").exceptAll(own.select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = got.unionByName(alone)
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
