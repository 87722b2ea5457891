"""Line dedup (operator 6): fuzzy lines by MinHash, in DataFrame and SQL functions only.

A line's set is its distinct character shingles (`WIDTH` code points at every position; a shorter line is one shingle),
and lines whose exact Jaccard reaches the threshold are linked. Candidates come from one-permutation MinHash over every
byte of every line's UTF-8: hashes of `WIDTH` bytes fall into `BINS` bins, a bin's least hash is a register, and `ROWS` registers make
a band. Only hashes under a bound that leaves about `DRAWN` of a line's positions are gathered (a register that is the
least of some is the least of all), so a line's signature is one row of an aggregation, not an array of its shingles. A
pair of similarity 0.8 shares no band with a probability of about 0.02. Candidates are decided by the exact Jaccard, and
distributed union-find keeps one line, the first by (doc_id, text, position), of each component.

Equal lines are one node from the start, found by a 64-bit hash; where two different lines have the same hash, which
their crc32 tells, all of them stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name, table
from .graph import link_stars, stars

WIDTH = 10
THRESHOLD = 0.8
#: Registers of a signature, and those of one band.
BINS, ROWS = 18, 3
#: Positions whose hashes are gathered, about, of a line that has more.
DRAWN = 4 * BINS
#: A longer line with fewer filled registers repeats itself; all its positions are gathered.
FEW = 12
BREAK = "\n"
#: Lines up to which ids are sent to every executor (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def all_shingles(line: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles at every position, cut from UTF-32, four bytes a code point. The encoded line is a lambda's
    variable: a column would be copied for every shingle."""
    starts = lambda b: F.sequence(F.lit(1), F.greatest(F.octet_length(b) - 4 * width + 1, F.lit(1)), F.lit(4))
    every = lambda b: F.transform(starts(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * width))))
    return F.transform(F.array(F.encode(line, "UTF-32")), every)[0]


def shingles(line: Column, width: int = WIDTH) -> Column:
    """Hashes of the distinct shingles."""
    return F.array_distinct(all_shingles(line, width))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos, line: every line of every text; lines of white space alone are left out, they
    are never dropped."""
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", BREAK)).alias("pos", "line"))
    # most lines begin with no white space, which their first character tells
    return every.where((F.ascii("line") > 32) | F.col("line").rlike(r"\S"))


def signatures(each: DataFrame, drawn: int | None = DRAWN) -> DataFrame:
    """node, n (positions), r0 ... of the lines of each. A signature comes from the bytes of UTF-8, `WIDTH` of
    them from every byte on, so a shingle is cut out in constant time; drawn=None gathers every position."""
    units = each.select(F.xxhash64("line").alias("node"), F.col("line").cast("binary").alias("b")).withColumn("n", F.greatest(F.octet_length("b") - (WIDTH - 1), F.lit(1)))
    bound = F.lit((1 << 63) - 1) if drawn is None else F.when(F.col("n") <= drawn, F.lit((1 << 63) - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(2.0**64 * drawn) / F.col("n")).cast("long"))
    # a column of its own below the positions: else it is worked out for each of them
    units = units.withColumn("bound", bound)
    at = units.select("node", "n", "b", "bound", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    # the zero is not deterministic to the optimizer, which else moves the filter below and hashes what passes it twice
    h = at.select("node", "n", "i", "bound", F.expr(f"xxhash64(substring(b, i, {WIDTH})) ^ CAST(spark_partition_id() & 0 AS BIGINT)").alias("h"))
    # a line's first position is carried along, so that no line is without a row
    some = h.where((F.col("h") <= F.col("bound")) | (F.col("i") == 1)).select("node", "n", "h", F.when(F.col("h") <= F.col("bound"), F.pmod("h", F.lit(BINS)).cast("int")).otherwise(-1).alias("bin"))
    return some.groupBy("node").agg(F.max("n").alias("n"), *[F.expr(f"min(h) FILTER (WHERE bin = {k})").alias(f"r{k}") for k in range(BINS)])


def _keys() -> Column:
    """One of each band with a filled register."""
    band = lambda k: [F.col(f"r{i}") for i in range(k * ROWS, (k + 1) * ROWS)]
    key = lambda k: F.when(F.coalesce(*band(k)).isNotNull(), F.xxhash64(F.lit(k), *[F.coalesce(r, F.lit(0)) for r in band(k)]))
    return F.array_compact(F.array(*[key(k) for k in range(BINS // ROWS)])).alias("keys")


def banded(docs: DataFrame, met: DataFrame, scratch: Scratch) -> DataFrame:
    """node, keys of every distinct line. met: node and th of the lines of docs."""
    filled = sum((F.col(f"r{k}").isNotNull().cast("int") for k in range(BINS)), F.lit(0))
    signed = scratch.write(signatures(lines(docs)).select("node", _keys(), ((F.col("n") > DRAWN) & (filled < FEW)).alias("again")), "signed")
    few = scratch.write(signed.where("again").select("node"), "few")
    keys, n = signed.where(~F.col("again")).select("node", "keys"), few.count()
    if n:
        small = lambda df: F.broadcast(df) if n <= BROADCAST_ROWS else df
        # one text that holds each of them: no others are split again
        holders = scratch.write(met.join(small(few), "node", "left_semi").groupBy("node").agg(F.min("th").alias("th")).select("th").distinct(), "holders")
        held = docs.join(small(holders), F.xxhash64("text") == F.col("th"), "left_semi")
        own = lines(held).where(F.octet_length("line") > DRAWN).join(small(few), F.xxhash64("line") == F.col("node"), "left_semi")
        keys = keys.unionByName(scratch.write(signatures(own, None).select("node", _keys()), "keys"))
    return keys


def _score(texts: DataFrame, threshold: float):
    """The exact Jaccard of each spoke, and how its set differs from the lead's. A lead's set is made once, a node's once
    a spoke. The only spoke of a star is compared with nothing else, so its differences are counted and left out."""
    none = F.expr("CAST(array() AS ARRAY<BIGINT>)")

    def score(spokes: DataFrame) -> DataFrame:
        heads = texts.join(spokes.groupBy(F.col("lead").alias("node")).agg(F.count("*").alias("n")), "node").select(F.col("node").alias("lead"), "n", shingles(F.col("line")).alias("hl"))
        own = spokes.join(texts, "node").select("lead", "node", "line")
        # array_except drops repeats, so a node's hashes may hold them
        both = own.join(heads, "lead").select("lead", "node", "n", "hl", all_shingles(F.col("line")).alias("hn"))
        apart = both.select("lead", "node", "n", F.size("hl").alias("whole"), F.array_except("hl", "hn").alias("less"), F.array_except("hn", "hl").alias("more"))
        common, union = F.col("whole") - F.size("less"), F.col("whole") + F.size("more")
        counted = apart.withColumns({"sim": common / union, "linked": common / union >= threshold, "size": 8 * (F.size("less") + F.size("more"))})
        kept = lambda c: F.when(F.col("n") > 1, F.col(c)).otherwise(none).alias(c)
        return counted.select("lead", "node", "sim", "linked", "size", "whole", kept("less"), kept("more"))

    return score


def _blocks(threshold: float):
    """Decides the pairs of two blocks of a star within one row. What x and y have in common is the lead's set without
    what either lacks, and what both have beside it, so exact counts come from the differences alone."""

    def pair(x: Column, y: Column) -> Column:
        other = (x["c"] != y["c"]) & ((x["node"] < y["node"]) | ~y["open"])
        near = F.abs(x["sim"] - y["sim"]) <= F.lit(1 - threshold + 1e-9)
        both = x["n"] + y["n"]
        enough = F.lit(threshold / (1 + threshold) - 1e-9) * both
        at_most = x["whole"] - F.greatest(x["nl"], y["nl"])
        beside = F.size(F.array_intersect(x["more"], y["more"]))
        common = x["whole"] - x["nl"] - y["nl"] + F.size(F.array_intersect(x["less"], y["less"])) + beside
        return other & near & (at_most + F.least(x["nm"], y["nm"]) >= enough) & (at_most + beside >= enough) & (common / (both - common) >= threshold)

    def blocks(dealt: DataFrame) -> DataFrame:
        sizes = [F.size("less").alias("nl"), F.size("more").alias("nm"), (F.col("whole") - F.size("less") + F.size("more")).alias("n")]
        full = dealt.select("lead", "i", "j", F.struct("left", "right", "open", "node", "c", "sim", "whole", "less", "more", *sizes).alias("x"))
        cell = full.groupBy("lead", "i", "j").agg(F.collect_list(F.when(F.col("x.left"), F.col("x"))).alias("l"), F.collect_list(F.when(F.col("x.right"), F.col("x"))).alias("r"))
        edge = lambda x, y: F.struct(F.least(x["c"], y["c"]).alias("a"), F.greatest(x["c"], y["c"]).alias("b"))
        found = F.transform("l", lambda x: F.array_distinct(F.transform(F.filter("r", lambda y: pair(x, y)), lambda y: edge(x, y))))
        return cell.select(F.explode(F.array_distinct(F.flatten(found))).alias("e")).select("e.a", "e.b")

    return blocks


def drop_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th (xxhash64 of the text), dropped (positions of the lines that go, ascending): a row for each text that
    loses a line.

    Null and empty texts have no line that could go; lines of white space stay. A class's first line by
    (doc_id, th, position) stays, a null doc_id coming first. Rows with the same doc_id and different texts are told
    apart; of rows that repeat doc_id and text all count as the first. An empty table gives no row. Other columns of
    docs are not read.
    """
    scratch = Scratch(docs.sparkSession)
    met = lines(docs).select("doc_id", "th", "pos", F.xxhash64("line").alias("node"), F.crc32(F.col("line").cast("binary")).alias("crc"))
    met = scratch.write(met, "met")
    keys = banded(docs, met, scratch)
    spokes = stars(keys.select("node", F.explode("keys").alias("key")), scratch)
    scratch.only(met, spokes)
    who = scratch.write(spokes.select("node").unionByName(spokes.select(F.col("lead").alias("node"))).distinct(), "who")
    small = who.count() <= BROADCAST_ROWS
    own = lines(docs).select(F.xxhash64("line").alias("node"), "line").join(F.broadcast(who) if small else who, "node", "left_semi")
    texts = scratch.write(own.groupBy("node").agg(F.min("line").alias("line")), "texts")
    scratch.drop(who)
    found = link_stars(spokes, _score(texts, threshold), _blocks(threshold), scratch, 1 - threshold + 1e-9)
    scratch.only(met, found)
    # a line that is met once and linked to none stays
    counts = met.groupBy("node").agg(F.count("*").alias("n"), F.min("crc").alias("c1"), F.max("crc").alias("c2"))
    again = counts.where(F.col("c1") == F.col("c2")).join(found, "node", "left").where(F.col("component").isNotNull() | (F.col("n") > 1))
    again = scratch.write(again.select("node", F.coalesce("component", "node").alias("c")), "again")
    small = F.broadcast if again.count() <= BROADCAST_ROWS else (lambda df: df)
    places = scratch.write(met.join(small(again), "node").select("c", F.struct("doc_id", "th", "pos").alias("at")), "places")
    first = scratch.write(places.groupBy("c").agg(F.min("at").alias("first")), "first")
    gone = places.join(small(first), "c").where(~F.col("at").eqNullSafe(F.col("first"))).select("at.*")
    out = scratch.write(gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped")), "gone")
    scratch.only(out)
    return out


def _with_dropped(docs: DataFrame, threshold: float) -> tuple[DataFrame, str]:
    """docs with a column of each one's dropped positions, and its name. The positions go to every executor while they
    are few, else texts are dealt out."""
    name, key, th = free_name(docs.columns, "__dropped"), free_name(docs.columns, "__id"), free_name(docs.columns, "__th")
    gone = drop_lines(docs, threshold).select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("dropped").alias(name))
    n = gone.agg(F.sum(F.size(name) + 6)).first()[0] or 0
    return docs.join(F.broadcast(gone) if n <= 4 * BROADCAST_ROWS else gone, F.expr(f"CAST(doc_id AS LONG) <=> {key}") & (F.xxhash64(docs["text"]) == F.col(th)), "left").drop(key, th), name


def _left(text: Column, dropped: str) -> Column:
    """The text without its dropped lines."""
    kept = F.filter(F.transform(F.split(text, BREAK), lambda x, i: F.when(~F.array_contains(dropped, i), x)), lambda x: x.isNotNull())
    return F.when(F.col(dropped).isNull(), text).otherwise(F.array_join(kept, BREAK))


def clean(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs with the repeated lines taken out of text (a text that loses every line is empty)."""
    out, dropped = _with_dropped(docs, threshold)
    return out.withColumn("text", _left(F.col("text"), dropped)).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept and the sha256 of the text that is left, of every document."""
    docs, dropped = _with_dropped(table(spark, sf_dir, "documents").select("doc_id", "text"), THRESHOLD)
    text = F.coalesce("text", F.lit(""))
    n = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(BREAK), F.lit(""))) + 1).cast("long")
    return docs.select("doc_id", n.alias("n_lines"), (n - F.coalesce(F.when(F.col(dropped).isNotNull(), F.size(dropped)), F.lit(0))).alias("n_kept"), F.sha2(_left(text, dropped), 256).alias("kept_sha256"))
