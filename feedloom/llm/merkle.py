"""Merkle dataset manifest: a digest for every row, a tree of digests for every source, one over the sources, and a proof for every row.

The method is coordinate lookup. Leaves are numbered within their source by a range sort and the counts of its ranges, so no source
is ever in one task. Levels are built SPAN at a time: a block of ARITY**SPAN consecutive nodes is one group of bounded size, whose nodes
above it go to the materialised node table (tree, level, place, digest). A proof explodes from a node's place and its tree's size
the coordinates of the siblings that it needs, joins the node table, orders what it gets and concatenates it; folding it with a digest gives
the root. A node looks up the siblings of its block's levels only; what comes above is the same for the whole block, is looked up once for
the block's top node and joined by block. So a key of any join has at most ARITY**SPAN rows, in a tree of any size.

Defined cases: a null field is ``-``. Leaves of a source ascend by doc_id, null first, and rows of one doc_id by their digest; rows that
are equal in all five fields have equal digests, so their order makes no difference to a digest, and each has its own proof. A null source is a source of
its own, the first. A lone leaf is the root of its source, and a lone source's root is the root. A level's last run may be one node, which is hashed as well. An empty
table gives no rows. Missing newlines make tampering a change of nothing. Texts of any length are hashed whole. Further columns of
``docs`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import Scratch

ARITY, SPAN = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: monotonically_increasing_id() has the partition above these bits and the row within it below.
ROW_BITS = 33


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(text: Column | None = None) -> Column:
    """The digest of a row, with another text if one is given."""

    def field(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return h(*(field((text if text is not None and name == "text" else F.col(name)).cast("string")) for name in FIELDS))


def runs_at(n: Column, level: Column | int) -> Column:
    """Nodes at a level of a tree with n leaves."""
    size = F.pow(F.lit(ARITY), F.lit(level) if isinstance(level, int) else level).cast("long")
    return F.floor((n - 1) / size).cast("long") + 1


def depth(n: Column) -> Column:
    """Levels above the leaves: of the powers of ARITY up to 2**62, those that are smaller than n."""
    powers = [ARITY**i for i in range(63) if ARITY**i < 1 << 62]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < n))


def numbered(rows: DataFrame, scratch: Scratch, tree: str, *order: str) -> DataFrame:
    """``rows`` with place (from 0, within its tree in this order) and n (the tree's rows). The rows of a tree may lie in many tasks."""
    written = scratch.table(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("m", F.monotonically_increasing_id()))
    written = written.withColumn("part", F.shiftright("m", ROW_BITS)).withColumn("row", F.col("m").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    each = written.groupBy(tree, "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    # A row for each tree and range, so a tree's window holds as many rows as there are ranges.
    of_tree = Window.partitionBy(tree)
    before = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    each = each.select(F.col(tree).alias("t"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("rows").over(of_tree).alias("n"))
    same = F.col(tree).eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))
    return written.join(each, same).withColumn("place", F.col("row") + F.col("shift")).drop("t", "p", "shift", "m", "part", "row")


def _levels(digests: Column, steps: Column) -> Column:
    """Arrays of the nodes of a block, level by level from ``digests`` on, for so many steps."""

    def above(nodes: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
        return F.transform(at, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))

    return F.aggregate(F.sequence(F.lit(1), steps), F.array(digests), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def nodes(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """The node table (tree, n, level, place, digest) of trees given as (tree, place, n, digest): all levels, leaves included."""
    table = top = leaves.select("tree", "n", F.lit(0).alias("level"), "place", "digest")
    low = 0
    while not top.filter(depth(F.col("n")) > low).isEmpty():
        block, steps = F.floor(F.col("place") / ARITY**SPAN), F.least(depth(F.col("n")) - low, F.lit(SPAN))
        rows = top.filter(depth(F.col("n")) > low).groupBy("tree", "n", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("x"))
        rows = rows.select("tree", "n", "block", F.posexplode(_levels(F.col("x.digest"), steps)).alias("up", "level_nodes")).filter("up > 0")
        rows = rows.select("tree", "n", "block", "up", F.posexplode("level_nodes").alias("i", "digest"))
        place = F.col("block") * F.pow(F.lit(ARITY), SPAN - F.col("up")).cast("long") + F.col("i")
        made = scratch.table(rows.select("tree", "n", (F.col("up") + low).cast("int").alias("level"), place.alias("place"), "digest"))
        table, low = table.unionByName(made), low + SPAN
        top = made.filter(F.col("level") == low)
    return table


def roots(table: DataFrame) -> DataFrame:
    """tree, root."""
    return table.filter(F.col("level") == depth(F.col("n"))).select("tree", F.col("digest").alias("root"))


def proofs(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, place, n, proof) of all leaves of a node table: their siblings' digests from the leaf to the root, joined."""
    low = table.agg(F.max("level")).first()[0] or 0  # one number
    low, above = max(low - 1, 0) // SPAN * SPAN, None
    while low >= 0:
        items = table.filter(F.col("level") == low).select("tree", "n", "place")
        levels = F.sequence(F.lit(low), F.lit(low + SPAN - 1))
        own = items.select("tree", "n", "place", F.explode(F.filter(levels, lambda x: x < depth(F.col("n")))).alias("level"))
        at = F.floor(F.col("place") / F.pow(F.lit(ARITY), F.col("level") - low)).cast("long")
        first = at - F.pmod(at, F.lit(ARITY))
        last = F.least(first + ARITY - 1, runs_at(F.col("n"), F.col("level")) - 1)
        wanted = own.select("tree", "place", "level", F.explode(F.filter(F.sequence(first, last), lambda x: x != at)).alias("sibling"))
        found = wanted.join(table.select("tree", "level", F.col("place").alias("sibling"), "digest"), ["tree", "level", "sibling"])
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "sibling", "digest"))), lambda x: x["digest"]), "")
        part = found.groupBy("tree", "place").agg(joined.alias("part"))
        rows = items.join(part, ["tree", "place"], "left").withColumn("part", F.coalesce("part", F.lit("")))
        if above is not None:
            up = above.select("tree", F.col("place").alias("block"), F.col("proof").alias("rest"))
            rows = rows.withColumn("block", F.floor(F.col("place") / ARITY**SPAN).cast("long")).join(up, ["tree", "block"], "left")
            rows = rows.withColumn("part", F.concat("part", F.coalesce("rest", F.lit(""))))
        above = scratch.table(rows.select("tree", "n", "place", F.col("part").alias("proof")))
        low -= SPAN
    return above


def folded(digest: Column, proof: Column, place: Column, n: Column) -> Column:
    """The root that a digest at a place of a tree with n leaves comes to with its siblings' digests."""
    width = 64

    def step(s: Column, _: Column) -> Column:
        mine = F.pmod(s["place"], F.lit(ARITY)).cast("int")
        run = F.least(F.lit(ARITY).cast("long"), s["n"] - s["place"] + mine).cast("int")
        left, right = F.substring(proof, s["at"], mine * width), F.substring(proof, s["at"] + mine * width, (run - 1 - mine) * width)
        return F.struct(
            h(left, s["digest"], right).alias("digest"), F.floor(s["place"] / ARITY).cast("long").alias("place"), (F.floor((s["n"] - 1) / ARITY) + 1).cast("long").alias("n"), (s["at"] + (run - 1) * width).cast("int").alias("at")
        )

    start = F.struct(digest.alias("digest"), place.cast("long").alias("place"), n.cast("long").alias("n"), F.lit(1).alias("at"))
    steps = F.filter(F.sequence(F.lit(0), depth(n)), lambda x: x > 0)
    return F.aggregate(steps, start, step, lambda s: s["digest"])


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, presented, subroot, root, place, n, proof, top_place, top_n, top_proof of every row of ``docs``.

    ``proof`` leads to the source's root, ``top_proof`` from there to the root. ``presented`` is the digest of the row with the text ``tampered``, if given.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf().alias("digest"), leaf(tampered).alias("presented"))
    leaves = numbered(scratch.table(rows), scratch, "source", "doc_id", "digest", "presented")
    sources = leaves.select(F.lit(0).alias("forest"), "source").distinct()
    sources = numbered(sources, scratch, "forest", "source").select(F.col("source").alias("s"), F.col("place").alias("tree"), F.col("n").alias("top_n"))
    leaves = scratch.table(leaves.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    table = nodes(leaves, scratch)
    subroots = roots(table).withColumnRenamed("root", "subroot")
    sources = leaves.select("tree", "top_n").distinct().join(subroots, "tree")
    top = nodes(scratch.table(sources.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("top_n").alias("n"), F.col("subroot").alias("digest"))), scratch)
    upper = proofs(top, scratch).select(F.col("place").alias("tree"), F.col("proof").alias("top_proof"))
    of_source = subroots.join(upper, "tree").join(F.broadcast(roots(top).select("root")))  # one row
    found = leaves.join(proofs(table, scratch).select("tree", "place", "proof"), ["tree", "place"]).join(of_source, "tree")
    return found.select("doc_id", "source", F.col("digest").alias("leaf"), "presented", "subroot", "root", "place", "n", "proof", F.col("tree").alias("top_place"), "top_n", "top_proof")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; every second document, by crc32 of its id, loses its newlines before it is checked."""
    cut = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    text = F.col("text").cast("string")
    out = manifest(docs, F.when(cut, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text))
    back = folded(folded(F.col("presented"), F.col("proof"), F.col("place"), F.col("n")), F.col("top_proof"), F.col("top_place"), F.col("top_n"))
    out = out.select("doc_id", "leaf", "subroot", "root", h(F.col("proof"), F.col("top_proof")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
