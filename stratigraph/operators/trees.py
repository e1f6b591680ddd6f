"""Rooted trees as tables (node, parent, branch_len, name): reading, path lengths, grafting."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratigraph.operators.ranking import positions
from stratigraph.storage import materialize

TREE = "node int, parent int, branch_len double, name string"


def parse_newick(text: str) -> list[tuple[int, int | None, float, str | None]]:
    """Rows of a tree in Newick form, nodes in order of their opening; the root has no parent."""
    rows: list[list] = [[0, None, 0.0, None]]
    at = 0
    for token in re.findall(r"\(|\)|,|;|[^(),;]+", text.strip()):
        if token == "(":
            rows.append([len(rows), at, 0.0, None])
            at = rows[-1][0]
        elif token == ",":
            rows.append([len(rows), rows[at][1], 0.0, None])
            at = rows[-1][0]
        elif token == ")":
            at = rows[at][1]
        elif token != ";" and token.strip():
            name, _, length = token.strip().partition(":")
            rows[at][3] = name.strip("'\" ") or rows[at][3]
            rows[at][2] = float(length) if length else rows[at][2]
    return [tuple(r) for r in rows]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """The tree in a file."""
    text = "".join(r[0] for r in spark.read.text(path).collect())
    return spark.createDataFrame(parse_newick(text), TREE)


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, anc, hops, up): every ancestor of a node, itself included, with the path's length, by doubling."""
    single = tree.select("node", "parent", "branch_len")
    known = single.select("node", F.col("node").alias("anc"), F.lit(0).alias("hops"), F.lit(0.0).alias("up"))
    jump = materialize(single.where("parent IS NOT NULL").select("node", F.col("parent").alias("to"), F.lit(1).alias("jh"), F.col("branch_len").alias("jl")), "tree")
    while not jump.isEmpty():
        j = jump.select(F.col("node").alias("jn"), "to", "jh", "jl")
        further = known.join(j, known["anc"] == j["jn"]).select("node", F.col("to").alias("anc"), (F.col("hops") + F.col("jh")).alias("hops"), (F.col("up") + F.col("jl")).alias("up"))
        known = materialize(known.union(further), "tree")
        again = jump.select(F.col("node").alias("jn"), F.col("to").alias("jt"), F.col("jh").alias("h2"), F.col("jl").alias("l2"))
        jump = materialize(jump.join(again, jump["to"] == again["jn"]).select("node", F.col("jt").alias("to"), (F.col("jh") + F.col("h2")).alias("jh"), (F.col("jl") + F.col("l2")).alias("jl")), "tree")
    return known


def leaf_depths(tree: DataFrame) -> DataFrame:
    """(name, depth): path length of each leaf from the root."""
    leaves = tree.join(tree.select(F.col("parent").alias("p")).distinct(), F.col("node") == F.col("p"), "left_anti")
    up = ancestors(tree).groupBy("node").agg(F.max_by("up", "hops").alias("depth"))
    return leaves.select("node", "name").join(up, "node").select("name", "depth")


def _leaves_in_order(tree: DataFrame, index: DataFrame) -> DataFrame:
    """(pos, idx, depth, fork) of the indexed nodes in pre-order, pos from 0.

    The order is that of the paths from the root. ``fork`` is (steps, depth) of the deepest common ancestor with the node
    before, null for the first; its steps are the length of the common start of both paths.
    """
    up = ancestors(tree)
    wanted = index.join(tree.select("node", "name"), "name").select("idx", "node")
    steps = F.sort_array(F.collect_list(F.struct((-F.col("hops")).alias("h"), "anc", "up")))
    paths = wanted.join(up, "node").groupBy("idx", "node").agg(steps.alias("s"))
    paths = paths.select("idx", F.transform("s", lambda a: a["anc"]).alias("path"), F.transform("s", lambda a: F.col("s")[0]["up"] - a["up"]).alias("depths"))
    placed = materialize(positions(paths, "path"), "tree")
    before = placed.select((F.col("pos") + 1).alias("pos"), F.col("path").alias("p0"))
    differ = F.array_position(F.zip_with("path", "p0", lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    common = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("path"), F.size("p0"))).cast("int")
    fork = F.when(F.col("p0").isNotNull(), F.struct(common.alias("steps"), F.get("depths", common - 1).alias("depth")))
    return placed.join(before, "pos", "left").select("pos", "idx", F.element_at("depths", -1).alias("depth"), fork.alias("fork"))


def cophenetic_pairs(tree: DataFrame, index: DataFrame, block: int = 256) -> DataFrame:
    """(i, j, d) with i < j for all pairs of the index (name, idx): the path over their deepest common ancestor.

    In pre-order the deepest common ancestor of two nodes is the least fork between them. The order is cut into blocks of
    ``block`` nodes; for two blocks that meet it is the least of three forks: the rest of the one block, the blocks
    between, the start of the other. So each pair is made once, no ancestor is a key, and meetings are equally large for a
    tree of any shape. Names are unique in the tree and in the index; lengths may be negative. The result is quadratic.
    """
    chunk = F.floor(F.col("pos") / block).cast("int")
    rows = _leaves_in_order(tree, index).withColumn("chunk", chunk)
    whole = Window.partitionBy("chunk").orderBy("pos")
    rows = rows.withColumn("head", F.min("fork").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("tail", F.min("fork").over(whole.rowsBetween(1, Window.unboundedFollowing)))
    item = F.struct("pos", "idx", "depth", "fork", "head", "tail")
    blocks = materialize(rows.groupBy("chunk").agg(F.sort_array(F.collect_list(item)).alias("items"), F.min("fork").alias("all")), "tree")
    last = blocks.agg(F.max("chunk").alias("last"))
    meet = blocks.select(F.col("chunk").alias("p")).crossJoin(F.broadcast(last)).select("p", F.explode(F.sequence("p", "last")).alias("q"))  # one row
    # the forks of the blocks between p and q, without both
    between = Window.partitionBy("p").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    meet = meet.join(blocks.select(F.col("chunk").alias("q"), "all"), "q").withColumn("mid", F.min(F.when(F.col("q") > F.col("p"), F.col("all"))).over(between)).drop("all")
    side = lambda c, out: blocks.select(F.col("chunk").alias(c), F.col("items").alias(out))
    met = meet.join(side("p", "left"), "p").join(side("q", "right"), "q").repartition("p", "q")
    met = met.select("p", "q", "mid", "right", F.transform("left", lambda a: a["fork"]).alias("forks"), F.explode("left").alias("a"))
    met = met.select("p", "q", "mid", "forks", "a", F.explode("right").alias("b")).where("b.pos > a.pos")
    start = (F.col("a.pos") - F.col("p").cast("long") * block + 2).cast("int")
    inside = F.array_min(F.slice("forks", start, (F.col("b.pos") - F.col("a.pos")).cast("int")))
    fork = F.when(F.col("p") == F.col("q"), inside).otherwise(F.least("a.tail", "mid", "b.head"))
    return met.select(F.least("a.idx", "b.idx").alias("i"), F.greatest("a.idx", "b.idx").alias("j"), (F.col("a.depth") + F.col("b.depth") - 2 * fork["depth"]).alias("d"))


def graft(consensus: DataFrame, families: DataFrame) -> DataFrame:
    """One tree: each family tree (family, node, parent, branch_len, name) hangs below the consensus node of its name,
    or below the root if there is none. Node ids become texts: c:<node> and <family>:<node>."""
    base = consensus.select(F.concat(F.lit("c:"), "node").alias("node"), F.when(F.col("parent").isNotNull(), F.concat(F.lit("c:"), "parent")).alias("parent"), "branch_len", "name")
    root = consensus.where("parent IS NULL").select(F.concat(F.lit("c:"), "node").alias("root"))
    named = consensus.where("name IS NOT NULL").groupBy(F.col("name").alias("family")).agg(F.min("node").alias("at"))
    hung = families.join(named, "family", "left").crossJoin(F.broadcast(root))  # one row
    own = lambda c: F.concat(F.col("family"), F.lit(":"), F.col(c))
    below = F.coalesce(F.concat(F.lit("c:"), F.col("at")), F.col("root"))
    return base.union(hung.select(own("node"), F.when(F.col("parent").isNull(), below).otherwise(own("parent")), "branch_len", "name"))
