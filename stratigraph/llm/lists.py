"""Links among the members of lists, without writing out the pairs of a list.

A list is the set of nodes that share a key. Any two of its members may be near; what is wanted is the components of all
near pairs.

1. In each list the member that meets the most others over all its lists is the pivot. Every node is first held against
   that of its pivots which meets the most: one comparison a node, so a group of n members in many lists of other members
   and pivots has n links. In a group of copies that pivot is the text they come from, or close to it.
2. The links so far give components. A member that is of its pivot's component is settled; the others are held
   against their pivots, and a pivot takes one link to each component.
3. Components again. A list whose members are of one component is settled. In the lists left, the members that are not of their pivot's component seek: each is compared with the members of
   other components. Only links that join components come back, fewer than the list has members.

Lists of equal members count once. Pivots and lists of more than ``BLOCK`` members are dealt into blocks, so no task
holds more than two blocks, and a list of n members with s seekers costs n * s / BLOCK rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratigraph.operators.components import connected_components
from stratigraph.storage import discard, materialize

#: Most members of a list that one group holds, and most seekers.
BLOCK = 512
#: Links that one task joins; more take rounds.
SMALL = 10_000
#: Most repeated keys (8 bytes each and as much for their count) that are sent to the lists.
SENT_KEYS = 2_000_000

#: Given the payload columns of a group, a function that tells which of the rows ``others`` are near to row ``one``.
Matcher = Callable[[dict[str, np.ndarray]], Callable[[int, np.ndarray], np.ndarray]]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each (key, block_a, block_b) of a partition sorted by them; a group may span batches."""
    names, kept = ("key", "block_a", "block_b"), None
    for batch in batches:
        rows = {c: batch[c].to_numpy() for c in batch.columns}
        if kept is not None:
            rows = {c: np.concatenate([kept[c], rows[c]]) for c in rows}
        n = len(rows["key"])
        if not n:
            continue
        ends = np.flatnonzero(np.any([rows[c][1:] != rows[c][:-1] for c in names], 0)) + 1
        starts = np.r_[0, ends]
        for low, high in zip(starts, ends, strict=False):
            yield {c: v[low:high] for c, v in rows.items()}
        kept = {c: v[starts[-1] :] for c, v in rows.items()}
    if kept is not None and len(kept["key"]):
        yield kept


def _links(group: dict[str, np.ndarray], matcher: Matcher) -> list[tuple[int, int]]:
    """Links of the seeking rows that join different components (``own``) of a group."""
    nodes, own = group["node"], group["own"]
    _, root = np.unique(own, return_inverse=True)
    if root.max(initial=0) == 0:
        return []
    near, links = matcher(group), []
    for at in np.flatnonzero(group["seeks"]):
        others = np.flatnonzero(root != root[at])
        if not len(others):
            break
        for k in others[near(at, others)]:
            if root[k] != root[at]:
                links.append((int(nodes[at]), int(nodes[k])))
                root[root == root[k]] = root[at]
    return links


def _compared(rows: DataFrame, told: DataFrame, matcher: Matcher) -> DataFrame:
    """(u, v) of ``rows (key, block_a, block_b, node, own, seeks)`` with the payload that ``told (node, ...)`` adds."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for group in _groups(batches):
            found += _links(group, matcher)
            if len(found) >= 10_000:
                yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")
                found = []
        yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    order = ["key", "block_a", "block_b"]
    dealt = rows.join(told, "node").repartition(*order).sortWithinPartitions(*order, "seeks", "node")
    return dealt.mapInPandas(work, "u long, v long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, node, own, apart, n, away) as groups; ``n`` members and ``away`` seekers of the key are known.

    Every block of members meets every block of seekers. In a list of one block the seekers are among its members.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    place = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    zero, whole = F.lit(0), F.col("n") <= BLOCK
    short = rows.where(whole).select("key", zero.alias("block_a"), zero.alias("block_b"), "node", "own", F.col("apart").alias("seeks"))
    long = rows.where(~whole)
    meets = long.select("key", F.explode(F.sequence(zero, blocks("away") - 1)).alias("block_a"), place("n").alias("block_b"), "node", "own", F.lit(False).alias("seeks"))
    seeking = long.where("apart").select("key", place("away").alias("block_a"), F.explode(F.sequence(zero, blocks("n") - 1)).alias("block_b"), "node", "own", F.lit(True).alias("seeks"))
    return short.union(meets).union(seeking)


def _starred(pairs: DataFrame) -> DataFrame:
    """Pivots against their members as groups: ``pairs (pivot, node, own, goal)``, a written table; ``goal`` is the pivot's own."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.first("goal").alias("goal"))
    zero, no, yes = F.lit(0).alias("block_a"), F.lit(False).alias("seeks"), F.lit(True).alias("seeks")
    place = F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block_b")
    held = pairs.drop("goal").join(sizes, "pivot").select(F.col("pivot").alias("key"), zero, place, "node", "own", no)
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block_b")
    return held.union(sizes.select(F.col("pivot").alias("key"), zero, blocks, F.col("pivot").alias("node"), F.col("goal").alias("own"), yes))


def list_classes(listed: DataFrame, payload: Callable[[DataFrame], DataFrame], matcher: Matcher) -> DataFrame:
    """(node, component) of the nodes of ``listed (key, node)`` that are linked to another.

    ``listed`` has a row once; it is computed twice. ``payload`` gets the table (node) of the nodes that share
    a list with another, each once, and returns it with the columns that ``matcher`` compares; its result is written.
    """
    counted = materialize(listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    shared = materialize(listed.join(F.broadcast(counted) if counted.count() <= SENT_KEYS else counted, "key"), "lists")
    meets = shared.groupBy("node").agg(F.sum(F.col("n") - 1).alias("meets"))
    heads = shared.join(meets, "node").groupBy("key").agg(
        F.max(F.struct("meets", "node")).alias("top"),
        F.first("n").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("mark"),
        F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("mark_too"),
    )
    heads = heads.groupBy("n", "mark", "mark_too", "top").agg(F.min("key").alias("key"))
    heads = materialize(heads.select("key", F.col("top.node").alias("pivot"), F.col("top.meets").alias("meets")), "lists")
    lists = materialize(shared.join(heads.drop("meets"), "key"), "lists")
    told = materialize(payload(lists.select("node").distinct()), "lists")
    met = heads.groupBy("pivot").agg(F.first("meets").alias("meets"))  # a pivot meets as many in each list it heads

    pairs = materialize(lists.where("node <> pivot").select("pivot", "node").distinct(), "lists")
    first = pairs.join(met, "pivot").groupBy("node").agg(F.max(F.struct("meets", "pivot"))["pivot"].alias("pivot"))
    first = materialize(first.select("pivot", "node", F.col("node").alias("own"), F.col("pivot").alias("goal")), "lists")
    stars = materialize(_compared(_starred(first), told, matcher), "lists")

    def placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
        pivot_parts = parts.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_part"))
        named = rows.join(parts, "node", "left").join(pivot_parts, "pivot", "left")
        own, goal = F.coalesce("component", "node"), F.coalesce("pivot_part", "pivot")
        return named.select(*rows.columns, own.alias("own"), goal.alias("goal"), (own != goal).alias("apart"))

    hooked = materialize(connected_components(stars, small=SMALL), "lists")
    rest = placed(pairs, hooked).where("apart").join(first.select("pivot", "node"), ["pivot", "node"], "left_anti")
    rest = materialize(rest.select("pivot", "node", "own", "goal"), "lists")
    stars_too = materialize(_compared(_starred(rest), told, matcher), "lists")
    parts = materialize(connected_components(stars.union(stars_too), small=SMALL), "lists")

    # whether a member is apart from its pivot is asked once a pair, not once in each of their lists
    apart = materialize(placed(pairs, parts).where("apart").select("pivot", "node"), "lists")
    longer = lists.where("n > 2")  # a list of two has its only pair settled
    away = materialize(longer.join(apart, ["pivot", "node"]).groupBy("key").agg(F.count(F.lit(1)).alias("away")), "lists")
    left = materialize(placed(longer.join(away, "key"), parts).drop("goal"), "lists")
    more = materialize(_compared(_dealt(left), told, matcher), "lists")
    out = materialize(connected_components(stars.union(stars_too).union(more), small=SMALL), "lists")
    for used in (counted, shared, heads, lists, told, pairs, first, stars, hooked, rest, stars_too, parts, apart, away, left, more):
        discard(used)
    return out
