"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A spaced seed is a fixed mask over consecutive tokens: 1 looks at a token, 0 ignores it. The hash of the tokens a
mask looks at is equal for two passages that differ only in ignored places, so a substituted word does not hide the
hits of every mask. Document positions are first held against the benchmark's hashes alone (8 bytes each, counted
before they are broadcast; beyond ``BROADCAST_ROWS`` the join shuffles); only hits go on, with the few tokens around
them, to the join that tells the item and place. There the two texts are laid side by side and counted token by token,
so a hit is evidence only if ``WINDOW`` aligned tokens agree to ``SIMILARITY`` or more.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratigraph.llm.names import spare
from stratigraph.storage import materialize

#: Fixed masks. Every one looks at six tokens. Items shorter than a window have masks of their own besides.
MASKS = ("1110111", "11010010011", "110010101001")
#: Aligned tokens that are compared around a hit, the share of them that must agree.
WINDOW, SIMILARITY = 13, 0.8
#: Benchmark items with fewer tokens are never evidence.
MIN_TOKENS = 5
#: Most different hashes of the benchmark (about 32 bytes each in memory) that are broadcast.
BROADCAST_ROWS = 4_000_000


def tokens_of(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits of a whole text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(hashes: Column, mask: str) -> Column:
    """Array of the masked hash at each position where the mask fits."""
    span, looks = len(mask), [k for k, c in enumerate(mask) if c == "1"]
    starts = F.when(F.size(hashes) >= span, F.sequence(F.lit(0), F.size(hashes) - span)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(mask), *[F.get(hashes, i + k) for k in looks]))


def _short_masks(n: int) -> list[str]:
    """Masks over a whole item of ``n`` tokens, one of which ignores whatever tokens ``SIMILARITY`` lets differ.

    The item is cut into blocks, and each mask ignores as many of them as tokens may differ: single tokens up to six,
    else two blocks more than that.
    """
    lost = n - ceil(SIMILARITY * n)
    blocks = n if n <= 6 else lost + 2
    block = [k * blocks // n for k in range(n)]
    return ["".join("0" if b in gone else "1" for b in block) for gone in combinations(range(blocks), lost)]


def _masks_for(items: DataFrame) -> list[str]:
    """The fixed masks, and those of each length of items that are shorter than a window."""
    lengths = items.where((F.size("tokens") >= MIN_TOKENS) & (F.size("tokens") < WINDOW)).agg(F.sort_array(F.collect_set(F.size("tokens")))).first()[0]
    return list(dict.fromkeys([*MASKS, *(mask for n in lengths for mask in _short_masks(n))]))


def _around(hashes: Column, at: Column) -> Column:
    """Tokens that a window may cover which touches the hit at ``at``: up to 12 before it and 24 after."""
    return F.slice(hashes, F.greatest(at - (WINDOW - 1), F.lit(0)) + 1, F.least(at, F.lit(WINDOW - 1)) + 2 * WINDOW - 1)


def _window_hits(doc: Column, at: Column, item: Column, start: Column, item_size: Column) -> Column:
    """Most agreeing tokens in any window of the alignment that touches the hit; (agree, wide) as a struct.

    ``doc`` and ``item`` are the tokens around the hit, ``at`` and ``start`` its places in the whole texts.
    """
    before, behind = F.least(at, F.lit(WINDOW - 1)), F.least(start, F.lit(WINDOW - 1))
    low = -F.least(before, behind)
    high = F.least(F.size(doc) - before, F.size(item) - behind)
    same = F.transform(F.sequence(low, high - 1), lambda k: F.when(F.get(doc, before + k) == F.get(item, behind + k), 1).otherwise(0))
    wide = F.least(F.lit(WINDOW), item_size)
    sums = F.when(
        F.size(same) >= wide,
        F.array_max(F.transform(F.sequence(F.lit(0), F.size(same) - wide), lambda s: F.aggregate(F.slice(same, s + 1, wide), F.lit(0), lambda a, x: a + x))),
    ).otherwise(F.lit(0))
    return F.struct(sums.alias("agree"), wide.alias("wide"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Overlaps of documents with benchmark items: (doc_id, item_id, agree, window, n_hits, first_token, last_token).

    One row per document and item that overlap: ``agree`` is the most of ``window`` aligned tokens that are equal,
    ``n_hits`` counts the verified seed hits, first_token and last_token bound them in the document. The window is
    13 tokens, or the whole item if that is shorter. Null and empty texts match nothing, items of fewer than 5
    tokens are never evidence, repeated rows of either side give the same overlap once, and a null doc_id or item_id
    is an id like any other. Empty tables give an empty result; other columns are not looked at.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens_of(F.col("text").cast("string")).alias("tokens")).where(F.size("tokens") >= MIN_TOKENS)
    masks = _masks_for(items)
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    coded = items.select("item_id", hashed(F.col("tokens")).alias("item_hashes")).distinct()
    # the seeds are a column of their own: a generator over a plain column is compiled with the join after it, so the
    # array of hashes is copied for hits only; the outer form keeps Spark from pushing a test of the seeds' number
    # below the hashes, which would compute them once for every position
    spread = lambda df, own: df.withColumn("seeds", F.concat(*[_seeds(F.col(own), m) for m in masks])).select("*", F.posexplode_outer("seeds").alias("slot", "seed")).drop("seeds")
    # the place of a seed in the concatenation gives back its mask and position
    place = lambda own: _place(F.col("slot"), F.size(own), masks)
    seeds = spread(coded, "item_hashes").withColumn("start", place("item_hashes")).where("seed IS NOT NULL")
    # an item has seeds of its own masks only, so what is found of it does not depend on the other items
    n, mask = F.size("item_hashes"), _place(F.col("slot"), F.size("item_hashes"), masks, number=True)
    wide = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), mask + 1)
    seeds = seeds.where(F.when(n >= WINDOW, mask < len(MASKS)).otherwise(wide == n))
    seeds = materialize(seeds.select("seed", "item_id", "start", F.size("item_hashes").alias("item_size"), _around(F.col("item_hashes"), F.col("start")).alias("item_near")), "seeds")
    wanted = materialize(seeds.select("seed").distinct(), "seeds")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(doc_id).alias("doc_id"), hashed(tokens_of(F.col("text").cast("string"))).alias("doc_hashes"))
    hits = spread(texts, "doc_hashes").join(wanted, "seed", "left_semi").withColumn("at", place("doc_hashes"))
    hits = hits.select("doc_id", "seed", "at", _around(F.col("doc_hashes"), F.col("at")).alias("doc_near")).join(seeds, "seed")
    # a generator again, so that the comparison stays out of the join, which would not be compiled with it
    best = F.array(_window_hits(F.col("doc_near"), F.col("at"), F.col("item_near"), F.col("start"), F.col("item_size")))
    hits = hits.select("doc_id", "item_id", "at", F.inline_outer(best))
    sure = hits.where(F.col("agree") >= F.ceil(F.lit(SIMILARITY) * F.col("wide")))
    return sure.groupBy("doc_id", "item_id").agg(
        F.max("agree").cast("long").alias("agree"),
        F.max("wide").cast("long").alias("window"),
        F.countDistinct("at").alias("n_hits"),
        F.min("at").cast("long").alias("first_token"),
        F.max("at").cast("long").alias("last_token"),
    )


def _place(slot: Column, n: Column, masks: list[str], number: bool = False) -> Column:
    """Token position of a slot in the concatenated seed arrays of a text of ``n`` tokens, or the mask's number."""
    out, before = None, F.lit(0)
    for k, mask in enumerate(masks):
        size = F.greatest(n - len(mask) + 1, F.lit(0))
        inside, told = (slot >= before) & (slot < before + size), F.lit(k) if number else slot - before
        out = F.when(inside, told) if out is None else out.when(inside, told)
        before = before + size
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any overlap with ``benchmark``, unchanged.

    The ids that go are written and counted. Up to ``BROADCAST_ROWS`` of them are sent to the documents, whose texts are
    then not shuffled.
    """
    [name] = spare(docs, "hit")
    hit = materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[name]), "left_anti")
