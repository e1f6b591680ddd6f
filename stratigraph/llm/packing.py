"""Hierarchical packing of tokenised documents into windows of several lengths.

Documents are routed by length to context tiers (512, 1024 and 2048 tokens). Whole windows of a long document are cut
off first. Every remainder of the largest tier opens a window; what it leaves free is filled with the longest whole
documents of shorter tiers that fit, and the last gap with the head of the next one, whose rest is routed again.
The shorter tiers are packed alike. A window is therefore full, and its length a power of two. Finished windows are
then dealt to step groups of equal token count whose attention cost (the squares of the piece lengths) is balanced.

Tokens never leave the task that made them: a task streams over its part of the table, holds at most ``BLOCK``
tokens and one document, and emits pieces only. There is no shuffle and no key, so a hot source cannot hurt.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratigraph.session import ship

#: Window lengths, shortest first.
TIERS = (512, 1024, 2048)
#: Id that ends every document.
END = 1
#: Tokens that a task gathers before it packs them.
BLOCK = 2_000_000
#: Tokens of one training step group.
STEP_TOKENS = 16 * 2048
VOCABULARY = "byte_bpe_50k"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier long, step_group long"


def encoder(folder: str | None = None) -> Callable[[str], list[int]]:
    """Ids that the public byte-level BPE vocabulary's JSON file gives in the tokenizers library.

    The file lies in ``folder`` or where the installed package has it. Its own encoder takes 475 ms a MB of text, which
    is over the time that packing may take, so the ranks file of the same vocabulary is tried first: the same ids, the
    special string included, in 100 ms. Where that encoder gives a text up (a million blanks exceed its stack), the
    JSON file's encoder takes the whole text.
    """
    import base64
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    place = lambda name: os.path.join(folder, name) if folder else public_tokenizers.path(name)
    with open(place(f"{VOCABULARY}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coding = tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    exact: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        try:
            return coding.encode(text, allowed_special="all")
        except ValueError:
            if not exact:
                exact.append(Tokenizer.from_file(place(f"{VOCABULARY}.json")))
            return exact[0].encode(text, add_special_tokens=False).ids

    return encode


class Packer:
    """Packs documents that come one by one; ``out`` gathers (doc, start, length, sequence, offset, tier)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tiers
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # by tier: (length, document, start), sorted
        self.out: list[tuple[int, int, int, int, int, int]] = []
        self.held = self.made = 0

    def add(self, doc: int, n: int) -> None:
        """Cut whole windows of the largest tier off, route the rest."""
        top = self.tiers[-1]
        for start in range(0, n - top + 1, top):
            self._window([(top, doc, start)], top)
        if rest := n % top:
            self._route((rest, doc, n - rest))

    def _route(self, piece: tuple[int, int, int]) -> None:
        insort(self.pools[next(k for k, t in enumerate(self.tiers) if piece[0] <= t)], piece)
        self.held += piece[0]

    def _take(self, tier: int, at: int) -> tuple[int, int, int]:
        piece = self.pools[tier].pop(at)
        self.held -= piece[0]
        return piece

    def _window(self, pieces: list[tuple[int, int, int]], tier: int) -> None:
        offset = 0
        for length, doc, start in pieces:
            self.out.append((doc, start, length, self.made, offset, tier))
            offset += length
        self.made += 1

    def pack(self) -> None:
        """Fill windows while enough is held for one of the tier; what cannot fill a window waits for more."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.pools[tier] and self.held >= self.tiers[tier]:
                self._window(self._fill(tier), self.tiers[tier])

    def _fill(self, tier: int) -> list[tuple[int, int, int]]:
        pieces = [self._take(tier, -1)]
        gap = self.tiers[tier] - pieces[0][0]
        while gap:
            fitting = next((k for k in range(tier, -1, -1) if self.pools[k] and self.pools[k][0][0] <= gap), None)
            if fitting is not None:
                piece = self._take(fitting, bisect_right(self.pools[fitting], (gap, float("inf"), 0)) - 1)
            else:  # nothing fits whole: the shortest piece there is gives its head
                length, doc, start = self._take(next(k for k, p in enumerate(self.pools) if p), 0)
                piece = (gap, doc, start)
                self._route((length - gap, doc, start + gap))
            pieces.append(piece)
            gap -= piece[0]
        return pieces

    def flush(self) -> None:
        """Pack all; the end is one run of pieces cut into windows of halving powers of two, which need no padding."""
        self.pack()
        rest = [p for pool in self.pools for p in pool]
        self.pools, self.held = [[] for _ in self.tiers], 0
        total = sum(p[0] for p in rest)
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            total -= size
            pieces, gap = [], size
            while gap:
                length, doc, start = rest.pop()
                pieces.append((min(length, gap), doc, start))
                if length > gap:
                    rest.append((length - gap, doc, start + gap))
                gap -= pieces[-1][0]
            self._window(pieces, size)


def step_groups(pieces: pd.DataFrame, step_tokens: int = STEP_TOKENS) -> np.ndarray:
    """Step group of each piece: windows in order of attention cost are dealt in turn to the groups of their block.

    Windows of equal length go to groups by turns that reverse each time, so every group gets a like number of each
    length and a like cost; the number of groups is the block's tokens over ``step_tokens``, one at least.
    """
    cost = (pieces["length"].astype(float) ** 2).groupby(pieces["sequence"]).sum()
    size = pieces.groupby("sequence")["tier"].first()
    groups = max(1, round(size.sum() / step_tokens))
    order = pd.DataFrame({"size": size, "cost": cost}).sort_values(["size", "cost"], ascending=False, kind="stable").index
    turn = np.arange(len(order)) % (2 * groups)
    dealt = pd.Series(np.where(turn < groups, turn, 2 * groups - 1 - turn), index=order)
    return dealt.reindex(pieces["sequence"]).to_numpy()


def _pieces(batches: Iterator[pd.DataFrame], folder: str | None, tiers: tuple[int, ...], block: int) -> Iterator[pd.DataFrame]:
    encode, packer, base = encoder(folder), Packer(tiers), TaskContext.get().partitionId() << 40
    ids: dict[int, np.ndarray] = {}  # of documents with tokens still to be placed
    left: dict[int, int] = {}
    names: dict[int, int | None] = {}
    groups = seen = waiting = 0

    def emitted() -> pd.DataFrame:
        nonlocal groups
        made = pd.DataFrame(packer.out, columns=["doc", "start", "length", "sequence", "offset", "tier"])
        packer.out = []
        made["crc"] = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n in zip(made["doc"], made["start"], made["length"], strict=True)]
        made["total"] = [len(ids[d]) for d in made["doc"]]
        dealt = step_groups(made)
        out = pd.DataFrame({
            "doc_id": pd.array([names[d] for d in made["doc"]], "Int64"), "start": made["start"], "length": made["length"], "ids_crc32": made["crc"], "doc_tokens": made["total"],
            "sequence_id": base + made["sequence"], "offset": made["offset"], "sequence_tokens": made["tier"], "tier": made["tier"].clip(lower=tiers[0]), "step_group": base + groups + dealt,
        })
        groups += int(dealt.max()) + 1
        for d, n in zip(made["doc"], made["length"], strict=True):
            left[d] -= n
            if not left[d]:
                del ids[d], left[d], names[d]
        return out

    for batch in batches:
        for name, text in zip(batch["doc_id"], batch["text"], strict=True):
            own = np.array([*encode(text or ""), END], "<u4")
            ids[seen], left[seen], names[seen] = own, len(own), None if pd.isna(name) else int(name)
            packer.add(seen, len(own))
            seen += 1
            waiting += len(own)
            if waiting >= block:
                packer.pack()
                if packer.out:
                    yield emitted()
                waiting = 0
    packer.flush()
    if packer.out:
        yield emitted()


def pack(docs: DataFrame, folder: str | None = None, tiers: tuple[int, ...] = TIERS, block: int = BLOCK) -> DataFrame:
    """Pack all documents; one row per piece.

    doc_id, start (ids of the document before the piece), length, ids_crc32 (of the piece's ids as little-endian
    unsigned 32-bit numbers), doc_tokens (the end id included), sequence_id, offset (of the piece in its sequence,
    gapless from 0), sequence_tokens, tier (the context tier whose steps the sequence joins), step_group. A null or
    empty text is the end id alone. Repeated rows are packed each. doc_id may be null. An empty table gives an empty
    result; other columns are not looked at. sequence_tokens is a power of two, so no sequence needs padding; the
    few short ones end the stream of each task. Sequence ids hold the task's partition number above 40 bits.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(lambda batches: _pieces(batches, folder, tiers, block), SCHEMA)
