"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of word characters. Shared-token seeds (runs of
`MIN_TILE` tokens) join documents with test items: a document's seeds are looked
up by their rolling hash among the items' seeds. An item can reach the threshold
only with at least ceil(threshold * tokens / MIN_TILE) of its seed positions in
the document, so that many less one of its most common seeds are not looked up
(prefix filter; it loses nothing). Each pair found so is tiled on its tokens:
Karp-Rabin search for common runs, longest first, marking runs that do not
overlap, with shorter and shorter search lengths down to `MIN_TILE`. The share
of an item's tokens under tiles is its coverage, whatever the order of the
passages. Pairs at `THRESHOLD` or above are returned.

Items are sent to the tasks in blocks of at most `BLOCK_TOKENS` tokens, measured
before they are sent; a larger benchmark takes further passes over the documents.
A document is tiled where it is read, so nothing is shuffled and no document or
passage is a hot key.

Defined cases: null texts count as empty; items with fewer than `MIN_TILE`
tokens have no tile and match nothing; rows with a null id are reported with it;
repeated documents are reported once each, repeated items once each; empty
tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

MIN_TILE = 5
THRESHOLD = 0.5
BLOCK_TOKENS = 2_000_000
WORD = re.compile(r"\w+")
# Multipliers of the rolling hashes modulo 2^64 (seeds) and modulo a prime (tiling).
BASE64, PRIME, BASE = 0x9E3779B97F4A7C15, (1 << 61) - 1, 1_000_003


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def seed_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` token numbers."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE64) + ids[k:len(ids) - size + 1 + k].astype(np.uint64) + np.uint64(1)
    return total ^ (total >> np.uint64(31))


def _windows(seq: list[int], marked: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """(position, Karp-Rabin hash) of each unmarked run of `size` tokens."""
    drop, at = pow(BASE, size, PRIME), 0
    while at < len(seq):
        if marked[at]:
            at += 1
            continue
        end = marked.find(1, at)
        end = len(seq) if end < 0 else end
        if end - at >= size:
            h = 0
            for x in seq[at:at + size]:
                h = (h * BASE + x + 1) % PRIME
            yield at, h
            for i in range(at + size, end):
                h = (h * BASE + seq[i] + 1 - (seq[i - size] + 1) * drop) % PRIME
                yield i - size + 1, h
        at = end


def tile(doc: list[int], item: list[int], min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document position, item position, length), longest tiles first."""
    out: list[tuple[int, int, int]] = []
    d_marked, i_marked = bytearray(len(doc)), bytearray(len(item))
    size = max(min_tile, len(item) // 2)
    while True:
        table = defaultdict(list)
        for at, h in _windows(item, i_marked, size):
            table[h].append(at)
        runs = []
        for d, h in _windows(doc, d_marked, size) if table else ():
            for i in table.get(h, ()):
                if d and i and doc[d - 1] == item[i - 1] and not d_marked[d - 1] and not i_marked[i - 1]:
                    continue  # part of the run that begins before it
                n = 0
                while (d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n]
                       and not d_marked[d + n] and not i_marked[i + n]):
                    n += 1
                if n >= size:
                    runs.append((-n, d, i))
        heapq.heapify(runs)
        while runs:
            n, d, i = heapq.heappop(runs)
            free = [not (d_marked[d + k] or i_marked[i + k]) for k in range(-n)]
            if all(free):
                d_marked[d:d - n] = i_marked[i:i - n] = b"\x01" * -n
                out.append((d, i, -n))
                continue
            start = 0  # what is left of the run may still be long enough
            for k, ok in enumerate([*free, False]):
                if not ok:
                    if k - start >= size:
                        heapq.heappush(runs, (start - k, d + start, i + start))
                    start = k + 1
        if size == min_tile:
            return out
        size = max(min_tile, size // 2)


class Items:
    """Test items of one block, ready for look-ups."""

    def __init__(self, rows: list[tuple[int, list[str]]], min_tile: int, threshold: float):
        self.min_tile, self.threshold = min_tile, threshold
        self.number: dict[str, int] = {}
        self.rows = [(i, [self.number.setdefault(w, len(self.number)) for w in words]) for i, words in rows]
        seeds = [seed_hashes(np.array(ids, np.int64), min_tile) for _, ids in self.rows]
        common = Counter(h for s in seeds for h in set(s.tolist()))
        keys, owner = [], []
        for n, (s, (_, ids)) in enumerate(zip(seeds, self.rows, strict=True)):
            spare = max(0, math.ceil(threshold * len(ids) / min_tile) - 1)
            kept = sorted(s.tolist(), key=lambda h: (-common[h], h))[spare:]
            keys += set(kept)
            owner += [n] * len(set(kept))
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys, self.owner = np.array(keys, np.uint64)[order], np.array(owner, np.int64)[order]

    def candidates(self, texts: list[list[int]]) -> dict[int, set[int]]:
        """Text number to item numbers that share a seed with it."""
        out: dict[int, set[int]] = defaultdict(set)
        flat = np.array([x for t in texts for x in (*t, -1)], np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts])
        hashes = seed_hashes(flat, self.min_tile)
        whole = np.convolve(flat < 0, np.ones(self.min_tile, np.int64), "valid") == 0 if len(hashes) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        lo = np.searchsorted(self.keys, hashes[at])
        hit = lo < len(self.keys)
        hit[hit] = self.keys[lo[hit]] == hashes[at][hit]
        for p, k in zip(at[hit].tolist(), lo[hit].tolist(), strict=True):
            text, h = int(np.searchsorted(ends, p, "right")), self.keys[k]
            while k < len(self.keys) and self.keys[k] == h:
                out[text].add(int(self.owner[k]))
                k += 1
        return out

    def covered(self, doc: list[int], n: int) -> tuple[int, int]:
        """(tiles, tokens under tiles) of item number n in a document."""
        ids = self.rows[n][1]
        own = set(ids)
        # Tokens that the item lacks end every match: runs of them count as one.
        kept, gap = [], True
        for x in doc:
            if x in own:
                kept.append(x)
                gap = False
            elif not gap:
                kept.append(-2)
                gap = True
        tiles = tile(kept, ids, self.min_tile)
        return len(tiles), sum(t[2] for t in tiles)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_tokens: int):
    """Blocks of items, each of at most `block_tokens` tokens (or one item), read one block at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        words = tokens(r.text)
        if block and size + len(words) > block_tokens:
            yield block
            block, size = [], 0
        block.append((r.id, words))
        size += len(words)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", min_tile: int = MIN_TILE,
                 threshold: float = THRESHOLD, block_tokens: int = BLOCK_TOKENS, keep: bool = False) -> DataFrame:
    """Pairs (id, item_id, n_tiles, covered, item_tokens, coverage) at or above the threshold.

    With `keep`, instead the rows of `docs` that match no item, all columns kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs if keep else None
    pairs = f"{id_col} long, {item_col} long, n_tiles long, covered long, item_tokens long, coverage double"
    for block in _blocks(items, item_col, item_text, block_tokens):
        sent = spark.sparkContext.broadcast(Items(block, min_tile, threshold))  # at most block_tokens tokens

        def read(batch: pa.RecordBatch, column: int, sent=sent):
            number = sent.value.number
            texts = [[number.get(w, -1) for w in tokens(t.as_py())] for t in batch.column(column)]
            for text, found in sorted(sent.value.candidates(texts).items()):
                for n in sorted(found):
                    item, ids = sent.value.rows[n]
                    tiles, covered = sent.value.covered(texts[text], n)
                    if covered >= threshold * len(ids):
                        yield text, item, tiles, covered, len(ids)

        if keep:
            def clean(batches, read=read, at=out.columns.index(text_col)):
                for batch in batches:
                    hit = {r[0] for r in read(batch, at)}
                    yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_())) if hit else batch

            out = out.mapInArrow(clean, T.StructType(docs.schema.fields))
        else:
            def found(batches, read=read):
                for batch in batches:
                    rows = [(batch.column(0)[text].as_py(), *rest, rest[2] / rest[3]) for text, *rest in read(batch, 1)]
                    kinds = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)],
                                                     [id_col, item_col, "n_tiles", "covered", "item_tokens", "coverage"])

            some = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(
                found, pairs)
            out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], pairs) if out is None else out
