"""The Gumbel-max orderings of `functions.draws` in numpy: the same numbers, hashed many at a time.

A draw's noise is an md5 of its counters. One entry and draw is one hash, so the
cost is theirs; all else is avoided: entries stand in the order of their utility, a
draw keeps its first ten so far, and the logarithms are only taken where the hash
can still pass the tenth. What a task holds is one contest's utilities and ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws
from ..functions.draws import GUMBEL_HIGH
from .grouping import spread, top_k

PLACES = 10
# Draws that a task takes at a time.
BLOCK_DRAWS = 500
# Hashes taken together: their buffers stay in a core's cache.
TOGETHER = 32_768
_K = [int(abs(math.sin(i + 1)) * 2 ** 32) & 0xFFFFFFFF for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [(1, 0), (5, 1), (3, 5), (7, 0)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(state: list[np.ndarray], words: list[np.ndarray | None], last: bool) -> list[np.ndarray]:
    """The state after one block of 16 words (None: zero); of the last block only the first word of the state is right."""
    a, b, c, d = (s.copy() for s in state)
    t, turned = np.empty_like(a), np.empty_like(a)
    for i in range(61 if last else 64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        step, first = _WORD[kind]
        word, turn = words[(step * i + first) % 16], np.uint32(_TURN[kind][i % 4])
        t += a
        t += np.uint32(_K[i]) if word is None else word + np.uint32(_K[i])
        np.left_shift(t, turn, out=turned)
        t >>= np.uint32(32) - turn
        t |= turned
        t += b
        a, b, c, d, t = d, t, b, c, a
    if last:
        return [state[0] + b]
    return [s + x for s, x in zip(state, (a, b, c, d), strict=True)]


def _words(texts: np.ndarray, at: int, size: int) -> np.ndarray:
    """Equally long byte rows as little-endian words of `size` bytes, placed `at` bytes from the start."""
    out = np.zeros((len(texts), size), np.uint8)
    out[:, at:at + texts.shape[1]] = texts
    return out.view("<u4")


def draw_ints(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """`draws.draw_int` of each head followed by each tail: rows of bytes, all heads of one length and all tails of one."""
    p, n = heads.shape[1], heads.shape[1] + tails.shape[1]
    size = ((n + 8) // 64 + 1) * 64
    ended = np.concatenate((tails, np.full((len(tails), 1), 0x80, np.uint8)), 1)
    head, tail = _words(heads, 0, size), _words(ended, p, size)
    tail[:, -2:] |= np.array([8 * n & 0xFFFFFFFF, 8 * n >> 32], np.uint32)
    state = [np.full((len(heads), len(tails)), s, np.uint32) for s in _START]
    for at in range(0, size // 4, 16):
        words = []
        for w in range(at, at + 16):
            x, y = head[:, w], tail[:, w]
            if x.any():
                words.append(x[:, None] | y[None, :] if y.any() else x[:, None])
            else:
                words.append(y[None, :] if y.any() else None)
        state = _block(state, words, at + 16 == size // 4)
    return state[0].byteswap()


def _bytes(texts: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)


def first_ten(utility: np.ndarray, tails: Sequence[bytes], seed: int, numbers: range) -> np.ndarray:
    """The entries at the first places of each draw (-1: none), from known utilities; ties fall to the lower position."""
    n, D = len(utility), len(numbers)
    best, who = np.full((D, PLACES), -np.inf), np.full((D, PLACES), n)
    heads: dict[int, list[int]] = {}
    for i, draw in enumerate(numbers):
        heads.setdefault(len(str(draw)), []).append(i)
    heads = [(np.array(own), _bytes([f"{seed}/{numbers[i]}".encode() for i in own])) for own in heads.values()]
    order = np.argsort(-utility, kind="stable")
    lengths = np.array([len(t) for t in tails])
    start, width = 0, 32
    while start < n:
        tile = order[start:start + width]
        start, width = start + width, max(32, TOGETHER // D)
        with np.errstate(over="ignore", invalid="ignore"):
            gap = best[:, -1] - utility[tile[0]]
            least = np.nan_to_num(np.exp(-np.exp(-gap))) * 4294967296.0 * (1 - 1e-12) - 2
        if (gap > GUMBEL_HIGH).all():
            break  # and the utilities to come are no larger
        least = np.clip(least, 0, 4294967295).astype(np.uint32)
        found = [(np.repeat(np.arange(D), PLACES), best.ravel(), who.ravel())]
        for length in np.unique(lengths[tile]):
            part = tile[lengths[tile] == length]
            ends = _bytes([tails[i] for i in part])
            for own, head in heads:
                ints = draw_ints(head, ends)
                r, c = np.nonzero(ints >= least[own][:, None])
                noise = -np.log(-np.log((ints[r, c] + 0.5) / 4294967296.0))
                found.append((own[r], utility[part[c]] + noise, part[c]))
        r, g, i = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = np.lexsort((i, -g, r))
        edge = np.searchsorted(r[keep], np.arange(D))
        keep = keep[edge[:, None] + np.arange(PLACES)]
        best, who = g[keep], i[keep]
    return np.where(who < n, who, -1)


def places(utility: np.ndarray, known: np.ndarray, tails: Sequence[bytes], seed: int, numbers: range) -> tuple[np.ndarray, np.ndarray]:
    """How many of the draws place each entry among the first three and ten.

    Entries stand in the order of their ids. As in a descending sort of Spark's, no
    number at all (NaN) comes first and what is not `known` last.
    """
    podium, top = np.zeros(len(utility), np.int64), np.zeros(len(utility), np.int64)
    odd = known & np.isnan(utility)
    fine = np.flatnonzero(known & ~odd)
    before = np.flatnonzero(odd)[:PLACES]
    order = first_ten(utility[fine], [tails[i] for i in fine], seed, numbers) if len(fine) and len(before) < PLACES else np.empty((0, PLACES), np.int64)
    after = np.flatnonzero(~known)[:PLACES]
    for count, k in ((podium, 3), (top, PLACES)):
        count[before[:k]] += len(numbers)
        some = order[:, :max(k - len(before), 0)]
        count[fine] += np.bincount(some[some >= 0], minlength=len(fine))
        count[after[:max(k - len(before) - len(fine), 0)]] += len(numbers)
    return podium, top


def _counted(batches: Iterator[pa.RecordBatch], keys: int, seed: int, n_draws: int, block: int) -> Iterator[pa.RecordBatch]:
    """Per contest, utility and block of draws the entries that some draw places, with their number of podiums and of first tens."""
    for batch in batches:
        names = batch.schema.names
        of, at, u, ids, tails = (batch.column(keys + i) for i in range(5))
        for r in range(batch.num_rows):
            first = at[r].as_py() * block + 1
            utility = u[r].values
            podium, top = places(utility.to_numpy(zero_copy_only=False).astype(float), utility.is_valid().to_numpy(zero_copy_only=False),
                                 [t.encode() for t in tails[r].as_py()], seed, range(first, min(first + block, n_draws + 1)))
            some = np.flatnonzero(top)
            same = [pa.array([batch.column(k)[r].as_py()] * len(some), batch.column(k).type) for k in range(keys)]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(np.full(len(some), of[r].as_py(), np.int32)), ids[r].values.take(pa.array(some)), pa.array(podium[some]), pa.array(top[some])],
                [*names[:keys], "_of", "driver", "_podium", "_top"])


def hashed_draws(rows: DataFrame, names: Mapping[int, str], n_draws: int, seed: int, contest: Sequence[str], draw_keys: Sequence[str]) -> DataFrame:
    """Podiums and first tens per utility, entry and block of draws; a contest's utilities meet once a block."""
    tail = F.concat_ws("/", F.lit(""), *[F.col(c).cast("string") for c in draw_keys], F.col("driver").cast("string"))
    each = F.array_compact(F.array(*[F.when(F.col(f"_r{i}"), F.struct(F.lit(i).alias("_of"), F.col(u).cast("double").alias("_u"))) for i, u in names.items()]))
    entry = F.struct(F.col("driver").isNull().alias("_none"), "driver", "_u", "_tail")
    listed = (rows.select(*contest, "driver", tail.alias("_tail"), F.inline(each)).groupBy(*contest, "_of")
              .agg(F.sort_array(F.collect_list(entry)).alias("_e")))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_draws - 1) // BLOCK_DRAWS))).alias("_block")
    listed = listed.select(*contest, "_of", blocks, F.col("_e._u").alias("_u"), F.col("_e.driver").alias("_ids"), F.col("_e._tail").alias("_tails"))
    keys = len(contest)
    schema = T.StructType([*rows.select(*contest).schema.fields, T.StructField("_of", T.IntegerType()), rows.schema["driver"],
                           T.StructField("_podium", T.LongType()), T.StructField("_top", T.LongType())])
    listed.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
    return spread(listed, *contest, "_of", "_block").mapInArrow(lambda batches: _counted(batches, keys, seed, n_draws, BLOCK_DRAWS), schema)


def ranked_draws(rows: DataFrame, names: Mapping[int, str], n_draws: int, seed: int, contest: Sequence[str], draw_keys: Sequence[str]) -> DataFrame:
    """The counts of `hashed_draws` by one rank per entry and draw: no contest meets in one task."""
    # Every contest keeps at least ten entries, and rows of one contest stand apart, so that the draws spread evenly.
    noisy = spread(rows, *contest, "driver").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    noisy = noisy.withColumn("_noise", draws.gumbel(seed, F.col("draw"), *[F.col(c) for c in draw_keys], F.col("driver")))
    each = [F.when(F.col(f"_r{i}"), F.struct(F.lit(i).alias("_of"), (F.col(u) + F.col("_noise")).alias("_g"))) for i, u in names.items()]
    noisy = noisy.select(*contest, "driver", "draw", F.inline(F.array_compact(F.array(*each))))
    first = top_k(noisy, [*contest, "_of", "draw"], [("_g", "desc"), ("driver", "asc")], 10)
    return first.groupBy(*contest, "_of", "driver").agg(F.count(F.when(F.col("place") <= 3, 1)).alias("_podium"), F.count(F.lit(1)).alias("_top"))
