"""Repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A window is a string of `least` bytes. Windows that are equal choose the same
anchor: of their `GRAM`-byte strings the one with the smallest hash, the last of
equals. So each text falls into contexts, runs of windows with one anchor, and
each window lies in one context; equal windows lie in contexts of one anchor hash.

1. Texts are made distinct by SHA-256 with the number of their copies and written
   once, bucketed by a hash of it, so later joins do not shuffle texts.
2. Anchor rows (anchor hash, context hash, text, place) are counted by anchor; only
   anchors that occur again are kept. A context that occurs again as a whole is
   repeated with all its windows, however often it occurs: counts are combined
   before the shuffle.
3. Contexts that differ but share their anchor meet in one task, one of each, some
   hundred kilobytes of whole anchor groups at a time. There the suffixes are sorted, the
   transform is read off, and longest common prefixes follow breadth-first: value
   l + 1 is set where a symbol's consecutive occurrences have a value-l boundary
   between them. At `least` it stops; suffixes without a value share that many
   bytes, and their windows are repeated.
4. An anchor with more than `group` different contexts is no longer one group: its
   contexts are cut into pieces by the windows' distance from the anchor, grouped
   by the bytes that all windows of a piece share, equal pieces counted; what is
   still mixed is expanded as above, and groups that are still too large are
   counted window by window. So no group is unbounded, and none is dropped.
5. Runs of repeated windows become byte ranges, joined to their text.

Defined cases: null text counts as empty; texts shorter than a window keep all
bytes; rows with the same text or id are reported once each; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import small_batches, text_bytes

LEAST, GRAM = 400, 64
# Different contexts of one anchor that one task may expand; bytes expanded at a time; windows in a piece.
GROUP, BATCH, PIECE = 2000, 1 << 18, 21
# Windows hashed at a time.
SEGMENT = 1 << 20
_M = 0xBF58476D1CE4E5B9
_TABLE = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "big") for i in range(256)], np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each `gram`-byte string (a power of two), by doubling."""
    h, m = _TABLE[data], 1
    while m < gram:
        h = h[:-m] * np.uint64(_M + 2 * m) + h[m:]
        h ^= h >> np.uint64(31)
        m *= 2
    return h * np.uint64(_M)


def anchors(data: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position of each window of a text, and the anchors' hashes."""
    out, hashes, width = [], [], least - gram + 1
    for at in range(0, len(data) - least + 1, SEGMENT):
        some = data[at:at + SEGMENT + least - 1]
        h = gram_hashes(some, gram)
        # Unique values: the hash's upper bits, then the place from the end, so the last of equals is smallest.
        v = (h >> np.uint64(31) << np.uint64(31)) | (np.uint64((1 << 31) - 1) - np.arange(len(h), dtype=np.uint64))
        low, m = v, 1
        while 2 * m <= width:
            low = np.minimum(low[:-m], low[m:])
            m *= 2
        if m < width:
            low = np.minimum(low[:len(low) - (width - m)], low[width - m:])
        place = (1 << 31) - 1 - (low & np.uint64((1 << 31) - 1)).astype(np.int64)
        out.append(at + place)
        hashes.append(h[place])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out), np.concatenate(hashes)


def contexts(data: bytes, least: int = LEAST, gram: int = GRAM):
    """(anchor hash, context hash, first window, windows less one, anchor's distance from the first window) arrays."""
    place, h = anchors(np.frombuffer(data, np.uint8), least, gram)
    if not len(place):
        return None
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    span = np.append(first[1:], len(place)) - first - 1
    code = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (first + span + least).tolist(), strict=True)),
                       np.uint64, len(first))
    return h[first].view(np.int64), code.view(np.int64), first, span, place[first] - first


def suffix_order(text: np.ndarray, end: np.ndarray, owner: np.ndarray, upto: int) -> np.ndarray:
    """Order of the suffixes of separated strings by their first `upto` symbols; a string's end is its own symbol."""
    n, k = len(text), 7
    key = np.zeros(n, np.int64)
    index = np.arange(n)
    for j in range(k):
        at = np.minimum(index + j, n - 1)
        key = (key << 9) | np.where(index + j < end, text[at].astype(np.int64) + 1, 0)
    order = np.argsort(key)
    slots = index  # places in the order that are not final yet: groups of equal suffixes so far
    rank = np.empty(n, np.int64)
    sorted_ = key[order]
    while True:
        first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        alone = first & np.append(first[1:], True)
        slots = slots[~alone]
        if k >= upto or not len(slots):
            return order
        some = order[slots]
        behind = some + k
        # Suffixes that end within the compared part differ by their string.
        second = np.where(behind < end[some], rank[np.minimum(behind, n - 1)] + owner[-1] + 1, owner[some])
        key = rank[some] * (n + int(owner[-1]) + 2) + second
        by = np.argsort(key)
        order[slots], sorted_ = some[by], key[by]
        k *= 2


def repeated_starts(strings: list[bytes], least: int = LEAST) -> np.ndarray:
    """For the strings laid end to end, each followed by one separator: whether the `least` bytes from there occur again."""
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    n, owner = len(text), np.repeat(np.arange(len(strings)), sizes)
    stop = np.repeat(ends - 1, sizes)  # place of the separator
    separator = np.zeros(n, bool)
    separator[ends - 1] = True
    order = suffix_order(text, stop, owner, least)
    # The transform: the symbol before each suffix. Separators are distinct symbols below all bytes.
    before = order - 1
    symbol = np.where(separator[before], -1 - owner[before], text[before].astype(np.int64))
    by = np.argsort(symbol.astype(np.int32), kind="stable")
    step = np.empty(n, np.int64)  # backward extension: the suffix longer by the symbol before
    step[by] = np.arange(n)
    prev = np.full(n, -1, np.int64)
    same = symbol[by][1:] == symbol[by][:-1]
    prev[by[1:][same]] = by[:-1][same]
    border = np.zeros(n, bool)  # suffixes whose common prefix with the one above has a value so far
    border[step[prev < 0]] = True
    border[0] = True
    unset = prev >= 0  # symbols whose extension has no value yet
    new = np.flatnonzero(border)
    for _ in range(1, least):
        if not len(new):
            break
        # Each new border begins a piece of an interval; a symbol in it whose occurrence before lies outside is cut off from that.
        borders = np.flatnonzero(border)
        after = np.append(borders, n)[np.searchsorted(borders, new) + 1]
        sizes_ = after - new
        starts = np.repeat(new, sizes_)
        at = starts + np.arange(len(starts)) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
        cut = at[unset[at] & (prev[at] < starts)]
        unset[cut] = False
        new = step[cut]
        border[new] = True
    again = ~border
    out = np.zeros(n, bool)
    out[order[again]] = True
    out[order[np.flatnonzero(again) - 1]] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _expand(batches: Iterator[pa.RecordBatch], least: int, limit: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows (g, h, c, at, data) sorted by g: runs of repeated windows of each, groups expanded together."""
    held, size, group = [], 0, None

    def flush():
        flags = repeated_starts([r[3] for r in held], least)
        at, rows = 0, []
        for h, c, shift, data in held:
            rows += [(h, c, shift + a, shift + b) for a, b in _runs(flags[at:at + len(data) - least + 1])]
            at += len(data) + 1
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["h", "c", "first", "last"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for g, h, c, at, data in zip(*columns, batch.column(4), strict=True):
            data = data.as_py()
            if g != group and size > limit:
                yield flush()
                held, size = [], 0
            group = g
            held.append((h, c, at, data))
            size += len(data) + 1
    if held:
        yield flush()


def _distinct(docs: DataFrame, text_col: str, least: int) -> str:
    """Name of a table (k, k2, sha, copies, data): texts of at least one window, one row each, in buckets by k."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(text_bytes(text_col).alias("data")).where(F.length("data") >= least)
    rows = rows.select(F.unhex(F.sha2("data", 256)).alias("sha"), "data")

    def once(batches):  # a copy of a text that this task has sent is sent without its bytes
        seen = set()
        for batch in batches:
            sha = batch.column(0).to_pylist()
            data = [None if s in seen or seen.add(s) else batch.column(1)[i].as_py() for i, s in enumerate(sha)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["sha", "data"])

    def merge(batches):  # rows of a text stand together, one with bytes first
        last, data, copies = None, None, 0
        for batch in batches:
            out = []
            for i, s in enumerate(batch.column(0).to_pylist()):
                if s != last:
                    if last is not None:
                        out.append((last, copies, data))
                    last, data, copies = s, batch.column(1)[i].as_py(), 0
                copies += 1
            if out:
                yield rows_of(out)
        if last is not None:
            yield rows_of([(last, copies, data)])

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()),
                                           pa.array([r[2] for r in out], pa.binary())], ["sha", "copies", "data"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(once, "sha binary, data binary").withColumn("k", F.xxhash64("sha"))
    sent = sent.repartition(n, "k").sortWithinPartitions("sha", F.col("data").isNull())
    texts = sent.select("sha", "data").mapInArrow(merge, "sha binary, copies long, data binary")
    texts = texts.select(F.xxhash64("sha").alias("k"), F.hash("sha").alias("k2"), "sha", "copies", "data")
    name = f"repeat_texts_{uuid.uuid4().hex}"
    texts.write.bucketBy(n, "k").option("path", scratch_path(spark, "repeat-texts")).saveAsTable(name)
    return name


def _with_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """`texts` joined with one row per text of (k, k2, ...); only `rows` are shuffled."""
    other = rows.withColumnsRenamed({"k": "_k", "k2": "_k2"}).hint("shuffle_hash")
    return texts.join(other, (F.col("k") == F.col("_k")) & (F.col("k2") - F.col("_k2") == 0)).drop("_k", "_k2")


def repeated_ranges(texts: DataFrame, least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(k, k2, ranges): byte ranges of each text that repeated windows cover."""
    def rows_of(batches):
        for batch in batches:
            k, k2, copies = (batch.column(i).to_pylist() for i in range(3))
            for i, data in enumerate(batch.column(3)):
                got = contexts(data.as_py(), least, gram)
                if got is None:
                    continue
                h, c, first, span, off = got
                m = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(c), pa.array(np.full(m, k[i])), pa.array(np.full(m, k2[i], np.int32)), pa.array(first.astype(np.int32)),
                     pa.array(span.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(np.full(m, copies[i]))],
                    ["h", "c", "k", "k2", "first", "span", "off", "copies"])

    rows = materialise(texts.select("k", "k2", "copies", "data").mapInArrow(
        rows_of, "h long, c long, k long, k2 int, first int, span int, off int, copies long"), "anchors")
    again = rows.groupBy("h").agg(F.sum("copies").alias("n"), (F.min("c") != F.max("c")).alias("mixed")).where("n > 1").select("h", "mixed")
    # Written first, so that the join sees two plain shuffles and can split a hot anchor.
    rows = materialise(rows.join(materialise(again, "anchors-kept"), "h"), "anchors-again")
    whole = rows.groupBy("h", "c", "mixed").agg(F.sum("copies").alias("n"), F.max("span").alias("span"),
                                                F.min(F.struct("k", "k2", "first", "off")).alias("rep"))
    whole = materialise(whole, "contexts")
    marks = whole.where("n > 1").select("h", "c", F.lit(0).cast("long").alias("first"), F.col("span").cast("long").alias("last"))
    mixed = whole.where("mixed")
    sizes = mixed.groupBy("h").agg(F.count("*").alias("m"))
    wanted = mixed.join(sizes, "h").select(F.col("rep.k").alias("k"), F.col("rep.k2").alias("k2"), F.struct(
        "h", "c", F.col("rep.first").alias("first"), "span", F.col("rep.off").alias("off"), (F.col("m") > group).alias("hot")).alias("w"))
    wanted = wanted.groupBy("k", "k2").agg(F.collect_list("w").alias("wanted"))  # at most a text's own contexts

    def cut(batches):
        for batch in batches:
            out = []
            for data, wanted_ in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py()
                for w in wanted_.as_py():
                    at, size = w["first"], w["span"] + least
                    out.append((w["h"], w["c"], w["off"], w["hot"], data[at:at + size]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                ["h", "c", "off", "hot", "data"])

    found = materialise(_with_text(texts.select("k", "k2", "data"), wanted).select("data", "wanted").mapInArrow(
        cut, "h long, c long, off long, hot boolean, data binary"), "context-bytes")

    def expand(df):
        return df.repartition("g").sortWithinPartitions("g").select("g", "h", "c", "at", "data").mapInArrow(
            lambda b: _expand(b, least), "h long, c long, first long, last long")

    plain = found.where("not hot").select(F.col("h").alias("g"), "h", "c", F.lit(0).cast("long").alias("at"), "data")
    marks = marks.unionByName(expand(plain))
    hot = found.where("hot")
    if hot.limit(1).count():
        marks = marks.unionByName(_hot_marks(hot, least, gram, group, expand))
    marks = materialise(marks, "marks")
    ranges = rows.join(marks.withColumnsRenamed({"first": "from", "last": "to"}), ["h", "c"]).select(
        "k", "k2", F.struct((F.col("first") + F.col("from")).alias("a"), (F.col("first") + F.col("to") + least).alias("b")).alias("r"))
    return ranges.groupBy("k", "k2").agg(F.collect_list("r").alias("ranges"))  # at most a text's own windows


def _hot_marks(hot: DataFrame, least: int, gram: int, group: int, expand) -> DataFrame:
    """Marks of the contexts of anchors with too many different contexts."""
    def pieces(batches):
        for batch in batches:
            out = []
            for h, c, off, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                # Window s is off - s before the anchor; pieces hold distances of one multiple of PIECE.
                s, last = 0, len(data) - least
                while s <= last:
                    part = (off - s) // PIECE
                    to = min(last, off - part * PIECE)
                    inner = data[off - part * PIECE:off - (part + 1) * PIECE + 1 + least] if part >= 0 else b""
                    core = xxhash.xxh3_64_intdigest(inner + part.to_bytes(4, "little"), h & (1 << 64) - 1)
                    own = data[s:to + least]
                    out.append((core, h, c, s, own, xxhash.xxh3_64_intdigest(own)))
                    s = to + 1
            kinds = (pa.uint64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.uint64())
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            columns[0], columns[5] = (pa.array(np.array([r[k] for r in out], np.uint64).view(np.int64)) for k in (0, 5))
            yield pa.RecordBatch.from_arrays(columns, ["g", "h", "c", "at", "data", "d"])

    parts = materialise(hot.select("h", "c", "off", "data").mapInArrow(
        pieces, "g long, h long, c long, at long, data binary, d long"), "hot-pieces")
    equal = parts.groupBy("g", "d").agg(F.count("*").alias("n"), F.min(F.struct("h", "c", "at")).alias("rep"))
    equal = materialise(equal, "hot-equal")
    sizes = equal.groupBy("g").agg(F.count("*").alias("m"))
    owners = parts.select("g", "d", "h", "c", "at", (F.length("data") - least).cast("long").alias("span"))
    many = equal.where("n > 1").select("g", "d")
    marks = owners.join(many, ["g", "d"]).select("h", "c", F.col("at").alias("first"), (F.col("at") + F.col("span")).alias("last"))
    # One of each piece goes on, with its bytes.
    reps = equal.join(sizes.where("m > 1"), "g").select("g", "d", "m", "rep.h", "rep.c", "rep.at")
    reps = materialise(parts.select("g", "d", "h", "c", "at", "data").join(reps, ["g", "d", "h", "c", "at"]), "hot-mixed")
    single = expand(reps.where(F.col("m") <= group).select("g", "h", "c", "at", "data"))

    def windows(batches):
        for batch in batches:
            out = []
            for h, c, at, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for s in range(len(data) - least + 1):
                    d = xxhash.xxh3_128_digest(data[s:s + least])
                    out.append((h, c, at + s, d))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k < 3 else pa.binary()) for k in range(4)],
                                             ["h", "c", "first", "d"])

    each = materialise(reps.where(F.col("m") > group).select("h", "c", "at", "data").mapInArrow(
        windows, "h long, c long, first long, d binary"), "hot-windows")
    twice = each.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    exact = each.join(twice, "d").select("h", "c", "first", F.col("first").alias("last"))
    # What holds for a representative holds for its equals, which `marks` covers already.
    return marks.unionByName(single).unionByName(exact)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM,
            group: int = GROUP) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    small_batches(docs.sparkSession)
    texts_name = _distinct(docs, text_col, least)
    texts = docs.sparkSession.table(texts_name)
    ranges = repeated_ranges(texts, least, gram, group)

    def strip(batches):
        for batch in batches:
            out = []
            for sha, data, ranges_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = data.as_py()
                edge = np.zeros(len(data) + 1, np.int32)
                got = np.array([(r["a"], r["b"]) for r in ranges_.as_py()])
                np.add.at(edge, got[:, 0], 1)
                np.add.at(edge, got[:, 1], -1)
                runs = _runs(np.cumsum(edge[:-1]) > 0)
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(data[at:a])
                    at = b + 1
                kept.update(data[at:])
                out.append((sha, sum(b - a + 1 for a, b in runs), len(runs), kept.hexdigest()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)],
                                             ["sha", "n_removed", "n_spans", "kept"])

    done = materialise(_with_text(texts.select("k", "k2", "sha", "data"), ranges).select("sha", "data", "ranges").mapInArrow(
        strip, "sha binary, n_removed long, n_spans long, kept string"), "stripped")
    data = text_bytes(text_col)
    docs.sparkSession.sql(f"drop table if exists {texts_name}")  # the files stay until the shared folder is cleared
    rows = docs.select(F.col(id_col).alias("_id"), F.length(data).cast("long").alias("n_bytes"), F.unhex(F.sha2(data, 256)).alias("sha"))
    return rows.join(done, "sha", "left").select(
        F.col("_id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", F.lower(F.hex("sha"))).alias("kept_sha256"))
