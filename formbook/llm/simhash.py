"""SimHash fingerprints and their near matches by multi-index hashing.

Fingerprints: 64 bits over the XXH64 hashes of word shingles. Equal fingerprints
are one node. A fingerprint is cut into `SEGMENTS` segments; two fingerprints
that differ in at most `distance` bits differ in at most distance // SEGMENTS
bits of one segment. So each segment has a table of its values, and each
fingerprint looks up the small Hamming ball around its own value. A table entry
and the look-ups that reach it share a shuffle key (segment, value). A task holds
its keys sorted in numpy and compares look-ups with the entries of their key on all
64 bits; for keys with more than a few entries it keeps a spanning forest of the
links, so links grow with the rows and not with the pairs. Entries of a key that many fingerprints share are
spread over `split` sub-keys by a hash, and look-ups of such keys go to each
sub-key, so no key meets in one task. Components follow from the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import small_batches, text_bytes
from .components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENTS = 3
# Table entries of one (segment, value) that one task may hold.
ENTRIES_PER_KEY = 4096
# Shingle hashes summed at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of UTF-8 text, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:len(words) - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1:].tolist(), strict=True)),
                         np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        some = hashes[at:at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Null text counts as empty."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).mapInArrow(
        of, "id long, fp long")


def segments_of(bits: int = 64, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    cuts = [round(bits * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _ball(width: int, radius: int) -> list[int]:
    """Masks of at most `radius` set bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _matches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links between look-ups and table entries of each key of this task."""
    read = [b for b in batches if b.num_rows]
    if not read:
        return
    key, fp, probe = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in read]) for i in range(3))
    del read
    order = np.lexsort((fp, probe, key))
    key, fp, probe = key[order], fp[order].view(np.uint64), probe[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(starts[1:], len(key))
    entries = np.add.reduceat(~probe, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    few, a_out, b_out = 8, [], []
    # Keys with a few entries: all keys at once, entry by entry.
    rows = np.arange(len(key))
    group = np.repeat(np.arange(len(starts)), ends - starts)
    for nth in range(few):
        sel = rows[(entries[group] > nth) & (entries[group] <= few) & (probe | (rows > starts[group] + nth))]
        other = starts[group[sel]] + nth
        near = np.bitwise_count(fp[sel] ^ fp[other]) <= distance
        near &= fp[sel] != fp[other]
        a_out.append(fp[sel[near]])
        b_out.append(fp[other[near]])
    for g in np.flatnonzero(entries > few):
        lo, mid, hi = starts[g], starts[g] + entries[g], ends[g]
        a, b = _linked(fp[lo:mid], fp[lo:hi], distance)
        a_out.append(a)
        b_out.append(b)
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _linked(table: np.ndarray, other: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of table entries with each other and with look-ups: breadth-first search."""
    entries = np.unique(table)
    probes = np.setdiff1d(other, entries)
    a, b = [], []
    while len(entries):
        queue, entries = [(entries[0], True)], entries[1:]
        while queue:
            value, entry = queue.pop()
            near = np.bitwise_count(entries ^ value) <= distance
            found = [(x, True) for x in entries[near]]
            entries = entries[~near]
            if entry:
                near = np.bitwise_count(probes ^ value) <= distance
                found += [(x, False) for x in probes[near]]
                probes = probes[~near]
            a += [value] * len(found)
            b += [x for x, _ in found]
            queue += found
    return np.array(a, np.uint64), np.array(b, np.uint64)


def near_links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS,
               entries_per_key: int = ENTRIES_PER_KEY) -> DataFrame:
    """Links (a, b) that join all values of `prints.fp` within `distance` bits, directly or through each other."""
    distinct = prints.select("fp").where("fp is not null").distinct()
    parts = segments_of(64, segments)
    radius = distance // segments

    def value(shift, width):
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))

    table = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("seg"), value(*p).alias("v")) for i, p in enumerate(parts)])).alias("s")).select(
        "fp", F.col("s.seg").alias("seg"), F.col("s.v").alias("v"))
    probes = None
    for i, (shift, width) in enumerate(parts):
        masks = F.explode(F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)[1:]] or [F.lit(None).cast("long")]))
        some = (distinct.withColumn("m", masks).where("m is not null")
                .select("fp", F.lit(i).alias("seg"), value(shift, width).bitwiseXOR(F.col("m")).alias("v")))
        probes = some if probes is None else probes.unionByName(some)
    # Sub-keys of keys with many entries: counted, written, then joined to both sides.
    many = (table.groupBy("seg", "v").count().where(F.col("count") > entries_per_key)
            .select("seg", "v", F.ceil(F.col("count") / entries_per_key).cast("int").alias("split")))
    many = materialise(many, "simhash-many")
    if many.limit(1).count():
        table = table.join(many, ["seg", "v"], "left")
        sub = F.pmod(F.xxhash64("fp"), F.coalesce("split", F.lit(1)))
        every = F.explode(F.sequence(F.lit(0), F.coalesce("split", F.lit(1)) - 1))
        entries = table.select("seg", "v", "fp", sub.cast("int").alias("sub"), F.lit(False).alias("probe"))
        own = table.where("split is not null").select("seg", "v", "fp", every.alias("sub"), F.lit(True).alias("probe"))
        probes = probes.join(many, ["seg", "v"], "left").select("seg", "v", "fp", every.alias("sub"), F.lit(True).alias("probe"))
        rows = entries.unionByName(own).unionByName(probes)
    else:
        rows = table.select("seg", "v", "fp", F.lit(0).alias("sub"), F.lit(False).alias("probe")).unionByName(
            probes.select("seg", "v", "fp", F.lit(0).alias("sub"), F.lit(True).alias("probe")))
    # The value has at most 32 bits, the segment 8, the sub-key the rest.
    key = F.shiftleft(F.col("sub").cast("long"), 40) + F.shiftleft(F.col("seg").cast("long"), 32) + F.col("v")
    keyed = rows.select(key.alias("key"), "fp", "probe").repartition("key")
    prints.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    return keyed.mapInArrow(lambda b: _matches(b, distance), "a long, b long")


def _named(prints: DataFrame, distance: int, segments: int, entries_per_key: int) -> DataFrame:
    """(fp, component_id) of each fingerprint of `prints` (id, fp)."""
    links = materialise(near_links(prints, distance, segments, entries_per_key), "near-links")
    roots = components(links)
    small_batches(prints.sparkSession)
    nodes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    return materialise(nodes.join(low, "root").select("fp", "component_id"), "components")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
                    segments: int = SEGMENTS, entries_per_key: int = ENTRIES_PER_KEY) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the smallest id it can reach.

    Defined cases: null and wordless texts have fingerprint zero and link like
    any other; a component whose ids are all null has a null component_id; rows
    with the same id are reported once each; an empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _named(prints, distance, segments, entries_per_key)
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
                segments: int = SEGMENTS, entries_per_key: int = ENTRIES_PER_KEY) -> DataFrame:
    """The rows of each component's smallest id, with all their columns.

    Rows with the same id and fingerprint are one document; of a component whose
    ids are all null every row stays.
    """
    if any(c.lower().startswith("_sh_") for c in docs.columns):
        raise ValueError("column names beginning with _sh_ are reserved")
    small_batches(docs.sparkSession)
    at, names = docs.columns.index(text_col), [*docs.columns, "_sh_fp"]

    def add(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = [fingerprint((t.as_py() or "").encode()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(values, np.uint64).view(np.int64))], names)

    rows = materialise(docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("_sh_fp", T.LongType())])), "fingerprinted")
    prints = rows.select(F.col(id_col).cast("long").alias("id"), F.col("_sh_fp").alias("fp"))
    named = _named(prints, distance, segments, entries_per_key)
    gone = (prints.join(named, "fp").where(~F.col("id").eqNullSafe(F.col("component_id")))
            .select(F.col("id").alias("_sh_id"), F.col("fp").alias("_sh_gone")).distinct())
    return rows.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_sh_id")) & (F.col("_sh_fp") == F.col("_sh_gone")),
                     "left_anti").select(*docs.columns)
