"""Phrase collocations: Misra-Gries summaries find every frequent n-gram, a second pass counts them exactly.

Texts are lower-cased (A-Z) and split into pieces and words; n-grams of one to
five words within a piece are hashed, their language included.

First pass. The hash space is cut into partitions. Tasks count their hashed
n-grams, one summary (keys, counts, loss) per flush and hash partition, and the
summaries of a partition merge in one task: counts add up, and when more than
`CAPACITY` counters are left the next largest count is taken from all of them and
added to the loss. The number of partitions follows from the bytes of text, so
that capacity exceeds a partition's mass divided by the threshold; a phrase, however
common, weighs at most the threshold in that mass. A phrase's count exceeds its
counter by the loss at most, so counters that reach the threshold with the loss
added hold every frequent n-gram. The loss is kept with each partition: should it
reach the threshold, the pass is repeated with twice the partitions. Keys are
hash prefixes whose length follows the mass; two n-grams with one key only let
more through.

Second pass. The survivors' keys, as a bit map of at most 2^`MAP_BITS` bits, tell a
task which n-grams to count; a fuller map lets more through and changes no
result. An n-gram is counted only if both its shorter parts are in the map.
N-grams are told apart by their words, never by hash. Counts travel packed, one
row per flush and hash partition, and are added up by language and phrase.

Candidates, their parts' counts, the lowest cut, containment in longer candidates
and the ranks are joins and aggregates over the frequent phrases; the ranks are
taken in two steps, so a task sees at most `BUCKETS` times the listed number of
one language.

Defined cases: a null text counts as empty, a null language as `und`; runs of
blanks and tabs separate words once; repeated rows count repeatedly; long texts
are cut between pieces, so only one piece is held whole; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import materialise
from .common import small_batches

WORDS = 5
CAPACITY = 1 << 20
MAP_BITS = 30
BUCKETS = 64
SALTS = 16
FLUSH_BYTES = 4 << 20
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"

_FOLD = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(PIECE_ENDS) + b" ")
_PIECE_END = re.compile(b"[" + PIECE_ENDS + b"]")
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Tokens:
    """The words of some texts: numbers, pieces, languages and the distinct words."""

    def __init__(self, texts: list[bytes], langs: list[bytes]):
        data = b"\n".join(texts).translate(_FOLD)
        raw = np.frombuffer(data, np.uint8)
        blank = (raw == 10) | (raw == 32)
        edge = np.diff(blank.astype(np.int8), prepend=1, append=1)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.piece = np.cumsum(raw == 10, dtype=np.int32)[starts]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~blank])])
        coded = words.dictionary_encode()
        self.word, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.langs = sorted(set(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.lang = np.array([number[x] for x in langs], np.int64)[np.searchsorted(text_ends, starts, side="right")]

    def hashes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, positions, hashes) of the n-grams of each length."""
        of_word = np.array([xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()], np.uint64)
        of_lang = np.array([xxhash.xxh64_intdigest(x, 1) for x in self.langs], np.uint64)
        if not len(self.word):
            return
        word = of_word[self.word]
        h = _mixed(word ^ of_lang[self.lang])
        yield 1, np.arange(len(h)), h
        for n in range(2, WORDS + 1):
            if len(word) < n:
                return
            h = _mixed(h[:-1] * _STEP + word[n - 1:])
            at = np.flatnonzero(self.piece[n - 1:] == self.piece[:len(h)])
            yield n, at, h[at]


def _cut(text: bytes, start: int, flush: int) -> int:
    """Where a stretch of about `flush` bytes ends: behind a piece, or with the text."""
    if len(text) - start <= flush:
        return len(text)
    last = text[start:start + flush].translate(_FOLD).rfind(b"\n")
    if last >= 0:
        return start + last + 1
    later = _PIECE_END.search(text, start + flush)
    return later.end() if later else len(text)


def _texts(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[Tokens]:
    """Tokens of about `flush` bytes of text at a time; longer texts are cut behind a piece."""
    texts, langs, held = [], [], 0
    for batch in batches:
        for lang, text in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in (0, 1)), strict=True):
            start, end = 0, -1
            while end < len(text):
                end = _cut(text, start, flush)
                texts.append(text[start:end])
                langs.append(lang)
                held, start = held + end - start + 1, end
                if held >= flush:
                    yield Tokens(texts, langs)
                    texts, langs, held = [], [], 0
    if texts:
        yield Tokens(texts, langs)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pruned(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most `capacity` counters of a summary, and what was taken from each of them."""
    if len(keys) <= capacity:
        return keys, counts, 0
    taken = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    stay = counts > taken
    return keys[stay], counts[stay] - taken, taken


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and counts, byte planes apart, compressed."""
    planes = [np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8), counts.view(np.uint8).reshape(-1, 8)]
    return zstandard.compress(np.ascontiguousarray(np.hstack(planes).T).tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(16, -1).T)
    keys, counts = (np.ascontiguousarray(planes[:, i:i + 8]).reshape(-1) for i in (0, 8))
    return np.cumsum(keys.view(np.uint64), dtype=np.uint64), counts.view(np.int64)


def _local(batches: Iterator[pa.RecordBatch], width: int, part_bits: int, capacity: int, flush: int) -> Iterator[pa.RecordBatch]:
    """A task's summaries, by hash partition (the first bits of a key)."""
    for tokens in _texts(batches, flush):
        every = [h for _, _, h in tokens.hashes()]
        if not every:
            continue
        keys = np.sort(np.concatenate(every) >> np.uint64(64 - width))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(first, append=len(keys)).astype(np.int64)
        keys = keys[first]
        part = (keys >> np.uint64(width - part_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        rows = [(int(part[a]), *pruned(keys[a:b], counts[a:b], capacity)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([_packed(r[1], r[2]) for r in rows], pa.binary()),
             pa.array([r[3] for r in rows], pa.int64())], ["part", "summary", "lost"])


def _merged(batches: Iterator[pa.RecordBatch], threshold: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: each part's summary, merged; the keys that may be frequent."""
    part, keys, counts, waiting, size, lost = None, None, None, [], 0, 0

    def fold():
        nonlocal keys, counts, waiting, size, lost
        every = [(keys, counts), *waiting]
        keys, counts, taken = pruned(*added(np.concatenate([k for k, _ in every]), np.concatenate([c for _, c in every])), capacity)
        waiting, size, lost = [], 0, lost + taken

    def row():
        fold()
        some = keys[counts + lost >= threshold]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([some.tobytes()], pa.binary()),
                                           pa.array([len(some)], pa.int64()), pa.array([lost], pa.int64())], ["part", "keys", "n", "lost"])

    for batch in batches:
        for p, data, gone in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if p != part:
                if part is not None:
                    yield row()
                part, keys, counts, waiting, size, lost = p, np.empty(0, np.uint64), np.empty(0, np.int64), [], 0, 0
            waiting.append(_unpacked(data))
            size, lost = size + len(waiting[-1][0]), lost + gone
            if size >= capacity:
                fold()
    if part is not None:
        yield row()


def survivors(docs: DataFrame, threshold: int, mass: int) -> tuple[DataFrame, int, int]:
    """(part, keys, n, lost) by hash partition, the keys' bits and the partitions' bits."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = min(60, max(40, mass.bit_length() + 6))
    part_bits = max(least, 2 * mass // (threshold * CAPACITY)).bit_length()
    while True:
        bits, capacity, flush = part_bits, CAPACITY, FLUSH_BYTES
        local = docs.mapInArrow(lambda b: _local(b, width, bits, capacity, flush), "part long, summary binary, lost long")  # noqa: B023
        merged = local.repartition(1 << bits, "part").sortWithinPartitions("part")
        kept = materialise(merged.mapInArrow(lambda b: _merged(b, threshold, capacity), "part long, keys binary, n long, lost long"),  # noqa: B023
                           "frequent-keys")
        if (kept.agg(F.max("lost")).first()[0] or 0) < threshold:
            return kept, width, bits
        part_bits += 1


def _slices(batches: Iterator[pa.RecordBatch], width: int, part_bits: int, map_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            marks = np.zeros(1 << (map_bits - part_bits), bool)
            at = np.frombuffer(keys, np.uint64) >> np.uint64(width - map_bits)
            marks[at.astype(np.int64) - (part << (map_bits - part_bits))] = True
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(marks).tobytes()], pa.binary())], ["part", "bits"])


def bit_map(kept: DataFrame, width: int, part_bits: int) -> tuple[np.ndarray, int]:
    """The survivors' keys as packed bits: 16 bits a key, at most 2^MAP_BITS, and at least a byte a partition."""
    n = kept.agg(F.sum("n")).first()[0] or 0
    map_bits = max(min(MAP_BITS, (16 * n).bit_length()), part_bits + 3)
    marks = np.zeros(1 << (map_bits - 3), np.uint8)
    size = 1 << (map_bits - part_bits - 3)
    sliced = kept.where("n > 0").mapInArrow(lambda b: _slices(b, width, part_bits, map_bits), "part long, bits binary")
    for r in sliced.toLocalIterator():
        marks[r["part"] * size:(r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return marks, map_bits


_PHRASES = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.binary()), ("f", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch], marks, map_bits: int, part_bits: int, flush: int) -> Iterator[pa.RecordBatch]:
    """Exact counts of the n-grams in the map, told apart by their words; one row of packed counts per hash partition.

    `size` 0 counts a language's words, in partition 0.
    """
    bits = marks.value
    for tokens in _texts(batches, flush):
        langs = pa.array(tokens.langs, pa.binary()).cast(pa.string())
        total = np.bincount(tokens.lang, minlength=len(tokens.langs))
        tables = [pa.table([langs, pa.array([0] * len(total), pa.int32()), pa.array([b""] * len(total), pa.binary()), pa.array(total)], _PHRASES)]
        part, shorter = [np.zeros(len(total), np.int64)], None
        for n, at, h in tokens.hashes():
            place = (h >> np.uint64(64 - map_bits)).astype(np.int64)
            hit = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
            if n > 1:
                hit &= (shorter[at] >= 0) & (shorter[at + 1] >= 0)
            at, h = at[hit], h[hit]
            if len(at) == 0:
                break
            head = tokens.lang[at] if n == 1 else shorter[at]
            code, _ = pd.factorize(head << 32 | tokens.word[at + n - 1])
            shorter = np.full(len(tokens.word), -1, np.int64)
            shorter[at] = code
            count = np.bincount(code)
            first = np.empty(len(count), np.int64)
            first[code[::-1]] = np.arange(len(at))[::-1]
            part.append((h[first] >> np.uint64(64 - part_bits)).astype(np.int64))
            first = at[first]
            words = [tokens.words.take(pa.array(tokens.word[first + i])) for i in range(n)]
            phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if n > 1 else words[0]
            tables.append(pa.table([langs.take(pa.array(tokens.lang[first])), pa.array([n] * len(first), pa.int32()),
                                    phrase.cast(pa.binary()), pa.array(count)], _PHRASES))
        part = np.concatenate(part)
        order = np.argsort(part, kind="stable")
        part, whole = part[order], pa.concat_tables(tables).take(pa.array(order))
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cuts[:-1]]), pa.array([_frozen(whole.slice(i, j - i)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                ["part", "counts"])


def _frozen(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _summed(batches: Iterator[pa.RecordBatch], threshold: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: each part's exact counts, added up, of phrases that reach the threshold."""
    part, held, size = None, [], 0

    def added_up():
        return pa.concat_tables(held).combine_chunks().group_by(["lang", "size", "phrase"]).aggregate([("f", "sum")]).rename_columns(_PHRASES.names)

    def rows():
        whole = added_up()
        keep = pc.or_(pc.equal(whole["size"], 0), pc.greater_equal(whole["f"], threshold))
        whole = whole.filter(keep)
        return whole.set_column(2, "phrase", whole["phrase"].cast(pa.string())).to_batches(max_chunksize=100_000)

    for batch in batches:
        for p, data in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            if p != part and held:
                yield from rows()
                held, size = [], 0
            part = p
            held.append(pa.ipc.open_stream(data).read_all())
            size += len(held[-1])
            if size >= capacity:
                held = [added_up()]
                size = len(held[0]) // 2
    if held:
        yield from rows()


def frequent_phrases(docs: DataFrame, threshold: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, size, phrase, f) of every phrase of one to five words with f >= threshold; size 0 has all words of a language."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    kept, width, part_bits = survivors(slim, threshold, WORDS * size // 2)
    marks, map_bits = bit_map(kept, width, part_bits)
    sent, flush = spark.sparkContext.broadcast(marks), FLUSH_BYTES
    counted = slim.mapInArrow(lambda b: _counted(b, sent, map_bits, part_bits, flush), "part long, counts binary")
    counted = counted.repartition(1 << part_bits, "part").sortWithinPartitions("part")
    capacity = CAPACITY
    return materialise(counted.mapInArrow(lambda b: _summed(b, threshold, capacity), "lang string, size int, phrase string, f long"), "frequent-phrases")


def _big(column: str):
    return F.col(column).cast(T.DecimalType(19, 0))


def collocations(docs: DataFrame, threshold: int = 100, top: int = 2000, cover_percent: int = 100,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases = frequent_phrases(docs, threshold, lang_col, text_col)
    totals = phrases.where("size = 0").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    parts = phrases.where(f"size between 1 and {WORDS - 1}").select("lang", "phrase", "f")
    found = (phrases.where("size > 1").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
             .join(totals, ["lang", "salt"]).select("lang", "phrase", F.col("f").alias("a"), "n", "size", F.split("phrase", " ").alias("words")))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "n", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("right"))
    cuts = (cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    cuts = cuts.withColumns({"above": (F.lit(1000).cast("long") * F.col("a")).cast(T.DecimalType(19, 0)) * _big("n"), "below": _big("l") * _big("r")})
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "n", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda j: F.array_join(F.slice("words", j, m), " "))))
    inside = (found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    free = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a"))).drop("longer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    free = free.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    some = free.withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(threshold: int = 100, top: int = 2000) -> str:
    """`collocations` of the documents in DuckDB's SQL."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    return rf"""
with pieces as (select coalesce(lang, 'und') as lang,
       unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as words from pieces),
totals as (select lang, cast(sum(len(words)) as bigint) as n from w group by lang),
grams as (select lang, m, array_to_string(words[j:j + m - 1], ' ') as phrase
          from (select *, unnest(range(1, len(words) - m + 2)) as j from (select *, unnest(range(1, {WORDS + 1})) as m from w) where len(words) >= m)),
f as (select lang, m, phrase, count(*) as f from grams group by all having count(*) >= {threshold}),
c as (select f.*, string_split(phrase, ' ') as words from f where m > 1),
cuts as (select lang, phrase, m, f as a, k, array_to_string(words[:k], ' ') as lp, array_to_string(words[k + 1:], ' ') as rp
         from (select *, unnest(range(1, m)) as k from c)),
s as (select cuts.lang, cuts.phrase, a, k, x.f as l, y.f as r, n, (cast(1000 * a as hugeint) * n) // (cast(x.f as hugeint) * y.f) as score
      from cuts join f x on x.lang = cuts.lang and x.phrase = lp join f y on y.lang = cuts.lang and y.phrase = rp join totals on totals.lang = cuts.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, array_to_string(words[j:j + i - 1], ' ') as phrase, max(f) as longer from (
             select *, unnest(range(1, m - i + 2)) as j from (select *, unnest(range(2, m)) as i from c)) group by 1, 2),
r as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) as rank
      from b left join inside using (lang, phrase) where longer is null or 100 * longer < 100 * a)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from r where rank <= {top}"""
