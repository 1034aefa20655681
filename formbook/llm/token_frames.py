"""Token ids in seekable files of independent zstandard frames.

File format of a part (``part-NNNNN.zst``), as of the public seekable variant of
zstandard: frames of at most `FRAME_BYTES` bytes of little-endian unsigned
32-bit ids, each decodable alone, then one skippable frame with the seek table:
for each frame its compressed size, its decompressed size and the low 32 bits of
the XXH64 of its decompressed bytes, then the number of frames, a descriptor
byte (128: with checksums) and the magic number. Any zstandard reader can read a
part from end to end. Beside it, ``part-NNNNN.idx`` holds two arrays of
little-endian 64-bit integers after their common length: document ids and the
number of ids of each document. A reader that wants some documents decompresses
only the frames that hold them.

Documents are range-partitioned and sorted by id; each task writes one part. The
driver sees one row a part, from which the parts' starts follow. Parts are
written under another name and then renamed, so a repeated task leaves one whole
part. The folder may be any URI that pyarrow's file systems know and that the
executors share.

Defined cases: null text counts as empty, an empty text has the end id only;
rows with a null id come first and read back as null (-2^63 in the index); rows
with the same id are ordered by text; an empty table has no part and gives an
empty result.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import small_batches, text_bytes

FRAME_BYTES = 1 << 18
END_ID = 1
# Fixed values of the format.
SEEKABLE_MAGIC, SKIPPABLE_MAGIC, WITH_CHECKSUMS = 0x8F92EAB1, 0x184D2A5E, 128
NULL_ID = -(1 << 63)
# Words and runs of letters whose ids a worker remembers, and the longest of them in bytes.
WORDS, RUNS, LONGEST = 900_000, 800_000, 48
# Words that are one run of Latin letters and then marks: the tokenizer divides them there,
# and their lower case and canonical composition are beyond doubt.
MARKS = b".,;:!?%&*#$|"
LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# Runs encoded in one call.
CALL = 2_000


class WordEncoder:
    """Encodes texts as a tokenizers file does, remembering the ids of words.

    Only for tokenizers that never join what ASCII white space divides, that drop
    white space and lower the case, as word-end BPE does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.runs = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max([*vocabulary.values(), *self.tokenizer.get_vocab().values()]) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _runs(self, runs: list[bytes]) -> None:
        """Learn runs of letters: many in one text, cut where a token ends a word."""
        for at in range(0, len(runs), CALL):
            some = runs[at:at + CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                data = ids.tobytes()
                bounds = [0, *(4 * cuts).tolist()]
                self.runs.update((r, data[a:b]) for r, a, b in zip(some, bounds, bounds[1:], strict=False))
            else:
                self.runs.update(zip(some, self._encode([r.decode() for r in some]), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        known, found, gaps = self.words, [], []
        split = [t.split() for t in texts]
        for words in split:
            ids = list(map(known.get, words))
            gaps.append([k for k, x in enumerate(ids) if x is None] if None in ids else [])
            found.append(ids)
        new = {words[k] for words, gap in zip(split, gaps, strict=True) for k in gap}
        if new:
            if len(known) + len(new) > WORDS:
                known.clear()
            got = self._learn(new)
            for words, ids, gap in zip(split, found, gaps, strict=True):
                for k in gap:
                    ids[k] = got[words[k]]
        return [b"".join(ids) for ids in found]

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words not known yet; all but long ones are remembered."""
        whole, parts = [], []
        for w in new:
            r = w.rstrip(MARKS)
            if len(w) > LONGEST:
                whole.append(w)
            elif r.isalpha():  # of bytes: A-Z and a-z only
                parts.append((w, r.lower(), w[len(r):]))
            elif LATIN.fullmatch(r):
                parts.append((w, r.decode().lower().encode(), w[len(r):]))
            else:
                whole.append(w)
        if len(self.runs) > RUNS:
            self.runs.clear()
        runs = self.runs
        self._runs(list({r for _, r, _ in parts if r not in runs}))
        marks = list({m for _, _, m in parts if m and m not in runs})
        runs.update(zip(marks, self._encode([m.decode() for m in marks]), strict=True))
        got = {w: runs[r] + runs[m] if m else runs[r] for w, r, m in parts}
        got.update(zip(whole, self._encode([w.decode("utf-8", "replace") for w in whole]), strict=True))
        self.words.update((w, x) for w, x in got.items() if len(w) <= LONGEST)
        return got


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which Spark uses for many tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class FrameWriter:
    """Writes one part."""

    def __init__(self, out, level: int = 1, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes, self.waiting, self.table = out, frame_bytes, bytearray(), []
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def write(self, data: bytes) -> None:
        self.waiting += data
        at = 0
        while len(self.waiting) - at >= self.frame_bytes:
            self._frame(bytes(self.waiting[at:at + self.frame_bytes]))
            at += self.frame_bytes
        if at:
            del self.waiting[:at]

    def _frame(self, raw: bytes) -> None:
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.waiting:
            self._frame(bytes(self.waiting))
        body = b"".join(struct.pack("<III", *row) for row in self.table)
        body += struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Reads byte ranges of a part, checking each frame that it decompresses."""

    def __init__(self, file):
        self.file, end = file, file.size()
        file.seek(end - 9)
        n, kind, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or kind != WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        file.seek(end - 9 - 12 * n)
        self.rows = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.rows[:, 0])))
        self.start = np.concatenate(([0], np.cumsum(self.rows[:, 1])))
        self.held, self.raw, self.unpack = -1, b"", zstandard.ZstdDecompressor()

    def _frame(self, i: int) -> bytes:
        if i != self.held:
            self.file.seek(int(self.at[i]))
            self.raw = self.unpack.decompress(self.file.read(int(self.rows[i, 0])), max_output_size=int(self.rows[i, 1]))
            if xxhash.xxh64_intdigest(self.raw) & 0xFFFFFFFF != self.rows[i, 2]:
                raise ValueError(f"frame {i} has another checksum")
            self.held = i
        return self.raw

    def read(self, start: int, stop: int) -> bytes:
        out, i = [], int(np.searchsorted(self.start, start, "right")) - 1
        while start < stop:
            upto = min(stop, int(self.start[i + 1]))
            out.append(self._frame(i)[start - int(self.start[i]):upto - int(self.start[i])])
            start, i = upto, i + 1
        return b"".join(out)


def _folder(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, uri: str, end_id: int):
    part, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
    store, folder = _folder(uri)
    code, ids, sizes, writer, name = encoder(tokenizer), [], [], None, f"{folder}/part-{part:05d}"
    own = f"{folder}/.{uuid.uuid4().hex}"
    for batch in batches:
        coded = code.encode([t.as_py() for t in batch.column(1)])
        for i, data in zip(batch.column(0).to_pylist(), coded, strict=True):
            if writer is None:
                out = store.open_output_stream(own)
                writer = FrameWriter(out)
            data += end
            writer.write(data)
            ids.append(NULL_ID if i is None else i)
            sizes.append(len(data) // 4)
    if writer is None:
        return
    writer.close()
    out.close()
    with store.open_output_stream(own + ".idx") as index:
        index.write(struct.pack("<q", len(ids)) + np.array(ids, "<i8").tobytes() + np.array(sizes, "<i8").tobytes())
    store.move(own + ".idx", name + ".idx")
    store.move(own, name + ".zst")
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"part-{part:05d}"]), pa.array([len(ids)], pa.int64()),
                                      pa.array([sum(sizes)], pa.int64())], ["part", "name", "n_docs", "n_ids"])


def write_token_files(docs: DataFrame, tokenizer: str, uri: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID) -> DataFrame:
    """Write the parts to the folder `uri`; (part, name, n_docs, n_ids) of each, in ascending order of ids."""
    small_batches(docs.sparkSession)
    store, folder = _folder(uri)
    store.create_dir(folder, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialise(rows.mapInArrow(lambda b: _write(b, tokenizer, uri, end_id), "part int, name string, n_docs long, n_ids long"),
                       "token-parts")


def open_part(uri: str, name: str):
    """(reader, document ids, numbers of ids) of one part."""
    store, folder = _folder(uri)
    with store.open_input_file(f"{folder}/{name}.idx") as f:
        index = np.frombuffer(f.read(), "<i8")
    n = int(index[0])
    return FrameReader(store.open_input_file(f"{folder}/{name}.zst")), index[1:n + 1], index[n + 1:]


def read_token_files(spark: SparkSession, uri: str, parts: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files; one task reads one part."""
    # One row a part: the number of parts follows from the input's partitions.
    listed = sorted(parts.select("part", "name", "n_ids").collect())
    firsts = np.concatenate(([0], np.cumsum([r.n_ids for r in listed], dtype=np.int64))).tolist()
    todo = [(r.name, first) for r, first in zip(listed, firsts, strict=False)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not todo:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, ids, sizes = open_part(uri, name)
                at = np.concatenate(([0], np.cumsum(sizes)))
                for lo in range(0, len(ids), 1024):
                    some = [reader.read(4 * a, 4 * b) for a, b in zip(at[lo:lo + 1024].tolist(), at[lo + 1:lo + 1025].tolist(), strict=False)]
                    columns = [pa.array([None if i == NULL_ID else i for i in ids[lo:lo + 1024].tolist()], pa.int64()),
                               pa.array(first + at[lo:lo + len(some)]), pa.array(sizes[lo:lo + 1024].astype(np.int64)),
                               pa.array([zlib.crc32(x) for x in some], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in some], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    files = spark.sparkContext.parallelize(todo, len(todo))
    return spark.createDataFrame(files, "name string, first long").mapInArrow(read, schema)


def token_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write `docs` to a new folder of the shared folder and report each document as read back."""
    spark = docs.sparkSession
    uri = scratch_path(spark, "token-files")
    parts = write_token_files(docs, tokenizer, uri, id_col, text_col)
    return read_token_files(spark, uri, parts, with_ids=False).withColumnRenamed("doc_id", id_col)
