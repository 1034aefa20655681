"""N-best segmentation over the piece lattice of a SentencePiece model, and decoding.

The lattice of a text has a node between any two characters and an edge for each
piece, with the piece's score; a character that no piece holds has one edge with
the unknown score, encoded as its UTF-8 bytes. Forward Viterbi gives each node
the best score of a path that reaches it, which is an exact heuristic for an A*
search that goes backward from the end: complete paths leave the queue in
descending order of score, so the first n are the n best.

White space is escaped as the model does it (a space becomes U+2581, one is put
before the text). No piece holds anything before an escaped space but escaped
spaces, so a text falls into independent chunks, and its n best are sums of
chunks' alternatives: only the n - 1 chunks with the smallest loss of their second
best can differ from their best. The forward pass, for many new chunks at once, gives
each chunk's best and that loss (a worker remembers the chunks it has seen); the A* search lists those
chunks' alternatives and then, over their lattice, the n best of the text.

Defined cases: null text counts as empty and has one segmentation without
pieces; a text with fewer than n segmentations gives all; equal scores are
ordered by the search, the same in each run; decoding returns the text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SPACE = "▁"
N_BEST = 4
# Below the lowest score of a piece by this much lies the score of an unknown character.
UNKNOWN_PENALTY = 10.0
# Chunks that a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 600_000, 40
# Characters of texts whose new chunks pass forward together.
TOGETHER = 1 << 20

Path = tuple[float, tuple[int, ...]]


def n_best(length: int, edges_to, n: int) -> list[Path]:
    """The n best paths from node 0 to node `length`: (score, edge labels).

    `edges_to(node)` lists (earlier node, score, label). Labels of a path are in
    forward order.
    """
    best = [0.0] + [-np.inf] * length
    into = [()] * (length + 1)
    for node in range(1, length + 1):
        into[node] = [e for e in edges_to(node) if best[e[0]] > -np.inf]
        for before, score, _ in into[node]:
            best[node] = max(best[node], best[before] + score)
    if best[length] == -np.inf:
        return []
    # Of equal totals the path nearest to the start goes on first.
    queue, count, out = [(-best[length], length, 0, 0.0, None)], 0, []
    while queue and len(out) < n:
        _, node, _, done, tail = heapq.heappop(queue)
        if node == 0:
            labels = []
            while tail is not None:
                label, tail = tail
                labels.append(label)
            out.append((done, tuple(labels)))
            continue
        for before, score, label in into[node]:
            count += 1
            heapq.heappush(queue, (-(best[before] + score + done), before, count, score + done, (label, tail)))
    return out


class PieceModel:
    """Pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.pieces: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.score: list[float] = []
        self.unknown = sp.unk_id()
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i), float(sp.get_score(i))
            self.score.append(score)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.pieces[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece holds white space after other characters")
        self.longest = max(map(len, self.pieces), default=1)
        # Beginnings of pieces, with the piece's id or -1.
        self.walk = {p[:k]: -1 for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.unknown_score = min((self.score[i] for i in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        # Line ends and tabs are chunks of their own where no piece holds them, and a mark begins a new
        # chunk after a letter or digit where no piece holds the two together.
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.pieces))
        after = {b for p in self.pieces for a, b in zip(p, p[1:], strict=False) if a.isalnum()}
        marks = re.escape("".join(c for c in ".,;:!?%&*#$|\"()=" if c not in after))
        ways = [f"[{alone}]"] if alone else []
        # Possessive: a run ends at a mark or not, giving characters back never helps.
        ways += [rf"{SPACE}*+[^{SPACE}{alone}{marks}]++(?=[{marks}])(?<=[^\W_])"] if marks else []
        self.chunk = re.compile("|".join([*ways, f"{SPACE}*+[^{SPACE}{alone}]++", f"{SPACE}++"]))
        # The same beginnings as a table: node * width + character's number -> next node; the node's piece or -1.
        self.alphabet = np.array(sorted({ord(c) for p in self.pieces for c in p}), np.int64)
        node, width = {p: k for k, p in enumerate(("", *self.walk))}, len(self.alphabet)
        place = {chr(c): k for k, c in enumerate(self.alphabet.tolist())}
        edge = sorted((node[p[:-1]] * width + place[p[-1]], node[p]) for p in self.walk)
        self.edge_key, self.edge_to = np.array([e for e, _ in edge], np.int64), np.array([e for _, e in edge], np.int64)
        self.start = np.full(width, -1, np.int64)  # the same for the first character
        self.start[self.edge_key[self.edge_key < width]] = self.edge_to[self.edge_key < width]
        self.piece_at = np.array([-1, *self.walk.values()], np.int64)
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.listed: dict[tuple[str, int], list[Path]] = {}

    def escaped(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _unknown_ids(self, char: str) -> tuple[int, ...]:
        data = char.encode("utf-8", "replace")
        return tuple(self.byte_id[b] for b in data) if all(b in self.byte_id for b in data) else (self.unknown,)

    def lattice(self, text: str):
        """`edges_to` of an escaped text; labels are tuples of ids."""
        pieces, score, longest = self.pieces, self.score, self.longest

        def edges_to(node):
            out = []
            for before in range(max(0, node - longest), node):
                i = pieces.get(text[before:node])
                if i is not None:
                    out.append((before, score[i], (i,)))
            if not out or out[-1][0] != node - 1:
                out.append((node - 1, self.unknown_score, self._unknown_ids(text[node - 1])))
            return out

        return edges_to

    def segment(self, text: str, n: int) -> list[Path]:
        """The n best segmentations of an escaped text: (score, ids)."""
        return [(s, tuple(i for label in labels for i in label)) for s, labels in n_best(len(text), self.lattice(text), n)]

    def forward(self, chunk: str) -> tuple[bytes, float, float]:
        """Forward Viterbi: ids and score of the best segmentation, and what the second best loses."""
        walk, score, length = self.walk, self.score, len(chunk)
        first, second, back = [-np.inf] * (length + 1), [-np.inf] * (length + 1), [None] * (length + 1)
        first[0] = 0.0
        for a in range(length):
            x, y, alone = first[a], second[a], True
            for b in range(a + 1, length + 1):
                i = walk.get(chunk[a:b])
                if i is None:
                    break
                if i >= 0:
                    if b == a + 1:
                        alone = False
                    v = x + score[i]
                    if v > first[b]:
                        second[b] = max(first[b], y + score[i])
                        first[b], back[b] = v, (a, i)
                    elif v > second[b]:
                        second[b] = v
            if alone:
                b, v = a + 1, x + self.unknown_score
                if v > first[b]:
                    second[b] = max(first[b], y + self.unknown_score)
                    first[b], back[b] = v, (a, -1)
                elif v > second[b]:
                    second[b] = v
        ids, at = [], length
        while at:
            at, i = back[at]
            ids.extend((i,) if i >= 0 else self._unknown_ids(chunk[at])[::-1])
        return np.array(ids[::-1], "<u4").tobytes(), first[length], first[length] - second[length]

    def forward_all(self, chunks: list[str]) -> list[tuple[bytes, float, float]]:
        """forward() of many chunks at once: the same steps in the same order, each taken for all chunks."""
        if not chunks or not len(self.edge_key):
            return list(map(self.forward, chunks))
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        by = np.argsort(-sizes, kind="stable")  # longest first, so that those with a position come first
        sizes, width, score = sizes[by], len(self.alphabet), np.array(self.score)
        n, longest = len(by), int(sizes[0])
        raw = np.frombuffer("".join(chunks[k] for k in by.tolist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        place = np.minimum(np.searchsorted(self.alphabet, raw), width - 1)
        codes = np.full((longest, n), -1, np.int64)
        codes.T[np.arange(longest) < sizes[:, None]] = np.where(self.alphabet[place] == raw, place, -1)
        first, second = (np.full((longest + 1, n), -np.inf) for _ in range(2))
        from_, piece = (np.full((longest + 1, n), -1, np.int64) for _ in range(2))
        first[0] = 0.0

        def reach(b, rows, a, ids, scores):
            v, old = first[a, rows] + scores, first[b, rows]
            better = v > old
            second[b, rows] = np.where(better, np.maximum(old, second[a, rows] + scores), np.maximum(second[b, rows], v))
            first[b, rows] = np.where(better, v, old)
            some = rows[better]
            from_[b, some], piece[b, some] = a, ids[better]

        for a in range(longest):
            rows = np.arange(np.searchsorted(-sizes, -a, side="left"))  # chunks longer than a
            alone, node = np.ones(len(rows), bool), np.zeros(len(rows), np.int64)
            for b in range(a + 1, min(longest, a + self.longest) + 1):
                inside = sizes[rows] >= b
                rows, node = rows[inside], node[inside]
                code = codes[b - 1, rows]
                if b == a + 1:
                    to = np.where(code >= 0, self.start[code], -1)
                    there = to >= 0
                    to = to[there]
                else:
                    key = node * width + code
                    at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
                    there = (code >= 0) & (self.edge_key[at] == key)
                    to = self.edge_to[at[there]]
                rows, node = rows[there], to
                if not len(rows):
                    break
                ids = self.piece_at[node]
                whole = ids >= 0
                if b == a + 1:
                    alone[rows[whole]] = False
                reach(b, rows[whole], a, ids[whole], score[ids[whole]])
            rows = np.flatnonzero(alone)
            reach(a + 1, rows, a, np.full(len(rows), -1), np.full(len(rows), self.unknown_score))
        back, at, every = [], sizes.copy(), np.arange(n)  # from the end; a chunk at its start adds nothing
        known = np.ones(n, bool)
        while at.any():
            ids = np.where(at > 0, piece[at, every], -2)
            known &= ids != -1
            back.append(ids)
            at = np.where(at > 0, from_[at, every], 0)
        steps = np.array(back[::-1]).T
        used = steps != -2
        data = steps[used].astype("<u4").tobytes()
        ends = (4 * np.cumsum(used.sum(1))).tolist()
        top, next_ = first[sizes, every], second[sizes, every]
        out: list = [None] * n
        for k, start, end, x, loss, plain in zip(by.tolist(), [0, *ends], ends, top.tolist(), (top - next_).tolist(), known.tolist(), strict=False):
            out[k] = (data[start:end], x, loss) if plain else self.forward(chunks[k])
        return out

    def learn(self, new: Iterable[str]) -> None:
        """Remember the forward passes of these chunks but the long ones."""
        new = [c for c in new if len(c) <= LONGEST]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        self.known.update(zip(new, self.forward_all(new), strict=True))

    def best(self, chunks: list[str], out: list | None = None) -> list[tuple[bytes, float, float]]:
        """The forward passes of these chunks; `out`: what is found of them already."""
        known = self.known
        out = list(map(known.get, chunks)) if out is None else out
        if None in out:
            for k, chunk in enumerate(chunks):
                if out[k] is None:
                    out[k] = known.get(chunk)
                    if out[k] is None:
                        out[k] = self.forward(chunk)
                        if len(chunk) <= LONGEST:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[chunk] = out[k]
        return out

    def ways(self, chunk: str, n: int, best: bytes) -> list[Path]:
        """A chunk's n best, the forward pass's best first among its equals."""
        found = self.listed.get((chunk, n))
        if found is None:
            found = self.segment(chunk, n)
            if len(chunk) <= LONGEST:
                if len(self.listed) >= REMEMBERED // 20:
                    self.listed.clear()
                self.listed[chunk, n] = found
        own = (found[0][0], tuple(np.frombuffer(best, "<u4").tolist()))
        return [own, *[w for w in found if w != own]][:n]

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(self.escaped(text))

    def encode(self, text: str, n: int = N_BEST, chunks: list[str] | None = None,
               found: list | None = None) -> tuple[bytes, list[float], list[dict[int, tuple[int, ...]]], tuple[bytes, ...]]:
        """The n best of a text.

        Returns the ids of the best, the n scores, for each segmentation the
        chunks in which it differs from the best ({chunk number: ids}), and the
        chunks' best ids.
        """
        chunks = self.chunks(text) if chunks is None else chunks
        parts, scores, losses = zip(*self.best(chunks, found), strict=True) if chunks else ((), (), ())
        base = sum(scores)
        losses = np.array(losses)
        if len(losses) > n - 1:
            edge = np.partition(losses, n - 2)[n - 2] if n > 1 else -np.inf
            under, equal = np.flatnonzero(losses < edge), np.flatnonzero(losses == edge)
            chosen = np.sort(np.concatenate((under, equal[:n - 1 - len(under)])))
        else:
            chosen = np.arange(len(losses))
        some = [(k, self.ways(chunks[k], n, parts[k])) for k in chosen.tolist() if losses[k] < np.inf]

        def edges_to(node):
            ways = some[node - 1][1]
            return [(node - 1, s - ways[0][0], a) for a, (s, _) in enumerate(ways)]

        found = n_best(len(some), edges_to, n)
        changes = [{k: ways[a][1] for (k, ways), a in zip(some, alt, strict=True) if a} for _, alt in found]
        return b"".join(parts), [base + s for s, _ in found], changes, parts

    def decode(self, ids) -> str:
        """The text of a segmentation: pieces joined, escaped spaces back, the first one gone."""
        return self.joined(ids).decode("utf-8", "replace")[1:]

    def joined(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def spliced(data: bytes, changes: list[dict[int, tuple[int, ...]]], parts: tuple[bytes, ...]) -> list[bytes]:
    """The ids of each segmentation: those of the best with the changed chunks put in."""
    if all(not c for c in changes):
        return [data] * len(changes)
    ends = list(accumulate(map(len, parts)))
    out = []
    for c in changes:
        at, got = 0, []
        for k in sorted(c):
            got += [data[at:ends[k] - len(parts[k])], np.array(c[k], "<u4").tobytes()]
            at = ends[k]
        out.append(b"".join([*got, data[at:]]))
    return out


def _offsets(sizes: Iterable[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.fromiter(sizes, np.int64)))), pa.int32())


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of this worker process, which Spark uses for many tasks."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def prepared(m: PieceModel, batch: pa.RecordBatch) -> Iterator[tuple[int, str, list[str], list]]:
    """Id, text, chunks and their forward passes of each row; the new chunks of `TOGETHER` characters pass at once."""
    ids, held, new, size = batch.column(0).to_pylist(), [], set(), 0
    for k, text in enumerate(batch.column(1)):
        text = text.as_py() or ""
        chunks = m.chunks(text)
        found = list(map(m.known.get, chunks))
        if None in found:
            new.update(set(chunks).difference(m.known))
        held.append((ids[k], text, chunks, found))
        size += len(text)
        if size >= TOGETHER or k + 1 == len(ids):
            m.learn(new)
            yield from held
            held, new, size = [], set(), 0


def encode_documents(docs: DataFrame, path: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text",
                     ids: str = "all") -> DataFrame:
    """(id, n_pieces, n_segmentations, scores, ids_crc32, decoded[, ids | segmentations]) of each document.

    `n_pieces` and `ids_crc32` (of the ids as little-endian unsigned 32-bit integers)
    belong to the best segmentation; `decoded` says whether each of the n best
    decodes to the text. `ids`: "all" adds the ids of the n best (segmentations),
    "best" those of the best (ids), "none" neither.
    """
    small_batches(docs.sparkSession)
    schema = (f"{id_col} long, n_pieces long, n_segmentations int, scores array<double>, ids_crc32 long, decoded boolean"
              + {"all": ", segmentations array<array<int>>", "best": ", ids array<int>", "none": ""}[ids])

    def encode(batches: Iterator[pa.RecordBatch]):
        m = model(path)
        for batch in batches:
            rows, listed = [], []
            for i, text, chunks, known in prepared(m, batch):
                data, scores, changes, parts = m.encode(text, n, chunks, known)
                best = np.frombuffer(data, "<u4").tolist()
                # Alternatives differ from the best in a few chunks: these are decoded apart.
                same = m.decode(best) == text and all(
                    m.joined(new) == m.joined(np.frombuffer(parts[k], "<u4").tolist()) for c in changes for k, new in c.items())
                rows.append((i, len(best), len(changes), scores, zlib.crc32(data), same))
                if ids != "none":
                    listed.append(spliced(data, changes, parts) if ids == "all" else [data])
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.bool_()]
            names = [id_col, "n_pieces", "n_segmentations", "scores", "ids_crc32", "decoded", "ids" if ids == "best" else "segmentations"]
            made = [pa.array([r[k] for r in rows], kinds[k]) for k in range(6)]
            if ids != "none":
                flat = [data for ways in listed for data in ways]
                one = pa.ListArray.from_arrays(_offsets(len(data) // 4 for data in flat), pa.array(np.frombuffer(b"".join(flat), "<i4"), pa.int32()))
                made.append(one if ids == "best" else pa.ListArray.from_arrays(_offsets(map(len, listed)), one))
            yield pa.RecordBatch.from_arrays(made, names[:len(made)])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`encoded` with the text of its ids (array<int>); null ids give null."""
    small_batches(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]):
        m = model(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else m.decode(x) for x in ids], pa.string())],
                                             [*batch.schema.names, text_col])

    return encoded.mapInArrow(decode, T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())]))
