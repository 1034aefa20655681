"""op7 gives the segmentations themselves, not only what is counted of them."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

import __spark_entry__ as entry
from formbook.llm import piece_lattice

SF = "/root/testdata/sf0.001"


def test_query_lists_all_segmentations(spark):
    model = piece_lattice.model(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op7_piece_lattice"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert len(r.segmentations) == r.n_segmentations == len(r.scores) and len(r.segmentations[0]) == r.n_pieces
        assert len({tuple(s) for s in r.segmentations}) == r.n_segmentations
        assert zlib.crc32(np.array(r.segmentations[0], "<u4").tobytes()) == r.ids_crc32
        assert {model.decode(s) for s in r.segmentations} == {texts[r.doc_id]} if r.decoded else True


def test_changed_chunks_are_put_in():
    parts = tuple(np.array(p, "<u4").tobytes() for p in ([1, 2], [], [3], [4, 5, 6]))
    got = piece_lattice.spliced(b"".join(parts), [{}, {0: (9,)}, {3: (7, 7), 1: (8,)}], parts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [[1, 2, 3, 4, 5, 6], [9, 3, 4, 5, 6], [1, 2, 8, 3, 7, 7]]
    assert piece_lattice.spliced(b"", [{}], ()) == [b""]
    assert piece_lattice._offsets([]).equals(pa.array([0], pa.int32()))


def test_chunks_pass_forward_together(monkeypatch):
    """Many chunks at once give what each gives alone, and a batch needs no single pass for known characters."""
    model = piece_lattice.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    letters = "▁aeinrst,.é日€\n\t😀XQ0" + "the"
    chunks = ["", "▁", "▁▁▁the", "x" * 300, *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(3000))]
    assert model.forward_all(chunks) == [model.forward(c) for c in chunks]
    assert model.forward_all([]) == []
    texts = ["the theory of " + " ".join("".join(rng.choices("aeinrst", k=rng.randrange(1, 20))) for _ in range(30)) for _ in range(20)]
    want = [model.encode(t) for t in texts]
    monkeypatch.setattr(piece_lattice, "REMEMBERED", 40)
    monkeypatch.setattr(piece_lattice, "TOGETHER", 500)
    model.known.clear()
    monkeypatch.setattr(model, "forward", lambda chunk: 1 / 0)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    rows = list(piece_lattice.prepared(model, batch))
    assert [(i, t) for i, t, *_ in rows] == list(enumerate(texts))
    got = []
    for _, t, chunks, found in piece_lattice.prepared(model, batch):
        got.append(model.encode(t, piece_lattice.N_BEST, chunks, found))
    assert got == want
