"""String tiling, piece lattice and licence scan against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from formbook.llm import license_scan, piece_lattice, string_tiling

SCHEMA = "doc_id long, text string, item_id string"


def tile_brute(doc, item, least):
    """Mark the longest common unmarked run, first in the document and then in the item, until none is long enough."""
    d, i, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not d[a + n] and not i[b + n]:
                    n += 1
                if n > best[2]:
                    best = (a, b, n)
        a, b, n = best
        if n < least:
            return out
        d[a:a + n], i[b:b + n] = [True] * n, [True] * n
        out.append(best)


@pytest.mark.parametrize("seed", range(12))
def test_tiles_are_greedy_and_longest_first(seed):
    rng = random.Random(seed)
    item = [rng.randrange(3 + seed) for _ in range(rng.choice([4, 20, 60]))]
    doc = [rng.randrange(3 + seed) for _ in range(80)]
    doc[30:30] = item[10:40]
    doc += item[:15]
    assert string_tiling.tile(doc, item, 3) == tile_brute(doc, item, 3)


def items_and_docs():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(200)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 6, 20, 60])))) for k in range(30)]
    items += [(30, None), (31, ""), (32, items[4][1]), (4, items[4][1])]
    docs = []
    for k in range(120):
        body = [rng.choice(words) for _ in range(rng.choice([0, 10, 300]))]
        if k % 3 == 0:
            w = rng.choice(items[:30])[1].split()
            cut = rng.randrange(len(w))
            body[5:5] = [x.upper() for x in w[cut:]] + ["gap"] + w[:cut]  # reordered
        docs.append((k, ", ".join(body), "x"))
    return items, [*docs, (None, items[4][1], "x"), (500, None, "x"), (1, docs[0][1], "x")]


def pairs_brute(items, docs, least, threshold):
    out = []
    for d, text, _ in docs:
        words = string_tiling.tokens(text)
        for i, item in items:
            other = string_tiling.tokens(item)
            tiles = tile_brute(words, other, least) if set(words) & set(other) else []
            covered = sum(t[2] for t in tiles)
            if tiles and covered >= threshold * len(other):
                out.append((d, i, len(tiles), covered, len(other), covered / len(other)))
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [2_000_000, 50])
def test_contaminated_pairs(spark, block):
    items, docs = items_and_docs()
    docs = [d for d in docs if len(d[1] or "") < 900]
    item_df = spark.createDataFrame(items, "item_id long, text string")
    doc_df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = string_tiling.contaminated(doc_df, item_df, block_tokens=block).collect()
    want = pairs_brute(items, docs, 5, 0.5)
    assert sorted(str(tuple(r)) for r in got) == want and want
    hit = {eval(w)[0] for w in want}
    kept = string_tiling.contaminated(doc_df, item_df, block_tokens=block, keep=True)
    assert kept.columns == doc_df.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(str(d) for d in docs if d[0] not in hit)


def test_tiling_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", "x")], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert string_tiling.contaminated(docs, none).count() == 0
    assert string_tiling.contaminated(docs, none, keep=True).count() == 1
    assert string_tiling.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return piece_lattice.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def all_segmentations(m, text):
    edges, out = m.lattice(text), []

    def back(node, score, ids):
        if node == 0:
            out.append((score, ids))
        for before, s, label in edges(node) if node else ():
            back(before, score + s, label + ids)

    back(len(text), 0.0, ())
    return out


@pytest.mark.parametrize("text", ["", "a", "the theory", "x  y", "日本 né", "a.b, c", "line\nnext\t€", "the the the"])
def test_n_best_against_all_paths(pieces, text):
    paths = all_segmentations(pieces, pieces.escaped(text))
    want = sorted((s for s, _ in paths), reverse=True)
    known = {ids: s for s, ids in paths}
    for n in (1, 2, 5, 9):
        direct = pieces.segment(pieces.escaped(text), n)
        assert [s for s, _ in direct] == want[:n] and len({i for _, i in direct}) == len(direct)
        data, scores, changes, parts = pieces.encode(text, n)
        assert scores == want[:n]
        full = [tuple(x for k, p in enumerate(parts) for x in c.get(k) or np.frombuffer(p, "<u4").tolist()) for c in changes]
        assert len(set(full)) == len(full) and [known[f] for f in full] == scores
        assert all(pieces.decode(f) == text for f in full)
        assert np.frombuffer(data, "<u4").tolist() == list(full[0])


def test_long_texts_without_spaces_end(pieces):
    data, scores, _, _ = pieces.encode("ab" * 3000, 4)
    assert len(scores) == 4 and sorted(scores, reverse=True) == scores and data


def test_encode_and_decode_documents(spark, pieces):
    texts = ["", None, "Hello  world", "a\n\tb é", "x" * 500, "the theory " * 40, " lead", "▁ mark"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_lattice.encode_documents(docs, path, 3)
    for r in rows.collect():
        text = texts[r.doc_id] or ""
        assert r.decoded == ("▁" not in text)
        assert [pieces.decode(s) for s in r.segmentations] == [text.replace("▁", " ")] * r.n_segmentations
        assert r.ids_crc32 == zlib.crc32(np.array(r.segmentations[0], "<u4").tobytes())
    back = piece_lattice.decode_documents(rows.selectExpr("doc_id", "segmentations[0] as ids"), path)
    assert {r.doc_id: r.text for r in back.collect()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert piece_lattice.encode_documents(docs.limit(0), path).count() == 0


def licences_brute(text):
    import re
    text = (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))
    norm = re.sub(r"[^a-z0-9\n]+", " ", text)
    units = [("line", k, x) for k, x in enumerate(norm.split("\n"))]
    parts = re.split(r"\n *(?:\n *)+", norm)
    units += [("paragraph", k, x) for k, x in enumerate(parts) if len(parts) > 1 and "\n" in x]
    units += [("document", 0, norm)] if "\n" in norm else []
    out = []
    for kind, no, words in units:
        bag = set(license_scan.bigram_bag(words))
        best = None
        for t, (name, notice) in enumerate(license_scan.TEMPLATES):
            other = set(license_scan.bigram_bag(notice))
            shared = len(bag & other)
            if bag and shared * 200 >= 80 * (len(bag) + len(other)):
                dice = 2.0 * shared / (len(bag) + len(other))
                if best is None or dice > best[5]:
                    best = (kind, no, name, t, shared, dice)
        out += [best] if best else []
    return out


def test_licences(spark):
    long = [t for _, t in license_scan.TEMPLATES if len(t) > 300]
    texts = ["", None, "RELEASED under the MIT license!", "x\n\nLicensed under CC BY-NC 4.0.\ny", "prose " * 5000,
             *long, "Copyright 2020 A\n\n" + long[0], "intro\n\n" + long[1].replace("purpose", "aim") + "\n\nend", "the the the the\n" * 30]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (None, texts[2], "z")], SCHEMA)
    got = sorted(str(tuple(r)) for r in license_scan.scan(docs).collect())
    want = sorted(str((i, *b)) for i, t in [*enumerate(texts), (3, texts[3]), (None, texts[2])] for b in licences_brute(t))
    assert got == want and any("paragraph" in w for w in want) and any("document" in w for w in want)
    assert license_scan.scan(docs.limit(0)).count() == 0
