"""Content sort, SimHash and token files against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard

from formbook.llm import components, content_sort, simhash, token_frames

SCHEMA = "doc_id long, text string, id string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def some_docs(seed=1, n=120):
    rng = random.Random(seed)
    base = ["", " ", "a b", "a  b", "a\tb", "\x0ba b", "a b ", "x" * 30_000, "ä ö", "a b", None]
    rows = [(i, rng.choice(base), "clash") for i in range(n)]
    rng.shuffle(rows)
    return rows + [rows[0], rows[0], (None, "a b", None), (None, "only null", "z"), (None, "only null", "z")]


def sort_brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        left = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), left, hashlib.sha256(t.encode()).hexdigest()))
            left = False
    return sorted(map(str, out))


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_groups_match_brute_force_at_any_number_of_partitions(spark, parts):
    rows = some_docs()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = content_sort.duplicate_groups(docs)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted(str(tuple(r)) for r in got.collect()) == sort_brute(rows)
        kept = content_sort.first_of_each(docs)
        assert kept.columns == docs.columns
        want = sorted(i for i, k, _, stays, _ in (eval(x) for x in sort_brute(rows)) if stays and i is not None)
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
        assert kept.count() == len({SPACE.sub(" ", t or "") for _, t, _ in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert content_sort.duplicate_groups(empty).count() == 0
    assert content_sort.first_of_each(empty).count() == 0
    assert simhash.near_components(empty).count() == 0
    assert token_frames.token_digest(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def print_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(prints, distance):
    parent = {i: i for i in range(len(prints))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["Straße", "ÄB", "ab c"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 9, 200]))) for _ in range(60)]
    for t in list(texts):
        w = t.split(" ")
        if len(w) > 100:
            texts += [" ".join(w[:-1]), "\t" + t.replace("w1 ", "W1  "), " ".join([*w, "new"])]
    texts += ["", None, None, "\n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    prints = [print_brute(t) for t in texts]
    roots = components_brute(prints, 4)
    for entries in (4096, 1):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_components(docs, entries_per_key=entries).collect()}
        assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, roots, strict=True))}


@pytest.mark.parametrize(("segments", "entries"), [(3, 4096), (3, 2), (2, 4096), (4, 16)])
def test_links_of_dense_values(spark, segments, entries):
    rng = random.Random(segments)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    for s in seeds:
        for _ in range(40):
            v = s
            for _ in range(rng.randrange(8)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, segments, entries).collect()
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
    index = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(index[a]), root(index[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(values))] == components_brute(values, 4)


def test_components_of_paths_and_odd_links(spark):
    edges = [(i, i + 1) for i in range(100)] + [(7, 7), (None, 3), (500, 400), (500, 400), (400, 450)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(101)} | {400: 400, 450: 400, 500: 400}


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(5)
    odd = ["Hello, wörld", "x" * 300, "<|endoftext|>a", "it's 12", "é ́x", "a b c", "\x1ca\x1cb", "日本語", "%%%", ""]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(odd) for _ in range(rng.choice([0, 1, 5, 400]))) for _ in range(80)] + [None]
    rows = [(1000 - 3 * i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(token_frames.token_digest(docs, path).collect(), key=lambda r: r.start)
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_frames_are_standard_and_checked(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 17} next " * (i % 900), "x") for i in range(900)], SCHEMA)
    path, uri = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/out"
    parts = token_frames.write_token_files(docs, path, uri)
    name = parts.orderBy("part").first().name
    reader, ids, sizes = token_frames.open_part(uri, name)
    raw = zstandard.ZstdDecompressor().stream_reader((tmp_path / "out" / f"{name}.zst").open("rb"), read_across_frames=True).read()
    assert len(raw) == 4 * sizes.sum() and len(reader.rows) > 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    for k in random.Random(1).sample(range(len(ids)), min(20, len(ids))):
        assert reader.read(4 * int(at[k]), 4 * int(at[k + 1])) == raw[4 * at[k]:4 * at[k + 1]]
    full = token_frames.read_token_files(spark, uri, parts).where("doc_id = 5").first()
    assert len(full.ids) == full.n_tokens and full.ids[-1] == 1
    file = tmp_path / "out" / f"{name}.zst"
    data = bytearray(file.read_bytes())
    data[20] ^= 255
    file.write_bytes(bytes(data))
    broken, _, _ = token_frames.open_part(uri, name)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.read(0, 100)
