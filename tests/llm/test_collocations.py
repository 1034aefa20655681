"""Collocations against brute force; summaries against their guarantee."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from formbook.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, phrase string, f int"


def brute(rows, threshold, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, *words[i:i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    cand = {p: c for p, c in f.items() if len(p) > 2 and c >= threshold}
    covered = Counter()
    for p, c in cand.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                covered[p[0], *p[i:i + k]] = max(covered[p[0], *p[i:i + k]], c)
    out = []
    for p, a in cand.items():
        if covered[p] >= a:
            continue
        cuts = [(1000 * a * n[p[0]] // (f[p[:1 + k]] * f[p[0], *p[1 + k:]]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, f[p[:1 + k]], f[p[0], *p[1 + k:]], n[p[0]], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def made(seed, docs=60):
    rng = random.Random(seed)
    words = ["New", "york", "new", "É", "times", "the", "a", "x.y", "(b", "\\d", "😀"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "", ", "]) for _ in range(rng.randrange(80))),
             rng.choice(["en", "de", None, "und"]), "the", 3) for i in range(docs)]
    return rows + [(90 + i, "one very common passage of words", "en", None, None) for i in range(40)] + [(7, None, "en", None, None), (7, "", None, None, None)]


def run(df, **options):
    return sorted(map(tuple, col.collocations(df, **options).collect()))


@pytest.mark.parametrize("seed,capacity,flush", [(1, 1 << 20, 12 << 20), (2, 200, 200)])
def test_equals_brute_force(spark, frame, monkeypatch, seed, capacity, flush):
    monkeypatch.setattr(col, "CAPACITY", capacity)
    monkeypatch.setattr(col, "FLUSH_BYTES", flush)
    rows = made(seed)
    got = run(frame(SCHEMA, *rows), threshold=6)
    assert got == brute(rows, 6) and len(got) > 20
    assert run(frame(SCHEMA, *rows), threshold=6, top=3) == brute(rows, 6, 3)


def test_a_full_map_and_too_few_partitions_change_nothing(spark, frame, monkeypatch):
    rows = made(5)
    monkeypatch.setattr(col, "MAP_BITS", 1)
    monkeypatch.setattr(col, "CAPACITY", 50)
    kept, _, bits = col.survivors(frame(SCHEMA, *rows).selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text"), 2, 1)
    assert bits > 4 and max(r["lost"] for r in kept.collect()) < 2  # the pass was repeated
    monkeypatch.setattr(col, "CAPACITY", 250)
    assert run(frame(SCHEMA, *rows), threshold=5) == brute(rows, 5)


def test_long_text_and_empty_table(spark, frame, monkeypatch):
    monkeypatch.setattr(col, "FLUSH_BYTES", 5000)
    rows = [(1, "alpha beta gamma. " * 30_000, "en", None, None), (2, "no end " * 20_000, "en", None, None)]
    assert run(frame(SCHEMA, *rows)) == brute(rows, 100)
    assert run(frame(SCHEMA)) == [] and run(frame(SCHEMA, (1, None, None, None, None))) == []


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(1)
    for capacity in (1, 5, 40):
        stream = np.minimum(rng.zipf(1.3, 20_000), 5000).astype(np.uint64)
        summaries = []
        for piece in np.array_split(stream, 13):
            keys, counts = col.added(piece, np.ones(len(piece), np.int64))
            keys, counts, lost = col.pruned(keys, counts, capacity)
            k2, c2 = col._unpacked(col._packed(keys, counts))
            assert (k2 == keys).all() and (c2 == counts).all()
            summaries.append((keys, counts, lost))
        keys, counts, lost = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for k, c, gone in summaries:
            keys, counts, taken = col.pruned(*col.added(np.concatenate([keys, k]), np.concatenate([counts, c])), capacity)
            lost += gone + taken
        assert lost <= len(stream) // (capacity + 1) and len(keys) <= capacity
        true = Counter(stream.tolist())
        assert {k for k, n in true.items() if n > lost} <= set(keys.tolist())
        assert all(true[k] - lost <= c <= true[k] for k, c in zip(keys.tolist(), counts.tolist(), strict=True))
