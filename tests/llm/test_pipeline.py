"""The pipeline against brute force, and its contract."""

import random
import re
import zlib

import pytest

import __spark_entry__
import corpus_pipeline
from formbook.llm import piece_lattice, simhash, string_tiling, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(8)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "nt", "ea", "ti", "to"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(rng.choice([30, 90]))]
        if k % 5 == 0:
            words[3:3] = ["grumbol"]
            words[9:9] = ["snivvles"]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 5 == 0)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(5)]
    rows += [(1000, rows[1][1].replace(" ", "  ")), (1001, rows[2][1] + "\n"), (1002, rows[3][1]), (1003, rows[3][1]), (1004, None), (1005, ""),
             (1006, "x " + items[2][1] + " y"), (1007, " ".join(items[3][1].split()[20:] + ["gap"] + items[3][1].split()[:20]))]
    long = " ".join(word() for _ in range(3000))
    rows += [(1010, long), (1011, long + " tail")]
    documents = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(documents, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, labels, items


def test_stages_take_effect_and_match_brute_force(spark, folder):
    path, rows, labels, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination",
                                                      "SentencePiece encoding"]
    y = {i: t for i, _, t in labels}
    known = {i: t for i, t in rows if i in y and zlib.crc32(str(i).encode()) % 3 != 1}
    model = toxicity.train([t for i, t in known.items() if y[i]], [t for i, t in known.items() if not y[i]])
    left = [(i, t or "") for i, t in rows if model.probability(model.texts([t or ""])[0][0]) < toxicity.THRESHOLD]
    assert len(left) < len(rows) - 60
    first = {}
    for i, t in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    left = sorted(first.values())
    prints = [simhash.fingerprint(t.encode()) for _, t in left]
    parent = list(range(len(left)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    left = [d for k, d in enumerate(left) if root(k) == k]
    number, clean = {}, []
    ids = lambda t: [number.setdefault(w, len(number)) for w in string_tiling.tokens(t)]
    for i, t in left:
        if not any(sum(x[2] for x in string_tiling.tile(ids(t), ids(item))) * 2 >= len(ids(item)) for _, item in items):
            clean.append((i, t))
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in clean)
    gone = {i for i, _ in rows} - {i for i, _ in clean}
    assert {1000, 1002, 1003, 1006, 1007, 1011} <= gone and {1, 1010} & {r.doc_id for r in got}
    texts = dict(clean)
    import public_tokenizers
    m = piece_lattice.PieceModel(public_tokenizers.path(corpus_pipeline.MODEL))
    assert all(m.decode(r.ids) == texts[r.doc_id] and r.decoded for r in got)


def test_all_but_the_last_stage_keep_the_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]


def test_empty_documents(spark, folder, tmp_path):
    path = folder[0]
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and {"op1_revisits", "op4_content_sort", "op9_license_dice"} <= __spark_entry__.oracle_sql().keys()
