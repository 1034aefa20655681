"""Zone-mapped clustering against brute force."""

import hashlib
import itertools

import numpy as np
import pytest

from formbook.llm import zone_clusters as zones

SCHEMA = "vec_id long, embedding array<double>, cluster string, place int"


def brute(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in kept]
        return [(min(range(len(f)), key=lambda c: (f[c], c)), min(f)) for f in far]

    for _ in range(rounds):
        where = [c for c, _ in assign()]
        for c in set(where):
            mine = [v for (_, v), w in zip(kept, where, strict=True) if w == c]
            centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    got = assign()
    per = [sum(d for c, d in got if c == k_) for k_ in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((-1 if i is None else i, c, d, per[c], sum(per), sha[c]) for (i, _), (c, d) in zip(kept, got, strict=True))


def run(df, **options):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, zones.clusters(df, **options).collect()))


@pytest.mark.parametrize("dims,k,spread", [(64, 40, 0.1), (64, 40, 3.0), (4, 7, 1.0), (2, 3, 30_000.0)])
def test_equals_brute_force(spark, frame, dims, k, spread):
    rng = np.random.default_rng(dims)
    heart = rng.normal(size=(6, dims)) * spread * 5
    rows = [(i, (heart[i % 6] + rng.normal(size=dims) * spread).tolist(), "x", 1) for i in range(400)]
    rows += [(1000 + i, heart[0].tolist(), None, None) for i in range(300)]  # one very common vector
    got = run(frame(SCHEMA, *rows), k=k, dims=dims)
    assert got == brute(rows, k, 5, dims, 256)


def test_defined_cases(spark, frame):
    good = [0.5, -0.25]
    rows = [(1, good, "x", 1), (1, good, "x", 1), (2, [0.5, None], None, 1), (3, [float("nan"), 1.0], None, 1), (4, None, None, 1),
            (5, [1.0], None, 1), (6, [float("-inf"), 1.0], None, 1), (7, [], None, 1), (None, [3.0, 3.0], None, 1), (8, [-0.001, 0.001], None, 1)]
    for k in (1, 2, 3, 40):
        assert run(frame(SCHEMA, *rows), k=k, dims=2) == brute(rows, k, 5, 2, 256)
    assert run(frame(SCHEMA), dims=2) == [] and run(frame(SCHEMA, (1, None, None, 1)), dims=2) == []
    with pytest.raises(Exception, match="exact distances"):
        run(frame(SCHEMA, (1, [1e9, 0.0], None, 1)), dims=2)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (6, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = zones.hilbert_position(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_prune_and_never_lose_the_nearest():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-900, 900, (40, 8))
    kept = 0
    for _ in range(200):
        block = centroids[rng.integers(40)] + rng.integers(-40, 40, (32, 8))
        low, high = block.min(axis=0), block.max(axis=0)
        some = zones.candidates(low, high, centroids)
        kept += len(some)
        all_far = ((block[:, None, :] - centroids) ** 2).sum(axis=2)
        number, far = zones.nearest(block, low, high, centroids)
        assert (number == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()
    assert kept < 200 * 4
