"""Centroid clustering over Hilbert-ordered blocks with min/max boxes.

Vectors become integers, floor(scale * x). Their order follows a Hilbert curve
through the leading principal axes; a range partition by (curve position, id)
and a sort within partitions put near vectors beside each other, and every
`BLOCK` neighbours are stored as one row with the smallest and largest value of
each component. A round reads the blocks: the distance from a centroid to the
box bounds the distances of all its vectors from below and from above, so only
centroids whose lower bound is within the smallest upper bound are candidates,
and the block's vectors are compared with these in exact integer arithmetic.
Boxes and bounds are integers too: pruning never changes an answer, and on data
without structure (independent components) every centroid stays a candidate.

Each task sends one row per centroid (count, sums, distances), so a round
brings k rows to the driver; centroids are k rows. Sums are decimals, the new
centroid floor(sum / count). The vectors whose ids hash lowest are the first
centroids; the lowest `SAMPLE` of them give the axes, which decide the layout
only. A hash cut-off from the row count keeps that choice from merging every
task's lowest rows. Blocks are written to the shared folder.

Defined cases: a vector that is null, has other than `dims` components or one
that is null or not finite is left out; ids may be null (such a vector starts
no centroid unless there are too few others) or repeated (each row is a vector,
equal hashes start in the order of their components); fewer vectors than k give
fewer centroids; equal distances go to the smaller number; an empty centroid
stays; an empty table gives an empty result; integers beyond 2^27 are refused,
as distances would leave 64 bits; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BLOCK = 128
SAMPLE = 2048
AXES, AXIS_BITS = 6, 8
LARGEST = 1 << 27  # of an integer component: 64 squares of twice that stay within 63 bits
EXACT = 1 << 22  # products of 64 such components are exact in double arithmetic
PART_ROWS = 200_000

_BLOCKS = "ids array<long>, vectors binary, low array<int>, high array<int>"
_SUMS = "cluster int, n long, distance decimal(38,0), sums array<decimal(38,0)>"
_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): kept vectors as integers."""
    known = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(F.col(vec_col), lambda x: F.floor(float(scale) * x.cast("double")))
    small = F.forall(F.col(vec_col), lambda x: F.abs(float(scale) * x.cast("double")) < float(LARGEST))
    return (vectors.where((F.size(vec_col) == dims) & known)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.when(small, scaled).otherwise(F.raise_error(F.lit("a component leaves the range of exact distances"))).alias("v")))


def hilbert_position(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of `cells` (integers below 2^bits); rows times bits fit in 63.

    Gray-code form of the curve: from the highest bit down, a set bit inverts
    the lower bits of the first axis and a clear one swaps them with it.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i, axis in enumerate(axes):
            is_set = (axis & bit) != 0
            swap = np.where(is_set, 0, (axes[0] ^ axis) & below)
            if i:
                axes[i] = axis ^ swap
            axes[0] = np.where(is_set, axes[0] ^ below, axes[0] ^ swap)
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1, (1 << level) - 1, 0)
    place = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            place = place << 1 | ((axis ^ turn) >> level & 1)
    return place


def principal_axes(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, axes, spread) of the sample: up to `AXES` directions of the largest variance."""
    mean = sample.mean(axis=0)
    _, directions = np.linalg.eigh(np.cov((sample - mean).T, bias=True).reshape(sample.shape[1], -1))
    axes = directions[:, ::-1][:, :AXES]
    spread = float(((sample - mean) @ axes).std(axis=0).max()) * 3
    return mean, axes, spread or 1.0


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _placed(batches: Iterator[pa.RecordBatch], dims: int, layout) -> Iterator[pa.RecordBatch]:
    mean, axes, spread = layout
    for batch in batches:
        if batch.num_rows == 0:
            continue
        v = _matrix(batch.column(1), dims)
        cells = ((v - mean) @ axes / spread + 1) / 2 * (1 << AXIS_BITS)
        place = hilbert_position(np.clip(cells, 0, (1 << AXIS_BITS) - 1).astype(np.int64), AXIS_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(0), batch.column(1)], ["place", "id", "v"])


def _blocked(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring vectors with their boxes."""
    ids, held = [], np.empty((0, dims), np.int32)

    def row(n):
        box = held[:n]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[:n]], pa.list_(pa.int64())), pa.array([box.tobytes()], pa.binary()),
             pa.array([box.min(axis=0)], pa.list_(pa.int32())), pa.array([box.max(axis=0)], pa.list_(pa.int32()))],
            ["ids", "vectors", "low", "high"])

    for batch in batches:
        ids += batch.column(0).to_pylist()
        held = np.concatenate([held, _matrix(batch.column(1), dims).astype(np.int32)])
        while len(ids) >= BLOCK:
            yield row(BLOCK)
            ids, held = ids[BLOCK:], held[BLOCK:]
    if ids:
        yield row(len(ids))


def hilbert_blocks(vectors: DataFrame, dims: int, sample: np.ndarray, count: int) -> DataFrame:
    """The stored blocks of (id, v)."""
    layout = principal_axes(sample)
    placed = vectors.mapInArrow(lambda b: _placed(b, dims, layout), "place long, id long, v array<long>")
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_ROWS))
    order = [F.col("place"), F.col("id")]
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "v")
    return materialise(ranged.mapInArrow(lambda b: _blocked(b, dims), _BLOCKS), "zone-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector in the box."""
    least = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    most = np.maximum(np.abs(low - centroids), np.abs(high - centroids))
    return np.flatnonzero((least * least).sum(axis=1) <= (most * most).sum(axis=1).min())


def nearest(block: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid; ties go to the smaller number."""
    some = candidates(low, high, centroids)
    near = centroids[some]
    if max(-low.min(), high.max(), np.abs(near).max()) <= EXACT:
        v, c = block.astype(np.float64), near.astype(np.float64)
        distances = ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        distances = np.stack([((block - c) ** 2).sum(axis=1) for c in near], axis=1)
    best = distances.argmin(axis=1)
    return some[best], distances[np.arange(len(block)), best]


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    for batch in batches:
        ids, vectors, low, high = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            block = np.frombuffer(vectors[i].as_py(), np.int32).reshape(-1, centroids.shape[1]).astype(np.int64)
            box = (np.asarray(side[i].values, np.int64) for side in (low, high))
            yield ids[i].values, block, *nearest(block, *box, centroids)


def _summed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per centroid and task: vectors, distances, sums of components."""
    k = len(centroids)
    n, sums, distance = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64), [0] * k
    for _, block, cluster, far in _assigned(batches, centroids):
        n += np.bincount(cluster, minlength=k)
        np.add.at(sums, cluster, block)
        for c in np.unique(cluster):
            distance[c] += int(far[cluster == c].sum())
    some = [c for c in range(k) if n[c]]
    whole = pa.decimal128(38, 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array(n[some]), pa.array([distance[c] for c in some], whole),
         pa.array([sums[c].tolist() for c in some], pa.list_(whole))], ["cluster", "n", "distance", "sums"])


def summary(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Count, summed distance and summed components by centroid: at most k rows reach the driver."""
    per = blocks.mapInArrow(lambda b: _summed(b, centroids), _SUMS).groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("distance").alias("distance"),
        *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(centroids.shape[1])])
    return {r["cluster"]: (r["n"], int(r["distance"]), [int(x) for x in r[3:]]) for r in per.collect()}


def _labelled(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, inertia: list[int]) -> Iterator[pa.RecordBatch]:
    shas = pa.array([centroid_sha256(c) for c in centroids])
    each, total = pa.array(inertia, pa.int64()), sum(inertia)
    for ids, block, cluster, far in _assigned(batches, centroids):
        where = pa.array(cluster)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(cluster, pa.int32()), pa.array(far), each.take(where), pa.array([total] * len(block), pa.int64()), shas.take(where)],
            [f.split()[0] for f in _OUT.split(", ")])


def centroid_sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def lowest_hashes(vectors: DataFrame, count: int, least: int, prefix: str) -> np.ndarray:
    """The vectors whose ids hash lowest, in that order: `least` of them, or all."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256).alias("hash"), "v")
    order = [F.col("hash").asc_nulls_last(), F.col("v")]
    share = min(1.0, 8 * least / max(count, 1))
    if share < 1:
        few = hashed.where(F.col("hash") < f"{int(share * 2**52):013x}").orderBy(*order).limit(least).collect()
        if len(few) == least:
            return np.array([r["v"] for r in few], np.int64)
    return np.array([r["v"] for r in hashed.orderBy(*order).limit(least).collect()], np.int64)


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, prefix: str = "2:",
             id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each kept vector with its cluster, squared distance, its cluster's and all inertia and its centroid's digest."""
    ints = integer_vectors(vectors, dims, scale, id_col, vec_col)
    count = ints.count()
    if count == 0:
        return vectors.sparkSession.createDataFrame([], _OUT).withColumnRenamed("vec_id", id_col)
    sample = lowest_hashes(ints, count, max(SAMPLE, k), prefix)
    centroids = sample[:k].copy()
    blocks = hilbert_blocks(ints, dims, sample[:SAMPLE], count)
    for _ in range(rounds):
        for c, (n, _, sums) in summary(blocks, centroids).items():
            centroids[c] = [s // n for s in sums]
    per = summary(blocks, centroids)
    inertia = [per[c][1] if c in per else 0 for c in range(len(centroids))]
    return blocks.mapInArrow(lambda b: _labelled(b, centroids, inertia), _OUT).withColumnRenamed("vec_id", id_col)


def oracle(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, prefix: str = "2:") -> str:
    """`clusters` of the embeddings table in DuckDB's SQL, every vector against every centroid."""
    ctes = [rf"""v as materialized (select row_number() over () as row, vec_id,
        list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
      where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})""",
            rf"""c0 as materialized (select row_number() over (order by h nulls last, v) - 1 as c, v from (
        select sha256('{prefix}' || vec_id) as h, v from v order by h nulls last, v limit {k}))"""]
    for n in range(rounds + 1):
        ctes.append(rf"""a{n} as materialized (select row, any_value(vec_id) as vec_id, any_value(v) as v, min(d * {k} + c) as best from (
        select row, vec_id, v.v, c, cast(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.v[i] - c{n}.v[i]) * (v.v[i] - c{n}.v[i]))) as bigint) as d
        from v, c{n}) group by row)""")
        if n < rounds:
            ctes.append(rf"""c{n + 1} as materialized (select c{n}.c, coalesce(m.v, c{n}.v) as v from c{n} left join (
        select c, list(cast((s - (s % n + n) % n) // n as bigint) order by i) as v from (
          select best % {k} as c, i, sum(v[i]) as s, count(*) as n from a{n}, unnest(range(1, {dims + 1})) as t(i) group by 1, 2) group by c) m on m.c = c{n}.c)""")
    return "with " + ",\n".join(ctes) + rf"""
select vec_id, cast(best % {k} as int) as cluster, best // {k} as distance, cast(sum(best // {k}) over (partition by best % {k}) as bigint) as cluster_inertia,
       cast(sum(best // {k}) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join c{rounds} on c{rounds}.c = best % {k}"""
