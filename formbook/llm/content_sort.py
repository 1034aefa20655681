"""Exact deduplication by sorting content.

Texts are normalised (each run of ASCII white space becomes one space) and the
rows are range-partitioned by splitters that Spark samples from the key (first
bytes of the text, SHA-256 of the text, id). The id in the key lets the copies
of one text span several partitions, so a text that a third of all rows share is
no hot key, and the splitters stay small however long the texts are. Each
partition is sorted externally, equal texts become neighbours, and a streaming
pass compares each text in full with its neighbour. A run of equal texts cut by
a splitter is joined again through the first and last run of each partition: at
most two rows a partition, the proven bound of the only broadcast.

Defined cases: null text counts as empty; empty texts form one group; null ids
come last, so a row with an id stays before one without; of rows with the same
text and id one stays; an empty table gives an empty result. Columns whose names
begin with ``_cs_`` are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import small_batches

WHITE_SPACE = r"[\x20\x09-\x0D]+"
PREFIX_BYTES = 16


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE_SPACE, " ")


def _sorted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    if any(c.lower().startswith("_cs_") for c in docs.columns):
        raise ValueError("column names beginning with _cs_ are reserved")
    small_batches(docs.sparkSession)
    rows = docs.withColumn("_cs_norm", normalised(text_col).cast("binary"))
    rows = rows.withColumns({"_cs_sha": F.unhex(F.sha2("_cs_norm", 256)),
                             "_cs_prefix": F.substring("_cs_norm", 1, PREFIX_BYTES)})
    order = [F.col("_cs_prefix"), F.col("_cs_sha")]
    last = F.col(id_col).asc_nulls_last()
    return rows.repartitionByRange(*order, last).sortWithinPartitions(*order, "_cs_norm", last)


def _marked(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    """Ids with their run: number, smallest id, size; edge runs carry their text once."""
    part = TaskContext.get().partitionId()
    run, text, ids, sha = -1, None, [], None

    def flush(last: bool):
        edge = last or run == 0
        n = len(ids)
        for start in range(0, n, 100_000):
            some = ids[start:start + 100_000]
            m = len(some)
            head = [start == 0] + [False] * (m - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([sha] * m, pa.binary()), pa.array([part] * m, pa.int32()),
                 pa.array([run] * m, pa.int64()), pa.array([ids[0]] * m, pa.int64()), pa.array([n] * m, pa.int64()),
                 pa.array(head), pa.array([edge] * m),
                 pa.array([text if edge and h else None for h in head], pa.binary())],
                ["id", "sha", "part", "run", "keep", "size", "head", "edge", "text"])

    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i, value, digest in zip(column[id_col].to_pylist(), column["_cs_norm"], column["_cs_sha"].to_pylist(),
                                    strict=True):
            value = value.as_py()
            if digest != sha or value != text:
                if run >= 0:
                    yield from flush(False)
                run, text, ids, sha = run + 1, value, [], digest
            ids.append(i)
    if run >= 0:
        yield from flush(True)


_MARKED = ("id long, sha binary, part int, run long, keep long, size long, head boolean, edge boolean, text binary")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = _sorted(slim, "id", "text").select("id", "_cs_norm", "_cs_sha")
    rows = materialise(ranged.mapInArrow(lambda b: _marked(b, "id"), _MARKED), "content-sort")
    edges = rows.where("edge and head")
    merged = (edges.groupBy("sha", "text").agg(
        F.sum("size").alias("size"), F.min(F.struct(F.col("keep").isNull().alias("none"), "keep", "part")).alias("best")))
    merged = (edges.select("part", "run", "sha", "text").join(merged, ["sha", "text"])
              .select("part", "run", F.col("size").alias("whole"), F.col("best.keep").alias("first"),
                      (F.col("best.part") == F.col("part")).alias("stays")))
    out = rows.join(F.broadcast(merged), ["part", "run"], "left")  # two rows a partition at most
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("edge"), F.col("first")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("whole", "size").alias("group_size"),
        (F.col("head") & F.coalesce("stays", F.lit(True))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _heads(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The first row of each run, with all columns; the last run of a partition is marked when it has ended."""
    part = TaskContext.get().partitionId()
    run, text, sha, waiting = -1, None, None, None

    def row(batch, last):
        edge = last or run_of[0] == 0
        return pa.RecordBatch.from_arrays(
            [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array([part], pa.int32()),
             pa.array([run_of[0]], pa.int64()), pa.array([edge])], [*names, "_cs_part", "_cs_run", "_cs_edge"])

    run_of = [0]
    for batch in batches:
        shas, norms = batch.column(batch.schema.get_field_index("_cs_sha")), batch.column(batch.schema.get_field_index("_cs_norm"))
        first, runs = [], []
        for i in range(batch.num_rows):
            digest, value = shas[i].as_py(), norms[i].as_py()
            if digest != sha or value != text:
                run, text, sha = run + 1, value, digest
                first.append(i)
                runs.append(run)
        if first:
            if waiting is not None:
                yield row(waiting, False)
            heads = batch.take(pa.array(first))
            if len(first) > 1:
                body = heads.slice(0, len(first) - 1)
                yield pa.RecordBatch.from_arrays(
                    [*[body.column(body.schema.get_field_index(n)) for n in names], pa.array([part] * len(body), pa.int32()),
                     pa.array(runs[:-1], pa.int64()), pa.array([r == 0 for r in runs[:-1]])],
                    [*names, "_cs_part", "_cs_run", "_cs_edge"])
            waiting = heads.slice(len(first) - 1)
            run_of[0] = runs[-1]
    if waiting is not None:
        yield row(waiting, True)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal normalised texts the one with the smallest id."""
    ranged = _sorted(docs, id_col, text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("_cs_sha", T.BinaryType()),
                           T.StructField("_cs_norm", T.BinaryType()), T.StructField("_cs_part", T.IntegerType()),
                           T.StructField("_cs_run", T.LongType()), T.StructField("_cs_edge", T.BooleanType())])
    names = [*docs.columns, "_cs_sha", "_cs_norm"]
    heads = materialise(ranged.mapInArrow(lambda b: _heads(b, names), schema).withColumn(
        "_cs_norm", F.when(F.col("_cs_edge"), F.col("_cs_norm"))), "content-heads")
    edges = heads.where("_cs_edge").select("_cs_sha", "_cs_norm", "_cs_part", "_cs_run")
    first = edges.groupBy("_cs_sha", "_cs_norm").agg(F.min("_cs_part").alias("_cs_first"))
    again = edges.join(first, ["_cs_sha", "_cs_norm"]).where("_cs_part > _cs_first").select("_cs_part", "_cs_run")
    return heads.join(F.broadcast(again), ["_cs_part", "_cs_run"], "left_anti").select(*docs.columns)  # two rows a partition at most
