"""A vector index whose answers are exact: coarse cells, codes of what is left, and bounds that say where to look no further.

Vectors are brought to length one and dealt to the nearest of some centres; what a vector differs from its centre by is kept in one byte
a dimension, with the exact length of what the code loses. So the distance of a query to a vector lies between two known bounds. A
search goes twice over cells: first over the nearest, which bounds the distance of a query's k-th neighbour from above; then over all
that the triangle inequality doesn't rule out, of which only vectors whose lower bound is within that distance are compared exactly.

Centres are fitted on a bounded sample; they decide what is read, never what is found. Cells with many vectors are split, so that a group
has GROUP vectors at most with the queries that come for them. Vectors of no length have a cosine of 0 with everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators.search import best
from stratalens.sources.staging import written

#: Vectors on which centres are fitted; centres; vectors in a group; queries that are compared with a group at a time.
SAMPLE, CELLS, GROUP, STEP = 50_000, 1024, 1 << 16, 256
#: Cells that a query reads first, and more until they hold as many vectors as it asks for.
PROBES = 2
#: Scores are rounded to six digits and ties go by key: what is within this much of the k-th is compared, too.
SLACK = 4e-6


@dataclass
class Shape:
    """Of every cell its centre, radius, size and parts; the last one, of vectors without length, has no centre."""

    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    parts: np.ndarray


@dataclass
class Index:
    """Codes (cell, id, scale, code, lost, far), the vectors themselves (id, vector), and the cells."""

    codes: DataFrame
    vectors: DataFrame
    shape: Shape


def _units(column) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow column as rows of length one, and which have no length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    length = np.linalg.norm(rows, axis=1)
    return rows / np.where(length == 0, 1, length)[:, None], length == 0


def _coded(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            unit, none = _units(batch.column("vector"))
            cell = (1 - 2 * unit @ centres.T + (centres**2).sum(1)).argmin(1) if len(unit) else np.zeros(0, np.int64)
            rest = unit - centres[cell]
            scale = np.abs(rest).max(1) / 127 if len(unit) else np.zeros(0)
            code = np.rint(rest / np.where(scale == 0, 1, scale)[:, None]).astype(np.int8)
            lost = np.linalg.norm(rest - scale[:, None] * code, axis=1)
            cell = np.where(none, len(centres), cell)  # those of no length have a cell of their own
            columns = [pa.array(cell.astype(np.int32)), batch.column("id"), pa.array(scale), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(lost), pa.array(np.linalg.norm(rest, axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "id", "scale", "code", "lost", "far"])

    return run


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, seed: int = 11) -> Index:
    """An index of all rows of `vectors` with a vector and a key; the first of repeated keys counts. All vectors have one dimension."""
    rows = written(vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).dropDuplicates(["id"]), "vectors")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).filter(F.exists("vector", lambda x: x != 0))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    some = some.select(array_to_vector(F.transform("vector", lambda x: x / length)).alias("features"))
    n = some.count()
    if n:
        k = min(cells or CELLS, max(1, math.isqrt(n)))
        centres = np.array(KMeans(k=k, seed=seed, maxIter=10, initSteps=2).fit(some).clusterCenters()) if k > 1 else np.array([r.features.toArray() for r in some.limit(1).collect()])
    else:
        first = rows.first()
        centres = np.zeros((1, len(first.vector) if first else 1))
    codes = written(rows.mapInArrow(_coded(centres), "cell int, id long, scale double, code binary, lost double, far double"), "codes")
    radius, size = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64)
    for r in codes.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # CELLS rows and one
        radius[r.cell], size[r.cell] = r.far, r.n
    return Index(codes, rows, Shape(centres, radius, size, 1 + size // GROUP))


def _cells(shape: Shape, k: int, first: bool):
    """Of each query the cells to read, with its distance to their centres: the nearest, or all within the distance of its k-th."""
    centres, radius, size, parts = shape.centres, shape.radius, shape.size, shape.parts

    def run(batches):
        for batch in batches:
            unit, none = _units(batch.column("query"))
            away = np.sqrt(np.maximum(0, (unit**2).sum(1)[:, None] - 2 * unit @ centres.T + (centres**2).sum(1)))
            low = np.maximum(0, away - radius[: len(centres)])
            low = np.concatenate([np.where(none[:, None], 0, low), np.full((len(unit), 1), 0 if first else 0.0)], axis=1)
            away = np.concatenate([away, np.zeros((len(unit), 1))], axis=1)
            out = [[], [], []]
            for q in range(len(unit)):
                if first:
                    order = np.argsort(away[q, :-1], kind="stable")
                    enough = int(np.searchsorted(np.cumsum(size[order]), k)) + 1
                    some = [*order[: max(PROBES, enough)], len(centres)]
                else:
                    some = np.flatnonzero(low[q] <= batch.column("limit")[q].as_py())
                for c in some:
                    if size[c]:
                        for p in range(parts[c]):
                            for column, x in zip(out, (q, c, p), strict=True):
                                column.append(x)
            at = pa.array(out[0], pa.int64())
            limit = [batch.column("limit").take(at)] if not first else []
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("query").take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), *limit], ["query_id", "query", "cell", "part", *(["limit"] if not first else [])])

    return run


def _bounds(centres: np.ndarray, k: int, first: bool):
    """Cogrouped queries and codes of a part of a cell: the k least upper bounds of each query, or what may be among its k nearest."""
    def run(asked: pa.Table, codes: pa.Table) -> pa.Table:
        out = [[], []]
        if asked.num_rows and codes.num_rows:
            unit, none = _units(asked["query"])
            cell = codes["cell"][0].as_py()
            lost, ids = codes["lost"].to_numpy(), codes["id"].to_numpy()
            if cell < len(centres):
                near = centres[cell] + codes["scale"].to_numpy()[:, None] * np.frombuffer(b"".join(codes["code"].to_pylist()), np.int8).reshape(len(ids), -1)
            for at in range(0, len(unit), STEP):
                q = slice(at, at + STEP)
                if cell < len(centres):
                    away = np.sqrt(np.maximum(0, (unit[q] ** 2).sum(1)[:, None] - 2 * unit[q] @ near.T + (near**2).sum(1)))
                    away = np.where(none[q][:, None], math.sqrt(2), away)
                    slack = np.where(none[q][:, None], 0, lost[None, :])
                else:  # a cosine of 0 is a distance of sqrt(2)
                    away, slack = np.full((len(unit[q]), len(ids)), math.sqrt(2)), np.zeros((1, len(ids)))
                for row, name in enumerate(asked["query_id"][at : at + STEP].to_pylist()):
                    if first:
                        upper = np.sort(away[row] + slack[min(row, len(slack) - 1)])[:k]
                        out[0] += [name] * len(upper)
                        out[1] += upper.tolist()
                    else:
                        kept = ids[away[row] - slack[min(row, len(slack) - 1)] <= asked["limit"][at + row].as_py()]
                        out[0] += [name] * len(kept)
                        out[1] += kept.tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64() if first else pa.int64())], ["query_id", "upper" if first else "id"])

    return run


def search(index: Index, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The k vectors with the highest cosine (rounded to six digits, ties by key) of each query (query_id long, query): query_id, id, score;
    the same rows as from comparing all. And of each query what was read: cells, of how many, vectors compared exactly."""
    if not index.shape.size.sum():
        none = queries.select(F.col("query_id").cast("long").alias("query_id"))
        return none.limit(0).select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")), none.select("query_id", F.lit(0).alias("cells_read"), F.lit(0).alias("cells"), F.lit(0).cast("long").alias("compared"))
    asked = written(queries.filter("query is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")), "asked")
    codes = index.codes.withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(int(p)) for p in index.shape.parts]), F.col("cell") + 1)).cast("int"))
    kind = "query_id long, query array<double>, cell int, part int"
    first, second = _bounds(index.shape.centres, k, True), _bounds(index.shape.centres, k, False)
    near = asked.mapInArrow(_cells(index.shape, k, True), kind)
    upper = near.groupBy("cell", "part").cogroup(codes.groupBy("cell", "part")).applyInArrow(lambda a, b: first(a, b), "query_id long, upper double")
    # The k-th least of what the groups sent: k a group at most.
    kth = upper.groupBy("query_id").agg(F.sort_array(F.collect_list("upper")).alias("u")).select("query_id", F.coalesce(F.get("u", F.lit(k - 1)), F.lit(2.0)).alias("kth"))
    limited = written(asked.join(kth, "query_id").select("query_id", "query", F.sqrt(F.col("kth") * F.col("kth") + SLACK).alias("limit")), "limits")
    wide = written(limited.mapInArrow(_cells(index.shape, k, False), f"{kind}, limit double"), "cells")
    kept = wide.groupBy("cell", "part").cogroup(codes.groupBy("cell", "part")).applyInArrow(lambda a, b: second(a, b), "query_id long, id long")
    kept = written(kept, "kept")
    scored = kept.join(index.vectors, "id").join(asked, "query_id").select("query_id", "id", F.round(F.coalesce(T.cosine("vector", "query"), F.lit(0.0)), 6).alias("score"))
    read = wide.groupBy("query_id").agg(F.count_distinct("cell").cast("int").alias("cells_read"))
    compared = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("compared"))
    report = read.join(compared, "query_id", "left").select("query_id", "cells_read", F.lit(int((index.shape.size > 0).sum())).alias("cells"), F.coalesce("compared", F.lit(0)).alias("compared"))
    return best(scored, "query_id", "score", "id", k), report
