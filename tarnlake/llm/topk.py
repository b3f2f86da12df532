"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors are cut into blocks. In a block each dimension is a posting list ordered by impact (the component's value) and
cut into segments at quantised impacts. For a query, segments of all dimensions are processed by descending
contribution (query component times impact); each adds to the accumulators of its vectors. A vector's score is at most
its accumulator plus the highest contribution left for each dimension in which it hasn't been met. Processing stops only
when exact scores found so far prove that few vectors can still be members; those are rescored exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.store import Scratch, saved

#: Vectors of a block, and queries at most that go to a block together.
BLOCK, QUERIES = 16384, 16384
#: Components within a step of this many share a segment.
STEP = 4
#: Contributions, in typical ones, down to which each round goes; the last round takes all.
ROUNDS = (0.5, -0.4, -0.7, -1.1, -1.6)


class ImpactIndex:
    """The postings of one block of integer vectors. `processed` counts the postings that searches have processed, `all`
    those that they had before them, and `unproved` the searches that had to score every vector.

    Impacts may be of any size: segments are those quantised impacts that occur. Scores must fit 64 bits.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(values[order].astype(np.int64))
        n, self.dims = self.values.shape
        columns = np.ascontiguousarray(self.values.T)
        self.postings = np.argsort(columns, 1, kind="stable")  # from the lowest impact
        self.impacts = np.take_along_axis(columns, self.postings, 1)
        self.largest = int(np.abs(self.values).max(initial=0))
        self.typical = self._typical(self.values)
        self.span = 2 * (self.largest + STEP) + 1
        self.keyed = (self.impacts + np.arange(self.dims)[:, None] * self.span).ravel()  # one sorted row, to find places in many dimensions at once
        self.processed = self.all = self.unproved = 0

    @staticmethod
    def _typical(x: np.ndarray) -> float:
        """A usual size, which a few outliers don't change."""
        size = np.abs(x)
        return 1.5 * float(np.median(size)) or float(np.sqrt((size.astype(float) ** 2).mean())) if x.size else 0.0

    def _rescored(self, on: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.values[on] @ q
        best = np.lexsort((self.ids[on], -score))[:k]
        return self.ids[on[best]], score[best]

    def search(self, q: np.ndarray, k: int, skip: int | None = None, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best, ties to the smaller id; vectors with the id `skip` are left out. With
        `floor`, a score that k vectors elsewhere have reached, only vectors that reach it, too, need be found."""
        n, q = len(self.ids), q.astype(np.int64)
        shift = int(self.dims).bit_length()
        lost = np.flatnonzero(self.ids == skip) if skip is not None else np.zeros(0, np.int64)
        dims = np.flatnonzero(q)
        many, enough = n - len(lost), max(4 * k, n // 10)
        if many <= enough or not len(dims):
            return self._rescored(np.setdiff1d(np.arange(n), lost), q, k)
        narrow = (self.largest * int(np.abs(q).max()) * self.dims + 1) << shift < 2**62
        acc, met = np.zeros(n, np.int64), np.zeros(0 if narrow else n, np.int64)  # if narrow, dimensions met are counted in the low bits
        up = q[dims] > 0
        at = np.where(up, n, 0)  # postings still to come: below `at` where the component is positive, else from it on
        scale = self.typical * self._typical(q[dims])
        self.all += n * len(dims)
        for t in ROUNDS:
            bound = int(np.floor(t * scale))
            # every segment whose highest contribution is above `bound` is processed now
            edge = np.where(up, np.floor_divide(np.floor_divide(bound, q[dims]) + 1, STEP) * STEP, (np.floor_divide(-np.floor_divide(-bound, q[dims]), STEP) + 1) * STEP)
            to = np.searchsorted(self.keyed, np.clip(edge, -self.largest, self.largest + 1) + dims * self.span) - dims * n
            low, high = np.where(up, to, at), np.where(up, at, to)
            for i in np.flatnonzero(high > low).tolist():
                d, a, b = dims[i], low[i], high[i]
                rows, here = self.postings[d, a:b], self.impacts[d, a:b]
                if narrow:
                    acc[rows] += here * (q[d] << shift) + 1
                else:
                    acc[rows] += here * q[d]
                    met[rows] += 1
            self.processed += int(np.maximum(high - low, 0).sum())
            at = np.where(high > low, to, at)
            if t > 0:
                continue
            # what isn't met contributes `bound` at most
            most = (acc >> shift) + (len(dims) - (acc & ((1 << shift) - 1))) * bound if narrow else acc + (len(dims) - met) * bound
            most[lost] = np.iinfo(np.int64).min
            near = np.argpartition(most, n - 4 * k)[n - 4 * k :]
            near = near[most[near] > np.iinfo(np.int64).min]
            _, score = self._rescored(near, q, k)
            least = max([x for x in (int(score[-1]) if len(score) == k else None, floor) if x is not None], default=None)
            if least is not None:
                may = np.flatnonzero(most >= least)
                if len(may) <= enough:
                    return self._rescored(may, q, k)
        self.unproved += 1
        return self._rescored(np.setdiff1d(np.arange(n), lost), q, k)


def usable(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _searcher(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        rows: list[np.ndarray] = []
        if queries.num_rows and vectors.num_rows:
            index = ImpactIndex(vectors["id"].to_numpy(), _matrix(vectors["v"]))
            for i, q, floor in zip(queries["ask_id"].to_numpy(), _matrix(queries["ask_v"]), queries["floor"].to_pylist(), strict=True):
                ids, score = index.search(q, k, i, floor)
                rows.append(np.stack([np.full(len(ids), i), ids, score], 1))
        out = np.concatenate([np.zeros((0, 3), np.int64), *rows])
        return pa.table({"query_id": out[:, 0], "vec_id": out[:, 1], "score": out[:, 2]})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` highest inner products of floor(scale * component) for each row
    that `is_query` marks, against all rows but those with the query's id; all, if fewer; ties to the smaller id.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id; vectors
    of another length than the query's are no candidates. An id that occurs in several rows is several candidates with
    that id, and one query (its lowest vector) if it is one. An empty table gives an empty result.

    Components may be of any size as long as scores fit 64 bits. Each block of queries goes to each block of vectors, as
    rows of a bounded group; at most k rows a query come out of a pair of blocks. The first block of vectors is searched
    before the others, which get each query's k-th score from it as a floor.
    """
    scratch = Scratch()
    good = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("ask"))
    good = scratch(good.withColumn("dims", F.size("v")))
    asked = good.where("ask").groupBy("id", "dims").agg(F.min("v").alias("v"))
    sizes = good.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ask").cast("int")).alias("asks"))
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    parts = F.ceil(F.col("n") / block).cast("int")
    sizes = sizes.where("asks > 0").select("dims", parts.alias("parts"), F.greatest(F.ceil(F.col("asks") / queries), F.least(F.lit(slots).cast("long"), F.ceil(F.col("asks") / 256))).cast("int").alias("groups"))
    place = F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    held = scratch(good.join(sizes, "dims").select("dims", "id", "v", place.cast("int").alias("part"), "groups"))
    asked = scratch(asked.join(sizes, "dims").select(F.col("dims").alias("ask_dims"), F.col("id").alias("ask_id"), F.col("v").alias("ask_v"), "parts", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("ask_group")))

    def found(first: bool, asked: DataFrame) -> DataFrame:
        mine = held.where((F.col("part") == 0) if first else (F.col("part") > 0)).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        parts = F.array(F.lit(0)) if first else F.sequence(F.lit(1), F.col("parts") - 1)
        asked = asked if first else asked.where("parts > 1")
        asked = asked.withColumn("ask_part", F.explode(parts))
        both = asked.groupBy("ask_dims", "ask_part", "ask_group").cogroup(mine.groupBy("dims", "part", "group"))
        return scratch(both.applyInArrow(_searcher(k), "query_id long, vec_id long, score long"))

    begun = found(True, asked.withColumn("floor", F.lit(None).cast("long")))
    floors = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("many"), F.min("score").alias("floor")).where(F.col("many") >= k).select("query_id", "floor")
    rest = found(False, asked.join(floors, F.col("ask_id") == F.col("query_id"), "left").drop("query_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = begun.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = saved(out)
    scratch.clear()
    return out
