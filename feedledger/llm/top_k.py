"""Exact top-k inner products by norm buckets (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedledger.llm.worker import ship
from feedledger.operators.ranking import global_rank
from feedledger.session import stage

ship(__name__)

BUCKET = 1024
STRIPE_BUCKETS = 64
COORDINATE_FROM = 0.7  # local cosine threshold from which one coordinate prunes better than length
EXACT = 2.0 ** 52


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def _pack(rows: DataFrame, key: list[str]) -> DataFrame:
    """Blocks of vectors of one dimension: ``key``, ``ids`` and ``data`` (integers as 64-bit floats), longest first.

    A block holds at most ``BUCKET`` vectors by construction of its key.
    """
    def run(table):
        matrix = np.floor(64.0 * np.array(table.column("vector").to_pylist(), np.float64))
        ids = table.column("id").to_numpy()
        order = np.lexsort((ids, -(matrix * matrix).sum(axis=1)))
        values = {c: [table.column(c)[0].as_py()] for c in key}
        return pa.table({**{c: pa.array(v, pa.int64()) for c, v in values.items()},
                         "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
                         "data": pa.array([matrix[order].astype("<f8").tobytes()], pa.binary())})

    schema = ", ".join(f"{c} long" for c in key) + ", ids binary, data binary"
    return rows.select(*[F.col(c).cast("long").alias(c) for c in key], "id", "vector").groupBy(*key).applyInArrow(run, schema)


class Best:
    """The running top ``k`` of a block of queries; equal scores prefer the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score = k, [np.empty(0)] * n
        self.ids = [np.empty(0, np.int64)] * n
        self.limit = np.full(n, -np.inf)

    def offer(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[query], score]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.score[query], self.ids[query] = score[order], ids[order]
        if len(order) == self.k:
            self.limit[query] = score[order[-1]]


def search_bucket(best: Best, queries: np.ndarray, query_ids: np.ndarray, lengths: np.ndarray, bucket: np.ndarray,
                  bucket_ids: np.ndarray, norms: np.ndarray) -> bool:
    """Offers a bucket's vectors to all queries; False when its length rules it out for every one.

    A query's limit over its length and the bucket's greatest length is the cosine a vector
    here must reach. Above 1 nothing can; where it is high, the query's largest coordinate
    bounds that coordinate of any such vector, and only vectors within the bounds are
    verified; otherwise only vectors long enough to reach the limit are. Bounds are widened by
    rounding, so what they leave out cannot qualify.
    """
    slack = 1.0 + 1e-9
    bound = lengths * norms[0] * slack
    alive = np.flatnonzero(bound >= best.limit)
    if not len(alive):
        return False
    cosine = np.divide(best.limit[alive], bound[alive], out=np.full(len(alive), -np.inf), where=bound[alive] > 0)
    by_length = alive[cosine < COORDINATE_FROM]
    if len(by_length):
        need = np.divide(best.limit[by_length], lengths[by_length] * slack, out=np.full(len(by_length), -np.inf), where=lengths[by_length] > 0)
        reach = len(norms) - np.searchsorted(norms[::-1], need.min())
        scores = queries[by_length] @ bucket[:reach].T
        hits = scores >= best.limit[by_length, None]
        for row in np.flatnonzero(hits.any(axis=1)):
            at = np.flatnonzero(hits[row])
            at = at[bucket_ids[at] != query_ids[by_length[row]]]
            best.offer(by_length[row], scores[row, at], bucket_ids[at])
    for query, need in zip(alive[cosine >= COORDINATE_FROM], cosine[cosine >= COORDINATE_FROM], strict=True):
        unit = queries[query] / lengths[query]
        axis = int(np.abs(unit).argmax())
        beside = np.linalg.norm(np.delete(unit, axis))
        spread = np.sqrt(max(0.0, 1.0 - need * need)) * beside + 1e-9
        # An axis within reach of the query, or its opposite end, leaves that side without a bound.
        upper = 1.0 + 1e-9 if unit[axis] >= need else need * unit[axis] + spread
        lower = -1.0 - 1e-9 if unit[axis] <= -need else need * unit[axis] - spread
        own = bucket[:, axis] / np.maximum(norms, 1.0)
        at = np.flatnonzero((own >= lower) & (own <= upper) if need < 1 else norms > 0)
        at = at[bucket_ids[at] != query_ids[query]]
        scores = bucket[at] @ queries[query]
        hits = scores >= best.limit[query]
        if hits.any():
            best.offer(query, scores[hits], bucket_ids[at[hits]])
    return True


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products per query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Components are taken as floor(64 * x). Queries are the usable rows where ``is_query`` holds, candidates
    all other usable rows of the same dimension; fewer than ``k`` candidates give all. Null ids and
    vectors that are null, empty or hold null or non-finite components take no part; equal scores
    rank by smaller id. A query leaves out the candidates of its own id. Scores must fit in 64 bits.

    Vectors are ranked by length and cut into buckets of ``BUCKET``; buckets are dealt to stripes, so each
    stripe has long and short ones. Every block of queries visits every stripe, whose size is
    bounded, goes through its buckets from long to short and stops when none can qualify; the
    stripes' results, ``k`` per query, are then merged.
    """
    spark = vectors.sparkSession
    own = F.col(vector_col)
    usable_rows = (vectors.where(usable(own) & F.col(id_col).isNotNull())
                   .select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"),
                           own.cast("array<double>").alias("vector"), F.size(own).alias("dim")))
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 64).cast("double"), F.lit(2.0)))
    ranked = stage(global_rank(usable_rows.withColumn("longest_first", -size), ["dim", "longest_first", "id"]), "by-length")
    total = ranked.agg(F.max("rank")).first()[0] or 0
    buckets = -(-total // BUCKET)
    stripes = max(1, -(-buckets // STRIPE_BUCKETS), min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bucketed = ranked.withColumn("bucket", F.floor((F.col("rank") - 1) / BUCKET))
    # A bucket at a border between dimensions is packed apart for each of them.
    held = (_pack(bucketed, ["bucket", "dim"]).select("bucket", F.pmod("bucket", F.lit(stripes)).alias("stripe"), "dim", "ids", "data")
            .withColumn("kind", F.lit(0)))
    asked = _pack(bucketed.where("query"), ["bucket", "dim"]).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    blocks = held.unionByName(asked.withColumn("kind", F.lit(1)).select(*held.columns))
    dealt = blocks.repartition(stripes, "stripe").sortWithinPartitions("stripe", "kind", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, mine = None, []
        for batch in batches:
            for at, kind, dim, ids, data in zip(*(batch.column(c) for c in ("stripe", "kind", "dim", "ids", "data")), strict=True):
                if at.as_py() != stripe:
                    stripe, mine = at.as_py(), []
                ids = np.frombuffer(ids.as_py(), "<i8")
                matrix = np.frombuffer(data.as_py(), "<f8").reshape(len(ids), dim.as_py())
                norms = np.sqrt((matrix * matrix).sum(axis=1))
                if kind.as_py() == 0:
                    mine.append((matrix, ids, norms))
                    continue
                best = Best(len(ids), k)
                for bucket, bucket_ids, bucket_norms in mine:
                    if bucket.shape[1] != matrix.shape[1]:
                        continue
                    if norms.max() * bucket_norms[0] >= EXACT:
                        exact = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in bucket] for a in matrix]
                        for q, row in enumerate(exact):
                            others = bucket_ids != ids[q]
                            best.offer(q, np.array(row, object)[others], bucket_ids[others])
                    elif not search_bucket(best, matrix, ids, norms, bucket, bucket_ids, bucket_norms):
                        break
                found = [len(s) for s in best.score]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, found)), pa.array(np.concatenate(best.ids)),
                     pa.array([int(s) for own in best.score for s in own], pa.int64())], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
