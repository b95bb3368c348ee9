"""Nearest neighbours by a block matrix join (operator 9).

Vectors are coded to int8 with a scale each and packed into blocks. Every block of queries meets every group of
candidate blocks in a cell; a cell streams its candidate blocks past its query block. The product of int8 codes
gives each inner product to within an error bound; only pairs that can still enter a query's best k are computed
anew in double precision, and heaps merge them, first within a cell and then over cells.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no
part; a query never finds its own id; fewer candidates than k are all returned; ties go to the smaller id; repeated
rows of one id are candidates each, and of repeated ids the least vector is the query; an empty table gives no rows; vectors
of another length than the most common one (of equally common ones the longest) take no part.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

QUERY_EVERY, K = 20, 20
#: Vectors of a block of queries and of candidates: what a task holds at a time.
QUERY_BLOCK, BLOCK = 4_096, 2_048
#: Candidate blocks that meet a query block in one cell.
GROUP_BLOCKS = 8


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def pack(batches):
    """Sorted by block: one row a block, its ids and vectors as bytes."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    open_ = None

    def out():
        ids = np.concatenate([x for x, _ in held])
        vectors = np.concatenate([x for _, x in held])
        return pa.RecordBatch.from_arrays([pa.array([open_], pa.int64()), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], names=["block", "ids", "vectors"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        ids = batch.column(1).to_numpy()
        values = batch.column(2)
        vectors = values.flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if open_ is not None and open_ != blocks[a]:
                yield out()
                held = []
            open_ = int(blocks[a])
            held.append((ids[a:b].copy(), vectors[a:b].copy()))
    if held:
        yield out()


def blocks(rows: DataFrame, n: int, size: int) -> DataFrame:
    count = max(1, math.ceil(n / size))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(count)).alias("block"), "id", "v")
    return dealt.repartition("block").sortWithinPartitions("block", "id").mapInArrow(pack, "block long, ids binary, vectors binary")


class Coded:
    """int8 codes with a scale each, and what they lose: |x - scale * code|."""

    def __init__(self, ids: bytes, vectors: bytes):
        import numpy as np

        self.ids = np.frombuffer(ids, "<i8")
        self.x = np.frombuffer(vectors, "<f8").reshape(len(self.ids), -1)
        self.scale = np.abs(self.x).max(axis=1) / 127
        codes = np.rint(self.x / self.scale[:, None]).astype(np.int8)
        self.lost = np.linalg.norm(self.x - codes * self.scale[:, None], axis=1)
        self.norm = np.linalg.norm(self.x, axis=1)
        # Products of int8 codes are whole numbers below 2^24 for up to 1040 dimensions, so single precision sums them exactly.
        self.codes = codes.astype(np.float32 if self.x.shape[1] <= 1040 else np.float64)


def cells(k: int):
    """Over rows sorted by cell, the queries' blocks first: each query's best k of the cell's candidates."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cell, query, best = None, None, []

        def done():
            rows = [(int(query.ids[i]), -d, -s) for i, heap in enumerate(best) for s, d in heap]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([-x for x in cols[2]], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for c, g, kind, ids, vectors in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if cell != (c, g):
                    if query is not None:
                        yield done()
                    cell, query, best = (c, g), None, []
                block = Coded(ids, vectors)
                if kind == 0:
                    query, best = block, [[] for _ in block.ids]
                    floor = np.full(len(block.ids), -np.inf)
                    continue
                if query is None:
                    continue
                near = (query.codes @ block.codes.T).astype(np.float64) * query.scale[:, None] * block.scale[None, :]
                bound = query.lost[:, None] * block.norm[None, :] + (query.norm + query.lost)[:, None] * block.lost[None, :] + 1e-12 * query.norm[:, None] * block.norm[None, :]
                if len(block.ids) >= k:
                    low = np.where(query.ids[:, None] == block.ids[None, :], -np.inf, near - bound)
                    floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
                at, of = np.nonzero(near + bound >= floor[:, None])
                other = query.ids[at] != block.ids[of]
                at, of = at[other], of[other]
                for a in range(0, len(at), 65_536):
                    i, j = at[a : a + 65_536], of[a : a + 65_536]
                    score = np.cumsum(query.x[i] * block.x[j], axis=1)[:, -1]  # added up from the left, as SQL does
                    for q, d, s in zip(i.tolist(), block.ids[j].tolist(), score.tolist(), strict=True):
                        heap = best[q]
                        if len(heap) < k:
                            heapq.heappush(heap, (s, -d))
                        elif (s, -d) > heap[0]:
                            heapq.heapreplace(heap, (s, -d))
                full = [i for i, h in enumerate(best) if len(h) == k]
                floor[full] = np.maximum(floor[full], [best[i][0][0] for i in full])
        if query is not None:
            yield done()

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """queries and candidates: rows (id, v) of `usable`. Rows (query_id, rank, vec_id, score)."""
    sizes = [(r["count"], r["n"]) for r in candidates.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()]
    nc, length = sizes[0] if sizes else (0, 0)
    candidates = candidates.where(F.size("v") == length)
    queries = queries.where(F.size("v") == length).groupBy("id").agg(F.min("v").alias("v"))
    nq = queries.count()
    groups = max(1, math.ceil(nc / (BLOCK * GROUP_BLOCKS)))
    q_blocks = max(1, math.ceil(nq / QUERY_BLOCK))
    q = blocks(queries, nq, QUERY_BLOCK).select(F.col("block").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(0).alias("kind"), "ids", "vectors")
    d = blocks(candidates, nc, BLOCK).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("c"), F.pmod("block", F.lit(groups)).cast("int").alias("g"), F.lit(1).alias("kind"), "ids", "vectors")
    met = q.union(d).repartition("c", "g").sortWithinPartitions("c", "g", "kind")
    found = met.mapInArrow(cells(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(rows.where(F.pmod("id", F.lit(QUERY_EVERY)) == 0), rows)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_reduce(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2]), lambda x, y: x + y) AS score FROM f q JOIN f d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
