"""Helpers shared by the training-data operators: input columns, stored intermediate tables, graph components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonarm.storage import new_path, shared_dir, spread, step, stored

__all__ = ["binary", "components", "held", "make_room", "new_path", "row_key", "semi", "shared_dir", "spread", "step", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def semi(docs: DataFrame, wanted: DataFrame, keys: dict) -> DataFrame:
    """docs' rows whose keys, columns by name in wanted, stand in wanted; nulls are equal."""
    named = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    met = F.lit(True)
    for i, c in enumerate(keys.values()):
        met = met & c.eqNullSafe(F.col(f"_k{i}"))
    return docs.join(named, met, "left_semi")


def row_key(text="text"):
    """With doc_id, tells repeated rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


_held: dict[tuple, object] = {}


def held(key: tuple, make):
    """A table that a Python worker keeps for its next task of the same kind."""
    if key not in _held:
        make_room()
        _held[key] = make()
    return _held[key]


def make_room() -> None:
    """Gives back what tasks of another kind left in this worker: their tables, and memory that Arrow keeps in reserve."""
    import gc

    import pyarrow as pa

    if _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def binary(column):
    """An Arrow string or binary column as Python bytes; null becomes empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long: rows (v, root), root the smallest vertex reachable.

    Alternating large-star and small-star rounds: every round is a partial-aggregated minimum and an
    equi-join, so a vertex with many edges is never gathered into one task. Rounds end when the edge set
    no longer changes, told by its count and a sum of hashes.
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        if small:
            pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        else:
            pairs = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = pairs.join(low, "a")
        kept = met if small else met.where("b > a")
        out = kept.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if small:
            out = out.union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = stored(edges.where("a <> b").distinct(), "edges")
    before = state(pairs)
    while before[0]:
        pairs = stored(star(star(pairs, False), True), "edges")
        if (after := state(pairs)) == before:
            break
        before = after
    return pairs.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root"))
