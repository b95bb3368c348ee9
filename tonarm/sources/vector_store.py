"""A store of vectors clustered by direction, with bounds by file, and an exact search that reads as few files as it can.

Every vector belongs to its nearest pivot (the largest inner product of unit vectors). Files hold vectors of one pivot in
order of their angle to it, so a file is a ring around its pivot: the manifest has each file's least and greatest angle, norms
and number of rows. A prompt at angle a from the pivot is no nearer than max(0, a - greatest, least - a) to any vector of
the file, and the cosine of that bounds their scores. A search reads files in order of their bounds, in waves that
double, and stops when the next bound is below the nth best score found: the result is that of a full scan.

Vectors that have no direction or no pivot of their size keep to files of their own: null ones, and those that hold a null
or no finite number, are read only if fewer than n others are there (they come last, without a score), zero ones have the
bound 0, other sizes the bound 1. A store can
be appended to: each append is a folder of files and a part of the manifest, under the pivots chosen at first.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonarm.functions.vectors import doubles, l2_normalize, norm
from tonarm.operators.retrieval import SHORTLIST, _score

#: Pivots, chosen by hash among so many vectors for each (a list of 8 MB at 1,024 numbers), and rounds that move them to their clusters' means.
MAX_PIVOTS, ROUNDS = 1_024, 2
#: Bytes of a file, about.
FILE_BYTES = 128 << 20
NULL, ZERO, OTHER = -1, -2, -3
#: Room for rounding in angles and scores.
EPS = 1e-9


def _assign(df: DataFrame, pivots) -> DataFrame:
    """df (index, embedding) with cluster, angle and norm; pivots: a broadcast array of unit vectors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        p = pivots.value
        for batch in batches:
            column, n = batch.column(1), batch.num_rows
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(n), sizes)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            fine = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(owner, ~np.isfinite(values), n) == 0)
            length = np.where(fine, np.sqrt(np.bincount(owner, np.where(np.isfinite(values), values, 0) ** 2, n)), 0)
            cluster, angle = np.where(fine, np.where(length > 1e-12, OTHER, ZERO), NULL), np.zeros(n)
            fit = np.flatnonzero((cluster == OTHER) & (sizes == p.shape[1])) if len(p) else ()
            for at in range(0, len(fit), 4_096):
                i = fit[at : at + 4_096]
                x = values[starts[i][:, None] + np.arange(p.shape[1])] / length[i][:, None]
                near = (x @ p.T).argmax(axis=1)
                # By the chord, for the arc of a cosine near one has few digits.
                cluster[i], angle[i] = near, 2 * np.arcsin(np.minimum(1, np.linalg.norm(x - p[near], axis=1) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(angle), pa.array(length)], names=["index", "embedding", "cluster", "angle", "norm"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, cluster int, angle double, norm double")


def _choose(df: DataFrame, k: int):
    """k unit vectors: those of the smallest hashes, moved to the means of their clusters."""
    import numpy as np

    spark = df.sparkSession
    some = df.withColumn("_n", norm(F.col("embedding"))).where("_n > 1e-12 AND _n < double('inf')")
    sizes = some.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0))
    own = some.where(F.size("embedding") == sizes[0]["size"])
    first = own.orderBy(F.xxhash64("index"), "index").limit(k).select(l2_normalize(F.col("embedding")).alias("u")).collect()
    pivots = np.unique(np.array([r["u"] for r in first], float), axis=0)
    for _ in range(ROUNDS):
        dealt = _assign(own.select("index", "embedding"), spark.sparkContext.broadcast(pivots)).where("cluster >= 0")
        unit = F.transform(doubles(F.col("embedding")), lambda x: x / F.col("norm"))
        # One row for each number of each pivot: partial sums in the tasks, k times the size in all.
        sums = dealt.select("cluster", F.posexplode(unit).alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x")).toArrow()
        cluster, at, x = (sums[c].to_numpy() for c in ("cluster", "at", "x"))
        moved = pivots.copy()
        moved[cluster, at] = x
        lengths = np.linalg.norm(moved, axis=1)
        pivots = np.where(lengths[:, None] > 1e-12, moved / np.maximum(lengths, 1e-12)[:, None], pivots)
    return pivots


def write_clustered(df: DataFrame, path: str, pivots: int | None = None, files: int | None = None) -> None:
    """Writes a new store of df (index, embedding): about sqrt(rows) / 2 pivots, MAX_PIVOTS at most, unless told."""
    df = df.select(F.col("index").cast("long").alias("index"), "embedding")
    n = df.count()
    chosen = _choose(df, min(MAX_PIVOTS, pivots or math.isqrt(n) // 2 + 1))
    df.sparkSession.createDataFrame(list(enumerate(chosen.tolist())), "cluster int, pivot array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    append_clustered(df, path, files)


def append_clustered(df: DataFrame, path: str, files: int | None = None) -> None:
    """Adds df's vectors to the store: files dealt by pivot and angle, of about FILE_BYTES each, then their bounds."""
    import numpy as np

    spark = df.sparkSession
    rows = spark.read.parquet(f"{path}/pivots").orderBy("cluster").collect()  # MAX_PIVOTS at most
    pivots = np.array([r["pivot"] for r in rows], float) if rows else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast(pivots)
    dealt = _assign(df.select(F.col("index").cast("long").alias("index"), "embedding"), sent)
    if files is None:
        size = df.agg(F.sum(F.size("embedding").cast("long") * 4)).first()[0] or 0
        files = max(1, len(rows), size // FILE_BYTES)
    folder = f"{path}/data/{uuid.uuid4().hex}"
    dealt.repartitionByRange(int(files), "cluster", "angle").sortWithinPartitions("cluster", "angle").write.partitionBy("cluster").parquet(folder)
    there = spark.read.schema("index long, norm double, angle double, cluster int").parquet(folder)
    bounds = there.groupBy("cluster", F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows"), F.min("angle").alias("least"), F.max("angle").alias("most"), F.min("norm").alias("least_norm"), F.max("norm").alias("most_norm")
    )
    bounds.write.mode("append").parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (cluster, file, rows, least, most, least_norm, most_norm), one for each file."""
    return spark.read.parquet(f"{path}/manifest")


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """All rows (index, embedding) of the appends that the manifest names, so of none that was broken off."""
    folders = [r["at"] for r in read_manifest(spark, path).select(_folder().alias("at")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], "index long, embedding array<double>")
    return spark.read.option("recursiveFileLookup", True).parquet(*folders).select("index", "embedding")


def _folder():
    return F.regexp_extract("file", r"^(.*/data/[^/]+)/", 1)


def file_bounds(spark: SparkSession, path: str, prompt: list[float]) -> list[tuple[float, int, str, int]]:
    """(bound, cluster, file, rows) of each file, the greatest bound first; null vectors have none."""
    import numpy as np

    q = np.array(prompt, float)
    pivots = spark.read.parquet(f"{path}/pivots").orderBy("cluster").collect()
    p = np.array([r["pivot"] for r in pivots], float) if pivots else np.zeros((0, 0))
    fit = np.zeros(p.shape[1])
    fit[: min(len(fit), len(q))] = q[: len(fit)]
    length = np.linalg.norm(fit)
    if length > 1e-12:
        # A chord's arc is as sure near 0 as elsewhere; an opposite prompt is as sure as float allows.
        angles = 2 * np.arcsin(np.minimum(1, np.linalg.norm(p - fit / length, axis=1) / 2))
    out = []
    for r in read_manifest(spark, path).collect():  # a row for each file, which the scan's own listing keeps on the driver too
        c = r["cluster"]
        if c == OTHER:
            bound = 1.0
        elif c < 0 or length <= 1e-12:
            bound = -math.inf if c == NULL else 0.0
        else:
            bound = math.cos(min(math.pi, max(0.0, angles[c] - r["most"] - EPS, r["least"] - angles[c] - EPS)))
        out.append((bound, c, r["file"], r["rows"]))
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))


def search_clustered(spark: SparkSession, path: str, prompt: DataFrame, n: int = SHORTLIST, wave: int | None = None) -> tuple[DataFrame, dict]:
    """Rows (index, score), the n best for one prompt row (embedding), as `shortlist` gives them over all vectors, and a report:
    files and rows in the store, files and rows read, waves."""
    rows = prompt.select("embedding").limit(1).collect()
    asked = rows[0]["embedding"] if rows else None
    kind = "index long, score double"
    if asked is None:
        return spark.createDataFrame([], kind), {"files": 0, "rows": 0, "files_read": 0, "rows_read": 0, "waves": 0}
    files = file_bounds(spark, path, asked)
    one = spark.createDataFrame([(list(map(float, asked)),)], "embedding array<double>")
    report = {"files": len(files), "rows": sum(f[3] for f in files), "files_read": 0, "rows_read": 0, "waves": 0}
    best: list[tuple[float | None, int]] = []
    at, step = 0, wave or spark.sparkContext.defaultParallelism
    while at < len(files):
        least = best[-1][0] if len(best) == n else None
        some = [f for f in files[at : at + step] if least is None or f[0] >= least - EPS]
        if not some:
            break
        vectors = spark.read.parquet(*[f[2] for f in some]).select("index", "embedding")
        score = F.when(~F.isnan("score"), F.col("score")).alias("score")
        found = _score(vectors, one).select("index", score).orderBy(F.desc_nulls_last("score"), "index").limit(n).collect()
        best = sorted(best + [(r["score"], r["index"]) for r in found], key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))[:n]
        report["files_read"] += len(some)
        report["rows_read"] += sum(f[3] for f in some)
        report["waves"] += 1
        at, step = at + step, 2 * step
    return spark.createDataFrame([(i, s) for s, i in best], kind), report
