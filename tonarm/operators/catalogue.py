"""Joins of the catalogue: tags, captions, files and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonarm.functions.text import path_candidates
from tonarm.storage import stored


def enrich(left: DataFrame, right: DataFrame, key: str, column: str, name: str | None = None) -> DataFrame:
    """One column of right by key; unmatched is null, repeats on the right multiply rows."""
    return left.join(right.select(key, F.col(column).alias(name or column)), key, "left")


def merge_captions(meta: DataFrame, captions: DataFrame, key: str) -> DataFrame:
    """Left join; columns of captions that meta has too get `_cap`, and a missing caption is empty."""
    clash = {c: f"{c}_cap" for c in captions.columns if c != key and c in meta.columns}
    met = meta.join(captions.withColumnsRenamed(clash), key, "left")
    return met.withColumn("caption", F.coalesce("caption", F.lit("")) if "caption" in met.columns else F.lit(""))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows of left with a key in right, and right's distinct keys."""
    inside = left.join(right, key, "left_semi").agg(F.count("*").alias("rows_inside"))
    return inside.crossJoin(right.agg(F.count_distinct(key).alias("keys")))  # one row each


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def done(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_semi")


def file_counts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """One row: rows, distinct paths named by rows, distinct files, files that no row names."""
    extra = files.select("path").distinct().join(rows, "path", "left_anti").agg(F.count("*").alias("extra_files"))
    named = rows.agg(F.count("*").alias("rows_total"), F.count_distinct("path").alias("paths_named"))
    return named.crossJoin(files.agg(F.count_distinct("path").alias("files_total"))).crossJoin(extra)  # one row each


def normalize_path(c):
    return F.replace(c, F.lit("\\"), F.lit("/"))


def meta_index(df: DataFrame, order: str) -> DataFrame:
    """A dense index from 0 in the order of a column: a range sort, stored, then positions by partition; no single task.

    Ties go by the other columns, so equal rows alone are interchangeable.
    """
    rest = [c for c in df.columns if c != order]
    sorted_ = stored(df.orderBy(order, *rest).withColumn("_at", F.monotonically_increasing_id()), "index")
    part = F.shiftright("_at", 33)  # the number of the partition; below it the place there
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = counts.select("_part", F.coalesce(upto, F.lit(0)).alias("_start"))
    met = sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return met.select((F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("index"), *df.columns)


def resolve_paths(tracks: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """tracks (index, track_id, path, numeric) with resolved_path and matched_candidate_index, -1 for none: one equi-join over listed files."""
    guesses = tracks.select("*", path_candidates(root, F.col("path"), F.col("numeric")).alias("path_guesses"))
    each = guesses.select("index", F.posexplode("path_guesses").alias("pos", "guess"))
    hits = each.join(files.select(F.col("path").alias("guess")).distinct(), "guess").groupBy("index").agg(F.min_by("guess", "pos").alias("resolved_path"), F.min("pos").alias("pos"))
    return guesses.join(hits, "index", "left").withColumn("matched_candidate_index", F.coalesce("pos", F.lit(-1))).drop("pos")


def run_summary(status: DataFrame) -> DataFrame:
    """status: rows (resolved_path, processed). One row of totals."""
    found, did = F.col("resolved_path").isNotNull(), F.coalesce("processed", F.lit(False))
    return status.agg(F.count("*").alias("total"), F.count_if(found).alias("resolved"), F.count_if(~found).alias("missing"), F.count_if(found & did).alias("processed"), F.count_if(found & ~did).alias("unprocessed"))


def segment_bounds(frames, rate, portion: float = 0.30, max_seconds: float = 10.0):
    """struct<start, length, is_silence> of a recording's middle segment; an empty one is a second of silence."""
    size = F.floor(F.least(frames * F.lit(float(portion)), rate * F.lit(float(max_seconds)))).cast("long")
    start = F.greatest(F.lit(0).cast("long"), F.floor((frames - size) / 2).cast("long"))
    empty = size <= 0
    return F.struct(start.alias("start"), F.when(empty, rate.cast("long")).otherwise(size).alias("length"), empty.alias("is_silence"))
