"""Readers and writers of the catalogue's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("track_id", "artist_id", "album_id", "path", "duration")


def read_tag_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lines of five fields and any number of tags; the header goes, missing fields are null."""
    p = F.split("value", "\t", -1)
    at = [F.try_element_at(p, F.lit(i + 1)) for i in range(5)]
    rows = spark.read.text(path).where(F.coalesce(at[0], F.lit("")) != "TRACK_ID")
    cols = [*(c.alias(n) for c, n in zip(at[:4], FIELDS, strict=False)), at[4].try_cast("double").alias("duration")]
    return rows.select(*cols, F.filter(F.slice(p, 6, F.greatest(F.size(p), F.lit(1))), lambda t: t != "").alias("tags"))


def read_csv(spark: SparkSession, path: str, required=()) -> DataFrame:
    """All columns as text, empty fields as empty text; names trimmed; raises ValueError if a required column is missing."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.strip() for c in df.columns])
    require(df, required)
    return df.na.fill("")


def require(df: DataFrame, columns) -> None:
    if missing := [c for c in columns if c.lower() not in {x.lower() for x in df.columns}]:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def find_column(df: DataFrame, name: str) -> str | None:
    """The column of this name whatever its case and outer blanks."""
    return next((c for c in df.columns if c.strip().lower() == name.lower()), None)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are written as JSON text."""
    arrays = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    df.select(*[F.to_json(c).alias(c) if c in arrays else F.col(c) for c in df.columns]).write.csv(path, header=True, escape='"')


def append_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Appended results, one row a key: of differing ones the greatest, so that a result is preferred to an empty one or null."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*")


def list_files(spark: SparkSession, root: str, pattern: str = "*.mp3") -> DataFrame:
    """Paths of files under root; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path")


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("index", "embedding").write.parquet(path)


def read_vectors(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """Rows (index, embedding) of a store; with an index table (index) one row for each of it, without a vector where none is stored."""
    vectors = spark.read.parquet(path).select("index", "embedding")
    return vectors if index is None else index.select("index").join(vectors, "index", "left")


def write_diagnostics(made: DataFrame, folder: str, missing: DataFrame | None = None) -> None:
    """Of a job's rows (..., status, error): the failed ones as `failed` in JSON and CSV, what could not be found as `missing`, counts by status."""
    failed = made.where("status = 'failed'")
    for name, rows in {"failed": failed, **({"missing": missing} if missing is not None else {})}.items():
        rows.write.json(f"{folder}/{name}.json")
        write_csv(rows, f"{folder}/{name}.csv")
    made.groupBy("status").agg(F.count("*").alias("n")).write.json(f"{folder}/summary.json")
