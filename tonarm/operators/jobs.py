"""Jobs around a model that the caller passes in: batches, errors of single rows, and what is done already.

A model is a function of a list that returns a list of as many results; it is made once a task by `make()`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tonarm.sources.checkpoint import Checkpoint
from tonarm.storage import step, stored


def run_model(df: DataFrame, key: str, column: str, make: Callable[[], Callable], result: str, batch: int) -> DataFrame:
    """Rows (key, result, status, error): a batch that fails is tried row by row, a row that fails gets `failed`. result is a DDL type.

    A task's Python holds the values of one batch; the rows that Spark hands over at once stay Arrow's.
    """
    kind, kind_of_result = df.schema[key].dataType.simpleString(), DataType.fromDDL(result)

    def run(blocks):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        model, made = make(), to_arrow_type(kind_of_result)
        for block in blocks:
            for at in range(0, block.num_rows, batch):
                part = block.slice(at, batch)
                values = part.column(1).to_pylist()
                try:
                    got = list(model(values))
                    if len(got) != len(values):
                        raise ValueError(f"{len(got)} results for {len(values)} rows")
                    rows = [(x, "ok", None) for x in got]
                except Exception:
                    rows = []
                    for v in values:
                        try:
                            (x,) = model([v])
                            rows.append((x, "ok", None))
                        except Exception as e:
                            rows.append((None, "failed", f"{type(e).__name__}: {e}"))
                # As of pandas' columns: NaN is null.
                results = pa.array([r[0] for r in rows], made, from_pandas=True)
                said = [pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), results, *said], [key, "result", "status", "error"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, result {result}, status string, error string")


def embed_texts(df: DataFrame, key: str, text: str, make, batch: int = 128) -> DataFrame:
    """Rows (key, embedding, status, error), embeddings of length one."""
    from tonarm.functions.vectors import l2_normalize

    made = run_model(df, key, text, make, "array<double>", batch)
    return made.select(key, l2_normalize(F.col("result")).cast("array<float>").alias("embedding"), "status", "error")


def embed_audio(resolved: DataFrame, processed: DataFrame, make, batch: int = 32) -> DataFrame:
    """Only resolved rows that are not processed yet; rows (index, embedding, status, error)."""
    todo = resolved.where(F.col("resolved_path").isNotNull()).join(processed, "index", "left_anti")
    return embed_texts(todo, "index", "resolved_path", make, batch)


def caption(tracks: DataFrame, done: DataFrame, make, batch: int = 2, retry_empty: bool = False) -> DataFrame:
    """New captions (track_id, caption): a repeated id is done once, its least path counts; a failed one is empty and, unless retry_empty, done."""
    did = done.where("caption <> ''") if retry_empty else done
    todo = tracks.groupBy("track_id").agg(F.min("path").alias("path")).join(did, "track_id", "left_anti")
    made = run_model(todo, "track_id", "path", make, "string", batch)
    return made.select("track_id", F.coalesce("result", F.lit("")).alias("caption"))


class ResumableJob:
    """A model's results by key in a folder, written slice by slice, and taken up again where the last run ended.

    Every row that was tried stands in the checkpoint (key, status, error, result): `ok` rows are the job's results, `failed` ones
    its dead letters. A slice is computed once, stored, and counts from its commit on; a run that dies in the middle leaves the
    slices before it. The next run computes only keys that are not there, and the dead letters too if it is told so. Ranges
    that grew are merged as the job goes on.
    """

    def __init__(self, spark, folder: str, key: str, key_type: str, result: str):
        self.spark, self.key, self.result = spark, key, result
        # Of two rows of a key the greater counts: `ok` before `failed`.
        self.checkpoint = Checkpoint(spark, folder, key, f"`{key}` {key_type}, status string, error string, result {result}")

    def run(self, df: DataFrame, column: str, make, batch: int, slices: int = 8, retry_failed: bool = False) -> dict:
        """Computes what is left of df (key, column): {"todo", "ok", "failed", "slices"} of this run. Null keys are left out, a repeated key is done once, with its least value."""
        todo = df.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(column).alias(column))
        if retry_failed and self.checkpoint.versions():
            todo = todo.join(self.checkpoint.read().where("status = 'ok'").select(self.key), self.key, "left_anti")
        else:
            todo = self.checkpoint.todo(todo)
        report = {"todo": 0, "ok": 0, "failed": 0, "slices": 0}
        with step(self.spark):
            part = F.pmod(F.xxhash64(self.key), F.lit(slices))
            todo = stored(todo.withColumn("_part", part), "todo")
            for r in todo.groupBy("_part").count().orderBy("_part").collect():  # a row a slice
                made = run_model(todo.where(F.col("_part") == r["_part"]), self.key, column, make, self.result, batch)
                made = stored(made.select(self.key, "status", "error", "result"), "made")
                counts = {x["status"]: x["count"] for x in made.groupBy("status").count().collect()}
                self.checkpoint.append(made, {"rows": r["count"], **counts})
                self.checkpoint.merge()
                report = {"todo": report["todo"] + r["count"], "ok": report["ok"] + counts.get("ok", 0), "failed": report["failed"] + counts.get("failed", 0), "slices": report["slices"] + 1}
        return report

    def results(self) -> DataFrame:
        """Rows (key, result) of what was computed."""
        return self.checkpoint.read().where("status = 'ok'").select(self.key, "result")

    def dead_letters(self) -> DataFrame:
        """Rows (key, error) of what failed."""
        return self.checkpoint.read().where("status = 'failed'").select(self.key, "error")
