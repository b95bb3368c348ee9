"""Bucketed tables, checkpoints and resumable jobs."""

import subprocess
import sys
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tonarm.operators import jobs
from tonarm.sources.checkpoint import Checkpoint
from tonarm.sources.track_store import TrackStore


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tracks_join_without_exchange(spark, tmp_path):
    store = TrackStore(spark, str(tmp_path), "track_id", 8, f"t{uuid.uuid4().hex}")
    tracks = [(f"t{i}" if i != 5 else None, i) for i in range(100)]
    store.write("tags", spark.createDataFrame(tracks, "track_id string, n int"))
    store.write("genres", spark.createDataFrame([(f"t{i}", f"g{i}") for i in range(0, 100, 2)] + [("t4", "again"), (None, "none")], "track_id string, genre string"))
    store.write("captions", spark.createDataFrame([(f"t{i}", f"c{i}") for i in range(0, 100, 3)], "track_id string, caption string"))
    met = store.enrich("tags", {"g": ("genres", "genre"), "c": ("captions", "caption")})
    assert "Exchange" not in plan_of(met) and plan_of(met).count("SortMergeJoin") == 2
    want = {(f"t{i}" if i != 5 else None, i, f"g{i}" if i % 2 == 0 else None, f"c{i}" if i % 3 == 0 else None) for i in range(100)} | {("t4", 4, "again", None)}
    assert {tuple(r) for r in met.collect()} == want
    todo = store.missing("tags", "captions")
    assert "Exchange" not in plan_of(todo) and todo.count() == 66
    few = store.only("tags", ["t7"])
    files = lambda df: sum(len(p.files()) for p in df._jdf.queryExecution().toRdd().partitions())
    assert files(few) == 1 and files(store.read("tags")) == 8 and [tuple(r) for r in few.collect()] == [("t7", 7)]
    store.drop()
    again = TrackStore(spark, str(tmp_path), "track_id", 8, f"t{uuid.uuid4().hex}")  # as another session would
    again.attach("tags", "track_id string, n int")
    again.attach("captions", "track_id string, caption string")
    todo = again.missing("tags", "captions")
    assert "Exchange" not in plan_of(todo) and todo.count() == 66


SCHEMA = "k long, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_checkpoint_versions(spark, tmp_path):
    store = Checkpoint(spark, str(tmp_path / "c"), "k", SCHEMA)
    assert store.read().count() == 0 and store.todo(rows(spark, (1, "a"))).count() == 1
    store.append(rows(spark, *[(i, "") for i in range(200)], (None, "x")))
    store.append(rows(spark, *[(i, f"v{i}") for i in range(50, 60)], (None, "y")))
    before = store.read()  # a reader that began before the merge
    assert store.merge(1) >= 1 and store.merge(1) == 0
    store.append(rows(spark, (300, "late")))
    want = {(i, f"v{i}" if 50 <= i < 60 else "") for i in range(200)} | {(None, "y")}
    assert {tuple(r) for r in before.collect()} == want
    assert {tuple(r) for r in store.read().collect()} == want | {(300, "late")}
    assert {tuple(r) for r in store.read(version=1).collect()} == {(i, "") for i in range(200)} | {(None, "x")}
    assert store.versions() == [1, 2, 3, 4] and store.vacuum() > 0 and store.versions() == [4]
    assert store.read().count() == 202
    assert store.manifest()["bounds"] and sum(p["rows"] for p in store.manifest()["parts"]) == 202


def test_checkpoint_reads_only_ranges(spark, tmp_path):
    store = Checkpoint(spark, str(tmp_path / "c"), "k", SCHEMA)
    store.append(rows(spark, *[(i, "") for i in range(1_000)]))
    few = store.read(990, 1_200)
    assert {r["k"] for r in few.collect()} == set(range(990, 1_000))
    assert len(few.inputFiles()) < len(store.read().inputFiles()) / 4
    todo = store.todo(rows(spark, *[(i, "") for i in range(995, 1_005)]))
    assert {r["k"] for r in todo.collect()} == set(range(1_000, 1_005))


def test_checkpoint_of_text_keys(spark, tmp_path):
    store = Checkpoint(spark, str(tmp_path / "c"), "k", "k string, v long")
    store.append(spark.createDataFrame([(f"t{i:03d}", i) for i in range(100)], "k string, v long"))
    store.append(spark.createDataFrame([("t007", 70), ("z", 1)], "k string, v long"))
    assert {tuple(r) for r in store.read("t099").collect()} == {("t099", 99), ("z", 1)}
    assert {r["v"] for r in store.read("t007", "t007").collect()} == {70}


def test_writers_meet(spark, tmp_path, monkeypatch):
    """Another writer takes the number between reading and writing: this one goes on from the other's version."""
    store, other = (Checkpoint(spark, str(tmp_path / "c"), "k", SCHEMA) for _ in range(2))
    store.append(rows(spark, (1, "a")))
    real, met = store._create, []

    def create(manifest):
        if not met:
            met.append(1)
            other.append(rows(spark, (2, "b")))
        return real(manifest)

    monkeypatch.setattr(store, "_create", create)
    store.append(rows(spark, (3, "c")))
    assert {tuple(r) for r in store.read().collect()} == {(1, "a"), (2, "b"), (3, "c")} and store.versions() == [1, 2, 3]


def test_a_broken_append_does_not_count(spark, tmp_path, monkeypatch):
    store = Checkpoint(spark, str(tmp_path / "c"), "k", SCHEMA)
    store.append(rows(spark, (1, "a")))
    monkeypatch.setattr(store, "_commit", lambda change: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        store.append(rows(spark, (2, "b")))
    assert [tuple(r) for r in Checkpoint(spark, str(tmp_path / "c"), "k", SCHEMA).read().collect()] == [(1, "a")]


RETRIED = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from tonarm.sources.checkpoint import Checkpoint
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", sys.argv[2]).getOrCreate()
def late(frames):
    for f in frames:
        yield f
    if TaskContext.get().attemptNumber() < 2:
        raise ValueError("lost after its rows were written")
df = spark.createDataFrame([(i, "x") for i in range(20)], "k long, v string").repartition(2).mapInPandas(late, "k long, v string")
store = Checkpoint(spark, sys.argv[1], "k", "k long, v string")
store._sampled = lambda df: [10]
store.append(df)
raw = store._load([p["path"] for p in store.manifest()["parts"]])
print("ROWS", raw.count(), store.read().count())
"""


def test_tasks_tried_again_write_once(tmp_path):
    """Every task fails twice after it has handed over its rows."""
    made = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path / "c"), str(tmp_path)], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parent.parent)
    assert "ROWS 20 20" in made.stdout, made.stderr[-2000:]


def test_job_is_taken_up_again(spark, tmp_path):
    """A run that dies in the middle keeps its slices; the next does only the rest, a third nothing; dead letters can be tried again."""
    marks = tmp_path / "marks"
    marks.mkdir()

    def make(dies):
        def model(values):
            for v in values:
                if dies and len(list(marks.iterdir())) >= 12:
                    sys.exit(1)  # not an error of a row: the worker goes
                (marks / f"{v}-{uuid.uuid4().hex}").touch()
            if any(v.endswith("3") for v in values):
                raise ValueError("unreadable")
            return [v.upper() for v in values]

        return lambda: model

    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)] + [(0, "q"), (None, "n")], "k long, path string")
    job = jobs.ResumableJob(spark, str(tmp_path / "job"), "k", "long", "string")
    with pytest.raises(Exception, match=r"."):
        job.run(df, "path", make(True), 1, slices=5)
    done = {r["k"] for r in job.checkpoint.read().collect()}
    assert 0 < len(done) < 40
    for f in marks.iterdir():
        f.unlink()
    report = job.run(df, "path", make(False), 1, slices=5)
    seen = {int(f.name.split("-")[0][1:]) for f in marks.iterdir()}
    assert report["todo"] == 40 - len(done) and seen == set(range(40)) - done
    assert job.run(df, "path", make(False), 1) == {"todo": 0, "ok": 0, "failed": 0, "slices": 0}
    assert {tuple(r) for r in job.results().collect()} == {(i, f"P{i}") for i in range(40) if i % 10 != 3}
    assert {r["k"] for r in job.dead_letters().collect()} == {3, 13, 23, 33}
    mended = jobs.ResumableJob(spark, str(tmp_path / "job"), "k", "long", "string")
    report = mended.run(df, "path", lambda: lambda v: [x.upper() for x in v], 8, retry_failed=True)
    assert (report["todo"], report["ok"], report["failed"]) == (4, 4, 0)
    assert mended.results().count() == 40 and mended.dead_letters().count() == 0

