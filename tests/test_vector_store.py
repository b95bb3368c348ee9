import numpy as np
import pytest

from tonarm.operators import retrieval
from tonarm.sources import vector_store as vs

SCHEMA = "index long, embedding array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], SCHEMA)


def both(spark, path, df, prompt, n, **how):
    one = frame(spark, [(0, prompt)])
    found, report = vs.search_clustered(spark, path, one, n, **how)
    got = [(r["index"], r["score"]) for r in found.collect()]
    want = [(r["index"], r["score"]) for r in retrieval.shortlist(df, one, n).collect()]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-12)
    return report


def test_search_skips_files(spark, tmp_path):
    """Vectors in 30 directions: the result is the full scan's, and most files are never read."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    rows = [(i, centres[i % 30] * rng.uniform(0.1, 9) + rng.normal(size=24) * 0.2) for i in range(900)]
    df, path = frame(spark, rows), str(tmp_path / "store")
    vs.write_clustered(df.where("index < 700"), path, pivots=40, files=30)
    vs.append_clustered(df.where("index >= 700"), path, files=20)
    for prompt in (centres[4], centres[11] + 0.1, rng.normal(size=24), -centres[0]):
        report = both(spark, path, df, prompt, 15, wave=4)
        assert report["rows"] == 900 and report["files"] >= 30
        if prompt is centres[4]:
            assert report["files_read"] < report["files"] / 3 and report["rows_read"] < 450 and report["waves"] >= 1
    assert vs.read_clustered(spark, path).count() == 900
    listed = vs.read_manifest(spark, path).collect()
    assert sum(r["rows"] for r in listed) == 900 and all(r["least"] <= r["most"] and r["least_norm"] <= r["most_norm"] for r in listed)


def test_bounds_hold(spark, tmp_path):
    """No vector of a file scores above the file's bound."""
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(400, 5)))]
    path = str(tmp_path / "store")
    vs.write_clustered(frame(spark, rows), path, pivots=8, files=12)
    vectors = dict(rows)
    for prompt in (*rng.normal(size=(3, 5)), rows[7][1], -rows[9][1]):
        unit = prompt / np.linalg.norm(prompt)
        for bound, _, file, n in vs.file_bounds(spark, path, prompt.tolist()):
            held = [r["index"] for r in spark.read.parquet(file).collect()]
            assert len(held) == n and max(vectors[i] @ unit / np.linalg.norm(vectors[i]) for i in held) <= bound + 1e-12


def test_odd_vectors(spark, tmp_path):
    """Null and zero vectors, other sizes, ties, repeated ids, prompts of other sizes, a zero prompt, and fewer rows than wanted."""
    rows = [(1, [1, 0]), (2, [2, 0]), (2, [0, 1]), (3, None), (4, [0, 0]), (5, [1, 1, 1]), (6, [-1, 0]), (7, [1]), (8, [3, 0]), (0, None)]
    df, path = frame(spark, rows), str(tmp_path / "store")
    vs.write_clustered(df, path)
    for prompt, n, wave in (([1, 0], 3, 1), ([1, 0.5, 9], 8, 4), ([1], 20, 8), ([0, 0], 6, 8), ([-1, -1], 9, 3)):
        both(spark, path, df, prompt, n, wave=wave)
    found, report = vs.search_clustered(spark, path, df.limit(0))
    assert found.count() == 0 and report["files_read"] == 0
    nan = frame(spark, [(1, [1, 2]), (2, [float("nan"), 1])])
    vs.write_clustered(nan, str(tmp_path / "nan"))
    assert [tuple(r) for r in vs.search_clustered(spark, str(tmp_path / "nan"), frame(spark, [(0, [1, 2])]), 5)[0].collect()] == [(1, pytest.approx(1)), (2, None)]
    vs.write_clustered(df.limit(0), str(tmp_path / "none"))
    assert vs.search_clustered(spark, str(tmp_path / "none"), frame(spark, [(0, [1, 2])]), 5)[0].count() == 0
