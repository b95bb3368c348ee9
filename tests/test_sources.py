import pytest

from tonarm.operators import jobs
from tonarm.sources import files


def test_tag_table(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("TRACK_ID\tARTIST_ID\tALBUM_ID\tPATH\tDURATION\tTAGS\nt1\ta\tb\tp\t1.5\tgenre---x\tgenre---y\nt2\ta\tb\nt3\ta\tb\tp\tlong\t\tgenre---x\n")
    got = [tuple(r) for r in files.read_tag_table(spark, str(tmp_path / "t.tsv")).orderBy("track_id").collect()]
    assert got == [("t1", "a", "b", "p", 1.5, ["genre---x", "genre---y"]), ("t2", "a", "b", None, None, []), ("t3", "a", "b", "p", None, ["genre---x"])]


def test_csv_needs_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text(' Track_ID ,caption\n1,\n2,"a ""b""\nc"\n')
    df = files.read_csv(spark, str(tmp_path / "t.csv"), ("track_id",))
    assert {tuple(r) for r in df.collect()} == {("1", ""), ("2", 'a "b"\nc')} and files.find_column(df, "TRACK_id") == "Track_ID"
    with pytest.raises(ValueError, match="path"):
        files.read_csv(spark, str(tmp_path / "t.csv"), ("track_id", "path"))


def test_list_files(spark, tmp_path):
    for name in ("00/1.mp3", "00/2.wav", "17/3.mp3"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["path"][-8:] for r in files.list_files(spark, str(tmp_path)).collect()) == ["00/1.mp3", "17/3.mp3"]


def test_diagnostics(spark, tmp_path):
    def make():
        def model(values):
            return [1 / len(v) for v in values]

        return model

    made = jobs.run_model(spark.createDataFrame([(1, "ab"), (2, ""), (3, "c")], "k long, v string"), "k", "v", make, "double", 8)
    files.write_diagnostics(made, str(tmp_path / "d"), spark.createDataFrame([], "k long"))
    failed = spark.read.json(str(tmp_path / "d/failed.json")).collect()
    assert [(r["k"], r["status"], r["error"]) for r in failed] == [(2, "failed", "ZeroDivisionError: division by zero")]
    assert files.read_csv(spark, str(tmp_path / "d/failed.csv")).count() == 1
    assert {(r["status"], r["n"]) for r in spark.read.json(str(tmp_path / "d/summary.json")).collect()} == {("ok", 2), ("failed", 1)}
