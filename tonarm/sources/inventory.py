"""A list of files kept up to date: folders are listed by tasks, and later runs list only folders that changed.

A run goes down the tree level by level. Of each folder a task asks for the time of its last change; if that is the time of the
run before, its files and subfolders are taken over from there, else it is listed. So the driver lists nothing, and a run
over a tree that hardly changed reads little more than one entry a folder. Every run writes its state beside those before:
files (path, folder, size, listed) and folders (folder, parent, mtime, listed), in paths below the root with `/`.

A folder's time tells of names that came or went, not of files written anew under the same name; `full=True` lists all folders.
A folder that changed within `settled` seconds before it was listed is listed again next time, for a later change can bear the
same time. Folders that vanish meanwhile have no files. Paths are read by pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonarm.storage import stored

SETTLED = 2.0
LISTED = "folder string, parent string, kind string, path string, size long, mtime long"


def opened(uri: str):
    """pyarrow's file system of a path, and the path there."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):  # as Hadoop writes local paths
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _lister(root: str, pattern: str, seconds: float):
    """Over rows (folder, parent, before): one row of kind `same` or `listed` for each folder, and one for each file and subfolder of a listed one."""

    def run(frames):
        import time

        import pandas as pd
        from pyarrow import fs

        files, top = opened(root)
        for pdf in frames:
            for folder, parent, before in zip(pdf["folder"], pdf["parent"], pdf["before"], strict=True):
                at = f"{top.rstrip('/')}/{folder}".rstrip("/")
                info = files.get_file_info(at)
                if info.type != fs.FileType.Directory:
                    continue
                now, mtime = time.time_ns(), info.mtime_ns
                if mtime is not None and before == mtime:
                    yield pd.DataFrame([(folder, parent, "same", None, None, mtime)], columns=[x.split()[0] for x in LISTED.split(", ")])
                    continue
                try:
                    inside = files.get_file_info(fs.FileSelector(at))
                except FileNotFoundError:
                    continue
                settled = mtime is not None and now - mtime > seconds * 1e9
                rows = [(folder, parent, "listed", None, None, mtime if settled else None)]
                for x in inside:
                    path = f"{folder}/{x.base_name}".lstrip("/")
                    if x.type == fs.FileType.Directory:
                        rows.append((path, folder, "folder", None, None, None))
                    elif fnmatch.fnmatchcase(x.base_name, pattern):
                        rows.append((folder, parent, "file", path, x.size, None))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in LISTED.split(", ")])
                yield out.astype({"size": "Int64", "mtime": "Int64"})

    return run


class Inventory:
    """The files under `root` whose names match `pattern`, with the states of all runs in `folder`."""

    def __init__(self, spark: SparkSession, root: str, folder: str, pattern: str = "*.mp3", settled: float = SETTLED):
        self.spark, self.root, self.folder, self.pattern, self.settled = spark, root, folder, pattern, settled

    def runs(self) -> int:
        """The number of whole runs: the last step of each is its folders' table."""
        files, at = self._files(self.folder)
        names = {s.getPath().getName() for s in files.listStatus(at)} if files.exists(at) else set()
        n = 0
        while f"run{n + 1}" in names and files.exists(self._files(f"{self.folder}/run{n + 1}/folders/_SUCCESS")[1]):
            n += 1
        return n

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def files(self, run: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/run{run or self.runs()}/files")

    def folders(self, run: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/run{run or self.runs()}/folders")

    def update(self, full: bool = False) -> int:
        """A further run; its number."""
        last = self.runs()
        known = self.folders(last) if last else self.spark.createDataFrame([], "folder string, parent string, mtime long, listed boolean")
        times = known.select("folder", (F.lit(None).cast("long") if full else F.col("mtime")).alias("before"))
        level = self.spark.createDataFrame([("", None)], "folder string, parent string")
        found = None
        tasks = self.spark.sparkContext.defaultParallelism
        while True:
            asked = level.join(times, "folder", "left").repartition(tasks)  # listing waits for answers, so any spread serves
            rows = stored(asked.mapInPandas(_lister(self.root, self.pattern, self.settled), LISTED), "listed")
            found = rows if found is None else found.union(rows)
            same = rows.where("kind = 'same'").select(F.col("folder").alias("parent"))
            level = rows.where("kind = 'folder'").select("folder", "parent").union(known.join(same, "parent", "left_semi").select("folder", "parent"))
            if level.isEmpty():
                break
        out = f"{self.folder}/run{last + 1}"
        listed = found.where("kind = 'file'").select("path", "folder", "size", F.lit(True).alias("listed"))
        if last:
            kept = found.where("kind = 'same'").select("folder")
            listed = listed.union(self.files(last).join(kept, "folder", "left_semi").select("path", "folder", "size", F.lit(False)))
        listed.write.mode("overwrite").parquet(f"{out}/files")
        state = found.where("kind IN ('same', 'listed')").select("folder", "parent", "mtime", (F.col("kind") == "listed").alias("listed"))
        state.write.mode("overwrite").parquet(f"{out}/folders")
        return last + 1

    def changes(self, run: int | None = None) -> DataFrame:
        """Rows (change, path), `added` or `removed` since the run before: files of folders that were taken over are not compared."""
        run = run or self.runs()
        new = self.files(run)
        if run <= 1:
            return new.select(F.lit("added").alias("change"), "path")
        taken_over = self.folders(run).where("NOT listed").select("folder")
        old = self.files(run - 1).join(taken_over, "folder", "left_anti")
        new = new.where("listed")
        added = new.join(old, "path", "left_anti").select(F.lit("added").alias("change"), "path")
        return added.union(old.join(new, "path", "left_anti").select(F.lit("removed").alias("change"), "path"))
