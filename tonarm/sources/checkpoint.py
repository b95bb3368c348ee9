"""Results of jobs by key: appended in slices, committed by a manifest, merged where they grew, and read by ranges.

A checkpoint is a folder. Keys fall into ranges, whose bounds come from a sample of the first slice. An append writes
a folder of files by range and then a new version of the manifest, which lists every part (range, path, rows, least and
greatest key) that counts. A version is created with its number as its name and only if no other writer had that number,
else the writer goes on from the other's version; so a slice counts as a whole or not at all, and tasks that are tried again or
drivers that die leave nothing behind but files that no version names. Readers take one version and keep to it: merging writes new
parts beside the old, and old files go only by `vacuum`.

A key that was appended several times is read once, with the greatest of its rows, so a result is preferred to an empty one.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges of a new checkpoint, keys that their bounds come from, and parts a range may have before it is merged.
RANGES, SAMPLE, PARTS = 32, 10_000, 4


class Checkpoint:
    """Rows of `schema` (DDL) by `key` (a whole number or text) in `folder`."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str):
        self.spark, self.folder, self.key = spark, folder, key
        self.schema = spark.createDataFrame([], schema).schema

    # Versions

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        files, at = self._files(f"{self.folder}/manifest")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest version, or the one asked for: its number, the ranges' bounds and the parts."""
        there = self.versions()
        if not there:
            return {"version": 0, "bounds": None, "parts": []}
        path = f"{self.folder}/manifest/v{there[-1] if version is None else version:08d}.json"
        return json.loads("".join(r["value"] for r in self.spark.read.option("wholetext", True).text(path).collect()))

    def _create(self, manifest: dict) -> bool:
        """Whether this number was free: then the version stands, whole. A rename that does not replace, so of two writers one is told."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files, at = self._files(f"{self.folder}/manifest/v{manifest['version']:08d}.json")
        _, hidden = self._files(f"{self.folder}/manifest/_{uuid.uuid4().hex}")
        said = files.create(hidden, True)
        said.write(json.dumps(manifest).encode())
        said.close()
        whole = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            whole.rename(files.makeQualified(hidden), files.makeQualified(at), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            files.delete(hidden, False)
            return False
        return True

    def _commit(self, change) -> dict:
        """Creates the next version, change(manifest) of the newest one, again if another writer was first."""
        for _ in range(100):
            old = self.manifest()
            new = change(dict(old)) | {"version": old["version"] + 1}
            if self._create(new):
                return new
        raise RuntimeError(f"no version of {self.folder} could be written")

    # Writing

    def _range(self, bounds: list):
        """The number of bounds at or below the key."""
        at = F.lit(0)
        for b in bounds:
            at = at + F.coalesce(F.col(self.key) >= F.lit(b), F.lit(False)).cast("int")
        return at

    def _sampled(self, df: DataFrame) -> list:
        keys = df.select(self.key).where(F.col(self.key).isNotNull()).orderBy(F.xxhash64(self.key)).limit(SAMPLE).collect()
        keys = sorted(r[0] for r in keys)
        return sorted({keys[len(keys) * i // RANGES] for i in range(1, RANGES)}) if keys else []

    def _write(self, df: DataFrame, bounds: list) -> list[dict]:
        """Writes df by range; the parts, which no version names yet."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        columns = self.schema.fieldNames()
        df.select(*columns, self._range(bounds).alias("key_range")).repartitionByRange(F.col(self.key)).write.partitionBy("key_range").parquet(path)
        there = self.spark.read.schema(f"{self.schema[self.key].name} {self.schema[self.key].dataType.simpleString()}, key_range int").parquet(path)
        found = there.groupBy("key_range").agg(F.count("*").alias("rows"), F.min(self.key).alias("least"), F.max(self.key).alias("most")).collect()
        return [{"range": r["key_range"], "path": f"{path}/key_range={r['key_range']}", "rows": r["rows"], "least": r["least"], "most": r["most"]} for r in found]

    def append(self, df: DataFrame, note: dict | None = None) -> dict:
        """Adds rows; counts once its version stands. note is kept in the manifest, under `notes`."""
        bounds = self.manifest()["bounds"]
        bounds = self._sampled(df) if bounds is None else bounds
        parts = self._write(df, bounds)

        def change(m):
            if m["bounds"] is not None and m["bounds"] != bounds:
                raise RuntimeError("two first appends at a time")
            return m | {"bounds": bounds, "parts": m["parts"] + parts, "notes": m.get("notes", []) + ([note] if note else [])}

        return self._commit(change)

    def merge(self, most: int = PARTS) -> int:
        """Writes anew, a row a key, the ranges that have more than `most` parts; how many there were. Appends meanwhile stay."""
        m = self.manifest()
        of: dict[int, list] = {}
        for p in m["parts"]:
            of.setdefault(p["range"], []).append(p)
        grown = {r: parts for r, parts in of.items() if len(parts) > most}
        if grown:
            old = {p["path"] for parts in grown.values() for p in parts}
            new = self._write(self._one_each(self._load(sorted(old))), m["bounds"])
            self._commit(lambda n: n | {"parts": [p for p in n["parts"] if p["path"] not in old] + new})
        return len(grown)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files of parts that none of the last `keep` versions names, and earlier versions; how many parts. Only while nobody appends."""
        there = self.versions()
        named = {p["path"] for v in there[-keep:] for p in self.manifest(v)["parts"]}
        gone = {p["path"] for v in there[:-keep] for p in self.manifest(v)["parts"]} - named
        for path in [*sorted(gone), *(f"{self.folder}/manifest/v{v:08d}.json" for v in there[:-keep])]:
            files, at = self._files(path)
            files.delete(at, True)
        return len(gone)

    # Reading

    def _load(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _one_each(self, df: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.fieldNames() if c != self.key]
        best = df.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("_r")) if rest else df.select(self.key).distinct()
        return best.select(*[F.col(c) if c == self.key else F.col(f"_r.{c}") for c in self.schema.fieldNames()])

    def read(self, least=None, most=None, version: int | None = None) -> DataFrame:
        """One row a key, of keys between least and most; only the parts that can hold such keys are read."""
        parts = self.manifest(version)["parts"]
        fine = [p for p in parts if (least is None or p["most"] is not None and p["most"] >= least) and (most is None or p["least"] is not None and p["least"] <= most)]
        rows = self._load([p["path"] for p in fine])
        if least is not None:
            rows = rows.where(F.col(self.key) >= F.lit(least))
        if most is not None:
            rows = rows.where(F.col(self.key) <= F.lit(most))
        return self._one_each(rows)

    def todo(self, df: DataFrame) -> DataFrame:
        """df's rows whose key is not here yet. Only the parts are read that df's least and greatest key can be in."""
        m = self.manifest()
        if not m["parts"]:
            return df
        ends = df.agg(F.min(self.key), F.max(self.key)).first()
        paths = [p["path"] for p in m["parts"] if p["most"] is not None and ends[0] is not None and p["most"] >= ends[0] and p["least"] <= ends[1]]
        return df.join(self._load(paths).select(self.key), self.key, "left_anti")
