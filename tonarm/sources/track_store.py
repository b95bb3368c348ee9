"""Tables of one key kept in the same buckets, so that enrichment by that key joins them where they lie.

Each table is written with one file a bucket, sorted by key: a join of any number of such tables has no exchange (what is left
is a sort within each bucket, of rows that are in order already, for Spark does not rely on a file's order), and a look-up of
given keys reads their buckets alone. Bucketed tables are known to the session's catalogue by
name; their files stand in a folder of the caller's, so another session can attach them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a store unless told: as many as tasks can be busy with at 100 TB in buckets of 1 GB is the caller's to say.
BUCKETS = 64


class TrackStore:
    """Tables bucketed by `key` in `folder`; every table of a store has the same number of buckets."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS, prefix: str = "tracks"):
        self.spark, self.folder, self.key, self.buckets, self.prefix = spark, folder, key, buckets, prefix

    def _name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def write(self, table: str, df: DataFrame) -> None:
        """One shuffle, at the time of writing; rows without a key are kept, in the bucket of null."""
        dealt = df.repartition(self.buckets, self.key)
        writer = dealt.write.format("parquet").option("path", f"{self.folder}/{table}").bucketBy(self.buckets, self.key).sortBy(self.key)
        writer.mode("overwrite").saveAsTable(self._name(table))

    def attach(self, table: str, schema: str) -> None:
        """Makes a table that another session wrote known to this one; schema as DDL."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({schema}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{table}'")

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def enrich(self, table: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
        """All of table, with columns of other tables by key: {name: (table, column)}. Unmatched is null, repeats of a key on the right multiply rows."""
        out = self.read(table)
        for name, (other, column) in columns.items():
            # The merge hint: a broadcast of what happens to be small would be the one thing here that grows.
            out = out.join(self.read(other).select(self.key, F.col(column).alias(name)).hint("merge"), self.key, "left")
        return out

    def only(self, table: str, keys: list) -> DataFrame:
        """The rows of given keys: their buckets alone are read."""
        return self.read(table).where(F.col(self.key).isin(*keys))

    def missing(self, table: str, other: str) -> DataFrame:
        """Rows of table whose key other does not have (what is left to do), without an exchange."""
        return self.read(table).join(self.read(other).select(self.key).hint("merge"), self.key, "left_anti")

    def drop(self) -> None:
        """Forgets the tables of this store; files stay."""
        for t in self.spark.catalog.listTables(pattern=f"{self.prefix}_*"):
            self.spark.sql(f"DROP TABLE IF EXISTS {t.name}")
