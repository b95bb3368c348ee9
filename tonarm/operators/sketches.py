"""Most frequent items by mergeable counters, and samples by mergeable smallest hashes.

Both keep a bounded state for each group in each task, and only these states move. What a sketch leaves open is proven or
counted exactly, so the results are those of a full count or a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonarm.storage import stored

#: Counters that a task keeps for each group at first, how many times more it keeps where that proves nothing, and the most; beyond it all items are counted.
CAPACITY, GROWTH, MOST = 1_024, 8, 1 << 20


class Counters:
    """Misra-Gries counters of a group: true counts are at most `error` above them, those of items without one at most `error`."""

    def __init__(self, capacity: int):
        self.capacity, self.error, self.counts = capacity, 0, {}

    def add(self, items, counts) -> None:
        mine = self.counts
        for x, n in zip(items, counts, strict=True):
            mine[x] = mine.get(x, 0) + n
        if len(mine) > 2 * self.capacity:
            self.shrink()

    def shrink(self) -> None:
        """The count of the first item that has no room is taken from all, and those that have nothing left go."""
        if len(self.counts) > self.capacity:
            cut = sorted(self.counts.values(), reverse=True)[self.capacity]
            self.counts = {x: n - cut for x, n in self.counts.items() if n > cut}
            self.error += cut


def _sketched(df: DataFrame, capacity: int) -> DataFrame:
    """df (g, item). Rows (g, item, n) of all tasks' counters, and with a null item the error of each group and task."""

    def run(batches):
        import pyarrow as pa

        groups: dict = {}
        for batch in batches:
            counted = pa.Table.from_batches([batch]).group_by(["g", "item"]).aggregate([([], "count_all")])
            rows: dict = {}
            for g, x, n in zip(*(counted.column(c).to_pylist() for c in ("g", "item", "count_all")), strict=True):
                rows.setdefault(g, ([], []))
                rows[g][0].append(x)
                rows[g][1].append(n)
            for g, (items, counts) in rows.items():
                if g not in groups:
                    groups[g] = Counters(capacity)
                groups[g].add(items, counts)
        for g, held in groups.items():
            held.shrink()
            n = len(held.counts) + 1
            yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.string()), pa.array([*held.counts, None], pa.string()), pa.array([*held.counts.values(), held.error], pa.int64())], names=["g", "item", "n"])

    return df.mapInArrow(run, "g string, item string, n long")


def heavy_hitters(df: DataFrame, item: str, k: int, by: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (by, item, n, rank): the k most frequent items of each group, ties by item; groups and items are given as text, a null group is one, null items do not count.

    Tasks count with bounded counters, which are merged. Their errors add up to a bound on what any item without a counter
    can have; if it is below the kth count for every group, the top k are among the items whose counters come near enough,
    and these alone are counted exactly. Else the counters grow; past MOST all items are counted. df is read again for
    each step, so store it if it is dear.
    """
    rows = df.select((F.col(by) if by else F.lit("")).cast("string").alias("g"), F.col(item).cast("string").alias("item")).where("item IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "item"))

    def top(counts: DataFrame) -> DataFrame:
        best = counts.withColumn("rank", rank).where(F.col("rank") <= k)
        return best.select(*([F.col("g").alias(by)] if by else []), F.col("item").alias(item), "n", "rank")

    while capacity <= MOST:
        found = stored(_sketched(rows, capacity).groupBy("g", "item").agg(F.sum("n").alias("n")), "counters")
        errors = found.where("item IS NULL").select("g", F.col("n").alias("error"))
        counters = found.where("item IS NOT NULL")
        if errors.where("error > 0").isEmpty():
            return top(counters)  # every item has a counter: the counts are exact
        kth = counters.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("g").alias("_g"), F.col("n").alias("kth"))
        bounds = errors.join(kth, F.col("g").eqNullSafe(F.col("_g")), "left").select("_g", F.col("g").alias("_of"), "error", "kth")
        if bounds.where("error > 0 AND (kth IS NULL OR kth <= error)").isEmpty():
            near = counters.join(bounds.drop("_g"), F.col("g").eqNullSafe(F.col("_of"))).where("kth IS NULL OR n + error >= kth")
            near = near.select(F.col("g").alias("_g"), F.col("item").alias("_i"))
            few = rows.join(near, F.col("g").eqNullSafe(F.col("_g")) & (F.col("item") == F.col("_i")), "left_semi")
            return top(few.groupBy("g", "item").agg(F.count("*").alias("n")))
        capacity *= GROWTH
    return top(rows.groupBy("g", "item").agg(F.count("*").alias("n")))


def bottom_k(df: DataFrame, k: int, by: str | None, order: list[Column]) -> DataFrame:
    """df's rows that come first by `order` (columns or expressions), k of each group: each task keeps k rows a group, no partition is
    sorted, and only what tasks keep moves. Rows must differ in order. Numbers, texts and nulls can stand in it, nulls first."""
    key = [f"_k{i}" for i in range(len(order))]
    rows = df.select("*", (F.col(by) if by else F.lit(None)).cast("string").alias("_g"), *[c.alias(x) for c, x in zip(order, key, strict=True)])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            at = pc.sort_indices(table, sort_keys=[(x, "ascending") for x in ("_g", *key)], null_placement="at_start")
            table = table.take(at)
            g = table.column("_g").to_pylist()
            keep, seen, last = [], 0, object()
            for i, x in enumerate(g):
                seen, last = (seen + 1, last) if x == last else (1, x)
                if seen <= k:
                    keep.append(i)
            held = table.take(pa.array(keep, pa.int64()))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    kept = rows.mapInArrow(run, rows.schema)
    first = F.row_number().over(Window.partitionBy("_g").orderBy(*key))
    return kept.withColumn("_r", first).where(F.col("_r") <= k).drop("_g", "_r", *key)


def stratified_sample(df: DataFrame, key: str, k: int, by: str | None = None, seed: int = 0, weight: str | None = None) -> DataFrame:
    """A repeatable random sample of k rows of each group, without repeats: those of the smallest hashes of seed and key.

    With a weight a row's chance grows with it: its hash, as a number u between 0 and 1, counts as -ln(u) / weight; rows of
    null, zero or negative weights are never drawn. Without one the sample is that of `profile.inspection_sample`.
    """
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string")))
    if weight is None:
        return bottom_k(df, k, by, [digest, F.col(key)])
    # 52 bits of the digest, never 0
    u = (F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return bottom_k(df.where(F.col(weight) > 0), k, by, [-F.ln(u) / F.col(weight).cast("double"), F.col(key)])
