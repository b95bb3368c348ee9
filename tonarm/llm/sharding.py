"""K-d tree sharding (operator 8), in DataFrame functions alone.

Points are groups of equal texts, weighted by their bytes, in a space of metadata of the text: its length, its lines and
its bytes a character. A node that stands for several shards is split along its widest dimension (against the
root's width) at the weighted median, or at the part of its bytes that its left half of shards is to get; a node of one
shard has reached the target bytes and is a leaf. The cut is found from distributed histograms, the bin that holds it
being refined until it is exact to SLACK of a shard; among points that are equal in the dimension the digest of the text
decides. Only the nodes, twice as many as shards, reach the driver. Places within a shard come from counts of
small cells, so that no shard is one task.

Law: `bytes`. Equal texts stay in one shard; only a group that alone exceeds a shard's target is dealt in parts, by
doc_id. Defined cases: null text counts as empty (size 1, crc 0); an empty table gives an empty result; repeated rows get a
slot each; with fewer groups than shards some shards stay empty; any number of shards from 1 on; null ids are dealt at random.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, stored, table

SHARDS = 16
BINS = 1024
#: A cut is exact to this part of a shard's target.
SLACK = 0.001
#: Rows of a cell in which slots are numbered.
CELL_ROWS = 20_000
DIMS = ("d_bytes", "d_lines", "d_width")
#: Values of the digest that breaks ties.
TIES = 2.0**44


def metadata(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, size, text_crc32, digest, tie, salt, dims): all but doc_id and salt follow from the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("digest"),
        F.regexp_count(text, F.lit("\n")).alias("lines"),
        F.char_length(text).alias("chars"),
    )
    return rows.select(
        "doc_id", "size", "text_crc32", "digest",
        F.conv(F.substring("digest", 1, 11), 16, 10).cast("double").alias("tie"),
        F.when(F.col("doc_id").isNull(), (F.rand(8) * 2.0**53).cast("long")).otherwise(F.xxhash64("doc_id", "digest")).alias("salt"),
        F.log2("size").alias("d_bytes"),
        F.log2(F.col("lines") + 1.0).alias("d_lines"),
        (F.col("size") / (F.col("chars") + 1.0)).alias("d_width"),
    )


@dataclass
class Node:
    """A leaf, or a split: points go left below the cut in dimension dim, and at it up to the tie."""

    shards: int
    first: int
    dim: int = -1
    cut: float = 0.0
    tie: float = math.inf
    left: int = -1
    right: int = -1


def node_of(tree: list[Node], dims) -> Column:
    """The leaf of each point: a walk down the tree, held as lists, so that the expression grows with the tree alone."""
    lists = {x: F.lit([getattr(n, x) for n in tree]) for x in ("dim", "cut", "tie", "left", "right")}
    point = F.array(*dims)

    def down(at, _):
        get = lambda x: F.get(lists[x], at)
        v, cut = F.get(point, get("dim")), get("cut")
        is_left = (v < cut) | ((v == cut) & (F.col("tie") <= get("tie")))
        return F.when(get("dim") < 0, at).when(is_left, get("left")).otherwise(get("right"))

    depth, level = 0, [0]
    while level := [c for i in level if tree[i].dim >= 0 for c in (tree[i].left, tree[i].right)]:
        depth += 1
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down) if depth else F.lit(0)


def cuts(at: DataFrame, dims, weight: str, search: dict[int, dict], slack: float) -> dict[int, tuple[float, float]]:
    """For each node of search (dim, goal, lo, hi) the (cut, tie) that leaves nearest to `goal` of weight on its left.

    at: points with their node. Every round counts, for each node, the bins of its open interval, and one row a node comes back.
    """
    found: dict[int, tuple[float, float]] = {}
    search = {n: {"below": 0.0, "value": None, **s} for n, s in search.items()}
    while search:
        given = [F.struct(F.lit(n).alias("node"), *[F.lit(s[x]).alias(x) for x in ("dim", "goal", "lo", "hi", "below")], F.lit(s["value"]).cast("double").alias("value")) for n, s in search.items()]
        asked = at.sparkSession.range(1).select(F.inline(F.array(*given)))  # a row for each open node
        met = at.join(F.broadcast(asked), "node").withColumn("d", F.get(F.array(*dims), F.col("dim")))
        met = met.withColumn("v", F.when(F.col("value").isNull(), F.col("d")).when(F.col("d") == F.col("value"), F.col("tie"))).where("v BETWEEN lo AND hi")
        part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (BINS - 1))).otherwise(0)
        bins = met.groupBy("node", part.alias("bin")).agg(F.sum(weight).cast("double").alias("w"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("goal").alias("goal"), F.first("below").alias("below"))
        bins = bins.withColumn("upto", F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        # The bin that holds the goal; the last one if sums fall short of it by rounding.
        reached = bins.groupBy("node").agg(F.min_by(F.struct("w", "least", "most", "upto"), F.struct(F.col("upto") < F.col("goal"), F.when(F.col("upto") < F.col("goal"), -F.col("bin")).otherwise(F.col("bin")))).alias("b"))
        for n, b in ((r["node"], r["b"]) for r in reached.collect()):
            s = search[n]
            if b["w"] <= slack:
                found[n] = (b["most"], math.inf) if s["value"] is None else (s["value"], b["most"])
            elif b["least"] < b["most"]:
                s.update(lo=b["least"], hi=b["most"], below=b["upto"] - b["w"])
                continue
            elif s["value"] is None:
                s.update(value=b["least"], lo=0.0, hi=s["ties"], below=b["upto"] - b["w"])
                continue
            else:  # one group of texts: wholly left or wholly right
                left = b["upto"] - s["goal"] <= s["goal"] - (b["upto"] - b["w"])
                found[n] = (s["value"], b["most"] if left else math.nextafter(b["most"], -math.inf))
            del search[n]
    return found


def kd_tree(points: DataFrame, dims, weight: str, shards: int) -> list[Node]:
    """The tree of a table of points: dims (double), tie (double) and weight (long). One level of nodes at a time."""
    tree, level, widths, target = [Node(shards, 0)], [0], None, 0.0
    while level := [i for i in level if tree[i].shards > 1]:
        at = points.withColumn("node", node_of(tree, dims)).where(F.col("node").isin(level))
        ends = [f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
        spans = {r["node"]: r for r in at.groupBy("node").agg(F.sum(weight).alias("w"), F.max("tie").alias("ties"), *ends).collect()}
        if widths is None and spans:
            widths = [(spans[0][f"hi{i}"] - spans[0][f"lo{i}"]) or 1.0 for i in range(len(dims))]
            target = spans[0]["w"] / shards
        search = {}
        for n, r in spans.items():
            dim = max(range(len(dims)), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"]) / widths[i])  # noqa: B023
            k = tree[n].shards
            search[n] = {"dim": dim, "goal": float(r["w"] * (k // 2) / k), "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"], "ties": r["ties"]}
        level = []
        for n, (cut, tie) in cuts(at, dims, weight, search, SLACK * target).items():
            node, k = tree[n], tree[n].shards // 2
            node.dim, node.cut, node.tie = search[n]["dim"], cut, tie
            node.left, node.right = len(tree), len(tree) + 1
            tree += [Node(k, node.first), Node(node.shards - k, node.first + k)]
            level += [node.left, node.right]
    return tree


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one per input row."""
    rows = stored(metadata(docs), "metadata")
    keys = ["digest", "size", "tie", *DIMS]
    points = stored(rows.groupBy(*keys).agg(F.sum("size").alias("w")), "points")
    total, n = points.agg(F.sum("w"), F.count("*")).first()
    if n:
        # At most `shards` groups can exceed the target, so this side is bounded.
        heavy = points.where(F.col("w") > total / shards).select("digest", "size", F.ceil(F.col("w") * 4 * shards / total).alias("parts"))
        if heavy.count():
            rows = rows.join(F.broadcast(heavy), ["digest", "size"], "left")
            spread = F.coalesce(F.pmod(F.col("salt"), F.col("parts")) * TIES, F.lit(0.0))
            rows = stored(rows.withColumn("tie", F.col("tie") + spread).drop("parts"), "metadata")
            points = stored(rows.groupBy(*keys).agg(F.sum("size").alias("w")), "points")
    tree = kd_tree(points, DIMS, "w", shards) if n else [Node(1, 0)]
    shard = F.get(F.lit([x.first for x in tree]), node_of(tree, DIMS)).cast("int")
    cells = max(1, math.ceil(rows.count() / (shards * CELL_ROWS)))
    dealt = stored(rows.select("doc_id", "size", "text_crc32", "digest", shard.alias("shard"), F.pmod(F.shiftright("salt", 8), F.lit(cells)).alias("cell")), "dealt")
    sizes = dealt.groupBy("shard", "cell").count()
    first = F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "cell", F.coalesce(first, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "digest")) - 1
    return dealt.withColumn("within", within).join(starts, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    found = kd_shards(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = None
