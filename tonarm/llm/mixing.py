"""Mixing sources to target weights (operator 5): hierarchical token budgets.

Weights go down a tree of domains, languages and sources. A node whose texts, over max_epochs, cannot fill its share
takes all it has; what it leaves goes to its siblings first and only then, as its parent's shortage, to its parent's
siblings. A leaf's budget is filled by whole epochs and the token prefix of one more, in an order seeded per epoch.

The tree is a table: capacities are summed up level by level, budgets dealt down level by level, so the number of leaves
is not bounded. Prefixes come from sums of small cells of the seeded order, so that a hot leaf is never one task.

Defined cases: null text has no tokens, and texts without tokens come with the prefix they stand in; null levels are
the leaf `?`; a weight that is not given is 1 (a weight of 0 gives nothing); the order goes by a hash of doc_id and text,
null ids included, so it does not depend on the order of rows; equal rows are taken one by one; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

SEED = 5
LEVELS = ("domain", "lang", "source")
#: Weights of the registered query and of the pipeline, by path from the root.
WEIGHTS = {("d0",): 2.0, ("d1",): 1.0, ("d2",): 1.0, ("d3",): 1.0, **{(d, "en"): 2.0 for d in ("d0", "d1", "d2", "d3")}}


def weighted(leaves: DataFrame, weights: dict[tuple, float], names: list[str]) -> DataFrame:
    """leaves with weight0, weight1, ... of the nodes on each leaf's path. weights are parameters of the caller, so few."""
    for k in range(len(names)):
        given = [(*path, float(w)) for path, w in weights.items() if len(path) == k + 1]
        if given:
            known = leaves.sparkSession.createDataFrame(given, ", ".join([*(f"{n} string" for n in names[: k + 1]), f"weight{k} double"]))
            leaves = leaves.join(F.broadcast(known), names[: k + 1], "left").withColumn(f"weight{k}", F.coalesce(f"weight{k}", F.lit(1.0)))
        else:
            leaves = leaves.withColumn(f"weight{k}", F.lit(1.0))
    return leaves


def budgets(leaves: DataFrame, weights: dict[tuple, float], fraction: float, max_epochs: int, names: list[str]) -> DataFrame:
    """leaves: rows (names..., t) with t tokens each. The same with the budget, in tokens, that the tree deals to each leaf.

    Children of a node share its budget by weight up to their capacities: child i gets min(capacity, rate * weight). In
    order of capacity / weight, the rate with the first i of them full is what is left over the weights that are left; it grows
    while children are rightly full and falls after, so the rate is the greatest of these.
    """
    usable = F.lit(True)
    for k in range(len(names)):
        usable = usable & (F.col(f"weight{k}") > 0)
    leaves = weighted(leaves, weights, names)
    leaves = leaves.withColumn("capacity", F.when(usable, F.col("t") * float(max_epochs)).otherwise(0.0))
    above = None
    for k in range(len(names)):
        parent, path = names[:k], names[: k + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.first(f"weight{k}").alias("weight"))
        live = nodes.where("capacity > 0").withColumn("full_at", F.col("capacity") / F.col("weight"))
        steps = live.groupBy(*parent, "full_at").agg(F.sum("capacity").alias("c"), F.sum("weight").alias("w"))
        steps = steps.join(above, parent) if parent else steps.withColumn("b", F.lit((leaves.agg(F.sum("t")).first()[0] or 0) * fraction))
        order = Window.partitionBy(*(parent or [F.lit(0)])).orderBy("full_at")
        left = F.col("b") - F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rate = left / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        rates = steps.select(*parent, rate.alias("rate")).groupBy(*parent).agg(F.max("rate").alias("rate"))
        # The rate of the root is one number.
        dealt = nodes.join(rates, parent, "left") if parent else nodes.withColumn("rate", F.lit(rates.first()["rate"]).cast("double"))
        share = F.when(F.col("capacity") > 0, F.least("capacity", F.col("rate") * F.col("weight")))
        above = dealt.select(*path, F.coalesce(share, F.lit(0.0)).alias("b"))
    return leaves.select(*names, "t").join(above.select(*names, F.col("b").alias("budget")), names)


def with_domain(docs: DataFrame) -> DataFrame:
    """The documents table names no domain: sources are dealt to four by the number in their name."""
    number = F.coalesce(F.try_element_at(F.regexp_extract_all("source", F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("long"), F.lit(0))
    return docs.withColumn("domain", F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string")))


def before(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells: rows (keys..., cell, t), cell in 0..4095. Rows (keys..., cell, start): the sum of t of all lower cells, in two levels of 64."""
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("part", F.shiftright("cell", 6))
    parts = cells.groupBy(*keys, "part").agg(F.sum("t").alias("t"))
    parts = parts.select(*keys, "part", F.coalesce(F.sum("t").over(upto(*keys).orderBy("part")), F.lit(0)).alias("first"))
    cells = cells.withColumn("start", F.coalesce(F.sum("t").over(upto(*keys, "part").orderBy("cell")), F.lit(0)))
    return cells.join(parts, [*keys, "part"]).select(*keys, "cell", (F.col("first") + F.col("start")).alias("start"))


def text_hash(text="text"):
    return F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 16)


def mix(docs: DataFrame, weights: dict[tuple, float], fraction: float, max_epochs: int = 1, levels=LEVELS, seed: int = SEED) -> DataFrame:
    """docs' doc_id and levels with text_hash, n_tokens, budget and copies (times that the document is taken, 0 for none), one per input row. The whole budget is `fraction` of all tokens."""
    names = [f"l{i}" for i in range(len(levels))]
    rows = docs.select(
        "doc_id",
        *[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(n) for c, n in zip(levels, names, strict=True)],
        text_hash().alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = stored(rows, "leaves")
    leaf = budgets(stored(rows.groupBy(*names).agg(F.sum("n_tokens").alias("t")), "tokens"), weights, fraction, max_epochs, names)
    budget, whole = F.floor(F.col("budget") + 1e-6), F.floor((F.col("budget") + 1e-6) / F.col("t"))
    leaf = leaf.select(*names, budget.alias("budget"), F.when(F.col("t") > 0, whole).otherwise(0).alias("epochs"), "t")
    leaf = stored(leaf.select(*names, "budget", "epochs", F.when(F.col("t") > 0, F.col("budget") - F.col("epochs") * F.col("t")).otherwise(0).alias("rest")), "budgets")
    # The order of the last, partial epoch is seeded by its number; 48 bits, the first 12 of them being the cell.
    met = rows.join(leaf, names)
    said = F.concat_ws("/", F.lit(seed), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_hash")
    met = met.withColumn("order", F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("long")).withColumn("cell", F.shiftright("order", 36).cast("int"))
    starts = before(met.groupBy(*names, "cell").agg(F.sum("n_tokens").alias("t")), names)
    within = F.sum("n_tokens").over(Window.partitionBy(*names, "cell").orderBy("order", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("within", within).join(starts, [*names, "cell"])
    copies = F.col("epochs") + ((F.col("budget") > 0) & (F.col("start") + F.col("within") <= F.col("rest"))).cast("int")
    return met.select("doc_id", *[F.col(n).alias(c) for n, c in zip(names, levels, strict=True)], "text_hash", "n_tokens", "budget", F.least(copies, F.lit(max_epochs)).cast("int").alias("copies"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(with_domain(docs), WEIGHTS, fraction=0.8, max_epochs=2)


def _level(k: int, path: str, parent: str, budget: str) -> str:
    """SQL of one level of the tree: capacities, rates and budgets of its nodes."""
    by = f"PARTITION BY {parent}" if parent else ""
    on = f"USING ({parent})" if parent else "ON true"
    cols = f"{parent}, " if parent else ""
    group = f"GROUP BY {parent}" if parent else ""
    return f"""n{k} AS (SELECT {path}, sum(cap) AS cap, any_value(w{k}) AS w FROM leaf GROUP BY ALL),
g{k} AS (SELECT {cols}cap / w AS full_at, sum(cap) AS c, sum(w) AS w FROM n{k} WHERE cap > 0 GROUP BY ALL),
s{k} AS (SELECT g{k}.*, {budget} - coalesce(sum(c) OVER ({by} ORDER BY full_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
  sum(w) OVER ({by} ORDER BY full_at ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM g{k} JOIN {f"b{k - 1}" if k else "top"} {on}),
r{k} AS (SELECT {cols}max(left_over / w_left) AS rate FROM s{k} {group}),
b{k} AS (SELECT {path}, CASE WHEN cap > 0 THEN least(cap, rate * w) ELSE 0 END AS b FROM n{k} LEFT JOIN r{k} {on})"""


SQL = rf"""
WITH d AS (SELECT doc_id, 'd' || coalesce(try_cast(list_extract(regexp_extract_all(source, '\d+'), -1) AS BIGINT) % 4, 0) AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
  substr(md5(coalesce(text, '')), 1, 16) AS text_hash, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS t, 2 * sum(n_tokens)::DOUBLE AS cap, any_value(CASE WHEN domain = 'd0' THEN 2 ELSE 1 END)::DOUBLE AS w0,
  any_value(CASE WHEN lang = 'en' THEN 2 ELSE 1 END)::DOUBLE AS w1, 1::DOUBLE AS w2 FROM d GROUP BY ALL),
top AS (SELECT sum(t) * 0.8::DOUBLE AS b FROM leaf),
{_level(0, "domain", "", "b")},
{_level(1, "domain, lang", "domain", "b")},
{_level(2, "domain, lang, source", "domain, lang", "b")},
p AS (SELECT domain, lang, source, t, floor(b + 1e-6)::BIGINT AS budget, CASE WHEN t > 0 THEN floor((b + 1e-6) / t)::BIGINT ELSE 0 END AS epochs FROM b2 JOIN leaf USING (domain, lang, source)),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('5/' || epochs || '/' || doc_id || '/' || text_hash), 1, 12))::BIGINT, doc_id) AS upto FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, text_hash, n_tokens::BIGINT AS n_tokens, budget,
  least(epochs + CASE WHEN budget > 0 AND t > 0 AND upto <= budget - epochs * t THEN 1 WHEN budget > 0 AND t = 0 THEN 1 ELSE 0 END, 2)::INTEGER AS copies FROM o
"""
