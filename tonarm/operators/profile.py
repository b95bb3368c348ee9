"""Profiles of tables and tag lists: counts of nulls, tags, tokens and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonarm.operators.quantiles import exact_quantiles
from tonarm.storage import stored


def column_profile(df: DataFrame, columns=None) -> DataFrame:
    """Rows (column_name, non_null, nulls), from one aggregation over the table."""
    columns = list(columns or df.columns)
    one = df.agg(F.count("*").alias("_all"), *[F.count(c).alias(c) for c in columns])
    long = one.unpivot("_all", columns, "column_name", "non_null")
    return long.select("column_name", "non_null", (F.col("_all") - F.col("non_null")).alias("nulls"))


def drop_sparse(df: DataFrame, least: int) -> DataFrame:
    """Without columns of fewer than `least` values; one row is read by the driver."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, n in counts.items() if n < least])


def missing_stats(df: DataFrame, lists) -> DataFrame:
    """Rows (tag_type, status, n): how often each list is missing or present."""
    flags = df.select(*[F.when(F.col(c).isNull(), "missing").otherwise("present").alias(c) for c in lists])
    return flags.unpivot([], list(lists), "tag_type", "status").groupBy("tag_type", "status").agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, group: str | None, value: str) -> DataFrame:
    """Quartiles and whiskers: the extreme values within 1.5 quartile distances of the box; of each group, or of all rows (one row)."""
    g, v = (F.col(group) if group else F.lit(0)).alias("g"), F.col(value).cast("double")
    rows = stored(df.select(g, v.alias("v")), "box")
    q = exact_quantiles(rows, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "g").withColumnRenamed("g", "_g")
    step = 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.join(q, F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("q1") - step, F.col("q3") + step))
    box = inside.groupBy("g", "q1", "median", "q3").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return box.withColumnRenamed("g", group) if group else box.drop("g")


def tag_counts(df: DataFrame, lists) -> DataFrame:
    """Rows (tag_type, n_tags), one for each row and list; a null list has none."""
    return df.select(*[F.coalesce(F.size(c), F.lit(0)).alias(c) for c in lists]).unpivot([], list(lists), "tag_type", "n_tags")


def top_tags(df: DataFrame, lists, n: int = 15) -> DataFrame:
    """The n most frequent tags of each list: counted first, so that the window sees only counts."""
    each = None
    for c in lists:
        part = df.select(F.lit(c).alias("tag_type"), F.explode(c).alias("tag"))
        each = part if each is None else each.unionByName(part)
    counts = each.groupBy("tag_type", "tag").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("tag_type").orderBy(F.desc("n"), "tag"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def combinations(df: DataFrame, tags: str) -> DataFrame:
    return df.groupBy(F.to_json(tags).alias("combination")).agg(F.count("*").alias("n"))


def top_items(df: DataFrame, items: Column, name: str, n: int) -> DataFrame:
    """The n most frequent items of lists; ties by item. Empty items go after the counts, so no filter makes the lists a second time."""
    counts = df.select(F.explode_outer(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return counts.where(F.col(name) != "").orderBy(F.desc("n"), name).limit(n)


#: Tokens that are broadcast, with what is known of them, are fewer than this; only the others' rows are shuffled by token.
COMMON = 1 << 20


def _per_token(tf: DataFrame) -> DataFrame:
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def _by_token(tf: DataFrame, common: int, often, seldom) -> DataFrame:
    """Joins tf with often(counts), rows (token, ...) made of rows (token, df) of the common tokens, by broadcast; seldom(rows) does the same for the rows of the rare ones.

    A common token has more than a `common`-th of all rows, so there are fewer than `common` of them; most rows are theirs
    and stay where they are. Rare tokens have few rows each, so none is too large for a task.
    """
    least = tf.count() // common + 1
    known = often(_per_token(tf).where(F.col("df") >= least))
    if least == 1:
        return tf.join(F.broadcast(known), "token")
    known = stored(known, "common")
    rest = tf.join(F.broadcast(known.select("token")), "token", "left_anti")
    return tf.join(F.broadcast(known), "token").unionByName(seldom(rest))


def _with_df(tf: DataFrame, common: int) -> DataFrame:
    count = F.count("*").over(Window.partitionBy("token"))
    return _by_token(tf, common, lambda counts: counts, lambda rows: rows.withColumn("df", count))


def _with_stems(tf: DataFrame, common: int, stemmer) -> DataFrame:
    """tf with a column _stem; the stemmer sees each distinct token once."""
    named = lambda tokens: tokens.select("token", stemmer(F.col("token")).alias("_stem"))
    return _by_token(tf, common, named, lambda rows: rows.join(named(rows.select("token").distinct()), "token"))


def tfidf(df: DataFrame, key: str, tokens: Column, top: int = 5, stemmer=None, common: int = COMMON) -> DataFrame:
    """Rows (key, token, tf, df, weight, rank): tf * (ln((1 + N) / (1 + df)) + 1), the top tokens of each document; N counts documents with tokens or without.

    Texts are tokenised once. They are dealt by key, so that a document's counts are stored in one place and most of them are
    ruled out there; counts of documents come from what is stored. With a stemmer (a function of a column) tokens of one
    stem count together; it sees each distinct token once.
    """
    # A given number is not merged: from a text come many rows, so tasks sized by texts would spill.
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # explode_outer: the null of a list without tokens goes after the exchange, so no filter tokenises a second time.
    tf = df.repartition(n_parts, key).select(key, F.explode_outer(tokens).alias("token")).groupBy(key, "token").agg(F.count("token").alias("tf"))
    tf = stored(tf, "tf").where("token IS NOT NULL")
    if stemmer is not None:
        tf = _with_stems(tf, common, stemmer).select(key, F.col("_stem").alias("token"), "tf")
        tf = stored(tf.repartition(n_parts, key).groupBy(key, "token").agg(F.sum("tf").alias("tf")), "stems")
    n = df.agg(F.count("*").alias("n_docs"))
    met = _with_df(tf, common).crossJoin(F.broadcast(n))  # one row
    weight = F.round(F.col("tf") * (F.ln((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0), 6)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "token"))
    return met.select(key, "token", "tf", "df", weight.alias("weight")).withColumn("rank", rank).where(F.col("rank") <= top)


def inspection_sample(df: DataFrame, key: str, n: int, seed: int = 0, by: str | None = None) -> DataFrame:
    """A repeatable random sample of n rows, of each value of the column `by` if one is given (a flag, or a few kinds)."""
    order = [F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    if by is None:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def fixed_rows(df: DataFrame, key: str, values) -> DataFrame:
    """The rows of given keys, to look at after each run."""
    return df.where(F.col(key).isin(*values))
