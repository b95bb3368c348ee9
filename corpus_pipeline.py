"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, whole texts. All but the last return the columns
of documents. A row is told by all it holds, not by its doc_id alone, so decisions hold for rows whose doc_id is null or
repeated. Defined cases are otherwise those of the operators; a stage over an empty table returns an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonarm import ship
from tonarm.llm.bpe import encode_decode
from tonarm.llm.common import new_path, semi, spread, step, stored
from tonarm.llm.language_id import identify, learn_profiles
from tonarm.llm.line_dedup import line_dedup
from tonarm.llm.mixing import WEIGHTS, mix, text_hash, with_domain
from tonarm.llm.simhash import similar_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates' sets of five-word shingles have a Jaccard similarity of 0.8 or more; their cosine is then 0.89 at
#: least, at which 78 of 512 bits differ on average, with a deviation of 8.
NEAR = {"similarity": 0.8, "shingle": 5, "words": 8, "segments": 32, "sure": 48, "radius": 88}
#: The share of all tokens that the mixture takes, without repeating any document.
MIX_FRACTION = 0.9
TOKENIZER = "word_bpe_49k.json"


#: Rows of an Arrow batch in this job: texts can be long, and workers hold some batches at once.
BATCH_ROWS = 1_000


def ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter; a missing lang is filled in."""
    ready(spark)
    found = identify(docs.select(COLUMNS), learn_profiles(docs), keep=COLUMNS).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that ten documents or more share; every document stays."""
    ready(spark)
    return line_dedup(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays (null last; then the smallest hash of its text; equal rows once)."""
    ready(spark)
    found = similar_groups(docs.select("doc_id", "text"), **NEAR).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = stored(found.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash", "n"), order).alias("k")).select("k.*"), "kept")
    keys = {"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64(F.coalesce("text", F.lit("")))}
    out = semi(docs, kept.where("n = 1"), keys).select(COLUMNS)
    if kept.where("n > 1").isEmpty():
        return out
    rest = [c for c in COLUMNS if c != "doc_id"]
    again = semi(docs, kept.where("n > 1"), keys).groupBy("doc_id", keys["text_hash"].alias("h")).agg(F.min(F.struct(*rest)).alias("r"))
    return out.union(again.select("doc_id", "r.*").select(COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the token budgets of domains, languages and sources take."""
    ready(spark)
    keys = {"doc_id": F.col("doc_id"), "text_hash": text_hash(), "lang": F.coalesce("lang", F.lit("?")), "source": F.coalesce("source", F.lit("?"))}
    mixed = mix(with_domain(docs), WEIGHTS, MIX_FRACTION, max_epochs=1).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("copies") > 0).alias("take"))
    mixed = stored(mixed.where("take > 0"), "taken")
    out = semi(docs, mixed.where("take = n"), keys).select(COLUMNS)
    some = mixed.where("take < n").select(*[F.col(k).alias(f"_{k}") for k in keys], "take")
    if some.isEmpty():
        return out
    # Equal rows that a budget ends among: one key a leaf at most.
    named = docs.select(*COLUMNS, *[c.alias(f"_{k}") for k, c in keys.items()]).withColumnRenamed("_doc_id", "_d")
    met = named.join(some, [F.col("_d").eqNullSafe(some["_doc_id"]), *(named[f"_{k}"] == some[f"_{k}"] for k in keys if k != "doc_id")])
    rank = F.row_number().over(Window.partitionBy("_d", *(named[f"_{k}"] for k in keys if k != "doc_id")).orderBy("lang", "source", "n_chars"))
    return out.union(met.withColumn("rank", rank).where("rank <= take").select(COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text decoded from them."""
    import public_tokenizers

    ready(spark)
    found = encode_decode(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id", "lang", "source"])
    return found.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing sources", mixture), ("BPE", tokens)]

#: Language profiles, fingerprints, seeded budgets and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage{i}")
        with step(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
