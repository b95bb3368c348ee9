"""Exact deduplication (operator 6).

A text's fingerprint is a polynomial of its bytes under two primes, composed from independent chunk hashes by
length-shifted arithmetic: H(AB) = H(A) * B^|B| + H(B). Texts of more than `HUGE` bytes are cut into blocks that hash in
tasks of their own, and the blocks' hashes are put together in the order of their places. Rows are range-partitioned by fingerprint, length and
doc_id, so that a group of copies of any size spreads over as many partitions as it fills; each partition is
streamed, and every text is compared chunk by chunk with the classes of its run before it joins one. Classes of a
partition's first and last runs may go on elsewhere. Each of them hands on one text, and these texts, few however large
their groups are, are compared chunk by chunk too: cut into blocks that meet the same block of the first class of equal
fingerprint, length and SHA-256, of which all must be equal; a class that differs (by a collision of both) stays a class of its own.

Defined cases: null text equals the empty text; of equal texts the row with the largest doc_id stays (null is
smallest; of equal rows all carry the same keep_id and `kept` is true for each of them only if it is that id).
Only doc_id and text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binary, spread, stored, table

CHUNK = 1 << 15
#: Bytes of a text beyond which blocks of so many bytes, whole chunks each, are hashed and compared in tasks of their own.
HUGE = 1 << 20
PRIMES = (2_147_483_629, 2_147_483_587)
BASES = (1_000_003, 998_244_353)
OUT = "doc_id long, fp long, size long, sha string, part long, cls long, edge boolean, body binary"


class Polynomial:
    """Chunk hashes and their composition; chunks can be hashed anywhere and combined in any bracketing."""

    def __init__(self, chunk: int = CHUNK):
        import numpy as np

        self.chunk, self.np = chunk, np
        self.powers = []
        for p, b in zip(PRIMES, BASES, strict=True):
            table_, x = [], 1
            for _ in range(chunk):
                table_.append(x)
                x = x * b % p
            self.powers.append(np.array(table_[::-1], np.uint64))

    def of_chunk(self, data: bytes) -> tuple[int, int]:
        x = self.np.frombuffer(data, self.np.uint8).astype(self.np.uint64) + self.np.uint64(1)
        return tuple(int((x * w[self.chunk - len(x) :]).sum()) % p for w, p in zip(self.powers, PRIMES, strict=True))  # at most 2^15 * 2^8 * 2^31

    def combine(self, left: tuple[int, int], right: tuple[int, int], right_size: int) -> tuple[int, int]:
        return tuple((h * pow(b, right_size, p) + k) % p for h, k, b, p in zip(left, right, BASES, PRIMES, strict=True))

    def of(self, data: bytes) -> int:
        whole = (0, 0)
        for at in range(0, len(data), self.chunk):
            part = data[at : at + self.chunk]
            whole = self.combine(whole, self.of_chunk(part), len(part))
        return self.packed(whole)

    @staticmethod
    def packed(whole: tuple[int, int]) -> int:
        return whole[0] << 31 | whole[1]

    @staticmethod
    def unpacked(fp: int) -> tuple[int, int]:
        return fp >> 31, fp & ((1 << 31) - 1)


def fingerprint_rows(batches):
    """Over rows (doc_id, body): the same with fingerprint and size."""
    import pyarrow as pa

    poly = Polynomial()
    for batch in batches:
        texts = binary(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array([poly.of(x) for x in texts], pa.int64()), pa.array([len(x) for x in texts], pa.int64())], names=["doc_id", "body", "fp", "size"])


def fingerprint_blocks(batches):
    """Over rows (key, block, body): (key, block, fp, size)."""
    import pyarrow as pa

    poly = Polynomial()
    for batch in batches:
        bodies = binary(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([poly.of(x) for x in bodies], pa.int64()), pa.array([len(x) for x in bodies], pa.int64())], names=["key", "block", "fp", "size"])


def compose(batches):
    """Over rows (key, blocks): (key, fp, size), the hashes of blocks put together; a block's hash is 24 bytes for HUGE of text."""
    import pyarrow as pa

    poly = Polynomial(1)
    for batch in batches:
        rows = []
        for key, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            whole, size = (0, 0), 0
            for b in sorted(blocks, key=lambda b: b["block"]):
                whole, size = poly.combine(whole, poly.unpacked(b["fp"]), b["size"]), size + b["size"]
            rows.append((key, poly.packed(whole), size))
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "fp", "size"])


def in_blocks(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (keep..., body) as rows (keep..., block, body) of HUGE bytes at most, a row each; an empty body has one."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / HUGE)).cast("int")
    cut = rows.select(*keep, "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return cut.select(*keep, "block", F.expr(f"substring(body, block * {HUGE} + 1, {HUGE})").alias("body"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, body, fp, size), one per input row (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    small = rows.where(F.octet_length("body") <= HUGE).mapInArrow(fingerprint_rows, "doc_id long, body binary, fp long, size long")
    huge = rows.where(F.octet_length("body") > HUGE).withColumn("key", F.sha2("body", 256))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal texts have equal blocks, which may be hashed once or more often, but are put together once.
    blocks = in_blocks(huge, "key").repartition(parts, "key", "block").mapInArrow(fingerprint_blocks, "key string, block int, fp long, size long").distinct()
    named = blocks.groupBy("key").agg(F.collect_list(F.struct("block", "fp", "size")).alias("blocks")).mapInArrow(compose, "key string, fp long, size long")
    return small.union(huge.join(named, "key").select("doc_id", "body", "fp", "size"))


def same(a: bytes, b: bytes) -> bool:
    """Chunkwise, so that a difference early in long texts ends the comparison."""
    return len(a) == len(b) and all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def stream_classes(batches):
    """Classes of equal texts within each run of equal fingerprints of a sorted partition; memory holds one text per class of the open run.

    The classes of the first and the last run are told again at their ends, as rows with `edge` and their text.
    """
    import hashlib

    import pyarrow as pa
    from pyspark import TaskContext

    part, cls, run, classes, first = TaskContext.get().partitionId(), -1, None, [], True
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def last(reps):
        for c, body, sha in reps:
            yield out([(None, *run, sha, part, c, True, body)])

    for batch in batches:
        rows = []
        for doc_id, body, fp, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if run != (fp, size):
                if run is not None and first:
                    yield from last(classes)
                    first = False
                run, classes = (fp, size), []
            for known in classes:
                if same(known[1], body):
                    break
            else:
                cls += 1
                known = (cls, body, hashlib.sha256(body).hexdigest())
                classes.append(known)
            rows.append((doc_id, fp, size, known[2], part, known[0], False, None))
        if rows:
            yield out(rows)
    if run is not None:
        yield from last(classes)


def edge_classes(rows: DataFrame) -> DataFrame:
    """Rows (part, cls, part0, cls0): for each class that was told with its text the first class of the same text, by comparison of all blocks."""
    edges = rows.where("edge").select("fp", "size", "sha", "part", "cls", "body").dropDuplicates(["part", "cls"])
    own = Window.partitionBy("fp", "size", "sha")  # two classes a partition at most
    named = edges.withColumn("f", F.min(F.struct("part", "cls")).over(own)).select("part", "cls", F.col("f.part").alias("part0"), F.col("f.cls").alias("cls0"), "body")
    named = stored(named, "edges")
    firsts = named.where("part = part0 AND cls = cls0")
    others = named.where("NOT (part = part0 AND cls = cls0)")
    there = in_blocks(firsts, "part0", "cls0").withColumnRenamed("body", "first_body")
    met = in_blocks(others, "part", "cls", "part0", "cls0").join(there, ["part0", "cls0", "block"], "left")
    equal = met.groupBy("part", "cls", "part0", "cls0").agg(F.bool_and(F.coalesce(F.col("body") == F.col("first_body"), F.lit(False))).alias("same")).where("same")
    return firsts.select("part", "cls", "part0", "cls0").union(equal.select("part", "cls", "part0", "cls0"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per input row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = fingerprints(docs).repartitionByRange(parts, "fp", "size", "doc_id").sortWithinPartitions("fp", "size")
    rows = stored(ranged.mapInArrow(stream_classes, OUT), "classes")
    edges = edge_classes(rows)
    own = rows.where("not edge").groupBy("part", "cls").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    named = stored(own.join(edges, ["part", "cls"], "left").select("part", "cls", "keep_id", "group_size", F.coalesce("part0", "part").alias("part0"), F.coalesce("cls0", "cls").alias("cls0")), "named")
    whole = named.groupBy("part0", "cls0").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    classes = named.select("part", "cls", "part0", "cls0").join(whole, ["part0", "cls0"])
    out = rows.where("not edge").select("doc_id", "part", "cls", "sha").join(classes, ["part", "cls"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
