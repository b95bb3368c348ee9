"""Suffix-array deduplication (operator 1): bytes covered by strings of LENGTH bytes that also start elsewhere.

Suffixes that can share LENGTH bytes are first brought together. Every window of LENGTH bytes has an anchor, the
least hash among its strings of ANCHOR bytes; equal windows have equal anchors at the same place. Runs of windows with
one anchor are segments. Segments whose anchor stands once are done; of segments that are equal as a whole one is kept
and all are repeated. What is left, segments that share an anchor but differ, is cut into pieces of windows that have a
core of bytes around the anchor in common; pieces are dealt into shards by their core, the core is written as one number,
and every shard is suffix-sorted by external induced sorting (`induced`), whose common-prefix values tell the
repeated windows. Pieces of a core that more than CORE_ROWS have are not sorted: each of their windows is a 128-bit hash, and
repeated hashes are counted by partial aggregation.

Sizes: hashes of about 2 / (LENGTH - ANCHOR + 2) of all bytes are shuffled; texts are compressed before they move.
No step holds more than a document, an Arrow batch or a shard of about SHARD_BYTES.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; matches never cross rows; rows of
one doc_id with different texts are different documents, and repeated rows are copies of each other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binary, spread, stored, table

LENGTH, ANCHOR = 200, 64
#: Classes of windows by the place of their anchor.
CUTS = 4
SHARD_BYTES = 2 << 20
#: Pieces with one core that may go to one shard; of more, the windows are told by 128-bit hashes and counted.
CORE_ROWS = 5_000
#: Keys of such cores that are broadcast (16 bytes each); more are joined by a shuffle.
FEW_KEYS = 1_000_000
#: Bytes of texts whose anchors are found at a time; places within them fit PLACE bits.
BLOCK_BYTES, PLACE = 1 << 20, 22
SEGMENTS = "mhash long, digest long, doc_id long, row_key long, loc long"


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Anchors:
    """Segments of texts: runs of windows with one anchor."""

    BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64

    def __init__(self, length: int, anchor: int):
        import numpy as np

        self.length, self.anchor, self.np = length, anchor, np
        self.letters = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(3))
        self.grow(BLOCK_BYTES)

    def grow(self, n: int) -> None:
        np = self.np
        self.power, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))

    def of(self, texts: list[bytes]):
        """Arrays (text, first window, windows, place of the anchor after the first, anchor hash, digest), block by block."""
        block, size, first = [], 0, 0
        for i, t in enumerate(texts):
            if block and size + len(t) > BLOCK_BYTES:
                yield self.block(block, first)
                block, size, first = [], 0, i
            block.append(t)
            size += len(t)
        if block:
            yield self.block(block, first)

    def block(self, texts: list[bytes], first: int):
        from xxhash import xxh3_64_intdigest

        np, k = self.np, self.anchor
        w = self.length - k + 1
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        n = len(data)
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none, none, none, none
        if n >= len(self.power):
            self.grow(n)
        if n >= 1 << 40:
            raise ValueError("a text of more than 2^40 bytes")
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        sums = np.r_[np.uint64(0), np.cumsum(self.letters[data] * self.power[:n], dtype=np.uint64)]
        h = _mix((sums[k:] - sums[:-k]) * self.inverse[: n - k + 1])
        bits = max(PLACE, n.bit_length())
        key = h >> np.uint64(bits) << np.uint64(bits) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
        low, span = key, 1
        while span * 2 <= w:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        at = (low & np.uint64((1 << bits) - 1)).astype(np.int64)  # the anchor of the window at each place
        text = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
        p = np.flatnonzero(np.arange(len(at)) + self.length <= ends[text])
        if not len(p):
            return none, none, none, none, none, none
        a, d = at[p], text[p]
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
        count = np.diff(np.r_[start, len(p)])
        s, m, of = p[start], a[start], d[start]
        end = s + count - 1 + self.length
        # Of the bytes, with the numbers of windows and the anchor's place as the seed.
        digest = np.array([xxh3_64_intdigest(whole[a:b], x) for a, b, x in zip(s.tolist(), end.tolist(), (count * 1024 + (m - s)).tolist(), strict=True)], np.uint64)
        return of + first, s - (ends - sizes)[of], count, m - s, h[m].view(np.int64), digest.view(np.int64)


def segment_rows(length: int, anchor: int, hashes_only: bool):
    def run(batches):
        import pyarrow as pa

        find = Anchors(length, anchor)
        for batch in batches:
            for of, s, n, o, h, digest in find.of(binary(batch.column(2))):
                if hashes_only:
                    yield pa.RecordBatch.from_arrays([pa.array(h)], names=["mhash"])
                else:
                    take = pa.array(of)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(digest), batch.column(0).take(take), batch.column(1).take(take), pa.array(s << 20 | n << 10 | o)], names=["mhash", "digest", "doc_id", "row_key", "loc"])

    return run


def compress(batches):
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([pack(t) for t in binary(batch.columns[-1])], pa.binary())], names=[*batch.schema.names[:-1], "packed"])


def pieces(length: int, anchor: int):
    """The windows of a document's segments, by the place of their anchor in CUTS classes.

    All windows of a class share a core of bytes around the anchor: a piece is what is left of the core, what is
    right of it, and the core's hash of 128 bits as the key that equal windows have in common.
    """
    width = -(-(length - anchor + 1) // CUTS)

    def run(batches):
        import pyarrow as pa
        import zstandard
        from xxhash import xxh3_128_digest

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc_id, row_key, packed, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = unpack(packed)
                for x in found:
                    s, n, o = x["loc"] >> 20, x["loc"] >> 10 & 1023, x["loc"] & 1023
                    m = s + o
                    for i in range(CUTS):
                        lo, hi = i * width, (i + 1) * width - 1
                        a, b = max(s, m - hi), min(s + n - 1, m - lo)
                        if a <= b:
                            left, right = m - lo, m - hi + length
                            key = xxh3_128_digest(text[left:right], i)
                            rows.append((int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), doc_id, row_key, a, x["single"], text[a:left], text[right : b + length], b - a + 1))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32())
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["k1", "k2", "doc_id", "row_key", "start", "single", "lhs", "rhs", "n"])

    return run


def sort_shard(length: int, anchor: int):
    """A partition is a shard: its pieces' repeated windows, as spans of bytes of their documents. A core is one number of three symbols."""
    width = -(-(length - anchor + 1) // CUTS)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .induced import repeated_windows

        where, bodies, marks, cores = [], [], [], {}
        for batch in batches:
            for k1, k2, doc_id, row_key, start, single, lhs, rhs, n in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                where.append((doc_id, row_key, start, single, n))
                bodies.append(lhs + b"   " + rhs)
                marks.append((len(lhs), cores.setdefault((k1, k2), len(cores))))
        out = []
        for (doc_id, row_key, start, single, n), hit in zip(where, repeated_windows(bodies, width + 2, marks), strict=True):
            if single and hit.any():
                edge = np.flatnonzero(np.diff(np.r_[0, hit[:n].astype(np.int8), 0]))
                out += [(doc_id, row_key, start + int(a), start + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "row_key", "a", "b"])

    return run


def windows(length: int):
    """Over pieces: each of their windows as a hash of 128 bits of the core's key and the bytes left and right of it."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

        def out(rows):
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["w1", "w2", "doc_id", "row_key", "a", "single"])

        for batch in batches:
            rows = []
            for k1, k2, doc_id, row_key, start, single, lhs, rhs, n in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                core = k1.to_bytes(8, "little", signed=True) + k2.to_bytes(8, "little", signed=True)
                for i in range(n):
                    said = lhs[i:]
                    w = xxh3_128_digest(core + said + rhs[: len(rhs) - (n - 1 - i)], len(said))
                    rows.append((int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True), doc_id, row_key, start + i, single))
                if len(rows) > 100_000:
                    yield out(rows)
                    rows = []
            yield out(rows)

    return run


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows (doc_id, row_key, keep..., text): a null doc_id is replaced by a second hash of the text, so that 128 bits tell such rows apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), text)).alias("doc_id"), F.xxhash64(text).alias("row_key"), *keep, "text")


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Rows (doc_id, row_key, a, b): spans [a, b) of bytes covered by repeated windows; they may overlap."""
    rows = keyed(docs)
    again = rows.mapInArrow(segment_rows(length, anchor, True), "mhash long").groupBy("mhash").count().where("count > 1").select("mhash")
    again = stored(again, "again")  # so that the join below is of two plain exchanges, whose hot keys Spark can split
    found = stored(rows.mapInArrow(segment_rows(length, anchor, False), SEGMENTS).join(again, "mhash", "left_semi"), "segments")
    where = F.struct("doc_id", "row_key", "loc")
    classes = stored(found.groupBy("mhash", "digest").agg(F.count("*").alias("n"), F.min(where).alias("rep")), "classes")
    # Segments that are equal as a whole, all windows of them.
    whole = found.join(classes.where("n > 1").select("mhash", "digest"), ["mhash", "digest"], "left_semi")
    s, n = F.shiftright("loc", 20), F.shiftright("loc", 10).bitwiseAND(1023)
    whole = whole.select("doc_id", "row_key", s.alias("a"), (s + n - 1 + length).alias("b"))
    # Anchors of several classes, one of them at least with a single member, whose windows are not known yet.
    mixed = classes.groupBy("mhash").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("singles")).where("k > 1 and singles > 0").select("mhash")
    mixed = stored(mixed, "mixed")
    reps = classes.join(mixed, "mhash", "left_semi").select("rep.*", (F.col("n") == 1).alias("single"))
    by_doc = reps.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("loc", "single")).alias("found"))
    texts = rows.mapInArrow(compress, "doc_id long, row_key long, packed binary").dropDuplicates(["doc_id", "row_key"])
    met = texts.join(by_doc, ["doc_id", "row_key"]).select("doc_id", "row_key", "packed", "found")
    cut = stored(met.mapInArrow(pieces(length, anchor), "k1 long, k2 long, doc_id long, row_key long, start long, single boolean, lhs binary, rhs binary, n int"), "pieces")
    shared = cut.groupBy("k1", "k2").agg(F.count("*").alias("k"), F.count_if("single").alias("singles"), F.sum(F.octet_length("lhs") + F.octet_length("rhs") + 4).alias("size")).where("k > 1 and singles > 0")
    shared = stored(shared, "keys")
    few = shared.where(F.col("k") <= CORE_ROWS)
    size = few.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    dealt = cut.join(few.select("k1", "k2"), ["k1", "k2"], "left_semi").repartition(shards, "k1", "k2")
    found = whole.union(dealt.mapInArrow(sort_shard(length, anchor), "doc_id long, row_key long, a long, b long"))
    many = shared.where(F.col("k") > CORE_ROWS).select("k1", "k2")
    many = F.broadcast(many) if many.count() <= FEW_KEYS else many
    hot = cut.join(many, ["k1", "k2"], "left_semi")
    hot = stored(hot.mapInArrow(windows(length), "w1 long, w2 long, doc_id long, row_key long, a long, single boolean"), "windows")
    twice = stored(hot.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"), "twice")
    return found.union(hot.where("single").join(twice, ["w1", "w2"], "left_semi").select("doc_id", "row_key", "a", (F.col("a") + length).alias("b")))


def merged_spans(spans: DataFrame) -> DataFrame:
    """Rows (doc_id, row_key, a, b): of each text the spans that touch or overlap as one, put together in order of their starts,
    before a text's spans are gathered: there are length / 2 times fewer of them than bytes, at most."""
    own = Window.partitionBy("doc_id", "row_key").orderBy("a", "b")
    before = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce(F.col("a") > before, F.lit(True)).cast("long"))
    runs = marked.withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "row_key", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def cut_spans(batches):
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = unpack(packed)
            kept, at, runs = [], 0, 0
            last = None
            for x in sorted(((x["a"], x["b"]) for x in spans or ())):
                if last is None or x[0] > last:
                    runs += 1
                    kept.append(text[at : x[0]])
                    last = x[1]
                else:
                    last = max(last, x[1])
                at = last
            kept.append(text[at:])
            kept = b"".join(kept)
            out.append((len(text), len(text) - len(kept), runs, kept))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def substring_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept), one per input row; kept is the bytes that stay."""
    spans = merged_spans(repeated_spans(docs, length, anchor)).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    texts = keyed(docs.withColumn("_id", F.col("doc_id").cast("long")), "_id").mapInArrow(compress, "doc_id long, row_key long, _id long, packed binary")
    return texts.join(spans, ["doc_id", "row_key"], "left").select(F.col("_id").alias("doc_id"), "packed", "spans").mapInArrow(cut_spans, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = None
