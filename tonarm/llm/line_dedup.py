"""Line deduplication (operator 2).

Line hashes are range-partitioned with a secondary sort by document and position; every partition is streamed
once. Of a run of equal hashes only the lines of the first documents are held, until the run is known to reach
`min_docs`; from there on lines pass straight through. What leaves the stream is a compressed bitmap of kept
lines per document, not text.

Defined cases: null text is one empty line; empty keys are never dropped; rows of one doc_id with different texts
are different documents, equal rows are one; extra columns are carried by `apply_bitmaps` unless they are its own.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, row_key, stored, table

MIN_DOCS = 10
MIN_CHARS = 1
LINES = "h1 long, h2 long, doc_id long, row_key long, pos int, n_lines int"
FOUND = "kind int, h1 long, h2 long, doc_id long, row_key long, pos int, n_lines int, n long"
#: kinds of rows that the stream returns
DROP, PENDING, COUNT = 0, 1, 2


def hash_lines(min_chars: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            hashes, rows, places, totals = [], [], [], []
            for i, text in enumerate(binary(batch.column(2))):
                lines = text.split(b"\n")
                for pos, line in enumerate(lines):
                    key = line.strip().lower()  # of bytes: ASCII white space and A-Z alone
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        rows.append(i)
                        places.append(pos)
                        totals.append(len(lines))
            pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), ids.take(take), keys.take(take), pa.array(places, pa.int32()), pa.array(totals, pa.int32())],
                names=["h1", "h2", "doc_id", "row_key", "pos", "n_lines"],
            )

    return run


def stream_runs(min_docs: int):
    """Over rows sorted by hash, document and position: the lines to drop, those that hang on another partition, and the document counts of a partition's first and last runs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ("h1", "h2", "doc_id", "row_key", "pos", "n_lines")
        null = np.iinfo(np.int64).min

        def out(kind, rows, n=None):
            size = len(rows["h1"])
            cols = [pa.array(np.full(size, kind, np.int32))]
            cols += [pa.array(rows[x], mask=(rows[x] == null) if x == "doc_id" else None) for x in names]
            return pa.RecordBatch.from_arrays([*cols, pa.array(n if n is not None else np.zeros(size, np.int64))], names=["kind", *names, "n"])

        def count_of(last, n):
            kinds = [np.int64] * 4 + [np.int32] * 2
            return out(COUNT, {x: np.array([v], k) for x, v, k in zip(names, (*last, 0, 0), kinds, strict=True)}, np.array([n]))

        def cut(rows, mask):
            return {x: v[mask] for x, v in rows.items()}

        held, seen, last, first_open, any_rows = None, 0, None, True, False
        for batch in batches:
            if not batch.num_rows:
                continue
            any_rows = True
            rows = {x: (batch.column(i).fill_null(null) if x == "doc_id" else batch.column(i)).to_numpy(zero_copy_only=False) for i, x in enumerate(names)}
            if held is not None:
                rows = {x: np.concatenate([held[x], rows[x]]) for x in names}
            new_run = np.r_[True, (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])]
            new_doc = new_run | np.r_[True, (rows["doc_id"][1:] != rows["doc_id"][:-1]) | (rows["row_key"][1:] != rows["row_key"][:-1])]
            key = (rows["h1"][0], rows["h2"][0])
            goes_on = last is not None and last[:2] == key  # a run whose first lines have passed already
            if goes_on and last[2:] == (rows["doc_id"][0], rows["row_key"][0]):
                new_doc[0] = False
            if last is not None and not goes_on and first_open:  # the first run ended with a batch
                yield count_of(last, seen)
                first_open = False
            starts = np.flatnonzero(new_run)
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            if goes_on:
                docs[0] += seen
            run_of = np.cumsum(new_run) - 1
            dropped = docs >= min_docs
            final = len(starts) - 1
            if first_open and final > 0:  # the partition's first run has ended
                yield out(COUNT, {x: v[:1] for x, v in rows.items()}, docs[:1])
                if not dropped[0]:
                    yield out(PENDING, cut(rows, run_of == 0))
                first_open = False
            take = dropped[run_of]
            if take.any():
                yield out(DROP, cut(rows, take))
            if dropped[final]:
                held, seen = None, docs[final]
                last = (rows["h1"][-1], rows["h2"][-1], rows["doc_id"][-1], rows["row_key"][-1])
            else:
                held, seen, last = cut(rows, run_of == final), 0, None
        if any_rows:
            if held is not None:
                same = (held["doc_id"][1:] != held["doc_id"][:-1]) | (held["row_key"][1:] != held["row_key"][:-1])
                yield out(COUNT, {x: v[:1] for x, v in held.items()}, np.array([1 + int(same.sum())]))
                yield out(PENDING, held)
            else:
                yield count_of(last, seen)

    return run


def pack(batches):
    """Positions to drop to a zlib-compressed bitmap, a set bit for each line that stays."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        maps = []
        for n, drops in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[drops] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(x) for x in batch.column(3).to_pylist()], pa.int32()), pa.array(maps, pa.binary())], names=["doc_id", "row_key", "n_lines", "n_dropped", "keep"])


def line_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (doc_id, row_key, n_lines, n_dropped, keep) of the documents that lose lines: those whose key stands in min_docs documents or more."""
    spark = docs.sparkSession
    lines = docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), "text").mapInArrow(hash_lines(min_chars), LINES)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(parts, "h1", "h2", "doc_id", "row_key").sortWithinPartitions("h1", "h2", "doc_id", "row_key", "pos")
    found = stored(ranged.mapInArrow(stream_runs(min_docs), FOUND), "lines")
    # At most two counts a partition, so this side is bounded by the number of partitions.
    whole = found.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    pending = found.where(F.col("kind") == PENDING).join(F.broadcast(whole), ["h1", "h2"], "left_semi")
    cols = ["doc_id", "row_key", "n_lines", "pos"]
    drops = found.where(F.col("kind") == DROP).select(cols).union(pending.select(cols))
    return drops.groupBy("doc_id", "row_key").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("drops")).mapInArrow(pack, "doc_id long, row_key long, n_lines int, n_dropped int, keep binary")


def keep_lines(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        texts, sizes, gone = [], [], []
        for text, keep in zip(binary(batch.columns[-2]), batch.columns[-1].to_pylist(), strict=True):
            lines = text.split(b"\n")
            sizes.append(len(lines))
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                text = b"\n".join([x for x, b in zip(lines, bits, strict=True) if b])
                gone.append(len(lines) - int(bits.sum()))
            else:
                gone.append(0)
            texts.append(text)
        rest = batch.schema.names[:-2]
        made = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=[*rest, "text", "n_lines", "n_dropped"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the lines that stay as text, and n_lines and n_dropped; a document without a bitmap stays whole."""
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    left = docs.select(*rest, row_key().alias("_row_key"), F.col("doc_id").cast("long").alias("_row_id"), F.col("text").alias("_row_text"))
    maps = bitmaps.select(F.col("doc_id").alias("_map_id"), F.col("row_key").alias("_map_key"), F.col("keep").alias("_map"))
    met = left.join(maps, left["_row_id"].eqNullSafe(maps["_map_id"]) & (left["_row_key"] == maps["_map_key"]), "left").select(*rest, "_row_text", "_map")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest]
    return met.mapInArrow(keep_lines, ", ".join([*kinds, "text string", "n_lines long", "n_dropped long"]))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    return apply_bitmaps(docs, line_bitmaps(docs, min_docs, min_chars))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: \s of RE2 lacks the vertical tab, so the class is written out.
SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents d, LATERAL (
    SELECT generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(d.text, ''), chr(10))) AS line) u),
bad AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(b.k) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN bad b ON l.k = b.k
GROUP BY l.doc_id
"""
