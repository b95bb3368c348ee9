"""Language identification by rank-order profiles (operator 10).

A profile is the list of a text's most frequent letter n-grams, most frequent first. A document gets the language
whose profile is nearest by out-of-place distance: the sum over its own n-grams of how far their ranks differ, with
the profile's length for those that are missing. Profiles are learned from labelled rows outside the held-out fold, of
each language from an equal part of SAMPLE_ROWS at most, chosen by a hash of doc_id, so that rare languages are learned too.

Defined cases: a null text or one without letters is `und` with score 0; so is every text if nothing could be
learned; ties go to the first language in alphabetical order, ties of n-grams to the smaller code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import make_room, spread, table

#: Bound on the labelled rows that profiles are learned from, and so on languages: of more, the most frequent ones count.
SAMPLE_ROWS = 20_000
LANGUAGE_GRAMS, DOCUMENT_GRAMS = 600, 400


def letters():
    """For each code point itself if it is a letter, else 0."""
    import numpy as np

    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int32)


class Grams:
    """Counts of 1- to 3-grams of letters in words, each run of other characters being one word border (0).

    An n-gram's number holds its length and its letters' code points, which take 20 bits at most, so no two are alike.
    """

    def __init__(self):
        self.codes = letters()

    def count(self, text: str):
        import numpy as np

        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(text) == 0:
            return none
        c = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        c = np.r_[np.int32(0), c, np.int32(0)]
        c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
        if len(c) < 2:
            return none
        # The text's own alphabet, in which n-grams are small numbers.
        ones = np.bincount(c)
        ones[0] = 1
        alphabet = np.flatnonzero(ones)
        k = len(alphabet)
        place = np.zeros(len(ones), np.int32 if k < 1290 else np.int64)  # 1290 ** 3 fits 31 bits
        place[alphabet] = np.arange(k)
        d = place[c]
        two = d[:-1] * k + d[1:]
        three = (two[:-1] * k + d[2:])[d[1:-1] != 0]  # no n-gram goes on beyond a border
        if k <= 1024:
            n2 = np.bincount(two)
            two = np.flatnonzero(n2)
            n2 = n2[two]
        else:
            two, n2 = np.unique(two, return_counts=True)
        three, n3 = np.unique(three, return_counts=True)
        one = alphabet[1:]
        two = alphabet[two // k] << 20 | alphabet[two % k] | 1 << 60
        three = alphabet[three // (k * k)] << 40 | alphabet[three // k % k] << 20 | alphabet[three % k] | 2 << 60
        return np.r_[one, two, three], np.r_[ones[one], n2, n3]


def labelled(docs: DataFrame, sample_rows: int) -> DataFrame:
    """Rows to learn from: of each language all, or if it has more than its equal part of sample_rows, about so many, by a hash."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows)  # one row a language
    quota = F.greatest(F.lit(1.0), sample_rows / F.count("*").over(Window.partitionBy(F.lit(0))))
    shares = F.broadcast(counts.select("lang", (quota / F.col("n")).alias("share")))  # of sample_rows rows at most
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 11) / F.lit(2.0**53)
    return rows.join(shares, "lang").where((F.col("share") >= 1) | (chance < F.col("share")))


def learn_profiles(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, size: int = LANGUAGE_GRAMS) -> dict[str, list[int]]:
    """Per language its most frequent n-grams: at most `size` numbers a language, so small enough for the driver."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make_room()
        grams = Grams()
        for batch in batches:
            for lang in set(batch.column(0).to_pylist()):
                texts = [t for t, x in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True) if x == lang]
                found = [grams.count(t) for t in texts]
                ids, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([x for _, x in found]), minlength=len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(n)], names=["lang", "gram", "n"])

    counts = labelled(docs, sample_rows).select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(profiles: dict[str, list[int]], doc_grams: int = DOCUMENT_GRAMS):
    langs = sorted(x for x in profiles if profiles[x])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make_room()
        grams = Grams()
        known = []
        for lang in langs:
            ids = np.array(profiles[lang], np.int64)
            order = np.argsort(ids)
            known.append((ids[order], order))
        for batch in batches:
            names, scores = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                ids, n = grams.count(text or "")
                if not len(ids) or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                ids = ids[np.lexsort((ids, -n))][:doc_grams]
                ranks = np.arange(len(ids))
                best, name = None, None
                for lang, (sorted_, order) in zip(langs, known, strict=True):
                    at = np.minimum(np.searchsorted(sorted_, ids), len(sorted_) - 1)
                    size = len(sorted_)
                    far = np.where(sorted_[at] == ids, np.minimum(np.abs(order[at] - ranks), size), size).sum() / (size * len(ids))
                    if best is None or far < best:
                        best, name = far, lang
                names.append(name)
                scores.append(float(1 - best))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]], keep=("doc_id",)) -> DataFrame:
    """Rows (keep..., lang_pred, score); the text alone decides. A column of docs named like an output is left out of keep."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for c in keep for f in docs.schema if f.name == c]
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(predict(profiles), ", ".join([*kinds, "lang_pred string", "score double"]))


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), learn_profiles(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(True))  # a null id is never learned from
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


SQL = None
