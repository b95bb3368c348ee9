"""Ranked lexical search (operator 11): accumulator-limited term-at-a-time evaluation over documents dealt to tasks.

The terms of the query set are numbered; each text is read once, and what it holds of these terms is stored with its
number of terms (`postings`). Counts over all documents follow from that by partial aggregation. Then every task builds
the posting lists of some hundred thousand postings at a time and evaluates each item on them: terms rarest first, one
accumulator a document. Scores of different terms only add up, so a term's greatest score in the lists bounds what it can
still give. Once the bounds of all terms to come, together, are below the kth best partial score (of these lists or of
those that the task has been through), no accumulators are created any more; those that survive are updated to the end,
so all scores are exact. A task returns k rows an item at most, and two windows of a limited number of rows merge them.

Items are dealt by a hash of item_id to slices of about `SLICE_TERMS` terms, each a pass over the documents, so what is
broadcast (terms by item, and counts by term) has a bound that neither documents nor items can push up; only an item's
own text can. Sums need 64 bits.

Defined cases: null and empty texts have no terms and count nowhere; rows of a repeated item_id are one item with the
terms of all, a null item_id is an item too; an item without terms, or without a document of a score above 0, has no
rows. Repeated rows of documents are ranked each; equal scores go by doc_id, null last. Empty tables give no rows.
Only item_id, doc_id and text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread, stored, table

K = 50
SLICE_TERMS = 500_000
#: Postings that a task evaluates together, but for a single document with more.
TOGETHER = 2_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = (bytes(range(a, a + 26)) for a in (65, 97))


def letters_table() -> bytes:
    """For bytes of UTF-8: capitals of ASCII lowered, other ASCII but letters and digits a blank."""
    return bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER, LOWER))


def terms_of(text):
    return F.regexp_extract_all(F.translate(text, UPPER.decode(), LOWER.decode()), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, numbers) -> DataFrame:
    """Rows (doc_id, n, terms, tfs), one for each document with terms: n counts all, terms and tfs (arrays) those in numbers, a broadcast of term: number."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        from .common import binary

        change = letters_table()
        known = numbers.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, text in zip(ids[at : at + 512], binary(texts.slice(at, 512)), strict=True):
                    if words := text.translate(change).split():
                        of = [(known[w], tf) for w, tf in Counter(words).items() if w in known]
                        rows.append((doc_id, len(words), [t for t, _ in of], [tf for _, tf in of]))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """Posting lists of some documents, with every posting's score (which no item changes) and each term's greatest."""

    def __init__(self, lengths, rows, terms, tfs, weights, n_docs: int, n_terms: int):
        """lengths: terms of each document; rows, terms, tfs: its place, term and count for each posting; weights: by term."""
        import numpy as np

        order = np.argsort(terms, kind="stable")
        self.docs, terms, tfs = rows[order], terms[order], tfs[order]
        m = 50 + (50 * lengths * n_docs) // n_terms
        self.scores = weights[terms] * ((1_000_000_000 * tfs) // (1_000 * tfs + 20 * m[self.docs]))
        self.starts = np.searchsorted(terms, np.arange(len(weights) + 1))
        some = np.flatnonzero(np.diff(self.starts))
        self.most = np.zeros(len(weights), np.int64)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.scores, self.starts[some])
        self.size = len(lengths)

    def evaluate(self, terms, k: int, floor: int):
        """Of an item's terms, rarest first: documents and scores, among them all of the k best whose score is floor at least; and how many accumulators there were."""
        import numpy as np

        total, there = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        terms = [t for t in terms if self.most[t]]
        rest = sum(int(self.most[t]) for t in terms)
        creating, survivors = True, np.zeros(0, np.int64)
        for t in terms:
            if creating and rest < max(floor, self._kth(total, k)):
                creating, survivors = False, np.flatnonzero(there)
            at, scores = (x[self.starts[t] : self.starts[t + 1]] for x in (self.docs, self.scores))
            if not creating:
                mine = there[at]
                at, scores = at[mine], scores[mine]
            total[at] += scores  # a document stands in a list once
            if creating:
                there[at] = True
            rest -= int(self.most[t])
        if creating:
            survivors = np.flatnonzero(there)
        return survivors, total[survivors]

    @staticmethod
    def _kth(total, k):
        import numpy as np

        return int(np.partition(total, len(total) - k)[len(total) - k]) if len(total) >= k else 0


def first(ids, missing, scores, k: int):
    """The places of the k best: by score, then doc_id, null last."""
    import numpy as np

    if len(scores) > k:
        few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        few = np.arange(len(scores))
    return few[np.lexsort((ids[few], missing[few], -scores[few]))[:k]]


def best_of_tasks(stored_postings: DataFrame, sent, k: int) -> DataFrame:
    """Rows (item, doc_id, score): each task's k best of each item, by its place in sent."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        items, weights, n_docs, n_terms = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)

        def work(parts):
            ids, missing, lengths, sizes, terms, tfs = (np.concatenate(x) for x in zip(*parts, strict=True))
            lists = Lists(lengths, np.repeat(np.arange(len(ids)), sizes), terms, tfs, weights, n_docs, n_terms)
            for i, item in enumerate(items):
                floor = int(best[i][2][-1]) if len(best[i][2]) == k else 0
                at, scores = lists.evaluate(item, k, floor)
                good = scores > max(floor - 1, 0)
                at, scores = at[good], scores[good]
                if len(at):
                    met = [np.r_[a, b] for a, b in zip(best[i], (ids[at], missing[at], scores), strict=True)]
                    few = first(*met, k)
                    best[i] = tuple(x[few] for x in met)

        parts, size = [], 0
        for batch in batches:
            ids, lengths, terms, tfs = batch.columns
            rows = (
                ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), lengths.to_numpy(), np.diff(terms.offsets.to_numpy()),
                terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(),
            )
            parts.append(rows)
            size += len(rows[4])
            if size >= TOGETHER:
                work(parts)
                parts, size = [], 0
        if parts:
            work(parts)
        out = [(i, *b) for i, b in enumerate(best) if len(b[0])]
        if out:
            places = np.repeat([i for i, *_ in out], [len(b) for _, b, *_ in out])
            ids, missing, scores = (np.concatenate(x) for x in list(zip(*out, strict=True))[1:])
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(ids, pa.int64(), mask=missing), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return stored_postings.mapInArrow(run, "item long, doc_id long, score long")


def merged(found: DataFrame, k: int) -> DataFrame:
    """found: rows (item, doc_id, score) of tasks. The k best an item with rank; tasks first meet in groups, so no window sees the rows of all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    group = F.floor(F.sqrt(F.spark_partition_id().cast("double"))).alias("_g")
    some = found.select("*", group).withColumn("_r", F.row_number().over(Window.partitionBy("item", "_g").orderBy(*order))).where(F.col("_r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): for each of items (item_id, text) its k best documents."""
    spark = docs.sparkSession
    wanted = stored(items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct(), "items")
    slices = max(1, -(-wanted.count() // SLICE_TERMS))
    out = None
    for i in range(slices):
        own = wanted if slices == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i)
        part = _search_slice(spark, docs, own, wanted.schema["item_id"].dataType, k)
        out = part if out is None else out.union(part)
    return out


def _search_slice(spark, docs: DataFrame, wanted: DataFrame, kind, k: int) -> DataFrame:
    pairs = [(r["item_id"], r["term"].encode()) for r in wanted.collect()]  # about SLICE_TERMS
    numbers = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
    sent = spark.sparkContext.broadcast(numbers)
    found = stored(postings(docs, sent), "postings")
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = [0] * len(numbers)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the slice
        df[r["t"]] = r["count"]
    of: dict = {}
    for item, term in pairs:
        of.setdefault(item, []).append(numbers[term])
    names = sorted(of, key=lambda x: (x is None, x))
    ranked = [sorted((t for t in of[x] if df[t]), key=lambda t: (df[t], t)) for x in names]

    import numpy as np

    weights = np.array([term_weight(n_docs, x) if x else 0 for x in df], np.int64)
    best = merged(best_of_tasks(found, spark.sparkContext.broadcast((ranked, weights, n_docs, n_terms)), k), k)
    named = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item long, item_id {kind.simpleString()}")
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # named: the items of a slice


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"
SQL = f"""
WITH q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} FROM benchmark)),
u AS (SELECT doc_id, {_TERMS} FROM documents), d AS (SELECT doc_id, count(*) AS n FROM u GROUP BY 1),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM d),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM u GROUP BY ALL), f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY 1),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
m AS (SELECT doc_id, 50 + (50 * n * nd) // nt AS m FROM d, s),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""
