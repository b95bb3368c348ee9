"""Two-stage retrieval: an exact shortlist by one vector space, a rerank by another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonarm.functions.vectors import align, cosine, l2_normalize, unit_dot

#: About so many prompts, and so many vectors of the corpus, meet in a cell of a batch.
PROMPTS, CELL = 2_000, 100_000
SHORTLIST, TOP = 300, 5
#: Candidates of a batch up to this size, known from the number of prompts, are broadcast to the vectors they are joined to.
BROADCAST_BYTES = 64 << 20
#: Vectors that meet all prompts of a cell in one product.
VECTORS = 2_000


def _met_score(q: str = "_q", unit: str = "_u"):
    """The score of the column embedding: the prompt q, whose unit vector stands beside it, is cut or filled up to the vector's size."""
    size = F.size("embedding")
    fit = F.when(F.size(q) == size, F.col(unit)).otherwise(l2_normalize(align(F.col(q), size)))
    return unit_dot(fit, F.col("embedding"))


def _score(corpus: DataFrame, prompt: DataFrame) -> DataFrame:
    """Rows (index, score): the prompt cut or filled up to the vectors' size, both of length one."""
    one = prompt.limit(1).select(F.col("embedding").alias("_q"), l2_normalize(F.col("embedding")).alias("_u"))
    return corpus.crossJoin(F.broadcast(one)).select("index", _met_score().alias("score"))  # one row


def shortlist(corpus: DataFrame, prompt: DataFrame, n: int = SHORTLIST) -> DataFrame:
    """The n best rows (index, score) of corpus (index, embedding) for one prompt row (embedding): exact, no sort of the corpus.

    A prompt of another size is cut or filled up with zeros; rows without a vector come last, without a score.
    """
    return _score(corpus, prompt).orderBy(F.desc_nulls_last("score"), "index").limit(n)


def rerank(candidates: DataFrame, corpus: DataFrame, prompt: DataFrame, unprocessed: str = "zero") -> DataFrame:
    """Candidates (index) scored anew in corpus: ids outside it drop out of an inner join; with `zero` a null vector scores 0."""
    met = corpus.join(candidates.select("index").distinct(), "index")
    scored = _score(met, prompt)
    return scored.na.fill(0.0, ["score"]) if unprocessed == "zero" else scored.where(F.col("score").isNotNull())


def similarities(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (index, score), cosines of rows (index, embedding) and texts (index, embedding).

    As many texts as rows: each row against the text of its index. Else each row against the first text, that of the least
    index; without any text there are no rows. Other sizes than a row's give an error, as do nulls a null score.
    """
    fits = F.size("embedding") == F.size("_t")
    score = F.when(fits | F.col("embedding").isNull() | F.col("_t").isNull(), cosine(F.col("embedding"), F.col("_t"))).otherwise(F.raise_error(F.lit("vectors of different sizes")))
    if rows.count() == texts.count():
        met = rows.join(texts.select("index", F.col("embedding").alias("_t")), "index")
    else:
        met = rows.crossJoin(F.broadcast(texts.orderBy("index").limit(1).select(F.col("embedding").alias("_t"))))  # one row
    return met.select("index", score.alias("score"))


def ranked(scored: DataFrame, n: int, by=()) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "index"))
    top = scored if by else scored.orderBy(F.desc("score"), "index").limit(n)
    return top.withColumn("rank", rank).where(F.col("rank") <= n)


def recommend(text: DataFrame, audio: DataFrame, text_prompt: DataFrame, audio_prompt: DataFrame, meta: DataFrame, rerank_by: str = "audio", top: int = TOP, n: int = SHORTLIST) -> DataFrame:
    """Rows (rank, index, score, and meta's columns): the two stages and the metadata of the few that stay.

    The `top` results come to the driver, so that their ids are a filter of the scan of meta.
    """
    found = shortlist(text, text_prompt, n)
    scored = rerank(found, audio, audio_prompt) if rerank_by == "audio" else rerank(found, text, text_prompt)
    best = ranked(scored, top).select("rank", "index", "score")
    rows = best.collect()
    few = meta.where(F.col("index").isin([r["index"] for r in rows]))
    return meta.sparkSession.createDataFrame(rows, best.schema).join(few, "index", "left").select("rank", "index", "score", *[c for c in meta.columns if c != "index"])


def one_each(prompts: DataFrame) -> DataFrame:
    """prompts (prompt_id, embedding) with an id and a vector; of repeated ids the least vector."""
    usable = prompts.where("prompt_id IS NOT NULL AND embedding IS NOT NULL")
    return usable.groupBy("prompt_id").agg(F.min("embedding").alias("embedding"))


def _grid(n_prompts: int, n_vectors: int, least: int) -> tuple[int, int]:
    """Blocks of the corpus and blocks of prompts, so that cells are bounded and there are `least` cells at least."""
    columns = max(1, -(-n_prompts // PROMPTS))
    return max(1, -(-n_vectors // CELL), -(-least // columns)), columns


class _Best:
    """The n best of each prompt of a cell."""

    def __init__(self, n: int):
        import numpy as np

        self.n, self.asked, self.ids, self.units = n, [], [], {}
        self.best: list = []
        self.empty = (np.zeros(0), np.zeros(0, np.int64))

    def ask(self, ids, vectors) -> None:
        self.ids += ids.tolist()
        self.asked += list(vectors)
        self.units = {}

    def prompts(self, size: int):
        """Unit vectors of all prompts, cut or filled up to size."""
        import numpy as np

        if size not in self.units:
            q = np.zeros((len(self.asked), size))
            for i, v in enumerate(self.asked):
                q[i, : min(size, len(v))] = v[:size]
            self.units[size] = unit_rows(q)
        return self.units[size]

    def meet(self, ids, vectors) -> None:
        import numpy as np

        if not self.ids:
            return
        self.best = self.best or [self.empty] * len(self.ids)
        x = unit_rows(vectors.astype(float))
        for at in range(0, len(x), VECTORS):
            scores, names = self.prompts(x.shape[1]) @ x[at : at + VECTORS].T, ids[at : at + VECTORS]
            least = np.array([s[-1] if len(s) == self.n else -np.inf for s, _ in self.best])
            better = scores >= least[:, None]
            for i in np.flatnonzero(better.any(axis=1)):
                s, a = np.r_[self.best[i][0], scores[i][better[i]]], np.r_[self.best[i][1], names[better[i]]]
                if len(s) > 4 * self.n:  # the bound is kept with its ties
                    keep = s >= -np.partition(-s, self.n - 1)[self.n - 1]
                    s, a = s[keep], a[keep]
                order = np.lexsort((a, -s))[: self.n]
                self.best[i] = (s[order], a[order])

    def rows(self):
        import numpy as np
        import pyarrow as pa

        if self.best:
            ids = np.repeat(self.ids, [len(s) for s, _ in self.best])
            scores, names = (np.concatenate(x) for x in zip(*self.best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(scores)], names=["prompt_id", "index", "score"])


def unit_rows(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def _cells(n: int):
    """Over rows (r, c, kind, size, id, embedding) sorted by the first four, prompts before vectors: each cell's n best of each prompt."""

    def run(batches):
        import numpy as np

        open_, best = None, None
        for batch in batches:
            r, c, kind, size, ids, vectors = batch.columns
            keys = np.stack([x.to_numpy() for x in (r, c, kind, size)], axis=1)
            cuts = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1), True]) if len(keys) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                cell = tuple(keys[a, :2])
                if cell != open_:
                    if best is not None:
                        yield from best.rows()
                    open_, best = cell, _Best(n)
                part = vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, keys[a, 3])
                (best.meet if keys[a, 2] else best.ask)(ids.slice(a, b - a).to_numpy(), part)
        if best is not None:
            yield from best.rows()

    return run


def _search(corpus: DataFrame, prompts: DataFrame, n: int) -> DataFrame:
    """Rows (prompt_id, index, score): a block of prompts and a block of the corpus meet in each cell, which returns the n best of its prompts."""
    spark = corpus.sparkSession
    corpus = corpus.where("embedding IS NOT NULL")
    rows, columns = _grid(prompts.count(), corpus.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = ["r", "c", "kind", F.size("embedding").alias("size"), "id", "embedding"]
    asked = prompts.select(every(rows).alias("r"), block("prompt_id", columns).alias("c"), F.lit(0).alias("kind"), F.col("prompt_id").cast("long").alias("id"), "embedding")
    there = corpus.select(block("index", rows).alias("r"), every(columns).alias("c"), F.lit(1).alias("kind"), F.col("index").cast("long").alias("id"), "embedding")
    met = asked.select(own).union(there.select(own)).repartition(rows * columns, "r", "c").sortWithinPartitions("r", "c", "kind", "size")
    return met.mapInArrow(_cells(n), "prompt_id long, index long, score double")


def batch_shortlist(corpus: DataFrame, prompts: DataFrame, n: int = SHORTLIST) -> DataFrame:
    """Rows (prompt_id, rank, index, score): all prompts (prompt_id, embedding) at once, in one pass over the corpus.

    A block join: prompts and vectors are dealt to blocks by a hash of their ids, every block of prompts meets every block of
    the corpus in a cell of bounded size, by products of matrices, and cells keep n rows a prompt. No prompt comes to the
    driver or is broadcast; a vector moves once for each block of PROMPTS prompts. Prompts without an id or a vector have
    no rows, those of a repeated id are one (`one_each`).
    """
    return ranked(_search(corpus, one_each(prompts), n), n, ["prompt_id"]).select("prompt_id", "rank", "index", "score")


def batch_recommend(text: DataFrame, audio: DataFrame, text_prompts: DataFrame, audio_prompts: DataFrame, top: int = TOP, n: int = SHORTLIST) -> DataFrame:
    """Rows (prompt_id, rank, index, score): shortlists joined to their vectors in the second space by key."""
    found = batch_shortlist(text, text_prompts, n).select("prompt_id", "index")
    audio_prompts = one_each(audio_prompts)
    if audio_prompts.count() * n * 16 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    asked = audio_prompts.select("prompt_id", F.col("embedding").alias("_q"), l2_normalize(F.col("embedding")).alias("_u"))
    met = found.join(audio, "index").join(asked, "prompt_id")
    scored = met.select("prompt_id", "index", F.coalesce(_met_score(), F.lit(0.0)).alias("score"))
    return ranked(scored, top, ["prompt_id"]).select("prompt_id", "rank", "index", "score")
