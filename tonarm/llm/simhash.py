"""SimHash near-deduplication (operator 3).

Every text gets a fingerprint of its word shingles, of 64 bits or a multiple. Distinct fingerprints are dealt into
tiles by segments of their bits. With radius + 1 segments, two fingerprints within the radius agree on one at least, so
every link lies inside a tile; wider fingerprints with a radius too large for that take narrower segments, which find
links with a probability that is stated where they are used. Tiles are compared exactly by numpy XOR and bit counts;
large tiles are ordered by population count and cut into blocks, and block pairs whose counts differ beyond the radius
are skipped. A tile returns a spanning forest of its links, never all pairs; forests of all tiles meet in a distributed
components job.

simhash_groups takes the fingerprints' word for it. similar_groups links texts of a given similarity of their sets of
shingles, every link computed exactly: wide fingerprints find most pairs; what they miss is found by the rarest shingles of
each text, of which similar texts must have one in common. A parity
map of the set (one bit for each of 512 classes of shingles: whether an odd number falls into it) rules out pairs before any
text is read: two maps differ in no more bits than the sets have elements apart.

Defined cases: null text is empty; a text of fewer words than a shingle is one shingle, without words the fingerprint
is zero and links like any other; equal rows share a fingerprint; a null doc_id takes part but names no component
unless all its members are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binary, components, make_room, spread, stored, table

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints of one tile in one task; larger tiles are dealt into pairs of parts of about this size.
TILE = 16_384
#: Rows of a block of the comparison.
BLOCK = 1_024


def _more(h, j: int):
    """The j-th further hash of a shingle's hash."""
    import numpy as np

    x = h + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(text: bytes, shingle: int = SHINGLE, seed: int = SEED):
    """XXH64 of each word shingle of a text in UTF-8, in order and with repeats; empty without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    said = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not said:
        return np.zeros(0, np.uint64)
    joined = b" ".join(said)
    n = max(1, len(said) - shingle + 1)
    if n == 1:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in said]).tolist()
    starts = [0, *ends[: n - 1]]
    return np.array([xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], np.uint64)


def fingerprints_of(texts, shingle: int = SHINGLE, seed: int = SEED, words: int = 1, distinct: bool = False):
    """An array of a row of 64-bit words for each text (UTF-8); the first word is of the XXH64 hashes themselves.

    distinct: each shingle counts once, and the set's parity map (as many words) and its size follow.
    """
    import numpy as np

    marks = np.zeros((len(texts), 2 * words + 1 if distinct else words), np.uint64)
    for i, text in enumerate(texts):
        h = shingles_of(text, shingle, seed)
        if distinct:
            h = np.unique(h)
            odd = np.bincount((h % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
            marks[i, words:-1] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
            marks[i, -1] = len(h)
        for j in range(words):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 8192):
                part = h[at : at + 8192] if j == 0 else _more(h[at : at + 8192], j)
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            marks[i, j] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return marks


def _names(words: int, sets: bool = False) -> list[str]:
    return [f"w{j}" for j in range(words)] + ([*(f"p{j}" for j in range(words)), "n"] if sets else [])


def fingerprint(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, words: int = 1, distinct: bool = False, keep=("doc_id",)) -> DataFrame:
    """Rows (keep..., w0, ...): columns of docs as longs, and each word of the fingerprint as a signed long; distinct: and p0, ..., n of the set."""
    names = _names(words, distinct)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make_room()
        for batch in batches:
            marks = fingerprints_of(binary(batch.column(batch.num_columns - 1)), shingle, seed, words, distinct)
            marks = [pa.array(np.ascontiguousarray(marks[:, j]).view("i8")) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *marks], names=[*keep, *names])

    return docs.select(*[F.col(c).cast("long").alias(c) for c in keep], "text").mapInArrow(run, ", ".join(f"{x} long" for x in [*keep, *names]))


def join_labels(labels, a, b):
    """Minimum labels over links a-b, in place: hooking and pointer jumping until nothing changes."""
    import numpy as np

    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := labels[labels], labels):
            labels[:] = nxt


def link_tile(fp, labels, base, radius):
    """Exact comparison of one large tile, sorted by population count, block pair by block pair."""
    import numpy as np

    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    for i in range(0, len(fp), BLOCK):
        for j in range(i, len(fp), BLOCK):
            if ones[j] - ones[min(i + BLOCK, len(fp)) - 1] > radius:
                break
            far = 0
            for w in range(fp.shape[1]):
                far = far + np.bitwise_count(fp[i : i + BLOCK, w][:, None] ^ fp[None, j : j + BLOCK, w]).astype(np.int16)
            a, b = np.nonzero(far <= radius)
            a, b = a + i + base, b + j + base
            ahead = (a < b) & (labels[a] != labels[b])
            if ahead.any():
                join_labels(labels, a[ahead], b[ahead])


def link(keys, fp, radius):
    """Spanning forest (a, b), as row numbers, of the links within runs of equal keys, of rows sorted by key and population count."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1)])
    sizes = np.diff(np.r_[starts, len(fp)])
    labels = np.arange(len(fp))
    small = sizes <= 128
    run = np.repeat(np.arange(len(starts)), sizes)
    run = np.where(np.repeat(small, sizes), run, -1 - np.arange(len(fp)))
    for lag in range(1, int(sizes[small].max(initial=1))):
        a = np.flatnonzero(run[:-lag] == run[lag:])
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]).sum(axis=1, dtype=np.int64) <= radius]
        if len(a):
            join_labels(labels, a, a + lag)
    for at, n in zip(starts[~small], sizes[~small], strict=True):
        link_tile(fp[at : at + n], labels, at, radius)
    child = np.flatnonzero(labels != np.arange(len(fp)))
    return child, labels[child]


def nearest_few(a, b, far, most):
    """Of pairs a-b those among the `most` nearest of either end, and the ends that have more pairs than that."""
    import numpy as np

    x, y, far = np.r_[a, b], np.r_[b, a], np.r_[far, far]
    order = np.lexsort((y, far, x))
    x, y = x[order], y[order]
    rank = np.arange(len(x)) - np.searchsorted(x, x)
    near = rank < most
    pairs = np.unique(np.stack([np.minimum(x, y)[near], np.maximum(x, y)[near]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1], x[rank == most]


#: A distance beyond any radius.
TOO_FAR = 1 << 14


class Bits:
    """Distances of fingerprints, rows being in order of population count."""

    def __init__(self, words: int, radius: int):
        self.words, self.radius = words, radius

    def far(self, a, b):
        """a, b: the columns of rows, shaped to meet."""
        import numpy as np

        return sum(np.bitwise_count(a[w] ^ b[w]).astype(np.int16) for w in range(self.words))

    def order(self, fp):
        import numpy as np

        return np.bitwise_count(fp[:, : self.words]).sum(axis=1, dtype=np.int64)

    def beyond(self, least: int, most: int) -> bool:
        """Whether rows from `least` on in their order are out of reach of rows up to `most`."""
        return least - most > self.radius


class Sets(Bits):
    """The same where sets can be similar, and TOO_FAR where they cannot; rows in order of the sets' sizes."""

    def __init__(self, words: int, similarity: float):
        super().__init__(words, 64 * words)
        self.similarity = similarity

    def far(self, a, b):
        import numpy as np

        w, s = self.words, self.similarity
        n, m = a[2 * w].astype(np.float32), b[2 * w].astype(np.float32)
        apart = sum(np.bitwise_count(a[i] ^ b[i]).astype(np.int16) for i in range(w, 2 * w))
        low = np.minimum(n, m)
        fine = (low >= s * np.maximum(n, m) - 1e-3) & (apart * (1 + s) <= (1 - s) * (n + m) + 1e-3)
        return np.where(fine, super().far(a, b), TOO_FAR)

    def order(self, fp):
        return fp[:, 2 * self.words].astype("i8")

    def beyond(self, least: int, most: int) -> bool:
        return most < self.similarity * least - 1e-3


def sift(keys, fp, root, sure, by: Bits, most):
    """Row numbers of rows sorted by key and by by.order: links (a, b) within `sure` bits that join roots; pairs (a, b) beyond
    it and within the radius, of different components, the `most` nearest of each row and block; rows that have more."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1)])
    sizes = np.diff(np.r_[starts, len(fp)])
    _, first, of = np.unique(root, return_index=True, return_inverse=True)
    before = first[of]
    labels = before.copy()
    pairs = []
    columns = list(fp.T)

    def take(a, b, far):
        near = far <= sure
        if near.any():
            join_labels(labels, a[near], b[near])
        return a[~near], b[~near], far[~near]

    def add(a, b, far):
        apart = labels[a] != labels[b]
        if apart.any():
            pairs.append(nearest_few(a[apart], b[apart], far[apart], most))

    small = sizes <= 128
    run = np.repeat(np.arange(len(starts)), sizes)
    run = np.where(np.repeat(small, sizes), run, -1 - np.arange(len(fp)))
    mid = []
    for lag in range(1, int(sizes[small].max(initial=1))):
        a = np.flatnonzero(run[:-lag] == run[lag:])
        far = by.far([c[a] for c in columns], [c[a + lag] for c in columns]).astype(np.int64)
        a, far = a[far <= by.radius], far[far <= by.radius]
        mid.append(take(a, a + lag, far))
    if mid:
        add(*(np.concatenate(x) for x in zip(*mid, strict=True)))
    for at, n in zip(starts[~small], sizes[~small], strict=True):
        tile = [c[at : at + n] for c in columns]
        order = by.order(fp[at : at + n])
        for i in range(0, n, BLOCK):
            for j in range(i, n, BLOCK):
                if by.beyond(order[j], order[min(i + BLOCK, n) - 1]):
                    break
                far = by.far([c[i : i + BLOCK, None] for c in tile], [c[None, j : j + BLOCK] for c in tile])
                a, b = np.nonzero(far <= by.radius)
                far, a, b = far[a, b].astype(np.int64), a + i, b + j
                ahead = a < b
                add(*take(a[ahead] + at, b[ahead] + at, far[ahead]))
    child = np.flatnonzero(labels != before)
    a, b, more = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in range(3))
    return child, labels[child], a, b, np.unique(more)


def gathered(batches, rows: int = 8_192):
    """Columns of batches put together to at least so many rows, but for the last."""
    import numpy as np

    waiting, n = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(x) for x in zip(*waiting, strict=True)]
            waiting, n = [], 0
    if waiting:
        yield [np.concatenate(x) for x in zip(*waiting, strict=True)]


def by_tile(batches, n_keys: int, work):
    """Yields work(columns) over whole tiles of batches sorted by their first n_keys columns."""
    import numpy as np

    make_room()
    held = None
    for cols in gathered(batches):
        rows = [np.stack(cols[:n_keys], axis=1), cols[n_keys], cols[n_keys + 1], np.stack(cols[n_keys + 2 :], axis=1).view(np.uint64)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        # The last tile may go on in the next batch.
        other = np.flatnonzero(np.any(rows[0] != rows[0][-1], axis=1))
        end = int(other[-1]) + 1 if len(other) else 0
        if end:
            yield work(*(x[:end] for x in rows))
        held = [x[end:] for x in rows]
    if held is not None:
        yield work(*held)


def tile_links(radius: int):
    """Over rows (seg, key, x, y, v, root, words...) sorted by tile: links between vertices v."""

    def run(batches):
        import pyarrow as pa

        def work(keys, v, root, fp):
            a, b = link(keys, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(v[a]), pa.array(v[b])], names=["a", "b"])

        yield from by_tile(batches, 4, work)

    return run


SURE, PAIR, MORE = 0, 1, 2


def tile_pairs(sure: int, by: Bits, most: int):
    """Over the same rows: sift's findings as (a, b, kind) of vertices."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def work(keys, v, root, fp):
            child, parent, a, b, more = sift(keys, fp, root, sure, by, most)
            kind = np.repeat(np.array([SURE, PAIR, MORE], np.int32), [len(child), len(a), len(more)])
            a, b = v[np.r_[child, a, more]], v[np.r_[parent, b, more]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(kind)], names=["a", "b", "kind"])

        yield from by_tile(batches, 4, work)

    return run


def tiles(marks: DataFrame, words: int, segments: int) -> DataFrame:
    """marks: rows (v, root, w0, ...) of distinct fingerprints. Rows (seg, key, x, y, v, root, words...) dealt and sorted by tile."""
    names = _names(words)
    per_word = -(-segments // words)
    cuts = [round(64 * i / per_word) for i in range(per_word + 1)]
    parts = [
        F.struct(F.lit(i * words + j).cast("long").alias("seg"), F.shiftrightunsigned(name, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("key"))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
        for j, name in enumerate(names)
    ]
    return cells(marks.select("v", "root", *names, F.explode(F.array(*parts)).alias("t")).select("t.*", "v", "root", *names), names)


def cells(dealt: DataFrame, names: list[str], order=None) -> DataFrame:
    """dealt: rows (seg, key, v, root, words...). Rows (seg, key, x, y, v, root, words...) sorted by tile, then by order or else by population count."""
    sizes = dealt.groupBy("seg", "key").count().where(F.col("count") > TILE)
    # A large tile becomes cells of two parts each, so that no task holds it whole.
    met = dealt.join(sizes, ["seg", "key"], "left").withColumn("m", F.coalesce(F.ceil(F.col("count") / TILE), F.lit(1)).cast("long"))
    met = met.withColumn("p", F.pmod(F.xxhash64("v"), F.col("m"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    keys = ["seg", "key", "x", "y"]
    met = met.select("seg", "key", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "v", "root", *names)
    ones = sum((F.bit_count(n) for n in names[1:]), F.bit_count(names[0])) if order is None else F.col(order)
    return met.repartition(*keys).sortWithinPartitions(*keys, ones, *names)


def near_links(marks: DataFrame, radius: int, words: int = 1, segments: int | None = None) -> DataFrame:
    """Links (a, b) of vertices whose components are those of all links within the radius that lie in a tile."""
    return tiles(marks.withColumn("root", F.col("v")), words, segments or radius + 1).mapInArrow(tile_links(radius), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, words: int = 1, segments: int | None = None) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per input row; fp is the first word, component_id the smallest doc_id reachable by links."""
    names = _names(words)
    rows = fingerprint(docs, shingle, seed, words)
    # A fingerprint of one word is its own vertex; of wider ones a hash is.
    rows = stored(rows.withColumn("v", F.col("w0") if words == 1 else F.xxhash64(*names)), "fingerprints")
    marks = stored(rows.groupBy("v").agg(F.min("doc_id").alias("least"), *[F.first(n).alias(n) for n in names]), "marks")
    roots = components(near_links(marks, radius, words, segments)).withColumnRenamed("v", "_v")
    rooted = marks.join(roots, marks["v"] == roots["_v"], "left").select("v", "least", F.coalesce("root", "v").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("v", "component_id")
    return rows.join(named, "v").select("doc_id", F.col("w0").alias("fp"), "component_id")


#: Distinct vertices whose texts are found by a broadcast of their hashes (16 bytes each); more are joined by a shuffle.
FEW_ENDS = 500_000


def plausible(pairs: DataFrame, marks: DataFrame, similarity: float, words: int) -> DataFrame:
    """pairs without those whose sizes or parity maps rule the similarity out."""
    names = [*(f"p{j}" for j in range(words)), "n"]
    side = lambda end: marks.select(F.col("v").alias(end), *[F.col(x).alias(f"{x}_{end}") for x in names])
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = sum(F.bit_count(F.col(f"p{j}_a").bitwiseXOR(F.col(f"p{j}_b"))) for j in range(words))
    n, m = F.col("n_a"), F.col("n_b")
    fine = (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (apart * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-9)
    return met.where(fine).select("a", "b")


def similar_pairs(pairs: DataFrame, marks: DataFrame, texts: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """Those of pairs (a, b) whose sets of shingles have at least this Jaccard similarity, computed exactly."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make_room()
        for batch in batches:
            sets = [np.unique(shingles_of(t, shingle, seed)).view("i8") for t in binary(batch.column(1))]
            ends = np.cumsum([0, *map(len, sets)])
            h = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), h.cast(pa.list_(pa.int64()))], names=["t", "h"])

    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(marks.select("v", "t"), "v"), "ends")
    wanted = ends.select("t").distinct()
    few = ends.count() <= FEW_ENDS
    found = texts.join(F.broadcast(wanted) if few else wanted, "t", "left_semi").dropDuplicates(["t"])
    sets = stored(found.select("t", "text").mapInArrow(run, "t long, h array<long>").join(ends, "t").select("v", "h"), "sets")
    met = pairs.join(sets.select(F.col("v").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("v").alias("b"), F.col("h").alias("hb")), "b")
    na, nb = F.size("ha"), F.size("hb")
    met = met.where(F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-9)
    # |A & B| / |A | B| >= s, with the intersection named once
    return met.where(F.size(F.array_intersect("ha", "hb")) * (1 + similarity) >= similarity * (na + nb) - 1e-9).select("a", "b")


#: Bytes of texts whose shingles meet in one bucket on average, and shingles of a part that a task hands over at a time.
BUCKET_BYTES, PART = 8 << 20, 1_000_000
#: Shingles in more than HOT of about HOT_SAMPLE texts count as frequent without being counted.
HOT, HOT_SAMPLE = 100, 10_000


def shingle_sets(shingle: int, seed: int):
    """Over rows (t, text): each text's distinct shingles, one a row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make_room()
        for batch in batches:
            for text in binary(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles_of(text, shingle, seed)).view("i8"))], names=["h"])

    return run


def shingle_parts(shingle: int, seed: int, buckets: int, hot: list[int]):
    """Over rows (t, text): distinct shingles with their texts' hashes t and numbers n of shingles, packed by bucket. Shingles
    are dealt by hash, hot ones by t into further buckets. A task hands over equal texts once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make_room()
        seen: set[int] = set()
        held: list = []
        known = np.array(sorted(hot), np.int64)

        def out():
            t = np.array([x for x, _ in held], np.int64)
            n = np.array([len(h) for _, h in held], np.int64)
            h, of = np.concatenate([h for _, h in held]), np.repeat(np.arange(len(t)), n)
            bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            bucket = np.where(np.isin(h.view("i8"), known), buckets + t[of] % buckets, bucket)
            order = np.argsort(bucket, kind="stable")
            bucket, h, of = bucket[order], h[order], of[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else np.zeros(0, np.int64)
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(h)], strict=True) if len(h) else ():
                who, at = np.unique(of[a:b], return_inverse=True)
                rows.append((int(bucket[a]), t[who].tobytes(), n[who].astype("<i4").tobytes(), at.astype("<u2").tobytes(), h[a:b].tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "t", "n", "at", "h"])

        size = 0
        for batch in batches:
            for t, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                if t in seen:
                    continue
                seen.add(t)
                held.append((t, np.unique(shingles_of(text, shingle, seed))))
                size += len(held[-1][1])
                if size >= PART or len(held) >= 60_000:  # places among the texts of a part fit 16 bits
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def shared_shingles(buckets: int):
    """Over parts sorted by bucket: rows (t, n, h, df) of the shingles that several texts have, df being how many."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make_room()
        held, open_ = [], None

        def out():
            t, n, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((t, h))
            t, n, h = t[order], n[order], h[order]
            own = np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])]
            t, n, h = t[own], n[own], h[own]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            df = np.diff(np.r_[starts, len(h)])
            df = np.repeat(df, df) if open_ < buckets else np.full(len(h), 1 << 40)
            keep = np.flatnonzero(df > 1)
            for a in range(0, len(keep), 200_000):
                i = keep[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(t[i]), pa.array(n[i].astype(np.int64)), pa.array(h[i]), pa.array(df[i])], names=["t", "n", "h", "df"])

        for batch in batches:
            for bucket, t, n, at, h in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and bucket != open_:
                    yield from out()
                    held = []
                open_, at = bucket, np.frombuffer(at, "<u2")
                held.append((np.frombuffer(t, "<i8")[at], np.frombuffer(n, "<i4")[at], np.frombuffer(h, "<i8")))
        if held:
            yield from out()

    return run


def rarest(texts: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """Rows (t, h): in an order of all shingles, rare ones first, as many of each text's first ones as it must have one of
    in common with any similar text; those that no other text has are left out. texts: rows (t, text)."""
    texts = texts.select("t", "text")
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = -(-(size or 1) // BUCKET_BYTES)
    some = texts.where(F.pmod(F.xxhash64("t"), F.lit(-(-n // HOT_SAMPLE) or 1)) == 0).dropDuplicates(["t"])
    # Any order serves, if it is the same for all texts; so a sample may say which shingles come last.
    hot = [r["h"] for r in some.mapInArrow(shingle_sets(shingle, seed), "h long").groupBy("h").count().where(F.col("count") > HOT).select("h").collect()]
    parts = texts.mapInArrow(shingle_parts(shingle, seed, buckets, hot), "bucket long, t binary, n binary, at binary, h binary")
    met = parts.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(shared_shingles(buckets), "t long, n long, h long, df long")
    # Of n shingles, n - ceil(similarity * n) + 1 come first; n - k of them no other text has.
    own = Window.partitionBy("t")
    met = met.withColumn("k", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "h")))
    return met.where(F.col("rank") <= F.col("k") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select("t", "h")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 8, segments: int = 32, sure: int = 48, radius: int = 88, most: int = 4, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, text_hash, root, component_id), one per input row: components of texts whose sets of shingles are similar.

    text_hash is the text's XXH64, root a number of the component; component_id, its smallest doc_id, is null if all are.

    Every link is computed exactly; fingerprints, of distinct shingles, only say what is computed first. Tiles of segments
    come first, once: of fingerprints within `sure` bits they give a spanning forest, beyond it and within the radius the `most`
    nearest pairs of each row and block, and so join most of what is similar at little cost. Tiles of the rarest shingles then hold all similar pairs,
    whatever their fingerprints; only pairs of different components that sizes and parity maps leave open are looked at, the `most`
    nearest of each row and block, and in a next round 64 times as many of the rows that had more, so that no pair is left
    out and large groups of similar texts do not make all their pairs.
    """
    sets = _names(words, True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    rows = fingerprint(texts, shingle, seed, words, True, ("doc_id", "t"))
    rows = stored(rows.withColumn("v", F.xxhash64(*sets)), "fingerprints")
    marks = stored(rows.groupBy("v").agg(F.min("doc_id").alias("least"), F.min("t").alias("t"), *[F.first(n).alias(n) for n in sets]), "marks")
    roots, tested = None, None

    def rounds(deal, by: Bits, sure: int, most: int, again: bool) -> None:
        nonlocal roots, tested
        live = marks if roots is None else marks.join(roots, "v", "left")
        live = live.withColumn("root", F.col("v") if roots is None else F.coalesce("root", "v"))
        while True:
            found = stored(deal(live).mapInArrow(tile_pairs(sure, by, most), "a long, b long, kind int"), "found")
            pairs = found.where(F.col("kind") != MORE).select("a", "b").distinct()
            pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = pairs if tested is None else tested.union(pairs)
            open_ = stored(plausible(pairs, marks, similarity, words), "plausible")
            linked = stored(similar_pairs(open_, marks, texts, similarity, shingle, seed), "links")
            # Components so far stand for the links of earlier rounds.
            roots = stored(components(linked if roots is None else linked.union(roots.select(F.col("v").alias("a"), F.col("root").alias("b")))), "roots")
            more = found.where(F.col("kind") == MORE).select(F.col("a").alias("v")).distinct()
            if not again or more.isEmpty():
                break
            live = marks.join(more, "v", "left_semi").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
            most *= 64

    rounds(lambda live: tiles(live, words, segments), Bits(words, radius), sure, most, False)
    first = rarest(texts, similarity, shingle, seed).join(rows.select("t", "v").distinct(), "t").select("v", "h").distinct()
    first = stored(first, "rarest")

    def by_shingle(live: DataFrame) -> DataFrame:
        dealt = first.join(live.select("v", "root"), "v")
        apart = dealt.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h")
        dealt = stored(dealt.join(apart, "h", "left_semi").select("v", "h"), "apart").join(live, "v")
        return cells(dealt.select(F.lit(-1).cast("long").alias("seg"), F.col("h").alias("key"), "v", "root", *sets), sets, "n")

    # No pair stands for others here: a forest's edge that fails would hide them.
    rounds(by_shingle, Sets(words, similarity), -1, most, True)
    rooted = marks.join(roots, "v", "left").select("v", "least", F.coalesce("root", "v").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("v", "root", "component_id"), "v").select("doc_id", F.col("t").alias("text_hash"), "root", "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = simhash_groups(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL = None
