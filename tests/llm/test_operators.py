import hashlib
import json
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tonarm.llm import bpe, chat, exact_dedup, induced, language_id, line_dedup, mixing, nearest, sharding, simhash, substring_dedup

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, keep string"
LONG = "".join(chr(97 + i * i % 26) for i in range(500)) + "é"
ROWS = [
    (1, None, "en", "src1", "x"), (2, "", None, "src1", "x"), (3, "a b c d", "en", None, None), (4, "A b C d", "en", "src2", "x"),
    (5, LONG, "en", "src2", "x"), (6, "zz" + LONG + "yy", "de", "src0", "x"), (7, LONG, "en", "src2", "x"), (7, LONG, "en", "src2", "x"), (None, "same\nlast", "fr", "src3", "x"),
] + [(100 + i, f"own {i}\n Same \nend", "en", "src0", "x") for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_repeated_windows():
    rng = np.random.default_rng(1)
    for _ in range(60):
        strings = [bytes(rng.integers(65, 68, rng.integers(0, 50)).tolist()) for _ in range(rng.integers(1, 8))]
        n = int(rng.integers(1, 14))
        seen = Counter(s[i : i + n] for s in strings for i in range(len(s) - n + 1))
        want = [[seen[s[i : i + n]] > 1 for i in range(len(s) - n + 1)] for s in strings]
        assert [x.tolist() for x in induced.repeated_windows(strings, n)] == want


def test_spans_of_crafted_texts(spark):
    """One repeated byte, a pattern on which polynomials modulo 2^64 collide with its opposite, and a very long text; clashing columns."""
    from tonarm.llm.induced import repeated_windows

    swap = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = (bytes(97 + (x ^ k) for x in swap).decode() for k in (0, 1))
    rng = np.random.default_rng(9)
    long = "".join(chr(x) for x in rng.integers(97, 123, 600_000))
    texts = ["z" * 5_000, one[:1024], two[1024:], "q" + one[:300] + "q", long, long[1_000:1_400] + "x" * 150]
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, spans string, packed string, a long, row_key long")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"]).decode()) for r in substring_dedup.substring_dedup(df).collect()}
    for i, found in enumerate(repeated_windows([t.encode() for t in texts], 200)):
        cover = np.zeros(len(texts[i]) + 1, int)
        for at in np.flatnonzero(found):
            cover[at] += 1
            cover[at + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert got[i] == (int(gone.sum()), runs, "".join(c for c, g in zip(texts[i], gone, strict=True) if not g))
    assert got[0][0] == 5_000 and got[4][0] == 400


def test_repeated_windows_on_disk(monkeypatch):
    """Queues and arrays beyond their memory go to disk, with the same result."""
    monkeypatch.setattr(induced, "QUEUE_MEMORY", 512)
    monkeypatch.setattr(induced, "ARRAY_MEMORY", 256)
    monkeypatch.setattr(induced, "BATCH", 64)
    spills = []
    spill = induced.BucketQueue.spill
    monkeypatch.setattr(induced.BucketQueue, "spill", lambda q: (spills.append(1), spill(q)))
    rng = np.random.default_rng(6)
    for letters in (2, 40):
        strings = [bytes(rng.integers(65, 65 + letters, 400).tolist()) for _ in range(12)]
        strings += [strings[0][50:300] + strings[1][:100], strings[2]]
        seen = Counter(s[i : i + 12] for s in strings for i in range(len(s) - 11))
        want = [[seen[s[i : i + 12]] > 1 for i in range(len(s) - 11)] for s in strings]
        assert [x.tolist() for x in induced.repeated_windows(strings, 12)] == want
    assert len(spills) > 10


def test_queue_spills():
    scratch = induced.Scratch()
    q = induced.BucketQueue(3, scratch, memory=64)
    for i in range(20):
        q.deal(np.array([i % 3, 2]), np.array([i, -i]), np.array([2 * i, 2 * i + 1]))
    assert q.pop(0)[0].tolist() == list(range(0, 20, 3))
    scratch.close()


def test_substrings(docs, empty):
    texts = [(r[0], (r[1] or "").encode()) for r in ROWS]
    seen = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want.append((d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), kept))
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_substrings_by_hand(spark, monkeypatch):
    """The whole query against counts of all windows, with sorters that have next to no memory."""
    monkeypatch.setattr(induced, "QUEUE_MEMORY", 4_096)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    texts = {d: (t or "").encode() for d, t in rows}
    seen = Counter(hash(t[i : i + 200]) for t in texts.values() for i in range(len(t) - 199))
    want = {}
    for d, t in texts.items():
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - 199):
            if seen[hash(t[i : i + 200])] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        want[d] = (len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.op1_substring_dedup(spark, SF).collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 50


def test_substrings_of_hot_core(spark, monkeypatch):
    """A passage in different contexts: its pieces, all of one core, go to no shard."""
    monkeypatch.setattr(substring_dedup, "CORE_ROWS", 10)
    used = []
    sort_shard = substring_dedup.sort_shard

    def watched(length, anchor):
        run = sort_shard(length, anchor)

        def counted(batches):
            def checked():
                seen = Counter()
                for batch in batches:
                    seen.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                    assert max(seen.values(), default=0) <= 10
                    yield batch

            yield from run(checked())

        used.append(counted)
        return counted

    monkeypatch.setattr(substring_dedup, "sort_shard", watched)
    rng = np.random.default_rng(5)
    words = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, near = words(260), [words(20) for _ in range(3)]
    texts = [words(150) + near[i % 3] + passage[: 195 + i % 65] + near[i % 2] + words(150) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = {}
    for d, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want[d] = (int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(t.encode(), np.uint8)[~gone]))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup.substring_dedup(rows).collect()}
    assert got == want and used


def test_lines(docs, empty):
    got = {(r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.line_dedup(docs).collect()}
    assert {(100, "own 0", 2), (None, "last", 1), (3, "a b c d", 0), (1, "", 0)} <= got
    assert line_dedup.line_dedup(docs).count() == len(ROWS) and line_dedup.line_dedup(empty).count() == 0
    assert {r["keep"] for r in line_dedup.line_dedup(docs).collect()} == {"x", None}  # a column of the caller named like one inside


def test_lines_of_hot_keys(spark):
    """A line of every document, in runs over several partitions, beside a very long text."""
    rows = [(i if i % 3 else None, f"own {i}\n" + "hot\n" * (i % 4) + f"some {i // 12}\nnine {i % 400 // 9}") for i in range(3_600)] + [(9_999, "\n".join(map(str, range(50_000))) + "\n HOT ")]
    docs = {}
    for i, (_, t) in enumerate(rows):
        for line in set(t.split("\n")):
            docs.setdefault(line.strip().lower(), set()).add(i)
    want = Counter()
    for d, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if not x.strip() or len(docs[x.strip().lower()]) < 10]
        want[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(tuple(r) for r in line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "text").collect()) == want


def test_simhash(docs, empty):
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs).collect()}
    assert got[1]["fp"] == got[2]["fp"] == 0 and got[2]["component_id"] == 1
    assert got[4]["component_id"] == 3 and got[7]["component_id"] == 5
    assert simhash.simhash_groups(empty).count() == 0


def fingerprint_by_hand(text, n=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(marks, ids, radius=2):
    """Smallest id reachable by links within the radius."""
    marks = np.array(marks, np.uint64)
    labels = np.arange(len(marks))
    a, b = np.nonzero(np.bitwise_count(marks[:, None] ^ marks[None]) <= radius)
    simhash.join_labels(labels, a, b)
    least = {}
    for i, x in enumerate(labels):
        least[x] = min(least.get(x, ids[i]), ids[i])
    return [least[x] for x in labels]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_simhash_by_hand(spark):
    rows = sorted(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    marks = [fingerprint_by_hand(t) for _, t in rows]
    want = {d: (f"{m:016x}", c) for (d, _), m, c in zip(rows, marks, groups_by_hand(marks, [d for d, _ in rows]), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3_simhash(spark, SF).collect()} == want


def test_simhash_of_large_tiles(spark, monkeypatch):
    """Many fingerprints that differ in few places: tiles dealt into cells, and blocks within them."""
    monkeypatch.setattr(simhash, "TILE", 300)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(12)
    low = rng.integers(0, 1 << 21, 1_500, dtype=np.uint64)  # the upper segments are one tile
    marks = np.unique(low ^ np.uint64(0x5A5A_0000_0000_0000))
    df = spark.createDataFrame([(int(np.int64(m.view("i8"))),) for m in marks], "v long").withColumn("w0", F.col("v"))
    roots = {r["v"]: r["root"] for r in simhash.components(simhash.near_links(df, 2)).collect()}
    ids = [int(m.view("i8")) for m in marks]
    assert [roots.get(i, i) for i in ids] == groups_by_hand(marks, ids)


def similar_by_hand(texts, similarity=0.8, n=5):
    """Component (smallest position) of every text by the similarity of all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if not a | b or len(a & b) >= similarity * len(a | b) - 1e-9:
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return [find(i) for i in range(len(texts))]


def test_similar(spark, docs, empty):
    rng = np.random.default_rng(3)
    texts = [None, "", "one two", "One  two", "one three"]
    for edits in (0, 1, 2, 4, 6, 12, 40):  # from copies to texts below the similarity
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for _ in range(30):
            said = list(base)
            for at in rng.integers(0, len(said), edits):
                said[at] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(said))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = similar_by_hand(texts)
    for few in (1, 4):  # one pair a row at first: needs further rounds
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(rows, most=few).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) > 30
    got = {(r["doc_id"], r["component_id"]) for r in simhash.similar_groups(docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (7, 5), (None, None)} <= got
    assert simhash.similar_groups(docs).count() == len(ROWS) and simhash.similar_groups(empty).count() == 0


@pytest.mark.parametrize("hot", [100, 1])
def test_similar_short(spark, monkeypatch, hot):
    """Pairs of 8 and 9 words at exactly 0.8, of which fingerprints alone lose some."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BUCKET_BYTES", 20_000)
    texts = []
    for i in range(1_000):
        said = [f"w{i}x{j}" for j in range(9)]
        texts += [" ".join(said[:8]), " ".join(said)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(rows).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_sift_large_tile():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (30, 8), dtype=np.uint64)
    fp = np.repeat(base, 50, axis=0)
    for i in range(len(fp)):
        for at in rng.integers(0, 512, rng.integers(0, 50)):
            fp[i, at // 64] ^= np.uint64(1 << int(at % 64))
    fp = fp[np.argsort(np.bitwise_count(fp).sum(axis=1), kind="stable")]
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2, dtype=np.int64)
    keys, root = np.zeros((len(fp), 4), np.int64), np.arange(len(fp))
    child, parent, a, b, more = simhash.sift(keys, fp, root, 20, simhash.Bits(8, 60), 10_000)
    label = root.copy()
    simhash.join_labels(label, *np.nonzero(far <= 20))
    mine = root.copy()
    simhash.join_labels(mine, child, parent)
    assert np.array_equal(label, mine) and not len(more)
    apart = (far > 20) & (far <= 60) & (label[:, None] != label[None]) & (root[:, None] < root[None])
    assert set(zip(*np.nonzero(apart), strict=True)) <= set(zip(a, b, strict=True))


def test_exact(docs, empty):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs).collect()}
    assert got[1]["keep_id"] == 2 and not got[1]["kept"] and got[5]["keep_id"] == 7 and got[5]["group_size"] == 3
    assert got[6]["text_sha256"] == hashlib.sha256(ROWS[5][1].encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0
    p = exact_dedup.Polynomial(8)
    said = b"some longer text in chunks"
    chunks = [said[i : i + 8] for i in range(0, len(said), 8)]
    whole = 0
    for prime, base, at in zip(exact_dedup.PRIMES, exact_dedup.BASES, (31, 0), strict=True):
        whole |= sum((c + 1) * pow(base, len(said) - 1 - i, prime) for i, c in enumerate(said)) % prime << at
    assert p.of(said) == whole != p.of(said[:-1] + b"t")
    h = [(p.of_chunk(c), len(c)) for c in chunks]
    both = lambda x, y: (p.combine(x[0], y[0], y[1]), x[1] + y[1])
    for way in (both(both(both(h[0], h[1]), h[2]), h[3]), both(h[0], both(h[1], both(h[2], h[3]))), both(both(h[0], h[1]), both(h[2], h[3]))):
        assert way[0][0] << 31 | way[0][1] == whole


def test_exact_over_partitions(spark, monkeypatch):
    """A hot text that fills several partitions, null and repeated ids, and texts of equal fingerprints."""
    monkeypatch.setattr(exact_dedup.Polynomial, "of", lambda self, data: len(data) % 3)
    rows = [(i, "hot") for i in range(2_000)] + [(None, "hot"), (None, None), (None, "")] + [(i % 700, f"t{i % 40}") for i in range(800)] + [(5, "y" * 300_000), (6, "y" * 299_999 + "z"), (7, "y" * 300_000)]
    members = {}
    for d, t in rows:
        members.setdefault(t or "", []).append(d)
    want = Counter()
    for d, t in rows:
        ids = [x for x in members[t or ""] if x is not None]
        keep = max(ids, default=None)
        want[d, keep, len(members[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(df).collect()) == want


def test_exact_in_blocks(spark, monkeypatch):
    """Texts beyond HUGE: blocks are hashed in several tasks, and the result is that of whole texts; clashing columns."""
    rng = np.random.default_rng(12)
    long = "".join(chr(x) for x in rng.integers(97, 123, 3_000))
    said = [long, long, long[:-1] + "é", long + "x", long[:1_000], long[:1_000], "", None, "é" * 600, "é" * 600, long[1_000:] + long[:1_000]]
    df = spark.createDataFrame([(i, t, 1, "k", 2, b"x") for i, t in enumerate(said)], "doc_id long, text string, fp long, key string, block int, body binary").repartition(3)
    want = {}
    for i, t in enumerate(said):
        same = [j for j, u in enumerate(said) if (u or "") == (t or "")]
        want[i] = (max(same), len(same), i == max(same), hashlib.sha256((t or "").encode()).hexdigest())
    whole = {r["doc_id"]: r["fp"] for r in exact_dedup.fingerprints(df).collect()}
    for huge in (1 << 20, 100, 1_000):
        monkeypatch.setattr(exact_dedup, "HUGE", huge)
        assert {r["doc_id"]: r["fp"] for r in exact_dedup.fingerprints(df).collect()} == whole
        assert {r[0]: tuple(r)[1:] for r in exact_dedup.exact_groups(df).collect()} == want
    monkeypatch.setattr(exact_dedup, "HUGE", 100)
    blocks = exact_dedup.in_blocks(df.where("doc_id = 0").select("key", F.col("text").cast("binary").alias("body")), "key").repartition(4, "key", "block")
    assert blocks.count() == 30 and blocks.select(F.spark_partition_id()).distinct().count() > 1
    assert b"".join(bytes(r["body"]) for r in blocks.orderBy("block").collect()) == long.encode()


def test_exact_edges_are_compared(spark, monkeypatch):
    """Classes of different partitions are one only if all their blocks are equal, whatever their hashes say."""
    monkeypatch.setattr(exact_dedup, "HUGE", 4)
    told = [(0, 0, b"abcdefghij"), (1, 0, b"abcdefghij"), (2, 0, b"abcdefgh_j"), (3, 0, b"abcdefghij"), (4, 1, b"abcdxxghij")]
    rows = spark.createDataFrame([(None, 7, 10, "sha", p, c, True, b) for p, c, b in told] + [(1, 7, 10, "sha", 0, 0, False, None)], exact_dedup.OUT)
    assert {tuple(r) for r in exact_dedup.edge_classes(rows).collect()} == {(0, 0, 0, 0), (1, 0, 0, 0), (3, 0, 0, 0)}
    assert exact_dedup.edge_classes(rows.limit(0)).count() == 0


def test_bpe(spark, docs, empty, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    real = tokenizers.Tokenizer.from_file(path)
    encoder = bpe.Encoder(bpe.Automaton(path))
    texts = ["", "Hello   World's 123", "ΣΑΣ aaaa aaaaa \u0130 <|endoftext|>x", LONG, "日本 e\u0301 ²½", "!!!!!...??", "a\x1cb \x1d c\x00", "<|endoftext|>", "it's we'll" * 400, "xyz" * 400]
    if os.path.isdir(SF):
        texts += [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    for kept in (bpe.KEPT, 3_000):  # with a store that is emptied again and again
        monkeypatch.setattr(bpe, "KEPT", kept)
        for t, (ids, said) in zip(texts, encoder.encode(texts), strict=True):
            e = real.encode(t, add_special_tokens=False).ids
            assert (np.frombuffer(ids, "<u4").tolist(), said) == (e, real.decode(e, skip_special_tokens=False)), t
    for word in ("anwhingen", "!!!!!!!!", "aaaaaaab", "ee\u0120"):
        ids, cuts = encoder.paths([word, word])
        assert ids.tolist() == 2 * encoder.path(word) and cuts.tolist() == [0, len(ids) // 2]
    clash = docs.withColumn("n_tokens", docs["doc_id"])
    got = bpe.encode_decode(clash, path, keep=["doc_id", "keep", "n_tokens"])
    assert got.columns == ["doc_id", "keep", "n_tokens", "token_ids", "decoded"] and got.count() == len(ROWS)
    assert {r["n_tokens"] for r in got.where("doc_id IN (1, 2)").collect()} == {0} and bpe.encode_decode(empty, path).count() == 0


class Tape(str):
    """A word that notes in which order its symbols are read."""

    def __getitem__(self, i):
        self.__dict__.setdefault("seen", []).append(i)
        return str.__getitem__(self, i)


def test_bpe_reads_once(monkeypatch):
    """Each symbol is read once, in order: no step goes back, in words that read otherwise would (a longest arc first is wrong in many)."""
    auto = bpe.Automaton(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    encoder = bpe.Encoder(auto)
    rng = np.random.default_rng(13)
    words = ["anwhingen", "e" * 40, "!" * 30, *("".join(rng.choice(list("aeinorst"), n)) for n in rng.integers(1, 60, 300))]
    greedy = 0
    for w in words:
        tape = Tape(w)
        ids = encoder.path(tape)
        assert tape.seen == list(range(len(w))) and "".join(auto.spelled[t] for t in ids) == w
        longest = max((t for t in auto.spelled if w.startswith(auto.spelled[t])), key=lambda t: auto.size[t]) if len(w) < 12 else None
        greedy += longest is not None and longest != ids[0]
    assert greedy > 5
    read = []
    real = encoder._read
    monkeypatch.setattr(encoder, "_read", lambda state, symbol: (read.append(len(symbol)), real(state, symbol))[1])
    ids, cuts = encoder.paths(words)
    assert sum(read) == sum(map(len, words)) and len(read) == max(map(len, words))
    for w, a, b in zip(words, cuts, [*cuts[1:], len(ids)], strict=True):
        assert ids[a:b].tolist() == encoder.path(w)


def test_bpe_refuses_other_files(tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError, match="of another kind"):
        bpe.Automaton(tokenizers.path("byte_bpe_50k.json"))
    with open(tokenizers.path("word_bpe_49k.json")) as f:
        spec = json.load(f)
    del spec["model"]["vocab"]["a"]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="missing"):
        bpe.Automaton(str(tmp_path / "t.json"))


def test_chat(spark):
    rows = [(1, 0, "user", "a\\</turn><turn:x"), (1, 1, "assistant", "\\<b\n"), (1, 2, "us\ner\\l", None), (2, 0, None, "x"), (None, 0, "assistant", "")]
    got = chat.chat_examples(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).where("whole")
    turns = {r[0]: [(t["role"], t["text"]) for t in r[1]] for r in got.select("conv_id", chat.read_turns(got["text"])).collect()}
    singles = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id long, turn int, role string, text string")
    assert sorted((r["text"], r["loss_len"]) for r in chat.chat_examples(singles).collect()) == [("<turn:assistant\nb</turn>\n", 1), ("<turn:user\na</turn>\n", 0), ("<turn:user\na</turn>\n", 0)]
    assert chat.chat_examples(singles.limit(0)).count() == 0
    assert turns == {1: [("user", "a\\</turn><turn:x"), ("assistant", "\\<b\n"), ("us\ner\\l", "")], 2: [("", "x")], None: [("assistant", "")]}


def check_shards(rows, found, shards):
    """Rows of docs against those of the operator: sizes, sums, slots; returns bytes a shard."""
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    size, slots = Counter(), {}
    for r in found:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    return size


@pytest.mark.parametrize("shards", [1, 7, 16])
def test_shards(spark, docs, empty, monkeypatch, shards):
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)  # several cells a shard
    check_shards([r[:2] for r in ROWS], sharding.kd_shards(docs, shards).collect(), shards)
    assert sharding.kd_shards(empty, shards).count() == 0
    # Equal texts beyond a shard, of null ids and of others, and a very long text.
    rng = np.random.default_rng(9)
    rows = [(i, "x" * int(rng.integers(0, 300)) + "\n" * int(rng.integers(0, 5)) + str(i // 3)) for i in range(2_000)]
    rows += [(5_000 + i, "hot " * 20) for i in range(900)] + [(None, "null " * 20) for _ in range(900)] + [(9_999, "ä" * 5_000)]
    found = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
    size = check_shards(rows, found, shards)
    mean = sum(size.values()) / shards
    assert len(size) == shards and max(size.values()) < 1.3 * mean and min(size.values()) > 0.7 * mean
    places = {}
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] < 5_000:
            places.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in places.values())


def test_tree_by_hand(spark):
    """Every split against sorted points: the widest dimension, and no point could be moved for a better cut."""
    rng = np.random.default_rng(10)
    points = [(float(rng.integers(0, 6)), float(rng.random() * 3), float(i), int(rng.integers(1, 50))) for i in range(600)]
    df = spark.createDataFrame(points, "x double, y double, tie double, w long").cache()
    tree = sharding.kd_tree(df, ("x", "y"), "w", 12)
    slack = sharding.SLACK * sum(p[3] for p in points) / 12
    wide = [max(p[i] for p in points) - min(p[i] for p in points) for i in (0, 1)]

    def walk(at, held):
        node = tree[at]
        if node.shards == 1:
            assert node.dim < 0
            return
        span = [(max(p[i] for p in held) - min(p[i] for p in held)) / wide[i] for i in (0, 1)]
        assert span[node.dim] == max(span)
        held = sorted(held, key=lambda p: (p[node.dim], p[2]))
        left = [p for p in held if p[node.dim] < node.cut or p[node.dim] == node.cut and p[2] <= node.tie]
        assert left == held[: len(left)]
        goal, got = sum(p[3] for p in held) * (node.shards // 2) / node.shards, sum(p[3] for p in left)
        assert abs(got - goal) <= max(slack, max(p[3] for p in held) / 2)
        walk(node.left, left)
        walk(node.right, held[len(left) :])

    walk(0, points)
    assert sum(n.shards == 1 for n in tree) == 12


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [float("nan")] * 8), (63, [None] * 8), (64, [1.0] * 8), (65, [1.0] * 8)]
    rows = nearest.usable(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {}
    for r in nearest.nearest(rows.where("id % 20 = 0"), rows, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    good = [(i, np.array(v)) for i, v in vectors if i not in (60, 61, 62, 63)]
    want = {q: [i for _, i in sorted((-float(v @ w), i) for i, w in good if i != q)[:5]] for q, v in good if q % 20 == 0}
    assert got == want


def test_nearest_at_its_edges(spark):
    """Many rows of the query's own id, a repeated query, other lengths, fewer candidates than asked for, nothing."""
    schema = "vec_id long, embedding array<float>"
    rng = np.random.default_rng(7)
    rows = [(0, [1.0, 0.0])] * 70 + [(0, [9.0, 0.0])] + [(i, rng.normal(size=2).tolist()) for i in range(1, 90)] + [(200, [1.0]), (201, [1.0, 2.0, 3.0]), (202, [])]
    use = nearest.usable(spark.createDataFrame(rows, schema), "vec_id", "embedding")
    got = [r["vec_id"] for r in nearest.nearest(use.where("id = 0"), use, 20).orderBy("rank").collect()]
    f = np.float32
    want = sorted((-float(f(v[0])), i) for i, v in rows if 0 < i < 200)
    assert got == [i for _, i in want[:20]]
    few = use.where("id IN (0, 3, 4)")
    assert sorted(r["vec_id"] for r in nearest.nearest(few.where("id = 0"), few, 20).collect()) == [3, 4]
    assert nearest.nearest(use.where("id = 200"), use, 5).count() == 0 and nearest.nearest(use.limit(0), use.limit(0), 5).count() == 0


def grams_by_hand(text):
    n = Counter()
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            n.update(word)
            framed = " " + word + " "
            n.update(framed[i : i + 2] for i in range(len(framed) - 1))
            n.update(framed[i : i + 3] for i in range(len(framed) - 2))
            word = ""
    return n


def ranked_by_hand(n, most):
    code = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    return sorted(n, key=lambda g: (-n[g], code(g)))[:most]


def number(gram):
    return len(gram) - 1 << 60 | sum((0 if c == " " else ord(c)) << 20 * i for i, c in enumerate(reversed(gram)))


def test_grams():
    grams = language_id.Grams()
    for text in ("", " 1 2", "Ein Wort, ein Wort!", "日本語 и ещё один ÉÀ a", "".join(map(chr, range(0x4E00, 0x4E00 + 1500))), "\U00020000\U00020001 x"):
        ids, n = grams.count(text)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == {number(g): k for g, k in grams_by_hand(text).items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_language_by_hand(spark):
    """The whole query against plain Python, and held-out accuracy."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    held_out = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    known, docs = {}, {}
    for d, t, lang in rows:
        docs[d] = grams_by_hand(t or "")
        if lang is not None and t is not None and not held_out[d]:
            known.setdefault(lang, Counter()).update(docs[d])
    places = {lang: {g: i for i, g in enumerate(ranked_by_hand(n, language_id.LANGUAGE_GRAMS))} for lang, n in known.items()}
    want = {}
    for d, n in docs.items():
        mine = ranked_by_hand(n, language_id.DOCUMENT_GRAMS)
        far = {lang: sum(min(abs(p[g] - i), len(p)) if g in p else len(p) for i, g in enumerate(mine)) / (len(p) * len(mine)) for lang, p in places.items()} if mine else {}
        best = min(sorted(far), key=far.get, default="und")
        want[d] = (held_out[d], best, round(1 - far[best], 9) if far else 0.0)
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in language_id.op10_language(spark, SF).collect()}
    assert got == want
    judged = [got[d][1] == lang for d, t, lang in rows if held_out[d] and lang is not None and got[d][1] != "und"]
    assert len(judged) > 100 and sum(judged) / len(judged) > 0.97


def test_language(spark, docs, empty):
    got = {r["doc_id"]: r for r in language_id.identify(docs, {"en": [97, 98], "de": [122]}).collect()}
    assert got[1]["lang_pred"] == "und" and got[3]["lang_pred"] == "en" and 0 <= got[3]["score"] <= 1
    assert language_id.learn_profiles(empty) == {}
    # A rare language is learned beside a common one, whatever the bound.
    rows = [(i, "aaa", "en", None, None) for i in range(4_000)] + [(9_000 + i, "zzz", "xx", None, None) for i in range(4)]
    sample = language_id.labelled(spark.createDataFrame(rows, DOCS), 100).groupBy("lang").count().collect()
    n = {r["lang"]: r["count"] for r in sample}
    assert 20 < n["en"] < 90 and n["xx"] == sum(zlib.crc32(str(9_000 + i).encode()) % 4 != 2 for i in range(4))


def fill_by_hand(tree, budget, capacity, weight):
    """Budgets of leaves (by path) of a tree of dicts, by dealing again and again until no child is over."""

    def cap(path, node):
        return sum(cap((*path, k), x) for k, x in node.items()) if isinstance(node, dict) else capacity(path)

    def deal(path, node, budget):
        if not isinstance(node, dict):
            return {path: min(budget, cap(path, node))}
        live, share = {k for k in node if cap((*path, k), node[k]) > 0}, dict.fromkeys(node, 0.0)
        while live:
            total = sum(weight((*path, k)) for k in live)
            over = {k for k in live if budget * weight((*path, k)) / total >= cap((*path, k), node[k])}
            for k in over or live:
                share[k] = cap((*path, k), node[k]) if over else budget * weight((*path, k)) / total
            budget -= sum(share[k] for k in over)
            live = live - over if over else ()
        return {p: b for k, x in node.items() for p, b in deal((*path, k), x, share[k]).items()}

    return deal((), tree, budget)


def test_budgets(spark):
    rng = np.random.default_rng(8)
    for fraction, epochs, weights in ((0.5, 1, {}), (0.3, 3, {("a",): 5.0, ("b", "x"): 0.0, ("c", "y"): 0.5}), (2.0, 1, {("a",): 0.0, ("b",): 3.0})):
        leaves = {(x, y, z): int(rng.integers(0, 200)) for x in "abc" for y in "xyz" for z in "123" if rng.random() < 0.8}
        tree = {}
        for x, y, z in leaves:
            tree.setdefault(x, {}).setdefault(y, {})[z] = 0
        weight = lambda path: weights.get(path, 1.0)  # noqa: B023, E731
        capacity = lambda path: leaves[path] * epochs * all(weight(path[: i + 1]) > 0 for i in range(3))  # noqa: B023, E731
        want = fill_by_hand(tree, fraction * sum(leaves.values()), capacity, weight)
        rows = spark.createDataFrame([(*p, t) for p, t in leaves.items()], "l0 string, l1 string, l2 string, t long")
        got = {tuple(r[:3]): r["budget"] for r in mixing.budgets(rows, weights, fraction, epochs, ["l0", "l1", "l2"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)
    rows = spark.createDataFrame([("a", "x", 100), ("a", "y", 10), ("b", "x", 100)], "l0 string, l1 string, t long")
    got = {tuple(r[:2]): r["budget"] for r in mixing.budgets(rows, {}, 120 / 210, 1, ["l0", "l1"]).collect()}
    assert {p: round(b, 6) for p, b in got.items()} == {("a", "x"): 50.0, ("a", "y"): 10.0, ("b", "x"): 60.0}  # a sibling fills in first


def test_mixing(spark, docs, empty):
    mixed = mixing.mix(mixing.with_domain(docs), {}, 0.5)
    assert mixed.count() == len(ROWS)
    rows = [(None if i % 3 else i % 5, f"{'w ' * (i % 7)}{i % 4}", "en", "src99999999999999999999" if i % 2 else None) for i in range(200)]
    for order in (rows, rows[::-1]):  # ties do not go by the order of rows
        df = mixing.with_domain(spark.createDataFrame(order, "doc_id long, text string, lang string, source string").repartition(3))
        for epochs, fraction in ((1, 0.4), (4, 2.5)):
            got = sorted(map(repr, mixing.mix(df, {}, fraction, epochs).collect()))
            assert got == sorted(map(repr, mixing.mix(mixing.with_domain(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), {}, fraction, epochs).collect()))
            taken = [r for r in mixing.mix(df, {}, fraction, epochs).collect() if r["copies"] > 0]
            per_leaf, budget = Counter(), {}
            for r in taken:
                per_leaf[r["domain"], r["source"]] += r["copies"] * r["n_tokens"]
                budget[r["domain"], r["source"]] = r["budget"]
            assert all(budget[k] - 8 < n <= budget[k] for k, n in per_leaf.items()) and {r["copies"] for r in taken} <= set(range(1, epochs + 1))
            if epochs > 1:
                assert {r["copies"] for r in taken} == {2, 3}  # whole epochs, and the prefix of one more
    assert mixing.mix(mixing.with_domain(empty), {}, 0.5).count() == 0
