"""Operators 11 to 13 against plain Python."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tonarm.llm import lexical_search, periodic_runs, token_counts

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
#: Columns with the names that the operators give or use themselves.
CLASHING = "doc_id long, text string, n long, item long, score long, n_tokens long, n_runs long, start long, rank int, term string, _text string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 9) for i, t in rows], CLASHING)


def of_table(name="documents", key="doc_id"):
    return duckdb.sql(f"SELECT {key}, text FROM '{SF}/{name}.parquet'").fetchall()


# 11


def plain_search(docs, items, k):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in of.items():
        scored = []
        for d, c, n in counts:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def random_docs(rng, n):
    words = ["The", "the", "a", "of", "Été", "x9", "日本", "y_z", "q"] + [f"w{i}" for i in range(40)]
    rows = [(i if i % 11 else None, " ".join(rng.choices(words[: rng.choice([3, 9, 49])], k=rng.randrange(30)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, "?!"), (7, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("seed", range(3))
def test_search(spark, monkeypatch, seed):
    rng = random.Random(seed)
    docs = random_docs(rng, 150)
    items = [(i, " ".join(rng.choices(["the", "A", "w1", "w2", "w30", "été", "none", "日本"], k=5))) for i in range(12)]
    items += [(0, "w7 w8"), (None, "w3 of"), (50, None), (51, ""), (52, "nowhere")]
    monkeypatch.setattr(lexical_search, "TOGETHER", 40)  # lists of few documents, so bounds of earlier lists count
    monkeypatch.setattr(lexical_search, "SLICE_TERMS", [500, 10, 25][seed])
    found = lexical_search.search(documents(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(docs, items, 7)


def test_search_stops_creating_accumulators():
    """With a rare and a common term, documents of the common one alone get no accumulator, and scores stay exact."""
    n, rng = 1000, np.random.default_rng(2)
    rare = np.sort(rng.choice(n, 30, replace=False))
    rows, terms = np.r_[rare, np.arange(n)], np.r_[np.zeros(30, int), np.ones(n, int)]
    weights = np.array([lexical_search.term_weight(n, 30), lexical_search.term_weight(n, 990)])
    lists = lexical_search.Lists(np.full(n, 10), rows, terms, np.ones(len(rows), np.int64), weights, n, 10 * n)
    at, scores = lists.evaluate([0, 1], 20, 0)
    assert at.tolist() == rare.tolist() and set(scores.tolist()) == {int(lists.scores[0] + lists.scores[-1])}
    assert len(lists.evaluate([0, 1], 40, 0)[0]) == n  # fewer than 40 partial scores: all count
    assert len(lists.evaluate([0, 1], 40, int(lists.most[1]) + 1)[0]) == 30  # a bound of earlier lists
    assert len(lists.evaluate([1], 5, int(lists.most[1]))[0]) == n  # an equal score could still win by its doc_id


def test_search_of_nothing(spark):
    none = documents(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(documents(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert lexical_search.search(documents(spark, [(1, None)]), items).count() == 0
    long = [(1, "b " * 300_000), (2, "a " + "c" * 1_000_000)]
    found = lexical_search.search(documents(spark, long), items)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(long, [(1, "a b")], 50)


# 12


def plain_runs(words):
    found = {}
    for p in range(1, len(words)):
        i = p
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - p]:
                j += 1
            if j > i:
                found.setdefault((i - p, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items() if n >= max(6, 4 * p)), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(kept)


def test_runs_of_words():
    rng = random.Random(4)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choices(["a", "b", "c", "dd"][: rng.choice([1, 2, 4])], k=rng.randrange(50))
            p = rng.randrange(1, 14)
            texts.append([w.encode() for w in words[: len(words) // 2] + (words[:p] * 20)[: rng.randrange(70)] + words[len(words) // 3 :]])
        assert periodic_runs.detect(texts) == [plain_runs(w) for w in texts]


def test_runs(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TOGETHER", 300)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(60)))) for i in range(300)]
    rows += [(None, "x " * 9), (400, None), (401, ""), (402, " \t\n"), (403, "A a A a b"), (3, rows[3][1]), (3, rows[3][1]), (404, "é\x1cé " * 12)]
    got = periodic_runs.periodic_runs(documents(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(*r)) for r in rows)
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0


@data
def test_runs_of_table(spark):
    want = sorted(repr(plain_row(*r)) for r in of_table() if len(r[1] or "") < 6_000)
    got = periodic_runs.op12_periodic_runs(spark, SF).collect()
    assert len(got) == len(of_table())
    assert not set(want) - {repr(tuple(r)) for r in got}


def test_runs_of_long_texts():
    """One repeated word, a period of a quarter, and many short runs: none takes a step for each pair of words."""
    n = 100_000
    rng = random.Random(6)
    quarter = [str(rng.random()).encode() for _ in range(n // 4)]
    noisy = rng.choices([b"a", b"b"], k=20_000)
    got = periodic_runs.detect([[b"a"] * n, quarter * 4, quarter * 3, noisy])
    assert got[:3] == [[(0, n, 1)], [(0, n, n // 4)], []]
    assert all(noisy[s + q : s + m] == noisy[s : s + m - q] for s, m, q in got[3]) and len(got[3]) > 100


# 13


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_counts(spark, library, monkeypatch):
    path, library = library
    monkeypatch.setattr(token_counts, "TOGETHER", 64)
    rng = random.Random(7)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'LL", "<|endoftext|>", "<|endof", "é", "日本", "́", "1", "!!", "aaaa", "the", " ", "\x00", "ſ"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(40)))) for i in range(400)] + [(None, None), (1, ""), (2, " the" * 300), (2, " the" * 300), (3, "ab" * 20_000)]
    got = token_counts.count_tokens(documents(spark, rows), path).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.count_tokens(documents(spark, []), path).count() == 0


@data
def test_counts_of_table(spark, library):
    rows = of_table()
    want = {(d, len((t or "").encode()), n, n > 1024) for (d, t), n in zip(rows, [len(e.ids) for e in library[1].encode_batch([t or "" for _, t in rows], add_special_tokens=False)], strict=True)}
    assert {tuple(r) for r in token_counts.op13_token_counts(spark, SF).collect()} == want


def test_counts_forget(library, monkeypatch):
    """What is known is forgotten beyond KEPT, with the same counts."""
    monkeypatch.setattr(token_counts, "KEPT", 5)
    counter = token_counts.Counter(token_counts.Merges(library[0]))
    for i in range(30):
        text = f"word{i} and others{i % 4} " + "long" * 40
        assert counter.count([text]) == [len(library[1].encode(text, add_special_tokens=False).ids)] and len(counter.known) <= 9


def test_other_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="another kind"):
        token_counts.Merges(public_tokenizers.path("word_bpe_49k.json"))
