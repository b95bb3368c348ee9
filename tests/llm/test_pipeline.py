from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from test_operators import similar_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
T = "one two three four five six seven eight nine ten"
OTHER = "nothing of this stands anywhere else in all of these rows"


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, lang, src, None if t is None else len(t)) for d, t, lang, src in rows], SCHEMA)


def texts(df):
    assert df.columns == cp.COLUMNS
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_duplicates_keep_one_row(spark):
    """Repeated and null ids: decisions are on rows."""
    rows = [(3, T, "en", "s1"), (9, T, "en", "s1"), (9, OTHER, "en", "s1"), (None, T, "en", "s1"), (None, OTHER + " but", "de", "s2"), (None, "its own text", None, None)]
    rows += [(3, T, "en", "s1"), (3, T, "de", "s1"), (None, "", "en", "s1"), (None, None, "en", "s1"), (1, "own", None, None)]
    got = texts(cp.near_duplicates(spark, rows_of(spark, rows), ""))
    assert got == Counter({(3, T): 1, (9, OTHER): 1, (None, "its own text"): 1, (1, "own"): 1, (None, ""): 1}) or got == Counter({(3, T): 1, (9, OTHER): 1, (None, "its own text"): 1, (1, "own"): 1, (None, None): 1})


def test_near_duplicates_by_hand(spark):
    rng = np.random.default_rng(11)
    said = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 400, 40)]
        for edits in (0, 1, 3, 9):
            new = list(base)
            for at in rng.integers(0, 40, edits):
                new[at] = f"n{rng.integers(0, 10**6)}"
            said.append(" ".join(new))
    top = similar_by_hand(said)
    got = texts(cp.near_duplicates(spark, rows_of(spark, [(i, t, "en", "s") for i, t in enumerate(said)]), ""))
    assert got == Counter((i, said[i]) for i in set(top))


def test_short_texts_below_the_similarity(spark):
    """Of 12 words a pair shares 7 of 9 shingles, 0.778: fingerprints within 48 bits do not make them near-duplicates."""
    from tonarm.llm.simhash import fingerprints_of

    rng = np.random.default_rng(5)
    pairs = []
    for i in range(8_000):
        base = [f"v{i}x{x}" for x in rng.integers(0, 10**6, 12)]
        pairs.append((" ".join(base), " ".join([*base[:-1], f"v{i}y"])))
    fp = [fingerprints_of([t[k].encode() for t in pairs], 5, words=8, distinct=True)[:, :8] for k in (0, 1)]
    near = np.flatnonzero(np.bitwise_count(fp[0] ^ fp[1]).sum(axis=1) <= cp.NEAR["sure"])
    said = [t for i in near[:40] for t in pairs[i]]
    assert len(said) >= 10
    similar = [("a b c d e f g h i j k l m", "a b c d e f g h i j k l n")]  # 8 of 10
    said += similar[0]
    got = texts(cp.near_duplicates(spark, rows_of(spark, [(i, t, "en", "s") for i, t in enumerate(said)]), ""))
    assert got == Counter((i, t) for i, t in enumerate(said[:-1]))


def test_run_end_to_end(spark, tmp_path):
    """All stages by plain Python up to the mixture, whose budgets have their own tests; then the library's tokens."""
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        lang = ["en", "de", "fr"][i % 3]
        base = [f"{lang}{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10]}" for x in rng.integers(0, 100, 30)]
        rows.append((i, "\n".join([" ".join(base), *["the very same line"] * (i % 2)]), lang, f"src{i % 4}"))
        if i % 5 == 0:
            rows.append((100 + i, " ".join([*base[:-1], "other"]), lang, f"src{i % 4}"))
    rows += [(200, "12 ... 34", "en", "src1"), (201, None, "en", "src1"), (202, "", "en", "src1")]
    rows_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    with_letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    count = Counter(k for _, t, _, _ in with_letters for k in {x.strip().lower() for x in t.split("\n")})
    left = [(d, "\n".join(x for x in t.split("\n") if count[x.strip().lower()] < 10), g, s) for d, t, g, s in with_letters]
    top = similar_by_hand([t for _, t, _, _ in left])
    kept = [r for i, r in enumerate(left) if top[i] == i]
    assert len(kept) == 60 and len(left) == 72
    mixed = cp.mix(cp.with_domain(rows_of(spark, kept)), cp.WEIGHTS, cp.MIX_FRACTION, max_epochs=1).where("copies > 0")
    library = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    said = {d: t for d, t, _, _ in kept}
    want = {}
    for d in [r["doc_id"] for r in mixed.collect()]:
        ids = library.encode(said[d], add_special_tokens=False).ids
        want[d] = len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, str(tmp_path)).collect()}
    assert got == want and 40 < len(want) < 60


def test_mixture_takes_rows(spark):
    """Equal rows: as many stay as the budget takes."""
    rows = [(None, "a b c d", "en", "s1")] * 20 + [(7, "a b c d", "en", "s1")] * 3 + [(7, "e f", None, None), (8, "", "de", "s2"), (9, None, "de", "s2")]
    df = rows_of(spark, rows)
    got = texts(cp.mixture(spark, df, ""))
    mixed = cp.mix(cp.with_domain(df), cp.WEIGHTS, cp.MIX_FRACTION, max_epochs=1).where("copies > 0")
    want = Counter((r["doc_id"], r["text_hash"]) for r in mixed.collect())
    hashes = {r["text"]: r["h"] for r in df.select("text", cp.text_hash().alias("h")).collect()}
    found = Counter()
    for (d, t), n in got.items():
        found[d, hashes[t]] += n
    assert found == want and 0 < sum(n for (_, t), n in got.items() if t == "a b c d") < 23


def test_language_and_lines(spark):
    rows = [(i, f"die und der {i}\n Shared LINE \nmehr", "de", "s1") for i in range(12)] + [(50, "12 345 !", "de", "s1"), (51, None, "de", "s1"), (None, "das und die", None, None)]
    kept = cp.language(spark, rows_of(spark, rows), "")
    got = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert got == {**{i: "de" for i in range(12)}, None: "de"} and kept.columns == cp.COLUMNS
    got = texts(cp.lines(spark, kept, ""))
    assert got == Counter([(i, f"die und der {i}") for i in range(12)] + [(None, "das und die")])


def test_tokens_and_empty_tables(spark):
    pytest.importorskip("public_tokenizers")
    rows = rows_of(spark, [(1, "hello world", "en", "s"), (None, None, None, None)])
    got = {r["doc_id"]: r["n_tokens"] for r in cp.tokens(spark, rows, "").collect()}
    assert got == {1: 2, None: 0}
    for _, stage in cp.STAGES:
        assert stage(spark, rows_of(spark, []), "").count() == 0
