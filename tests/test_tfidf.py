import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonarm.functions import stem as st
from tonarm.functions import text
from tonarm.operators import profile


def expected(rows, top):
    """Rows (key, token, tf, df, weight, rank) of rows (key, tokens), by plain Python."""
    counts = {}
    for k, tokens in rows:
        counts.setdefault(k, Counter()).update(tokens or [])
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for k, c in counts.items():
        each = sorted(((-round(n * (math.log((1 + len(rows)) / (1 + df[t])) + 1), 6), t, n) for t, n in c.items()))
        out += [(k, t, n, df[t], -w, i + 1) for i, (w, t, n) in enumerate(each[:top])]
    return sorted(out, key=repr)


#: One token in all rows, some in many, many in one; a key twice, a row without a key, one without tokens.
ROWS = [(i, ["all", f"m{i % 5}", f"m{i % 5}", f"one{i}", f"uno{i}", f"m{i % 7}"]) for i in range(60)] + [(3, ["all", "one3"]), (None, ["all", "x"]), (99, []), (98, None)]


@pytest.mark.parametrize("common", [1, 20, 1 << 20])
def test_common_and_rare_tokens(spark, common):
    """The same rows whether tokens are broadcast, shuffled or both."""
    df = spark.createDataFrame(ROWS, "k long, t array<string>")
    got = profile.tfidf(df, "k", F.col("t"), 4, common=common).select("k", "token", "tf", "df", "weight", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS, 4)


@pytest.mark.parametrize("common", [1, 8, 1 << 20])
def test_common_and_rare_stems(spark, common):
    rows = [(i, ["dances", "dancing", "cats", "relational", f"{'abcdefghij'[i]}nnings"][: 2 + i % 4]) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    words = sorted({t for _, ts in rows for t in ts})
    stem_of = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", st.stem(F.col("w")).alias("s")).collect()}
    got = profile.tfidf(df, "k", F.col("t"), 4, st.stem, common=common).select("k", "token", "tf", "df", "weight", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == expected([(k, [stem_of[t] for t in ts]) for k, ts in rows], 4)


def test_rows_of_common_tokens_are_not_shuffled_by_token(spark):
    """Counts by document are neither sorted by token nor dealt by it where the token is common."""
    df = spark.createDataFrame(ROWS, "k long, t array<string>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stemmer in (None, st.stem):
            plan = profile.tfidf(df, "k", F.col("t"), 4, stemmer)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
            mixed = profile.tfidf(df, "k", F.col("t"), 4, stemmer, common=20)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in mixed and "LeftAnti" in mixed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_counts_of_a_document_are_in_one_file(spark, monkeypatch):
    """So the most of a document's tokens are ruled out before the last exchange."""
    seen = []
    real = profile.stored
    monkeypatch.setattr(profile, "stored", lambda df, name: (seen.append((name, out := real(df, name))), out)[1])
    df = spark.createDataFrame(ROWS, "k long, t array<string>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        profile.tfidf(df, "k", F.col("t"), 4, st.stem)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [n for n, _ in seen] == ["tf", "stems"]
    for _, table in seen:
        assert table.select("k", F.input_file_name().alias("file")).distinct().groupBy("k").count().where("count > 1").isEmpty()


def test_tokens_are_whole_runs(spark):
    """Runs of letters alone count; what stands beside a digit or `_` is no token, stop words are none."""
    said = ["abc 1abc abc1 abc_ _abc a1b2c", "The été-Straße don't ÀÉ x9y naïve", "\U0001d400bc d\U0001d400 \U0001d7ceab ab\U0001d7ce", "１２ab ab", "", None, "a\u0301b İstanbul ǅ ªº"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    runs = F.regexp_extract_all(F.lower(F.coalesce("s", F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    plain = F.filter(runs, lambda t: t.rlike(r"^\p{L}+$") & ~t.isin(*text.STOP_WORDS))
    rows = df.select(text.clean_and_tokenize(F.col("s")).alias("got"), plain.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert rows[0]["got"] == ["abc"] and re.search("straße", " ".join(rows[1]["got"]))
