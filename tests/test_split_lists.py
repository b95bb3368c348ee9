import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tonarm.functions import text
from tonarm.plans import keyword_sql

PARTS = ["and", "AND", "with", "With", "sandy", "without", "rock", "Pop", "the", "it sounds", "Keywords:", "keyword", "suggested tags -", "Tags", " ", "  ", "\t", " ", "　", ",", ";", "|", "/", "//", ".", "..", "-", "_", "é", "x9", "a", "an", "(", ")", "'s", "coding", "the song", "one two three four five six seven"]


@pytest.mark.parametrize("version", [1, 2])
def test_lists_against_sql(spark, version):
    """Random lists of words, separators and blanks."""
    r = random.Random(7)
    rows = [(i, "".join(r.choice(PARTS) + r.choice(["", " "]) for _ in range(r.randint(0, 12)))) for i in range(3_000)] + [(-1, None), (-2, ""), (-3, "  keywords : "), (-4, "a b c d e, f")]
    got = {x["i"]: x["k"] for x in spark.createDataFrame(rows, "i int, s string").select("i", text.split_candidates(F.col("s"), version).alias("k")).collect()}
    con = duckdb.connect()
    con.sql("CREATE TABLE s (i INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO s VALUES (?, ?)", rows)
    want = dict(con.sql(f"WITH {keyword_sql.split('s', 'k', 'i', version)} SELECT i, keywords FROM k").fetchall())
    assert {i: k or [] for i, k in want.items()} == got


def test_patterns_of_a_list(spark):
    """Few patterns for an item, none of them for words that it does not hold, and no stripping of what is cut anyway."""
    plan = spark.createDataFrame([("x",)], "s string").select(text.split_candidates(F.col("s")).alias("k"))._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"regexp_replace\(|regexp_extract\(|split\(|RLIKE", plan)) <= 9 and "trim(" not in plan
    assert "Contains(lower(" in plan
