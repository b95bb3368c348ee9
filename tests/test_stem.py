import duckdb
from pyspark.sql import functions as F

from tonarm.functions import stem as st
from tonarm.operators import profile
from tonarm.plans import stem_sql

#: Words of the published description, and others, with their stems.
GOLDEN = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil musical music running run dances danc dancing danc guitars guitar relaxing relax energetic energet
melancholic melanchol happiness happi strings string played plai playing plai voices voic flying fly dying dy studies studi national nation happily happili
toys toi syzygy syzygi was wa yes ye be be the the"""


def golden():
    words = GOLDEN.split()
    return list(zip(words[::2], words[1::2], strict=True))


def test_golden_words(spark):
    assert len(golden()) >= 100
    odd = [("été", "été"), ("x9s", "x9s"), ("", ""), ("s", "s"), (None, None), ("naïves", "naïves")]
    df = spark.createDataFrame(golden() + odd, "w string, want string")
    assert [(r["w"], r["s"]) for r in df.select("w", "want", st.stem(F.col("w")).alias("s")).where("NOT s <=> want").collect()] == []
    con = duckdb.connect()
    con.sql("CREATE TABLE t (token VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(w,) for w, _ in golden()])
    assert dict(con.sql(f"WITH {stem_sql.stems('t', 'k')} SELECT token, stem FROM k").fetchall()) == dict(golden())
    assert df.limit(0).select(st.stem(F.col("w"))).count() == 0


def test_tfidf_of_stems(spark):
    df = spark.createDataFrame([(1, ["dances", "dancing", "cats"]), (2, ["dance"]), (3, []), (4, None)], "k long, t array<string>")
    got = {(r["k"], r["token"]): (r["tf"], r["df"]) for r in profile.tfidf(df, "k", F.col("t"), 5, st.stem).collect()}
    assert got == {(1, "danc"): (2, 2), (1, "cat"): (1, 1), (2, "danc"): (1, 2)}


def test_texts_are_tokenised_once(spark, tmp_path):
    """The plan has one generator, no filter on what it tokenises, and both counts read what it wrote."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"some words {i} and more words") for i in range(50)], "k long, text string").write.parquet(path)
    from tonarm.functions.text import clean_and_tokenize

    seen = []
    real = profile.stored
    profile.stored = lambda df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1]
    try:
        out = profile.tfidf(spark.read.parquet(path), "k", clean_and_tokenize(F.col("text")))
    finally:
        profile.stored = real
    (plan,) = seen
    assert plan.count("Generate explode") == 1 and "size(" not in plan
    assert "regexp_extract_all" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 50
