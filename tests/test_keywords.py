import pytest
from pyspark.sql import functions as F

from tonarm.functions import tags, text

CASES = [  # caption, first version, second version
    (None, [], "none", [], "none"),
    ("  ", [], "none", [], "none"),
    ("Calm song. Keywords: dark and moody", ["dark and moody"], "keywords_field", ["dark", "moody"], "keywords_field"),
    ("x\nKeywords:\n a, b", ["a", "b"], "keywords_field", ["a", "b"], "keywords_field"),
    ("A mix of pop, rock and alternative. Keywords:", [], "none", ["pop", "rock", "alternative"], "prev_sentence_list"),
    ("Warm sound || dreamy, soft, piano", ["dreamy", "soft", "piano"], "trailing_double_pipe", ["dreamy", "soft", "piano"], "trailing_double_pipe"),
    ("Warm sound | dreamy; soft", ["dreamy", "soft"], "trailing_pipe", ["dreamy", "soft"], "trailing_pipe"),
    ("Nice track (rock, pop)", ["rock", "pop"], "trailing_paren", ["rock", "pop"], "trailing_paren"),
    ("Nice track (calm (rock, pop)", ["calm (rock", "pop"], "trailing_paren", ["calm (rock", "pop"], "trailing_paren"),
    ("Nice (one) track () (rock, pop)", ["rock", "pop"], "trailing_paren", ["rock", "pop"], "trailing_paren"),
    (f"one two three four five {'x' * 110}{' ' * 9_000}, the a,{' ' * 9_000}an b .", ["four five " + "x" * 110], "regex_tail_list", ["four five " + "x" * 110], "regex_tail_list"),
    ("Soft piano. Calm night", ["calm night"], "trailing_after_dot", ["calm night"], "trailing_after_dot"),
    ("A fast and loud electronic techno piece, dark.", ["dark"], "last_line_list", ["dark"], "last_line_list"),
    ("Tagged as rock, pop", ["ged as rock", "pop"], "keywords_field", ["ged as rock", "pop"], "last_line_list"),
    ("Keywords: Rock, rock, ROCK", ["rock"], "keywords_field", ["rock"], "keywords_field"),
    ("Keywords: the drums, coding, jazz", ["jazz"], "keywords_field", ["coding", "jazz"], "keywords_field"),
]


@pytest.mark.parametrize("version", [1, 2])
def test_cascade(spark, version):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, caption string")
    rows = {r["i"]: r for r in text.with_keywords(df, "caption", version).collect()}
    for i, c in enumerate(CASES):
        want = c[1:3] if version == 1 else c[3:5]
        assert (rows[i]["extracted_keywords"], rows[i]["kw_method"]) == want, c[0]


def test_functions(spark):
    r = spark.range(1).select(
        text.normalize_token(F.lit('  "deep   house!_"')).alias("norm"),
        text.split_candidates(F.lit("rock with a groove, soft and warm")).alias("split"),
        text.clean_and_tokenize(F.lit("The 80s synth_pop, don't stop Été")).alias("tokens"),
        F.array(*[text.numeric_from_track(F.lit(x)) for x in ("track_0871999", "a12b34", "abc")]).alias("numeric"),
        text.path_candidates("r", F.lit("99/871999.mp3"), F.lit("0871999")).alias("paths"),
        tags.combined_text(F.lit("cap"), F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>"), F.array(F.lit("c"))).alias("both"),
        F.array(*[tags.text_of_list(F.lit(x)) for x in ("['a', '', 'b c']", "[]", "plain, text", None, "[broken")]).alias("texts"),
        tags.canonical(F.array(F.lit("XMAS"), F.lit("other")), tags.tag_map("mood/theme")).alias("canonical"),
    ).first()
    assert r["norm"] == "deep house"
    assert r["split"] == ["rock", "soft", "warm"]
    assert r["tokens"] == ["stop", "été"]
    assert r["numeric"] == ["0871999", "34", "abc"]
    assert r["paths"] == ["r/99/871999.mp3", "r/871999.mp3", "r/99/0871999.mp3"]
    assert r["both"] == "cap | tags: a b c"
    assert r["texts"] == ["a b c", "", "plain, text", "", "[broken"]
    assert r["canonical"] == ["christmas", "other"]
    assert [len(tags.tag_map(c)) for c in tags.TAG_MAP] == [27, 31, 41]
