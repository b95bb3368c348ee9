"""Text rules as column expressions: tokens, tag lists and keyword extraction.

Word characters are letters, digits and `_`, and white space is Unicode's, both spelled out because Java's classes are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SP = f"[{SPACE}]"
#: The same characters, one by one.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
START, END = rf"(?<!{W})", rf"(?!{W})"

# English stop words without those that hold an apostrophe, which tokens never do.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

# Starts and phrases that rule a keyword out; the first version's list is longer.
BAD_STARTS = ("a", "an", "the", "it", "its", "like", "such", "this", "that")
BAD_PHRASES = ("the song", "it sounds", "suggested tags", "keywords", "suggested", "recommended", "example")
BAD_PHRASES_1 = (*BAD_PHRASES, "the answer", "the total", "software", "programming", "coding")

# Words that mark a keyword list.
MARKER = "(?:keywords?|suggested tags?|suggested|tags?)"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SP}+", -1), lambda x: x != "")


def clean_and_tokenize(c: Column, null_token: bool = False) -> Column:
    """Lower-case runs of word characters that are all letters and no stop words; null gives none, or `nan` if asked for."""
    text = F.coalesce(c, F.lit("nan" if null_token else ""))
    # A run of letters that no digit or `_` goes on; of any other run the group is empty.
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(\p{{L}}++)(?![\p{{N}}_])|{W}++"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin("", *STOP_WORDS))


def normalize_token(c: Column) -> Column:
    """From the first letter or digit to the last, with single blanks."""
    inner = F.regexp_extract(c, r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", 0)
    return F.regexp_replace(inner, rf"{SP}{{2,}}|(?! ){SP}", " ")


def is_high_confidence(c: Column, phrases=BAD_PHRASES) -> Column:
    return c.rlike(W) & (F.size(words(c)) <= 4) & _unsuspicious(F.lower(c), phrases) & ~(F.contains(c, F.lit(".")) & ~F.endswith(strip(c), F.lit(".")))


def _unsuspicious(low: Column, phrases) -> Column:
    ok = ~low.rlike(f"^(?:{'|'.join(BAD_STARTS)}) ")
    for p in phrases:
        ok = ok & ~F.contains(low, F.lit(p))
    return ok


def looks_like_tag_list(c: Column) -> Column:
    """Holds a separator, or is one to six plain words; null is false."""
    said = strip(c)
    few = said.rlike(rf"^[A-Za-z\-]+(?:{SP}+[A-Za-z\-]+){{0,5}}\z")
    return F.coalesce((said != "") & (c.rlike(r"[,|;/]") | few), F.lit(False))


def _flat_map(a: Column, f) -> Column:
    return F.flatten(F.transform(a, f))


def split_candidates(c: Column, version: int = 2) -> Column:
    """Clean, lower-case, distinct keywords of a list in text, in order."""
    # Neither a line nor an item is stripped before its ends are cut off in normalize_token; what is cheap to see comes before patterns.
    t = F.coalesce(c, F.lit(""))
    both = f"(?i){START}and{END}"
    has = lambda x, word: F.contains(F.lower(x), F.lit(word))
    if version == 2:
        t = F.when(~F.contains(t, F.lit(",")) & has(t, "and"), F.regexp_replace(t, both, ",")).otherwise(t)
    t = F.regexp_replace(t, rf"(?i)^{SP}*+(?:keywords?|suggested tags?|suggested|tags?){SP}*[:\-]?{SP}*", "")
    items = F.split(t, r"[/;|]+|,", -1)
    if version == 2:
        items = F.transform(items, lambda i: F.when(has(i, "with"), F.element_at(F.split(i, f"(?i){START}with{END}", 2), 1)).otherwise(i))
        items = _flat_map(items, lambda i: F.when(has(i, "and") & (F.size(words(i)) <= 6), F.split(i, both, -1)).otherwise(F.array(i)))
    phrases = BAD_PHRASES if version == 2 else BAD_PHRASES_1
    # Of such a token, that it is not empty, has four words at most and no full stop is all that is_high_confidence asks before phrases.
    tokens = F.filter(F.transform(items, normalize_token), lambda x: (x != "") & (F.substring_index(x, " ", 4) == x) & ~F.contains(x, F.lit(".")))
    return F.array_distinct(F.filter(F.transform(tokens, F.lower), lambda x: _unsuspicious(x, phrases)))


def _group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, n))


def _first(s: Column, rules, version: int) -> Column:
    """The first rule whose text looks like a list and yields keywords, or null; a later rule is looked at only if those before give nothing."""

    def one(method: str, said: Column) -> Column:
        listed = F.filter(F.array(said), looks_like_tag_list)
        made = F.transform(listed, lambda t: F.struct(split_candidates(t, version).alias("keywords"), F.lit(method).alias("method")))
        return F.try_element_at(F.filter(made, lambda x: F.size(x["keywords"]) > 0), F.lit(1))

    return F.coalesce(*[one(m, t) for m, t in rules])


def with_keywords(df: DataFrame, column: str, version: int = 2) -> DataFrame:
    """df with extracted_keywords, kw_method and n_keywords: the first rule, in a fixed order, whose text looks like a list and yields keywords.

    A rule whose guard fails has a null text; rules are tried in order, the costly ones only where the others give nothing. Null and blank captions give no keywords and `none`. Columns of df named like these are replaced.
    """
    s, lines, at = F.col("_said"), F.col("_lines"), F.col("_at")
    ends = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
    if version == 2:
        marker = rf"(?id){START}{MARKER}{END}{SP}*[:\-]?{SP}*(.*)$"
    else:
        marker = rf"(?id){START}{MARKER}{SP}*[:\-]?{SP}*(.+)$"
    df = df.withColumn("_said", strip(F.coalesce(F.col(column), F.lit(""))))
    df = df.withColumn("_lines", F.filter(F.transform(F.split(s, ends, -1), strip), lambda x: x != "")).withColumn("_marked", s.rlike(marker))
    df = df.withColumn("_at", F.when(F.col("_marked"), F.array_position(F.transform(lines, lambda x: x.rlike(f"(?i){START}{MARKER}{END}")), True).cast("int")).otherwise(0))
    n = F.size(lines)
    line = lambda i: F.try_element_at(lines, i)
    marked = [
        ("keywords_field", strip(_group(s, marker))),
        ("keywords_field_nextline", F.when((at > 0) & (at < n), line(F.greatest(at + 1, F.lit(1))))),
    ]
    a = rf"[A-Za-z0-9\-{SPACE}]"
    if version == 2:
        before = F.array_join(F.slice(lines, 1, F.greatest(at, F.lit(0))), " ")
        sentence = F.when(F.contains(before, F.lit(".")), strip(F.try_element_at(F.split(before, r"\.", -1), F.lit(-2)))).otherwise(before)
        mix = _group(sentence, rf"(?id)(?:mix|blend){SP}+of{SP}+(.+)$")
        listed = _group(sentence, rf"(?d)({a}{{2,120}}(?:,{SP}*{a}{{1,120}}){{1,6}})(?:{SP}+with.*)?$")
        marked.append(("prev_sentence_list", F.when(at > 0, F.coalesce(mix, listed))))
    # What is in a last pair of brackets, from the first opening one after the last closing one before.
    paren = F.substring_index(F.left(s, F.length(s) - 1), ")", -1)
    inner = F.when(F.contains(paren, F.lit("(")), F.substring(paren, F.locate("(", paren) + 1, F.length(paren)))
    trailing = [
        ("trailing_double_pipe", F.when(F.contains(s, F.lit("||")), strip(F.substring_index(s, "||", -1)))),
        ("trailing_pipe", F.when(F.contains(s, F.lit("|")), strip(F.substring_index(s, "|", -1)))),
        ("trailing_paren", F.when(F.endswith(s, F.lit(")")), F.nullif(inner, F.lit("")))),
        ("trailing_after_dot", F.when(F.contains(s, F.lit(".")), strip(F.substring_index(s, ".", -1)))),
        ("last_line_list", line(F.lit(-1))),
        ("last_lines_combined", F.when(n >= 2, F.concat_ws(" ", line(F.lit(-2)), line(F.lit(-1))))),
    ]
    # The end of the text that is made of list characters alone, read from behind; of that the last eight items.
    tail = rf"({a}{{3,120}}{SP}*,{SP}*{a}{{1,120}}{SP}*(?:,{SP}*{a}{{1,120}}){{1,6}}){SP}*\.?{SP}*\z"
    end = F.reverse(F.regexp_extract(F.reverse(s), rf"^{SP}*+\.?[A-Za-z0-9\-,{SPACE}]*+", 0))
    rest = [("regex_tail_list", _group(F.substring_index(F.when(F.regexp_count(end, F.lit(",")) >= 2, end), ",", -8), tail))]
    none = F.struct(F.array().cast("array<string>").alias("keywords"), F.lit("none").alias("method"))
    found = F.coalesce(F.when(F.col("_marked"), _first(s, marked, version)), _first(s, trailing, version), _first(s, rest, version), none)
    df = df.withColumn("_k", F.when(s == "", none).otherwise(found))
    df = df.withColumns({"extracted_keywords": F.col("_k.keywords"), "kw_method": F.col("_k.method")}).withColumn("n_keywords", F.size("extracted_keywords"))
    return df.drop("_said", "_lines", "_marked", "_at", "_k")


def caption_with_keywords(caption: Column, keywords: Column, most: int = 4) -> Column:
    """`<caption> || kw, kw, ...` of the first `most` keywords that are not empty, which `trailing_double_pipe` reads again; without keywords the caption alone.

    Bars in a caption would end it early, so each becomes a slash; so do bars and commas of keywords, which would split them.
    """
    said = F.replace(strip(F.coalesce(caption, F.lit(""))), F.lit("|"), F.lit("/"))
    words_ = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: strip(F.translate(k, "|,", "//")))
    few = F.slice(F.filter(words_, lambda k: k != ""), 1, most)
    return F.when(F.size(few) > 0, F.concat(said, F.lit(" || "), F.array_join(few, ", "))).otherwise(said)


def likely_has_keywords(c: Column, n_keywords: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    marked = s.rlike(rf"(?i){START}(?:keywords?|suggested tags?){END}")
    listed = (F.size(words(s)) >= 40) & (F.regexp_count(F.right(s, F.lit(180)), F.lit(",")) >= 2)
    return (n_keywords == 0) & (marked | listed)


def numeric_from_track(c: Column) -> Column:
    """The last `_` part if all digits, else the last run of digits, else the id."""
    part = F.element_at(F.split(c, "_", -1), -1)
    runs = F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.contains(c, F.lit("_")) & part.rlike(r"^\d+\z"), part).otherwise(F.coalesce(F.try_element_at(runs, F.lit(-1)), c))


def path_candidates(root: str, path: Column, numeric: Column, try_trim: bool = True) -> Column:
    """Places to look for a file, the best first, without repeats."""
    path = F.coalesce(path, F.lit(""))
    top = F.concat_ws("/", F.lit(root), F.when(path != "", F.left(path, F.lit(2))))
    under = lambda *x: F.concat_ws("/", *x)
    found = [under(F.lit(root), F.when(path != "", path)), under(F.lit(root), F.when(path != "", F.substring_index(path, "/", -1))), under(top, F.concat(numeric, F.lit(".mp3")))]
    if try_trim:
        found.append(F.when(numeric.rlike(r"^\d+\z"), under(top, F.concat(F.regexp_replace(numeric, r"^0+(?=.)", ""), F.lit(".mp3")))))
    return F.array_distinct(F.array_compact(F.array(*found)))
