"""A suffix-rule stemmer for English as column expressions: Porter's algorithm of 1980, without a Python worker.

Five steps of ordered rules; in each the longest suffix that fits decides, under a condition on what stands before it: its
measure (the number of vowel groups that a consonant group follows), whether it holds a vowel, or how it ends. Patterns
need no look-around and no references to groups, so the SQL twin (`plans/stem_sql.py`) reads the same ones.

Words of one or two letters and words with anything but a-z stay as they are; null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first vowel group with what stands before it; `y` is a vowel after a consonant.
_HEAD = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])[aeiou]*[^aeiou]"
#: Measure over 0, measure over 1, a vowel, and consonant-vowel-consonant at the end (the last not w, x or y).
MORE_0, MORE_1 = _HEAD, _HEAD + "[^aeiouy]*[aeiouy][aeiou]*[^aeiou]"
VOWEL = "[aeiou]|[^aeiou]y"
SHORT = "(?:[^aeiouy]|^y|[aeiou]y)[aeiouy][^aeiouwxy]$"
PLAIN = "^[a-z]{3,}$"
TWICE = f"(?:{'|'.join(2 * c for c in 'bcdfghjkmnpqrtvwxy')})$"

# The suffixes of the published rules and what takes their place.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
PAST = ("ed", "ing")
MENDED = "(?:at|bl|iz)$"
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
FULL_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST_SUFFIXES = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def once(c: Column, f) -> Column:
    """f(c), with c computed once however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def ending(suffixes) -> str:
    """A pattern whose first group is the longest of suffixes at a word's end."""
    return f"({'|'.join(suffixes)})$"


def _split(w: Column, suffixes, f) -> Column:
    """f(stem, suffix) of the longest suffix at the end of w; w itself where there is none."""

    def cut(s):
        return once(F.left(w, F.length(w) - F.length(s)), lambda stem: f(stem, s))

    return once(F.regexp_extract(w, ending(suffixes), 1), lambda s: F.when(s == "", w).otherwise(cut(s)))


def _replaced(w: Column, rules: dict[str, str], least: str | None) -> Column:
    """The longest suffix replaced, if what stands before it matches least."""
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    made = lambda stem, s: F.concat(stem, F.element_at(table, s))
    return _split(w, rules, made if least is None else lambda stem, s: F.when(stem.rlike(least), made(stem, s)).otherwise(w))


def _is_one(stem: Column) -> Column:
    return stem.rlike(MORE_0) & ~stem.rlike(MORE_1)


def _mended(stem: Column) -> Column:
    """What is left of a word in -ed or -ing: an `e` comes back, or a doubled letter goes."""
    return (
        F.when(stem.rlike(MENDED), F.concat(stem, F.lit("e"))).when(stem.rlike(TWICE), F.left(stem, F.length(stem) - 1))
        .when(_is_one(stem) & stem.rlike(SHORT), F.concat(stem, F.lit("e"))).otherwise(stem)
    )


def _past(w: Column) -> Column:
    agreed = lambda stem, s: F.when(stem.rlike(MORE_0), F.concat(stem, F.lit("ee"))).otherwise(w)
    other = lambda stem, s: F.when(stem.rlike(VOWEL), _mended(stem)).otherwise(w)
    return F.when(F.endswith(w, F.lit("eed")), _split(w, ["eed"], agreed)).otherwise(_split(w, PAST, other))


def _last(w: Column) -> Column:
    return _split(w, LAST_SUFFIXES, lambda stem, s: F.when(stem.rlike(MORE_1) & ((s != "ion") | stem.rlike("[st]$")), stem).otherwise(w))


def _final_e(w: Column) -> Column:
    return _split(w, ["e"], lambda stem, s: F.when(stem.rlike(MORE_1) | (stem.rlike(MORE_0) & ~stem.rlike(SHORT)), stem).otherwise(w))


def _final_l(w: Column) -> Column:
    return once(F.left(w, F.length(w) - 1), lambda stem: F.when(F.endswith(w, F.lit("ll")) & stem.rlike(MORE_1), stem).otherwise(w))


STEPS = (
    lambda w: _replaced(w, PLURALS, None),
    _past,
    lambda w: _replaced(w, {"y": "i"}, VOWEL),
    lambda w: _replaced(w, DOUBLE_SUFFIXES, MORE_0),
    lambda w: _replaced(w, FULL_SUFFIXES, MORE_0),
    _last,
    _final_e,
    _final_l,
)


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""

    def all_steps(w, steps=STEPS):
        return once(steps[0](w), lambda x: all_steps(x, steps[1:])) if steps else w

    return once(word, lambda w: F.when(w.rlike(PLAIN), all_steps(w)).otherwise(w))


def stems(words: Column) -> Column:
    """The stems of a list of lower-case words, repeats dropped after the first."""
    return F.array_distinct(F.transform(words, stem))
