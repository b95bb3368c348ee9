"""The stemmer as DuckDB SQL: one sub-select a step, with the patterns of `functions/stem.py`."""

from __future__ import annotations

from tonarm.functions import stem as st


def _has(pattern: str, c: str = "stem") -> str:
    return f"regexp_matches({c}, '{pattern}')"


_ONE = f"({_has(st.MORE_0)} AND NOT {_has(st.MORE_1)})"


def _table(rules: dict[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.items()) + " END"


def _step(source: str, suffixes, made: str) -> str:
    """made: the word in terms of w, its longest suffix s and the stem before it."""
    cut = f"SELECT token, w, regexp_extract(w, '{st.ending(suffixes)}', 1) AS s FROM ({source})"
    return f"SELECT token, CASE WHEN s = '' OR NOT {_has(st.PLAIN, 'token')} THEN w ELSE {made} END AS w FROM (SELECT *, left(w, length(w) - length(s)) AS stem FROM ({cut}))"


def stems(source: str, name: str) -> str:
    """A table expression `name` (token, stem) of the distinct tokens of source (token)."""
    mended = f"CASE WHEN {_has(st.MENDED)} THEN stem || 'e' WHEN {_has(st.TWICE)} THEN left(stem, length(stem) - 1) WHEN {_ONE} AND {_has(st.SHORT)} THEN stem || 'e' ELSE stem END"
    past = f"CASE WHEN s = 'eed' THEN CASE WHEN {_has(st.MORE_0)} THEN stem || 'ee' ELSE w END WHEN {_has(st.VOWEL)} THEN {mended} ELSE w END"
    rules = lambda table, least: f"CASE WHEN {_has(least)} THEN stem || {_table(table)} ELSE w END"
    q = f"SELECT DISTINCT token, token AS w FROM {source}"
    q = _step(q, st.PLURALS, f"stem || {_table(st.PLURALS)}")
    q = _step(q, ("eed", *st.PAST), past)
    q = _step(q, ["y"], rules({"y": "i"}, st.VOWEL))
    q = _step(q, st.DOUBLE_SUFFIXES, rules(st.DOUBLE_SUFFIXES, st.MORE_0))
    q = _step(q, st.FULL_SUFFIXES, rules(st.FULL_SUFFIXES, st.MORE_0))
    q = _step(q, st.LAST_SUFFIXES, f"CASE WHEN {_has(st.MORE_1)} AND (s <> 'ion' OR {_has('[st]$')}) THEN stem ELSE w END")
    q = _step(q, ["e"], f"CASE WHEN {_has(st.MORE_1)} OR ({_has(st.MORE_0)} AND NOT {_has(st.SHORT)}) THEN stem ELSE w END")
    q = _step(q, ["l"], f"CASE WHEN ends_with(w, 'll') AND {_has(st.MORE_1)} THEN stem ELSE w END")
    return f"{name} AS (SELECT token, w AS stem FROM ({q}))"
