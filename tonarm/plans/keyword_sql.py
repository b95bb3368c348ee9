"""DuckDB SQL of the keyword rules: the same rows as functions.text.with_keywords, by other means.

The engine's patterns have no look-around, so words are cut out with their neighbours put back (twice, for neighbours are shared).
"""

from __future__ import annotations

from tonarm.functions import text as tx

SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SP, W, NOT_W = f"[{SPACE}]", r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
A = rf"[A-Za-z0-9\-{SPACE}]"
CUT = "chr(1)"


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^{SP}+|{SP}+\z', '', 'g')"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{SP}+'), lambda x: x <> '')"


def cut_word(e: str, word: str, mark: str = CUT) -> str:
    once = lambda x: rf"regexp_replace({x}, '(^|{NOT_W}){word}($|{NOT_W})', '\1' || {mark} || '\2', 'gi')"
    return once(once(e))


def normalize(e: str) -> str:
    return rf"regexp_replace(regexp_replace({e}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+\z', '', 'g'), '{SP}+', ' ', 'g')"


def confident(e: str, version: int) -> str:
    phrases = tx.BAD_PHRASES if version == 2 else tx.BAD_PHRASES_1
    bad = " ".join(f"AND NOT contains(lower({e}), '{p}')" for p in phrases)
    return rf"(regexp_matches({e}, '{W}') AND len({words(e)}) <= 4 AND NOT regexp_matches(lower({e}), '^(?:{'|'.join(tx.BAD_STARTS)}) ') {bad} AND NOT (contains({e}, '.') AND NOT ends_with({strip(e)}, '.')))"


def is_list(e: str) -> str:
    return rf"({strip(e)} <> '' AND (regexp_matches({e}, '[,|;/]') OR regexp_full_match({strip(e)}, '[A-Za-z\-]+(?:{SP}+[A-Za-z\-]+){{0,5}}')))"


def split(source: str, out: str, keys: str, version: int) -> str:
    """CTEs from rows (keys, text) of `source` to rows (keys, keywords) of `out`."""
    t = strip("coalesce(text, '')")
    if version == 2:
        t = f"CASE WHEN contains(text, ',') THEN {t} ELSE {cut_word(t, 'and', chr(39) + ',' + chr(39))} END"
    items = "list_transform(flatten(list_transform(regexp_split_to_array(t, '[/;|]+'), lambda p: string_split(p, ','))), lambda i: {})"
    if version == 2:
        first = items.format(strip(f"split_part({cut_word('i', 'with')}, {CUT}, 1)"))
        steps = f"""{out}_b AS (SELECT {keys}, {first} AS l FROM {out}_a),
{out}_c AS (SELECT {keys}, flatten(list_transform(l, lambda i: CASE WHEN len({words('i')}) <= 6 THEN string_split({cut_word('i', 'and')}, {CUT}) ELSE [i] END)) AS l FROM {out}_b),"""
    else:
        steps = f"{out}_c AS (SELECT {keys}, {items.format('i')} AS l FROM {out}_a),"
    return rf"""{out}_a AS (SELECT {keys}, regexp_replace({t}, '^(?:keywords?|suggested tags?|suggested|tags?){SP}*[:\-]?{SP}*', '', 'i') AS t FROM {source}),
{steps}
{out}_d AS (SELECT {keys}, list_filter(list_transform(l, lambda i: {strip(f"regexp_replace({normalize('i')}, '[.]+$', '')")}), lambda i: {confident('i', version)}) AS l FROM {out}_c),
{out}_e AS (SELECT {keys}, list_transform(l, lambda i: lower(i)) AS l FROM {out}_d),
{out} AS (SELECT {keys}, list_filter(l, lambda x, i: list_position(l, x) = i) AS keywords FROM {out}_e)"""


def keywords(source: str, out: str, version: int = 2) -> str:
    """CTEs from rows (doc_id, text) of `source` to rows (doc_id, text, extracted_keywords, kw_method, n_keywords) of `out`."""
    marker = "(?:keywords?|suggested tags?|suggested|tags?)"
    start, some = rf"(?:^|{NOT_W})", lambda n: rf"(?s)^.*{n}(.*)$"
    if version == 2:
        # What follows a marker word: white space, a sign, or anything that is not of a word.
        tails = [rf"{SP}+[:\-]?{SP}*([^\n]*)", rf"[:\-]{SP}*([^\n]*)", rf"({NOT_W}[^\n]*)", "()"]
        tail = rf"(?i){start}{marker}(?:{'|'.join(tails)})\z"
        field = " || ".join(f"regexp_extract(s, '{tail}', {i})" for i in (1, 2, 3))
    else:
        tail = rf"(?i){start}{marker}{SP}*[:\-]?{SP}*([^\n]+)\z"
        field = f"regexp_extract(s, '{tail}', 1)"
    line = rf"(?i){start}{marker}($|{NOT_W})"
    before = "array_to_string(lines[1:hit], ' ')"
    sentence = f"CASE WHEN contains({before}, '.') THEN {strip(f'string_split({before}, chr(46))[-2]')} ELSE {before} END"
    mix = rf"(?i)(?:mix|blend){SP}+of{SP}+([^\n]+)\z"
    listed = rf"({A}{{2,120}}(?:,{SP}*{A}{{1,120}}){{1,6}})(?:{SP}+with[^\n]*)?\z"
    rest = rf"({A}{{3,120}}{SP}*,{SP}*{A}{{1,120}}{SP}*(?:,{SP}*{A}{{1,120}}){{1,6}}){SP}*\.?{SP}*\z"
    previous = f"(3, 'prev_sentence_list', CASE WHEN marked AND hit > 0 THEN CASE WHEN regexp_matches(prev, '{mix}') THEN regexp_extract(prev, '{mix}', 1) ELSE regexp_extract(prev, '{listed}', 1) END END)," if version == 2 else ""
    rules = rf"""(1, 'keywords_field', CASE WHEN marked THEN {strip(field)} END),
 (2, 'keywords_field_nextline', CASE WHEN marked AND hit > 0 THEN lines[hit + 1] END), {previous}
 (4, 'trailing_double_pipe', {strip(f"regexp_extract(s, '{some('[|][|]')}', 1)")}), (5, 'trailing_pipe', {strip(f"regexp_extract(s, '{some('[|]')}', 1)")}),
 (6, 'trailing_paren', regexp_extract(s, '\(([^)]+)\)\z', 1)), (7, 'trailing_after_dot', {strip(f"regexp_extract(s, '{some('[.]')}', 1)")}),
 (8, 'last_line_list', lines[-1]), (9, 'last_lines_combined', CASE WHEN len(lines) >= 2 THEN lines[-2] || ' ' || lines[-1] END), (10, 'regex_tail_list', regexp_extract(s, '{rest}', 1))"""
    return rf"""{out}_1 AS (SELECT doc_id, {strip("coalesce(text, '')")} AS s FROM {source}),
{out}_2 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(s, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {strip('x')}), lambda x: x <> '') AS lines, regexp_matches(s, '{tail}') AS marked FROM {out}_1),
{out}_3 AS (SELECT *, CASE WHEN marked THEN coalesce(list_position(list_transform(lines, lambda x: regexp_matches(x, '{line}')), true), 0) ELSE 0 END AS hit FROM {out}_2),
{out}_4 AS (SELECT *, {sentence} AS prev FROM {out}_3),
{out}_5 AS (SELECT d.doc_id, r.pos, r.method, r.text FROM {out}_4 d, LATERAL (VALUES {rules}) r(pos, method, text) WHERE {is_list('r.text')}),
{split(f"{out}_5", f"{out}_6", "doc_id, pos, method", version)},
{out}_7 AS (SELECT doc_id, arg_min(keywords, pos) AS k, arg_min(method, pos) AS m FROM {out}_6 WHERE len(keywords) > 0 GROUP BY doc_id),
{out} AS (SELECT d.doc_id, d.text, coalesce(array_to_string(k, '|'), '') AS extracted_keywords, coalesce(m, 'none') AS kw_method, coalesce(len(k), 0)::INTEGER AS n_keywords, coalesce(k, []) AS kw_list FROM {source} d LEFT JOIN {out}_7 USING (doc_id))"""
