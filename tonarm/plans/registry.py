"""Registered queries and the SQL that gives the same rows.

The driver's tables stand in for the catalogue: documents are tracks and captions, parts hold tag lists, labels are
a partial subset and the set of what is done, embeddings are text vectors and, reversed, audio vectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonarm.functions import stem as st
from tonarm.functions import tags as tg
from tonarm.functions import text as tx
from tonarm.functions import vectors as vc
from tonarm.operators import catalogue as cat
from tonarm.operators import jobs, profile, quantiles, sketches
from tonarm.operators import retrieval as ret
from tonarm.plans import keyword_sql as kq
from tonarm.plans import stem_sql as sq
from tonarm.sources import files as fs
from tonarm.sources import vector_store as vs
from tonarm.sources.checkpoint import Checkpoint
from tonarm.sources.inventory import Inventory, opened
from tonarm.sources.track_store import TrackStore
from tonarm.storage import new_path, spread

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(c):
    return F.array_join(c, "|")


# Tags


def _slots():
    return (
        F.concat(F.lit("genre---"), F.col("p_type")),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("genre---"), F.col("p_brand"))),
        F.concat(F.lit("genre---"), F.col("p_name")),
    )


@query("""
WITH s AS (SELECT p_partkey, ['genre---' || p_type, CASE WHEN p_size % 3 <> 0 THEN 'genre---' || p_brand END, 'genre---' || p_name] AS l FROM part),
t AS (SELECT p_partkey, list_transform(list_filter(l, lambda x: x IS NOT NULL), lambda x: replace(x, 'genre---', '')) AS l FROM s)
SELECT p_partkey, array_to_string(l[1:7], '|') AS tags, len(l[1:7])::INTEGER AS n_tags FROM t""")
def tag_prefix_list(spark, sf_dir):
    tags = F.slice(tg.strip_prefix(tg.gather_tags(*_slots()), "genre"), 1, tg.MAX_TAGS)
    return _t(spark, sf_dir, "part").select("p_partkey", _joined(tags).alias("tags"), F.size(tags).alias("n_tags"))


def _named_tags():
    """Words of the name, and a tag with variants."""
    extra = F.element_at(F.array(*[F.lit(x) for x in ("Punk", "tecno", "raps", "techno")]), (F.col("p_size") % 4 + 1).cast("int"))
    return F.concat(F.split("p_name", " "), F.array(extra, F.lit("rap")))


@query("""
WITH s AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [['Punk', 'tecno', 'raps', 'techno'][(p_size % 4 + 1)::INTEGER], 'rap']) AS l FROM part),
m AS (SELECT p_partkey, list_transform(l, lambda x: CASE lower(x) WHEN 'punk' THEN 'punkrock' WHEN 'tecno' THEN 'techno' WHEN 'raps' THEN 'rap' ELSE lower(x) END) AS l FROM s)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS tags FROM m""")
def tag_canonical(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", _joined(tg.canonical(_named_tags(), tg.tag_map("genre"))).alias("tags"))


@query("""
SELECT d.doc_id, d.lang, l.quality AS genre_tag, l.toxic AS instrument_tag, c.text AS caption
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT * FROM conversations WHERE turn = 0) c ON c.conv_id = d.doc_id""")
def tags_left_enrich(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels")
    captions = _t(spark, sf_dir, "conversations").where("turn = 0").withColumnRenamed("conv_id", "doc_id")
    one = cat.enrich(cat.enrich(docs, labels, "doc_id", "quality", "genre_tag"), labels, "doc_id", "toxic", "instrument_tag")
    return cat.enrich(one, captions, "doc_id", "text", "caption")


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS rows_inside, (SELECT count(DISTINCT doc_id) FROM labels) AS keys")
def overlap_count(spark, sf_dir):
    return cat.overlap(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id"), "doc_id")


_LISTS = ("name_tags", "type_tags", "brand_tags")


def _lists(df, *keep):
    some = lambda n, c: F.when(F.col("p_size") % n != 0, F.split(c, " "))
    return df.select(*keep, some(4, "p_name").alias("name_tags"), some(7, "p_type").alias("type_tags"), F.array("p_brand").alias("brand_tags"))


_LISTS_SQL = """l AS (SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN string_split(p_name, ' ') END AS name_tags,
  CASE WHEN p_size % 7 <> 0 THEN string_split(p_type, ' ') END AS type_tags, [p_brand] AS brand_tags FROM part)"""


def _tag_lists(spark, sf_dir):
    return _lists(_t(spark, sf_dir, "part"), "p_partkey")


@query(f"""
WITH {_LISTS_SQL}, u AS (SELECT 'name_tags' AS tag_type, name_tags AS l FROM l UNION ALL SELECT 'type_tags', type_tags FROM l UNION ALL SELECT 'brand_tags', brand_tags FROM l)
SELECT tag_type, CASE WHEN l IS NULL THEN 'missing' ELSE 'present' END AS status, count(*) AS n FROM u GROUP BY ALL""")
def tag_missing_stats(spark, sf_dir):
    return profile.missing_stats(_tag_lists(spark, sf_dir), list(_LISTS))


@query(f"""
WITH {_LISTS_SQL}, u AS (SELECT 'name_tags' AS tag_type, coalesce(len(name_tags), 0)::DOUBLE AS v FROM l UNION ALL SELECT 'type_tags', coalesce(len(type_tags), 0) FROM l UNION ALL SELECT 'brand_tags', len(brand_tags) FROM l),
q AS (SELECT tag_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM u GROUP BY 1)
SELECT tag_type, q1, median, q3, min(v) AS low, max(v) AS high FROM u JOIN q USING (tag_type)
WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def tag_count_box(spark, sf_dir):
    return profile.box_stats(profile.tag_counts(_tag_lists(spark, sf_dir), list(_LISTS)), "tag_type", "n_tags")


@query("SELECT '[\"' || replace(p_type, ' ', '\",\"') || '\"]' AS combination, count(*) AS n FROM part GROUP BY 1")
def tag_combo_counts(spark, sf_dir):
    return profile.combinations(_t(spark, sf_dir, "part").select(F.split("p_type", " ").alias("tags")), "tags")


@query(f"""
WITH {_LISTS_SQL}, u AS (SELECT 'name_tags' AS tag_type, unnest(name_tags) AS tag FROM l UNION ALL SELECT 'type_tags', unnest(type_tags) FROM l UNION ALL SELECT 'brand_tags', unnest(brand_tags) FROM l),
c AS (SELECT tag_type, tag, count(*) AS n FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tag_type ORDER BY n DESC, tag)::INTEGER AS rank FROM c)
SELECT tag_type, tag, n, rank FROM r WHERE rank <= 15""")
def top_tags_per_type(spark, sf_dir):
    return profile.top_tags(_tag_lists(spark, sf_dir), list(_LISTS), 15)


# Files and progress


def _paths(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    rows = docs.select("doc_id", cat.normalize_path(F.concat(F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("\\"), "doc_id", F.lit(".mp3"))).alias("path"))
    there = rows.where("doc_id % 3 <> 0").select("path")
    other = docs.where("doc_id % 50 = 0").select(F.concat(F.lit("xx/"), "doc_id", F.lit(".mp3")).alias("path"))
    return rows, there.union(other)


_PATHS_SQL = """r AS (SELECT doc_id, lpad((doc_id % 100)::VARCHAR, 2, '0') || '/' || doc_id || '.mp3' AS path FROM documents),
f AS (SELECT path FROM r WHERE doc_id % 3 <> 0 UNION ALL SELECT 'xx/' || doc_id || '.mp3' FROM documents WHERE doc_id % 50 = 0)"""


@query(f"WITH {_PATHS_SQL} SELECT doc_id, path FROM r WHERE path NOT IN (SELECT path FROM f)")
def missing_files(spark, sf_dir):
    rows, files = _paths(spark, sf_dir)
    return cat.not_in(rows, files, "path").select("doc_id", "path")


@query(f"WITH {_PATHS_SQL} SELECT DISTINCT path FROM f WHERE path NOT IN (SELECT path FROM r)")
def extra_files(spark, sf_dir):
    rows, files = _paths(spark, sf_dir)
    return cat.not_in(files.distinct(), rows, "path")


@query(f"""WITH {_PATHS_SQL} SELECT (SELECT count(*) FROM r) AS rows_total, (SELECT count(DISTINCT path) FROM r) AS paths_named,
(SELECT count(DISTINCT path) FROM f) AS files_total, (SELECT count(DISTINCT path) FROM f WHERE path NOT IN (SELECT path FROM r)) AS extra_files""")
def file_counts(spark, sf_dir):
    return cat.file_counts(*_paths(spark, sf_dir))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_todo(spark, sf_dir):
    return cat.not_in(_t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def done_snapshot(spark, sf_dir):
    return cat.done(_t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "labels"), "doc_id")


_TRACKS_SQL = """t AS (SELECT doc_id AS index, 'track_' || lpad(doc_id::VARCHAR, 7, '0') AS track_id, lpad((doc_id % 100)::VARCHAR, 2, '0') || '/' || doc_id || '.mp3' AS path, lpad(doc_id::VARCHAR, 7, '0') AS numeric FROM documents),
f AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'r/' || path WHEN 1 THEN 'r/' || doc_id || '.mp3' WHEN 2 THEN 'r/' || left(path, 2) || '/' || lpad(doc_id::VARCHAR, 7, '0') || '.mp3' END AS p
  FROM (SELECT doc_id, lpad((doc_id % 100)::VARCHAR, 2, '0') || '/' || doc_id || '.mp3' AS path FROM documents)),
g AS (SELECT *, ['r/' || path, 'r/' || split_part(path, '/', -1), 'r/' || left(path, 2) || '/' || numeric || '.mp3'] AS c FROM t),
u AS (SELECT index, unnest(c) AS p, generate_subscripts(c, 1) - 1 AS pos FROM g),
h AS (SELECT index, min(pos) AS pos, arg_min(u.p, pos) AS p FROM u JOIN (SELECT DISTINCT p FROM f) f ON u.p = f.p GROUP BY 1),
x AS (SELECT g.index, g.track_id, g.c, h.p AS resolved_path, coalesce(h.pos, -1)::INTEGER AS matched_candidate_index FROM g LEFT JOIN h USING (index))"""


def _resolved(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    number = F.lpad(F.col("doc_id").cast("string"), 7, "0")
    path = F.concat(F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("/"), "doc_id", F.lit(".mp3"))
    tracks = docs.select(F.col("doc_id").alias("index"), F.concat(F.lit("track_"), number).alias("track_id"), path.alias("path"))
    tracks = tracks.withColumn("numeric", tx.numeric_from_track(F.col("track_id")))
    kind = F.col("doc_id") % 4
    place = F.when(kind == 0, path).when(kind == 1, F.concat("doc_id", F.lit(".mp3"))).when(kind == 2, F.concat(F.left(path, F.lit(2)), F.lit("/"), number, F.lit(".mp3")))
    files = docs.select(F.concat(F.lit("r/"), place).alias("path")).where("path IS NOT NULL")
    return cat.resolve_paths(tracks, files, "r")


@query(f"WITH {_TRACKS_SQL} SELECT index, track_id, resolved_path, matched_candidate_index FROM x")
def resolve_paths(spark, sf_dir):
    return _resolved(spark, sf_dir).select("index", "track_id", "resolved_path", "matched_candidate_index")


@query(f"WITH {_TRACKS_SQL} SELECT index, track_id, array_to_string(c, '|') AS path_guesses FROM x WHERE resolved_path IS NULL")
def resolve_missing(spark, sf_dir):
    return _resolved(spark, sf_dir).where("resolved_path IS NULL").select("index", "track_id", _joined("path_guesses").alias("path_guesses"))


@query(f"""WITH {_TRACKS_SQL}, s AS (SELECT x.*, l.doc_id IS NOT NULL AS processed FROM x LEFT JOIN labels l ON l.doc_id = x.index)
SELECT count(*) AS total, count(resolved_path) AS resolved, count(*) - count(resolved_path) AS missing,
count(*) FILTER (WHERE resolved_path IS NOT NULL AND processed) AS processed, count(*) FILTER (WHERE resolved_path IS NOT NULL AND NOT processed) AS unprocessed FROM s""")
def run_summary(spark, sf_dir):
    did = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("index"), F.lit(True).alias("processed"))
    return cat.run_summary(_resolved(spark, sf_dir).join(did, "index", "left"))


@query("""
WITH s AS (SELECT doc_id, n_chars * 1000 AS frames, floor(least(n_chars * 1000 * 0.30::DOUBLE, 480000.0::DOUBLE))::BIGINT AS n FROM documents)
SELECT doc_id, greatest(0, floor((frames - n) / 2.0::DOUBLE)::BIGINT) AS start, CASE WHEN n <= 0 THEN 48000 ELSE n END AS length, n <= 0 AS is_silence FROM s""")
def segment_bounds(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 1000).alias("frames"))
    return docs.select("doc_id", cat.segment_bounds(F.col("frames"), F.lit(48_000)).alias("s")).select("doc_id", "s.*")


# Profiles


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def column_profile(spark, sf_dir):
    return profile.column_profile(_t(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


def _wide(spark, sf_dir):
    tags = F.split("p_name", " ")
    return _t(spark, sf_dir, "part").select(*[F.when(F.col("p_size") > 10 * i, F.try_element_at(tags, F.lit(i + 1))).alias(f"tag_{i + 1}") for i in range(4)])


_WIDE_SQL = "w AS (SELECT " + ", ".join(f"CASE WHEN p_size > {10 * i} THEN string_split(p_name, ' ')[{i + 1}] END AS tag_{i + 1}" for i in range(4)) + " FROM part)"


@query(f"WITH {_WIDE_SQL} " + " UNION ALL ".join(f"SELECT 'tag_{i}' AS column_name, count(tag_{i}) AS non_null, count(*) - count(tag_{i}) AS nulls FROM w" for i in range(1, 5)))
def null_counts(spark, sf_dir):
    return profile.column_profile(_wide(spark, sf_dir))


@query(f"WITH {_WIDE_SQL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'tag_{i}' AS column_name, 2 * count(tag_{i}) >= count(*) AS kept FROM w" for i in range(1, 5)) + ")")
def sparse_columns(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    counts = profile.column_profile(wide)
    return counts.select("column_name", (F.col("non_null") * 2 >= F.col("non_null") + F.col("nulls")).alias("kept"))


# Captions and keywords

_STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOKENS_SQL = f"""k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda t: regexp_full_match(t, '\\p{{L}}+') AND t NOT IN ({_STOP_SQL})) AS l FROM documents)"""


@query(f"WITH {_TOKENS_SQL}, u AS (SELECT unnest(l) AS token FROM k) SELECT token, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, token LIMIT 100")
def caption_token_top100(spark, sf_dir):
    return profile.top_items(spread(_t(spark, sf_dir, "documents").select("text")), tx.clean_and_tokenize(F.col("text")), "token", 100)


_SP_SQL = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"""
WITH u AS (SELECT doc_id, unnest(string_split(text, ',')) AS raw, generate_subscripts(string_split(text, ','), 1)::INTEGER - 1 AS pos FROM documents),
n AS (SELECT doc_id, pos, regexp_replace(regexp_replace(raw, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+\z', '', 'g'), '{_SP_SQL}+', ' ', 'g') AS token FROM u)
SELECT doc_id, pos, md5(token) AS token, regexp_matches(token, '[\p{{L}}\p{{N}}_]') AND len(list_filter(regexp_split_to_array(token, ' '), lambda x: x <> '')) <= 4
  AND NOT regexp_matches(lower(token), '^(?:{"|".join(tx.BAD_STARTS)}) ') {" ".join(f"AND NOT contains(lower(token), '{p}')" for p in tx.BAD_PHRASES)}
  AND NOT (contains(token, '.') AND NOT ends_with(token, '.')) AS confident FROM n""")
def keyword_tokens(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", ",", -1)).alias("pos", "raw"))
    token = tx.normalize_token(F.col("raw"))
    return docs.select("doc_id", "pos", token.alias("token")).select("doc_id", "pos", F.md5("token").alias("token"), tx.is_high_confidence(F.col("token")).alias("confident"))


@query(rf"""
WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER - 1 AS pos FROM documents),
s AS (SELECT *, regexp_replace(line, '^{_SP_SQL}+|{_SP_SQL}+\z', '', 'g') AS said FROM u)
SELECT doc_id, pos, said <> '' AND (regexp_matches(line, '[,|;/]') OR regexp_full_match(said, '[A-Za-z\-]+(?:{_SP_SQL}+[A-Za-z\-]+){{0,5}}')) AS is_list FROM s""")
def tag_list_flag(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return docs.select("doc_id", "pos", tx.looks_like_tag_list(F.col("line")).alias("is_list"))


def _keywords(spark, sf_dir, version=2):
    return tx.with_keywords(spread(_t(spark, sf_dir, "documents").select("doc_id", "text")), "text", version)


def _kw_sql(select, version=2, source="documents", before=""):
    return f"WITH {before}{kq.keywords(source, 'k', version)} {select}"


_KW_ROWS = "SELECT doc_id, extracted_keywords, kw_method, n_keywords FROM k"


@query(_kw_sql(_KW_ROWS, 1))
def keywords_v1(spark, sf_dir):
    return _keywords(spark, sf_dir, 1).select("doc_id", _joined("extracted_keywords").alias("extracted_keywords"), "kw_method", "n_keywords")


@query(_kw_sql(_KW_ROWS))
def keywords_v2(spark, sf_dir):
    return _keywords(spark, sf_dir).select("doc_id", _joined("extracted_keywords").alias("extracted_keywords"), "kw_method", "n_keywords")


# Captions of every form that the rules know, made of each document's text, and of its first words as a list.
_FORMS = (
    ("", ". Keywords: ", ", ", ""), ("", "\nSuggested tags:\n", ", ", "\nmore"), ("A mix of ", "", ", ", " with a groove. Keywords:"), ("", " || ", ", ", ""), ("", " | ", "; ", ""), ("", " (calm (", ", ", ")"),
    ("", ") (", "/", ")"), ("", ". ", " and ", ""), ("", "\n", ", ", "."), ("Tagged as ", "\n", " ", "\nlike that"), ("", "!? ", ", ", ". "), ("tags ", "... Suggested - ", " and ", "!"), ("", "\u2028Keyword\u3000", ",\u2003", ""),
)


def _forms(spark, sf_dir):
    kind = F.pmod("doc_id", F.lit(len(_FORMS)))
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"[|()]", " ")
    few = F.slice(tx.words(said), 1, 5)
    made = F.lit(None).cast("string")
    for i, (a, b, sep, z) in enumerate(_FORMS):
        made = F.when(kind == i, F.concat(F.lit(a), said, F.lit(b), F.array_join(few, sep), F.lit(z))).otherwise(made)
    return spread(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", made.alias("text"))


def _forms_sql():
    quote = lambda x: " || chr(10) || ".join("'" + y + "'" for y in x.split("\n"))
    cases = " ".join(f"WHEN {i} THEN {quote(a)} || said || {quote(b)} || array_to_string(few, {quote(sep)}) || {quote(z)}" for i, (a, b, sep, z) in enumerate(_FORMS))
    return f"""f0 AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[|()]', ' ', 'g') AS said FROM documents),
f1 AS (SELECT doc_id, said, ({kq.words("said")})[1:5] AS few FROM f0), f AS (SELECT doc_id, CASE doc_id % {len(_FORMS)} {cases} END AS text FROM f1), """


@query(_kw_sql(_KW_ROWS, 1, "f", _forms_sql()))
def keyword_forms_v1(spark, sf_dir):
    return tx.with_keywords(_forms(spark, sf_dir), "text", 1).select("doc_id", _joined("extracted_keywords").alias("extracted_keywords"), "kw_method", "n_keywords")


@query(_kw_sql(_KW_ROWS, 2, "f", _forms_sql()))
def keyword_forms_v2(spark, sf_dir):
    return tx.with_keywords(_forms(spark, sf_dir), "text").select("doc_id", _joined("extracted_keywords").alias("extracted_keywords"), "kw_method", "n_keywords")


_WRITTEN_SQL = r"""w0 AS (SELECT doc_id, replace(regexp_replace(coalesce(text, ''), '^{sp}+|{sp}+\z', '', 'g'), '|', '/') AS said, list_filter(list_transform([lang, source, source || ',|' || doc_id, '', 'fourth', 'fifth'], lambda x: translate(x, '|,', '//')), lambda x: x <> '') AS l FROM documents),
w AS (SELECT doc_id, said || ' || ' || array_to_string(l[1:4], ', ') AS text FROM w0), """.replace("{sp}", _SP_SQL)


@query(_kw_sql("SELECT k.doc_id, md5(w.text) AS caption, extracted_keywords, kw_method FROM k JOIN w USING (doc_id)", 2, "w", _WRITTEN_SQL))
def captions_with_keywords(spark, sf_dir):
    """Captions written with their keywords, and read again."""
    docs = spread(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    given = F.array("lang", "source", F.concat("source", F.lit(",|"), "doc_id"), F.lit(""), F.lit("fourth"), F.lit("fifth"))
    written = docs.select("doc_id", tx.caption_with_keywords(F.col("text"), given).alias("text"))
    return tx.with_keywords(written, "text").select("doc_id", F.md5("text").alias("caption"), _joined("extracted_keywords").alias("extracted_keywords"), "kw_method")


@query(_kw_sql(rf"""SELECT doc_id, n_keywords = 0 AND (regexp_matches({kq.strip("coalesce(text, '')")}, '(?i)(?:^|{kq.NOT_W})(?:keywords?|suggested tags?)(?:$|{kq.NOT_W})')
  OR (len({kq.words("coalesce(text, '')")}) >= 40 AND len(regexp_extract_all(right({kq.strip("coalesce(text, '')")}, 180), ',')) >= 2)) AS likely_has_keywords FROM k"""))
def likely_keywords(spark, sf_dir):
    return _keywords(spark, sf_dir).select("doc_id", tx.likely_has_keywords(F.col("text"), F.col("n_keywords")).alias("likely_has_keywords"))


@query(_kw_sql("SELECT count(*) AS total, round(coalesce(avg((n_keywords > 0)::INTEGER::DOUBLE) * 100, 0), 6) AS coverage FROM k"))
def keyword_coverage(spark, sf_dir):
    share = F.avg((F.col("n_keywords") > 0).cast("double")) * 100
    return _keywords(spark, sf_dir).agg(F.count("*").alias("total"), F.round(F.coalesce(share, F.lit(0.0)), 6).alias("coverage"))


@query(_kw_sql("SELECT kw_method, count(*) AS n FROM k GROUP BY 1"))
def kw_method_counts(spark, sf_dir):
    return _keywords(spark, sf_dir).groupBy("kw_method").agg(F.count("*").alias("n"))


@query(_kw_sql("SELECT keyword, count(*) AS n FROM (SELECT unnest(kw_list) AS keyword FROM k) WHERE keyword <> '' GROUP BY 1 ORDER BY n DESC, keyword LIMIT 60"))
def top_keywords(spark, sf_dir):
    return profile.top_items(_keywords(spark, sf_dir), F.col("extracted_keywords"), "keyword", 60)


@query(_kw_sql("SELECT n_keywords, count(*) AS n FROM k GROUP BY 1"))
def n_keywords_hist(spark, sf_dir):
    return _keywords(spark, sf_dir).groupBy("n_keywords").agg(F.count("*").alias("n"))


@query(_kw_sql("""SELECT kw_method, q1, median, q3, min(v) AS low, max(v) AS high FROM (SELECT kw_method, n_keywords::DOUBLE AS v FROM k)
JOIN (SELECT kw_method, quantile_cont(n_keywords::DOUBLE, 0.25) AS q1, quantile_cont(n_keywords::DOUBLE, 0.5) AS median, quantile_cont(n_keywords::DOUBLE, 0.75) AS q3 FROM k GROUP BY 1) USING (kw_method)
WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL"""))
def n_keywords_box(spark, sf_dir):
    """Box statistics of the keywords a caption has, by method."""
    return profile.box_stats(_keywords(spark, sf_dir).select("kw_method", "n_keywords"), "kw_method", "n_keywords")


@query(f"""
WITH {_TOKENS_SQL}, u AS (SELECT doc_id, unnest(l) AS token FROM k), tf AS (SELECT doc_id, token, count(*) AS tf FROM u GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT doc_id, token, tf, df, round(tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE), 6) AS weight FROM tf JOIN df USING (token)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token)::INTEGER AS rank FROM w)
SELECT doc_id, token, tf, df, weight, rank FROM r WHERE rank <= 5""")
def tfidf_keywords(spark, sf_dir):
    docs = spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return profile.tfidf(docs, "doc_id", tx.clean_and_tokenize(F.col("text")), 5)


_BOX_SQL = """SELECT {g}q1, median, q3, min(v) AS low, max(v) AS high FROM {t} {join} WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL"""
_QUARTERS_SQL = "quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3"


@query(_kw_sql(f"SELECT * FROM ({_BOX_SQL.format(g='', t='(SELECT n_keywords::DOUBLE AS v FROM k)', join=f'CROSS JOIN (SELECT {_QUARTERS_SQL} FROM (SELECT n_keywords::DOUBLE AS v FROM k))')})"))
def n_keywords_box_all(spark, sf_dir):
    """One box over all captions."""
    return profile.box_stats(_keywords(spark, sf_dir).select("n_keywords"), None, "n_keywords")


_PRICES_SQL = "p AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS v FROM lineitem)"


@query(f"""WITH {_PRICES_SQL}, q AS (SELECT l_returnflag, {_QUARTERS_SQL} FROM p GROUP BY 1), b AS ({_BOX_SQL.format(g="l_returnflag, ", t="p", join="JOIN q USING (l_returnflag)")})
SELECT l_returnflag, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, low, high FROM b""")
def price_box(spark, sf_dir):
    """A box of values that hardly repeat."""
    box = profile.box_stats(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return box.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "low", "high")


@query(f"""WITH {_PRICES_SQL} SELECT l_returnflag, count(*) AS n, {", ".join(f"round(quantile_cont(v, {x}), 4) AS {n}" for n, x in (("p01", 0.01), ("p50", 0.5), ("p999", 0.999)))} FROM p GROUP BY 1""")
def price_quantiles(spark, sf_dir):
    found = quantiles.exact_quantiles(_t(spark, sf_dir, "lineitem"), "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p999": 0.999}, "l_returnflag")
    return found.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("p01", "p50", "p999")])


# Sketches


@query(f"WITH {_TOKENS_SQL}, u AS (SELECT unnest(l) AS token FROM k), c AS (SELECT token, count(*) AS n FROM u GROUP BY 1) SELECT token, n, row_number() OVER (ORDER BY n DESC, token)::INTEGER AS rank FROM c ORDER BY n DESC, token LIMIT 100")
def heavy_tokens(spark, sf_dir):
    """The 100 most frequent tokens by mergeable counters."""
    docs = spread(_t(spark, sf_dir, "documents").select("text"))
    return sketches.heavy_hitters(docs.select(F.explode_outer(tx.clean_and_tokenize(F.col("text"))).alias("token")), "token", 100)


@query(SQL["top_tags_per_type"])
def heavy_tags(spark, sf_dir):
    """The 15 most frequent tags of each list by mergeable counters."""
    lists = _tag_lists(spark, sf_dir)
    each = lists.select(F.explode(F.array(*[F.struct(F.lit(c).alias("tag_type"), F.col(c).alias("l")) for c in _LISTS])).alias("s"))
    return sketches.heavy_hitters(each.select("s.tag_type", F.explode_outer("s.l").alias("tag")), "tag", 15, "tag_type")


@query("SELECT part, n, row_number() OVER (ORDER BY n DESC, part)::INTEGER AS rank FROM (SELECT l_partkey::VARCHAR AS part, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, part LIMIT 50")
def heavy_parts(spark, sf_dir):
    """Items that are all about as frequent, from few counters: these grow until they prove the result."""
    return sketches.heavy_hitters(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("part")), "part", 50, capacity=64)


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('5/' || l_orderkey || '-' || l_linenumber), l_orderkey || '-' || l_linenumber)::INTEGER AS r FROM lineitem) WHERE r <= 25""")
def stratified_sample(spark, sf_dir):
    """25 rows of each flag, from bounded states."""
    lines = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    found = sketches.stratified_sample(lines, "line", 25, "l_returnflag", 5)
    place = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.md5(F.concat(F.lit("5/"), "line")), "line"))
    return found.select("l_returnflag", "l_orderkey", "l_linenumber", place.alias("place"))


# Stems of words

_STEMS_SQL = f"{_TOKENS_SQL}, u AS (SELECT doc_id, unnest(l) AS token FROM k), {sq.stems('u', 'z')}"


@query(f"WITH {_STEMS_SQL} SELECT token, any_value(stem) AS stem, count(*) AS n FROM u JOIN z USING (token) GROUP BY 1")
def stemmed_tokens(spark, sf_dir):
    """All tokens of texts with their stems and counts: counted first, so that each is stemmed once."""
    docs = spread(_t(spark, sf_dir, "documents").select("text"))
    counts = docs.select(F.explode_outer(tx.clean_and_tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.where("token IS NOT NULL").select("token", st.stem(F.col("token")).alias("stem"), "n")


@query(f"""WITH {_STEMS_SQL}, tf AS (SELECT doc_id, stem AS token, count(*) AS tf FROM u JOIN z USING (token) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT doc_id, token, tf, df, round(tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE), 6) AS weight FROM tf JOIN df USING (token)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token)::INTEGER AS rank FROM w)
SELECT doc_id, token, tf, df, weight, rank FROM r WHERE rank <= 5""")
def tfidf_stems(spark, sf_dir):
    docs = spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return profile.tfidf(docs, "doc_id", tx.clean_and_tokenize(F.col("text")), 5, st.stem)


_ENGLISH = ("relaxing", "energetic", "melancholic", "happiness", "guitars", "drums", "dancing", "dances", "voices")


@query(f"""WITH s AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [['{"', '".join(_ENGLISH)}'][(p_size % {len(_ENGLISH)} + 1)::INTEGER], 'dances']) AS l FROM part),
u AS (SELECT p_partkey, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM s), {sq.stems('u', 'z')},
f AS (SELECT p_partkey, stem, min(pos) AS pos FROM u JOIN z USING (token) GROUP BY ALL) SELECT p_partkey, string_agg(stem, '|' ORDER BY pos) AS tags FROM f GROUP BY 1""")
def tag_stems(spark, sf_dir):
    """Words of the name and a tag, stemmed, repeats dropped after the first."""
    extra = F.element_at(F.array(*[F.lit(x) for x in _ENGLISH]), (F.col("p_size") % len(_ENGLISH) + 1).cast("int"))
    tags = F.concat(F.split("p_name", " "), F.array(extra, F.lit("dances")))
    return _t(spark, sf_dir, "part").select("p_partkey", _joined(st.stems(tags)).alias("tags"))


# Corpus of texts


@query(f"""WITH {_LISTS_SQL}, j AS (SELECT p_partkey, p_brand AS caption, list_filter(name_tags, lambda t: t <> '') AS a, type_tags AS b FROM l JOIN part USING (p_partkey)),
s AS (SELECT p_partkey, trim(caption) AS c, trim(concat_ws(' ', nullif(array_to_string(a, ' '), ''), nullif(array_to_string(b, ' '), ''))) AS t FROM j)
SELECT p_partkey, CASE WHEN t <> '' THEN c || ' | tags: ' || t ELSE c END AS combined_text FROM s""")
def combined_text(spark, sf_dir):
    part = _lists(_t(spark, sf_dir, "part"), "p_partkey", "p_brand")
    return part.select("p_partkey", tg.combined_text(F.col("p_brand"), F.col("name_tags"), F.col("type_tags")).alias("combined_text"))


@query("""SELECT d.doc_id, d.source, d.lang, l.quality AS source_cap, coalesce(l.toxic::VARCHAR, '') AS caption FROM documents d LEFT JOIN labels l USING (doc_id)""")
def caption_merge(spark, sf_dir):
    meta = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    captions = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("source"), F.col("toxic").cast("string").alias("caption"))
    return cat.merge_captions(meta, captions, "doc_id").select("doc_id", "source", "lang", "source_cap", "caption")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS index, doc_id, md5(text) AS caption, source FROM documents")
def meta_index(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("caption"), "source")
    return cat.meta_index(docs, "doc_id")


@query("SELECT p_partkey, replace(p_type, ' ', '|') AS tags FROM part")
def list_roundtrip(spark, sf_dir):
    said = F.concat(F.lit("['"), F.array_join(F.split("p_type", " "), "', '"), F.lit("']"))
    return _t(spark, sf_dir, "part").select("p_partkey", _joined(tg.list_from_text(said)).alias("tags"))


# Vectors and retrieval

_DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE), lambda x, y: x + y)"
_UNIT = "list_transform({v}, lambda x: x::DOUBLE / greatest(sqrt(" + _DOT.format(a="{v}", b="{v}") + "), 1e-12))"
_SPACES_SQL = f"""e AS (SELECT vec_id AS index, {_UNIT.format(v="embedding")} AS t, {_UNIT.format(v="list_reverse(embedding)")} AS a FROM embeddings)"""


def _text(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("index"), "embedding")


def _audio(spark, sf_dir):
    """The second space: vectors reversed."""
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("index"), F.reverse("embedding").alias("embedding"))


def _prompt(space, at=3):
    """The prompt: the vector of a fixed id."""
    return space.where(F.col("index") == at)


def _short(where="index = 3", n=300, q="t", v="t"):
    return f"SELECT e.index, {_DOT.format(a='p.' + q, b='e.' + v)} AS score FROM e, (SELECT * FROM e WHERE {where}) p ORDER BY score DESC, e.index LIMIT {n}"


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, pos, round(x, 6) AS x FROM (SELECT vec_id, unnest(u) AS x, generate_subscripts(u, 1)::INTEGER - 1 AS pos FROM (SELECT vec_id, {_UNIT.format(v='embedding')} AS u FROM embeddings))")
def l2_normalize(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vc.l2_normalize(F.col("embedding"))).alias("pos", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query("""SELECT vec_id, len(embedding[1:48])::INTEGER AS n_cut, len(list_concat(embedding, list_transform(range(16), lambda i: 0.0::FLOAT)))::INTEGER AS n_filled,
round(list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)), 6) AS sum_cut FROM embeddings""")
def dim_align(spark, sf_dir):
    v = F.col("embedding")
    cut, filled = vc.align(v, 48), vc.align(v, 80)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.size(cut).alias("n_cut"), F.size(filled).alias("n_filled"), F.round(F.aggregate(vc.doubles(cut), F.lit(0.0), lambda s, x: s + x), 6).alias("sum_cut"))


@query(f"WITH {_SPACES_SQL} SELECT index, round({_DOT.format(a='t', b='a')}, 6) AS score FROM e")
def pairwise_cosine(spark, sf_dir):
    return _text(spark, sf_dir).select("index", F.round(vc.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("score"))


@query(f"""WITH {_SPACES_SQL} SELECT e.index, 'fewer texts' AS texts, round({_DOT.format(a='f.t', b='e.a')}, 6) AS score FROM e, (SELECT t FROM e WHERE index % 5 = 2 ORDER BY index LIMIT 1) f
UNION ALL SELECT index, 'as many', round({_DOT.format(a='t', b='a')}, 6) FROM e""")
def similarity_rules(spark, sf_dir):
    """Each recording against the first text where there are fewer texts, else against its own."""
    text, audio = _text(spark, sf_dir), _audio(spark, sf_dir)
    out = None
    for name, texts in (("fewer texts", text.where("index % 5 = 2")), ("as many", text)):
        part = ret.similarities(audio, texts).select("index", F.lit(name).alias("texts"), F.round("score", 6).alias("score"))
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {_SPACES_SQL}, s AS ({_short()}) SELECT index, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, index)::INTEGER AS rank FROM s")
def shortlist_topk(spark, sf_dir):
    space = _text(spark, sf_dir)
    return _rounded(ret.ranked(ret.shortlist(space, _prompt(space)), ret.SHORTLIST))


def _reranked(space):
    return f"""WITH {_SPACES_SQL}, s AS ({_short()}), r AS (SELECT s.index, {_DOT.format(a='p.' + space, b='e.' + space)} AS score FROM s JOIN e USING (index), (SELECT * FROM e WHERE index = 3) p)
SELECT index, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, index)::INTEGER AS rank FROM r"""


@query(_reranked("a"))
def rerank_audio(spark, sf_dir):
    space, audio = _text(spark, sf_dir), _audio(spark, sf_dir)
    return _rounded(ret.ranked(ret.rerank(ret.shortlist(space, _prompt(space)), audio, _prompt(audio)), ret.SHORTLIST))


@query(_reranked("t"))
def rerank_text(spark, sf_dir):
    space = _text(spark, sf_dir)
    return _rounded(ret.ranked(ret.rerank(ret.shortlist(space, _prompt(space)), space, _prompt(space)), ret.SHORTLIST))


@query(f"WITH {_SPACES_SQL}, s AS ({_short(n=20, q='a')}) SELECT index, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, index)::INTEGER AS rank FROM s")
def rank_texts_for_audio(spark, sf_dir):
    return _rounded(ret.ranked(ret.shortlist(_text(spark, sf_dir), _prompt(_audio(spark, sf_dir)), 20), 20))


@query(f"""WITH {_SPACES_SQL}, s AS ({_short()}), r AS (SELECT s.index, {_DOT.format(a='p.a', b='e.a')} AS score FROM s JOIN e USING (index), (SELECT * FROM e WHERE index = 3) p),
k AS (SELECT index, score, row_number() OVER (ORDER BY score DESC, index)::INTEGER AS rank FROM r)
SELECT rank, index, round(score, 6) AS score, 'track_' || lpad(d.doc_id::VARCHAR, 7, '0') AS track_id, d.text AS caption, 'r/' || d.doc_id || '.mp3' AS path
FROM k LEFT JOIN documents d ON d.doc_id = k.index WHERE rank <= 5""")
def recommend(spark, sf_dir):
    text, audio = _text(spark, sf_dir), _audio(spark, sf_dir)
    meta = _t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("index"), F.concat(F.lit("track_"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("track_id"), F.col("text").alias("caption"), F.concat(F.lit("r/"), "doc_id", F.lit(".mp3")).alias("path")
    )
    return _rounded(ret.recommend(text, audio, _prompt(text), _prompt(audio), meta))


def _prompts(space):
    """The query set of searches: every row whose id is divisible by 100, so that the work grows with the table."""
    return space.where("index % 100 = 0").select(F.col("index").alias("prompt_id"), "embedding")


def _batch_sql(q, v):
    return f"""WITH {_SPACES_SQL}, s AS (SELECT p.index AS prompt_id, e.index, {_DOT.format(a='p.' + q, b='e.' + v)} AS score FROM e, (SELECT * FROM e WHERE index % 100 = 0) p),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, index)::INTEGER AS rank FROM s)
SELECT prompt_id, rank, index, round(score, 6) AS score FROM r WHERE rank <= 300"""


def _batch_recommend_sql(q, by):
    return f"""WITH {_SPACES_SQL}, s AS (SELECT p.index AS prompt_id, e.index, {_DOT.format(a='p.' + q, b='e.' + q)} AS score, {_DOT.format(a='p.' + by, b='e.' + by)} AS other FROM e, (SELECT * FROM e WHERE index % 100 = 0) p),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, index) AS rank FROM s),
k AS (SELECT prompt_id, index, other AS score, row_number() OVER (PARTITION BY prompt_id ORDER BY other DESC, index)::INTEGER AS rank FROM r WHERE rank <= 300)
SELECT prompt_id, rank, index, round(score, 6) AS score FROM k WHERE rank <= 5"""


@query(_batch_sql("a", "t"))
def batch_shortlist(spark, sf_dir):
    """Texts for recordings: prompts are vectors of the second space."""
    return _rounded(ret.batch_shortlist(_text(spark, sf_dir), _prompts(_audio(spark, sf_dir))))


@query(_batch_recommend_sql("a", "t"))
def batch_recommend(spark, sf_dir):
    """Shortlists by recordings, scored anew by texts."""
    text, audio = _text(spark, sf_dir), _audio(spark, sf_dir)
    return _rounded(ret.batch_recommend(audio, text, _prompts(audio), _prompts(text)))


@query(_batch_sql("t", "t"))
def batch_shortlist_hundredth(spark, sf_dir):
    text = _text(spark, sf_dir)
    return _rounded(ret.batch_shortlist(text, _prompts(text)))


@query(_batch_recommend_sql("t", "a"))
def batch_recommend_hundredth(spark, sf_dir):
    """Shortlists by texts, scored anew by recordings."""
    text, audio = _text(spark, sf_dir), _audio(spark, sf_dir)
    return _rounded(ret.batch_recommend(text, audio, _prompts(text), _prompts(audio)))


# The clustered store of vectors


def _clustered(spark, sf_dir):
    """A store written in two parts, rows without a vector among them."""
    path, text = new_path(spark, "clustered"), _text(spark, sf_dir)
    some = text.withColumn("embedding", F.when(F.col("index") % 9 != 4, F.col("embedding")))
    vs.write_clustered(some.where("index % 3 <> 0"), path)
    vs.append_clustered(some.where("index % 3 = 0"), path)
    return path


@query(f"""WITH {_SPACES_SQL}, s AS (SELECT e.index, {_DOT.format(a='p.t', b='e.t')} AS score FROM e, (SELECT * FROM e WHERE index = 3) p WHERE e.index % 9 <> 4 ORDER BY score DESC, e.index LIMIT 20)
SELECT index, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, index)::INTEGER AS rank FROM s""")
def clustered_shortlist(spark, sf_dir):
    """The 20 best by a search that reads files in order of their bounds."""
    found, _ = vs.search_clustered(spark, _clustered(spark, sf_dir), _prompt(_text(spark, sf_dir)), 20)
    return _rounded(ret.ranked(found, 20))


@query("""SELECT (SELECT count(*) FROM embeddings) AS n_rows, (SELECT count(*) FROM embeddings WHERE vec_id % 9 = 4) AS n_null, (SELECT count(*) FROM embeddings) AS n_listed,
(SELECT round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 4) FROM embeddings WHERE vec_id % 9 <> 4) AS total""")
def clustered_store(spark, sf_dir):
    """What the store holds, by its rows and by its manifest."""
    path = _clustered(spark, sf_dir)
    rows = vs.read_clustered(spark, path)
    total = F.aggregate(vc.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    held = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("embedding").isNull()).alias("n_null"), F.round(F.sum(total), 4).alias("total"))
    listed = vs.read_manifest(spark, path).agg(F.sum("rows").alias("n_listed"))
    return held.crossJoin(listed)  # one row each


# Jobs around models, with stand-ins for the models


def _make_lengths():
    """An encoder that knows a text's length and its commas; it fails on texts that hold `fail`."""

    def model(texts):
        if any("fail" in t for t in texts):
            raise ValueError("unreadable")
        return [[float(len(t)), float(t.count(",")), 1.0] for t in texts]

    return model


@query("""SELECT doc_id, round(length(text) / sqrt(length(text)::DOUBLE ** 2 + (length(text) - length(replace(text, ',', ''))) ** 2 + 1), 4) AS x,
CASE WHEN contains(text, 'fail') THEN 'failed' ELSE 'ok' END AS status FROM documents""")
def embed_job(spark, sf_dir):
    made = jobs.embed_texts(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", _make_lengths)
    return made.select("doc_id", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("x"), "status")


@query(f"WITH {_TRACKS_SQL} SELECT index, 'ok' AS status FROM x WHERE resolved_path IS NOT NULL AND index NOT IN (SELECT doc_id FROM labels)")
def audio_job_status(spark, sf_dir):
    did = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("index"))
    return jobs.embed_audio(_resolved(spark, sf_dir), did, _make_lengths).select("index", "status")


def _make_names():
    def model(paths):
        if any(p.endswith("7") for p in paths):
            raise ValueError("unreadable")
        return [f"A track at {p}" for p in paths]

    return model


@query("""SELECT 'track_' || doc_id AS track_id, CASE WHEN source LIKE '%7' THEN '' ELSE 'A track at ' || source END AS caption FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def caption_job(spark, sf_dir):
    name = F.concat(F.lit("track_"), "doc_id").alias("track_id")
    tracks = _t(spark, sf_dir, "documents").select(name, F.col("source").alias("path"))
    return jobs.caption(tracks, _t(spark, sf_dir, "labels").select(name, F.lit("done").alias("caption")), _make_names)


@query(_kw_sql("SELECT doc_id, kw_method, n_keywords FROM k ORDER BY md5('0/' || doc_id), doc_id LIMIT 8"))
def inspection_sample(spark, sf_dir):
    return profile.inspection_sample(_keywords(spark, sf_dir).select("doc_id", "kw_method", "n_keywords"), "doc_id", 8)


@query(_kw_sql("""SELECT doc_id, kw_method, n_keywords, found FROM (SELECT *, n_keywords > 0 AS found, row_number() OVER (PARTITION BY n_keywords > 0 ORDER BY md5('1/' || doc_id), doc_id) AS r FROM k) WHERE r <= 8
UNION ALL SELECT doc_id, kw_method, n_keywords, NULL FROM k WHERE doc_id IN (0, 10, 100)"""))
def inspection_groups(spark, sf_dir):
    """Samples of rows with keywords and without, and the rows of fixed places."""
    rows = _keywords(spark, sf_dir).select("doc_id", "kw_method", "n_keywords")
    sample = profile.inspection_sample(rows.withColumn("found", F.col("n_keywords") > 0), "doc_id", 8, 1, "found")
    return sample.union(profile.fixed_rows(rows, "doc_id", (0, 10, 100)).withColumn("found", F.lit(None).cast("boolean")))


# Stores of the catalogue: tables in buckets, checkpoints, and jobs that are taken up again


def _tracks(spark, sf_dir):
    store = TrackStore(spark, new_path(spark, "tracks"), "doc_id", 16, f"t{uuid.uuid4().hex}")
    store.write("documents", _t(spark, sf_dir, "documents").select("doc_id", "lang", "source"))
    store.write("labels", _t(spark, sf_dir, "labels"))
    store.write("captions", _t(spark, sf_dir, "conversations").where("turn = 0").withColumnRenamed("conv_id", "doc_id"))
    return store


@query(SQL["tags_left_enrich"])
def bucketed_enrich(spark, sf_dir):
    """The enrichment of tags_left_enrich from tables in the same buckets: without an exchange."""
    columns = {"genre_tag": ("labels", "quality"), "instrument_tag": ("labels", "toxic"), "caption": ("captions", "text")}
    return _tracks(spark, sf_dir).enrich("documents", columns).select("doc_id", "lang", "genre_tag", "instrument_tag", "caption")


@query(SQL["resume_todo"])
def bucketed_todo(spark, sf_dir):
    return _tracks(spark, sf_dir).missing("documents", "labels").select("doc_id", "source")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'caption ' || l.quality ELSE '' END AS caption, 1::BIGINT AS n_rows FROM documents d LEFT JOIN labels l USING (doc_id)""")
def checkpoint_merged(spark, sf_dir):
    """Six appends, the later ones of captions that were empty before; merged, old files deleted, and read."""
    store = Checkpoint(spark, new_path(spark, "checkpoint"), "doc_id", "doc_id long, caption string")
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    for i in range(3):
        store.append(docs.where(F.col("doc_id") % 3 == i).select("doc_id", F.lit("").alias("caption")))
        store.append(labels.where(F.col("doc_id") % 3 == (i + 1) % 3).select("doc_id", F.concat(F.lit("caption "), "quality").alias("caption")))
    store.merge(2)
    store.vacuum()
    return store.read().groupBy("doc_id").agg(F.max("caption").alias("caption"), F.count("*").alias("n_rows"))


@query("""WITH r AS (SELECT doc_id, source, source LIKE '%7' AS bad, doc_id % 3 <> 0 AS before FROM documents)
SELECT 'results' AS part, doc_id, 'A track at ' || source AS said, 1::BIGINT AS n FROM r WHERE NOT bad UNION ALL SELECT 'dead letters', doc_id, 'ValueError: unreadable', 1 FROM r WHERE bad
UNION ALL SELECT 'run 1', NULL, 'failed ' || count_if(bad), count(*) FROM r WHERE before UNION ALL SELECT 'run 2', NULL, 'failed ' || count_if(bad), count(*) FROM r WHERE NOT before
UNION ALL SELECT 'run 3', NULL, 'failed 0', 0""")
def resumable_job(spark, sf_dir):
    """A first run over a part, a second that does the rest, and a third that has nothing to do; then the results, the dead letters and what each run did."""
    job = jobs.ResumableJob(spark, new_path(spark, "job"), "doc_id", "long", "string")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source")
    runs = [job.run(part, "source", _make_names, 32, slices=3) for part in (docs.where("doc_id % 3 <> 0"), docs, docs)]
    told = spark.createDataFrame([(f"run {i + 1}", None, f"failed {r['failed']}", r["todo"]) for i, r in enumerate(runs)], "part string, doc_id long, said string, n long")
    one = F.lit(1).cast("long").alias("n")
    results = job.results().select(F.lit("results").alias("part"), "doc_id", F.col("result").alias("said"), one)
    return results.union(job.dead_letters().select(F.lit("dead letters").alias("part"), "doc_id", F.col("error").alias("said"), one)).union(told)


def _touch(root, gone=False):
    """Over rows (path): makes the file below root, or takes it away."""

    def run(frames):
        files, top = opened(root)
        for pdf in frames:
            for path in pdf["path"]:
                if gone:
                    files.delete_file(f"{top}/{path}")
                else:
                    files.create_dir(f"{top}/{path.rpartition('/')[0]}")
                    files.open_output_stream(f"{top}/{path}").close()
            yield pdf

    return run


@query("""WITH d AS (SELECT doc_id, lpad((doc_id % 100)::VARCHAR, 2, '0') || '/' || (doc_id % 3) || '/' || doc_id || '.mp3' AS path FROM documents)
SELECT 'run 1' AS run, 'added' AS change, path FROM d WHERE doc_id % 5 <> 0 UNION ALL SELECT 'run 2', 'added', path FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT 'run 2', 'removed', path FROM d WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0""")
def inventory_changes(spark, sf_dir):
    """A file for each document in folders of two levels; some come and some go between two runs."""
    place = F.concat_ws("/", F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.col("doc_id") % 3, F.concat("doc_id", F.lit(".mp3")))
    docs = _t(spark, sf_dir, "documents").select("doc_id", place.alias("path"))
    root = new_path(spark, "recordings")
    listing = Inventory(spark, root, new_path(spark, "inventory"))
    made = lambda rows, gone=False: rows.select("path").repartition(8).mapInPandas(_touch(root, gone), "path string").count()
    made(docs.where("doc_id % 5 <> 0"))
    listing.update()
    made(docs.where("doc_id % 5 = 0"))
    made(docs.where("doc_id % 5 <> 0 AND doc_id % 7 = 0"), True)
    listing.update()
    one = lambda n: listing.changes(n).select(F.lit(f"run {n}").alias("run"), "change", "path")
    return one(1).union(one(2))


# Lists in the lines of all texts


def _split_lists(spark, sf_dir, version):
    docs = spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "pos", F.md5(_joined(tx.split_candidates(F.col("line"), version))).alias("keywords"))


def _split_sql(version):
    lines = "s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER - 1 AS pos FROM documents)"
    return f"WITH {lines}, {kq.split('s', 'k', 'doc_id, pos', version)} SELECT doc_id, pos, md5(coalesce(array_to_string(keywords, '|'), '')) AS keywords FROM k"


@query(_split_sql(1))
def split_lists_v1(spark, sf_dir):
    return _split_lists(spark, sf_dir, 1)


@query(_split_sql(2))
def split_lists_v2(spark, sf_dir):
    return _split_lists(spark, sf_dir, 2)


# Files: written from the tables to the shared folder, and read back


@query("""SELECT 'track_' || p_partkey AS track_id, p_brand AS artist_id, 'album ' || p_size AS album_id, p_partkey || '.mp3' AS path, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS duration,
array_to_string(list_transform(list_concat(string_split(p_name, ' '), CASE WHEN p_size % 2 = 0 THEN [p_type] ELSE [] END), lambda t: 'genre---' || t), '|') AS tags FROM part""")
def tag_table_roundtrip(spark, sf_dir):
    tags = F.transform(F.concat(F.split("p_name", " "), F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>"))), lambda t: F.concat(F.lit("genre---"), t))
    length = F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice").cast("string")).otherwise("unknown")
    fields = (F.concat(F.lit("track_"), "p_partkey"), "p_brand", F.concat(F.lit("album "), "p_size"), F.concat("p_partkey", F.lit(".mp3")), length, F.array_join(tags, "\t"))
    lines = _t(spark, sf_dir, "part").select(F.concat_ws("\t", *fields).alias("value"))
    head = spark.createDataFrame([("\t".join((*(x.upper() for x in fs.FIELDS), "TAGS")),)], "value string")
    path = new_path(spark, "tags")
    head.union(lines).write.text(path)
    return fs.read_tag_table(spark, path).withColumn("tags", _joined("tags"))


@query(r"""SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, '["' || coalesce(replace(lang, '"', ''), 'none') || '","x, \"y\""]' AS tags FROM documents""")
def csv_roundtrip(spark, sf_dir):
    """Names with outer blanks and capitals, arrays, quotes and line ends inside fields."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias(" DOC_ID "), "text", "lang", "source", F.array(F.coalesce("lang", F.lit("none")), F.lit('x, "y"')).alias("tags"))
    path = new_path(spark, "csv")
    fs.write_csv(docs, path)
    back = fs.read_csv(spark, path, required=("doc_id", "text", "tags"))
    return back.select(F.col(fs.find_column(back, "doc_id")).alias("doc_id"), F.md5("text").alias("text"), "lang", "source", "tags")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'second ' || l.quality ELSE '' END AS caption FROM documents d LEFT JOIN labels l USING (doc_id)""")
def checkpoint_appends(spark, sf_dir):
    """Two runs append to one checkpoint; a repeated key is read once, with the caption that is not empty."""
    path = new_path(spark, "captions")
    fs.append_checkpoint(_t(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("caption")), path)
    fs.append_checkpoint(_t(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("second "), "quality").alias("caption")), path)
    return fs.read_checkpoint(spark, path, "doc_id")


@query("SELECT lpad((doc_id % 100)::VARCHAR, 2, '0') AS folder, 1::BIGINT AS n_files FROM documents GROUP BY ALL")
def list_files(spark, sf_dir):
    """One file in each of the folders 00 to 99 that hold a document, and one of another kind."""
    path = new_path(spark, "audio")
    docs = _t(spark, sf_dir, "documents").select(F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0").alias("folder"), F.col("doc_id").cast("string").alias("value"))
    docs.repartition("folder").write.partitionBy("folder").text(path)
    docs.limit(1).select("value").write.json(f"{path}/folder=other")
    found = fs.list_files(spark, path, "*.txt")
    return found.groupBy(F.regexp_extract("path", r"folder=([^/]+)", 1).alias("folder")).agg(F.count("*").alias("n_files"))


@query("""SELECT vec_id AS index, CASE WHEN vec_id % 7 <> 0 THEN len(embedding)::INTEGER END AS size, CASE WHEN vec_id % 7 <> 0 THEN round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) END AS total FROM embeddings""")
def vector_store(spark, sf_dir):
    """Vectors of some rows are stored; all rows are looked up."""
    text, path = _text(spark, sf_dir), new_path(spark, "vectors")
    fs.write_vectors(text.where("index % 7 <> 0"), path)
    v = F.col("embedding")
    total = F.aggregate(vc.doubles(v), F.lit(0.0), lambda s, x: s + x)
    return fs.read_vectors(spark, path, text).select("index", F.when(v.isNotNull(), F.size(v)).alias("size"), F.round(total, 6).alias("total"))


@query(f"""WITH {_TRACKS_SQL}, m AS (SELECT doc_id, source, source LIKE '%7' AS bad FROM documents),
w AS (SELECT 'failed.json' AS file, doc_id::VARCHAR AS key, 'ValueError: unreadable' AS said FROM m WHERE bad UNION ALL SELECT 'failed.csv', doc_id::VARCHAR, 'ValueError: unreadable' FROM m WHERE bad
UNION ALL SELECT 'missing.csv', index::VARCHAR, '["' || array_to_string(c, '","') || '"]' FROM x WHERE resolved_path IS NULL UNION ALL SELECT 'missing.json', index::VARCHAR, array_to_string(c, '|') FROM x WHERE resolved_path IS NULL
UNION ALL SELECT 'summary.json', CASE WHEN bad THEN 'failed' ELSE 'ok' END, count(*)::VARCHAR FROM m GROUP BY bad) SELECT file, key, said FROM w""")
def diagnostics(spark, sf_dir):
    """What a job could not do and what it did not find, as JSON and CSV, read back."""
    made = jobs.run_model(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", _make_names, "string", 32)
    lost = _resolved(spark, sf_dir).where("resolved_path IS NULL").select("index", "track_id", "path_guesses")
    path = new_path(spark, "diagnostics")
    fs.write_diagnostics(made.select("doc_id", "status", "error"), path, lost)
    js = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}.json")
    found = [
        ("failed.json", js("failed", "doc_id long, error string"), "doc_id", F.col("error")), ("failed.csv", fs.read_csv(spark, f"{path}/failed.csv"), "doc_id", F.col("error")),
        ("missing.json", js("missing", "index long, path_guesses array<string>"), "index", _joined("path_guesses")), ("missing.csv", fs.read_csv(spark, f"{path}/missing.csv"), "index", F.col("path_guesses")),
        ("summary.json", js("summary", "status string, n long"), "status", F.col("n").cast("string")),
    ]
    out = None
    for name, df, key, said in found:
        part = df.select(F.lit(name).alias("file"), F.col(key).cast("string").alias("key"), said.alias("said"))
        out = part if out is None else out.union(part)
    return out


@query("""WITH w AS (SELECT l_orderkey AS tag_0, CASE WHEN l_linenumber > 2 THEN l_partkey END AS tag_1, CASE WHEN l_linenumber > 5 THEN l_suppkey END AS tag_2, CASE WHEN l_linenumber > 6 AND l_discount > 0.06 THEN l_suppkey END AS tag_3 FROM lineitem),
c AS (SELECT 'tag_0' AS column_name, count(tag_0) AS non_null, count(*) - count(tag_0) AS nulls FROM w UNION ALL SELECT 'tag_1', count(tag_1), count(*) - count(tag_1) FROM w
UNION ALL SELECT 'tag_2', count(tag_2), count(*) - count(tag_2) FROM w UNION ALL SELECT 'tag_3', count(tag_3), count(*) - count(tag_3) FROM w) SELECT * FROM c WHERE non_null >= 5000""")
def drop_sparse_columns(spark, sf_dir):
    """What is left after columns of fewer than 5,000 values have gone."""
    some = lambda n, c: F.when(F.col("l_linenumber") > n, F.col(c))
    wide = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tag_0"), some(2, "l_partkey").alias("tag_1"), some(5, "l_suppkey").alias("tag_2"), F.when((F.col("l_linenumber") > 6) & (F.col("l_discount") > 0.06), F.col("l_suppkey")).alias("tag_3"))
    return profile.column_profile(profile.drop_sparse(wide, 5_000))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN replace(p_type, ' ', ' ') WHEN 1 THEN p_name WHEN 2 THEN '' ELSE p_brand || ' x' END AS said FROM part")
def tag_text_or_raw(spark, sf_dir):
    """Tag fields as text: lists in text form, text that is none, and nothing."""
    kind = F.col("p_size") % 4
    listed = F.concat(F.lit("['"), F.array_join(F.split("p_type", " "), "', '"), F.lit("', '']"))
    field = F.when(kind == 0, listed).when(kind == 1, F.col("p_name")).when(kind == 3, F.concat(F.lit('["'), "p_brand", F.lit('", "x"]')))
    return _t(spark, sf_dir, "part").select("p_partkey", tg.text_of_list(field).alias("said"))


# Retrieval at its edges


@query(f"""WITH {_SPACES_SQL}, s AS ({_short()}), r AS (SELECT s.index, CASE WHEN e.index % 4 = 0 THEN 0.0::DOUBLE ELSE {_DOT.format(a='p.a', b='e.a')} END AS score FROM s JOIN e USING (index), (SELECT * FROM e WHERE index = 3) p)
SELECT index, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, index)::INTEGER AS rank FROM r""")
def rerank_unprocessed(spark, sf_dir):
    """Tracks without an audio vector score 0, above negative scores; ids that stand for nothing drop out."""
    space, audio = _text(spark, sf_dir), _audio(spark, sf_dir)
    some = audio.withColumn("embedding", F.when(F.col("index") % 4 != 0, F.col("embedding")))
    found = ret.shortlist(space, _prompt(space)).select("index")
    strays = found.select((-1 - F.col("index")).alias("index")).union(found.select((F.col("index") + 10**12).alias("index")))
    return _rounded(ret.ranked(ret.rerank(found.union(strays), some, _prompt(audio)), 2 * ret.SHORTLIST))


def _other_size(n):
    cut = f"list_concat(embedding[1:{n}], list_transform(range(greatest(0, len(embedding) - {n})), lambda i: 0.0::FLOAT))[1:len(embedding)]"
    return f"(SELECT {_UNIT.format(v='q')} AS t FROM (SELECT {cut} AS q FROM embeddings WHERE vec_id = 3))"


@query(f"""WITH {_SPACES_SQL}, s AS ({" UNION ALL ".join(f"SELECT * FROM (SELECT {n} AS size, e.index, {_DOT.format(a='p.t', b='e.t')} AS score FROM e, {_other_size(n)} p ORDER BY score DESC, e.index LIMIT 300)" for n in (48, 80))})
SELECT size, index, round(score, 6) AS score, row_number() OVER (PARTITION BY size ORDER BY score DESC, index)::INTEGER AS rank FROM s""")
def shortlist_other_size(spark, sf_dir):
    """Prompts of fewer or more numbers than the vectors hold."""
    space = _text(spark, sf_dir)
    out = None
    for n in (48, 80):
        prompt = _prompt(space).withColumn("embedding", vc.align(F.col("embedding"), n))
        part = ret.ranked(ret.shortlist(space, prompt), ret.SHORTLIST).withColumn("size", F.lit(n))
        out = part if out is None else out.union(part)
    return _rounded(out)
