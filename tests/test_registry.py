import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SOME = ["tag_canonical", "top_tags_per_type", "resolve_paths", "run_summary", "recommend", "batch_recommend", "caption_job", "meta_index", "keyword_forms_v1", "keyword_forms_v2", "tag_table_roundtrip", "csv_roundtrip", "diagnostics", "rerank_unprocessed", "shortlist_other_size", "drop_sparse_columns", "tfidf_stems", "tag_stems", "clustered_shortlist", "price_box", "heavy_parts", "stratified_sample", "bucketed_enrich", "checkpoint_merged", "resumable_job", "captions_with_keywords", "similarity_rules", "inventory_changes"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DIR).select(want.columns).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall()))
