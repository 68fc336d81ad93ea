"""Registered queries against their DuckDB oracle at sf0.001 (fast subset)."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import kinds, rows_of
from siftwork.sources.corpus import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["clean_text", "admit_documents", "keyword_density", "density_top5", "extract_bullets", "lexicon_match",
        "section_presence", "verb_usage", "readability", "contact_signals", "domain_inference", "keyword_coverage",
        "skill_gap", "top_third_scan", "parse_issues", "screening_verdict", "bullet_rewrite", "bullet_issues",
        "project_strength", "rewrite_document", "version_compare", "owner_languages_topk", "tech_stack",
        "rake_keywords", "debounced_lint", "repo_payload_scan", "resolve_targets"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    ddf = con.execute(E.oracle_sql()[name]).df()
    assert rows_of(sdf) == rows_of(ddf)
    assert kinds(sdf) == kinds(ddf)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.columns) > 5
    assert df.limit(5).count() >= 0
