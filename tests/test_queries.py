"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import pytest
from pyspark.sql import functions as F

from landgrid import queries as Q
from landgrid.functions import text as X


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(Q.QUERIES[name](spark, sf_dir), duck, Q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["linkage_crossref_dense", "fk_violations_found", "assign_claim_ids_beyond", "claims_page_deep", "queue_replay"])
def test_query_has_rows(name, spark, sf_dir):
    assert not Q.QUERIES[name](spark, sf_dir).isEmpty()


def test_every_query_has_sql(spark, sf_dir):
    assert set(Q.QUERIES) == set(Q.ORACLE_SQL)
    assert Q.QUERIES["boundaries"](spark, sf_dir).where("n > 0").count() > 0


def test_entity_summary_counts_every_kind(spark, sf_dir):
    summary = Q.QUERIES["entity_summary"](spark, sf_dir)
    for kind in X.KINDS:
        assert summary.select("id", kind).exceptAll(Q.QUERIES[kind](spark, sf_dir).select("id", "n")).isEmpty()
    assert summary.agg(F.max("boundaries")).first()[0] > 1


def test_entry_module():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
