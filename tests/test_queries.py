"""Every query runs on the small tables; those with SQL give the same rows as their SQL."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

DIR = os.environ.get("TQ_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        assert compare(spark, con, fn, sql, DIR) == ""
    else:  # every plan runs, whole
        df = fn(spark, DIR)
        df.write.format("noop").mode("overwrite").save()
        assert df.columns


def test_span_compactions_with_hits(spark, make_spans, tmp_path):
    from tracequarry.functions import classify as C

    near = "## Summary, summarized\n" + "x" * 100  # 60 points without the name
    low = "## Context of a summary"  # 55 points only with the name
    rows = [(C.COMPACTION_TASK, "x"), ("so: " + C.COMPACTION_CONTINUED, None), (near, None), (low, "litellm_request"), (low, "x"), (low, None), (near + " continued from", "x"), ("write a " + near, "x"), ("short", "litellm_request"), (None, "litellm_request")]
    make_spans(*({"input_value": v, "name": n} for v, n in rows)).write.parquet(str(tmp_path / "spans.parquet"))
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fn, sql = entry.queries()["span_compactions"], entry.oracle_sql()["span_compactions"]
    assert compare(spark, duck(str(tmp_path)), fn, sql, str(tmp_path)) == ""
    kinds = {r.id: r.kind for r in fn(spark, str(tmp_path)).collect()}
    assert kinds == {1: "compaction_task", 2: "post_compaction", 3: "compaction_structural", 4: "compaction_structural", 7: "post_compaction_structural", 8: "compaction_task_structural"}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
