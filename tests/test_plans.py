"""What the physical plans must look like to hold on large tables."""

import os

import pytest
from pyspark.sql import functions as F

from hibiki.catalog import retrieval, service, tables
from hibiki.catalog import views as V
from hibiki.operators.ranking import best_per_key

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_per_key_is_cut_before_the_shuffle(spark):
    events = V.table(spark, SF_DIR, "events")
    text = plan(best_per_key(events, ["user_id"], [F.desc("ts")], 3))
    partial, final = text.index("row_number(), 3, Partial"), text.index("row_number(), 3, Final")
    assert final < text.index("Exchange") < partial


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(V.customers(spark, SF_DIR).filter("name = 'Customer#000000001'").select("tier"))
    assert "PushedFilters: [IsNotNull(c_name), EqualTo(c_name,Customer#000000001)]" in text
    assert "ReadSchema: struct<c_name:string,c_acctbal:double>" in text


def test_projection_does_not_read_texts(spark):
    text = plan(tables.project_cols(spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text


@pytest.mark.parametrize(
    "query",
    [tables.change_feed, service.enrich_vehicles, service.link_mismatch, retrieval.text_topk_,
     retrieval.text_topk_pruned, service.case_model_match],
)
def test_no_pairing_of_everything(spark, query):
    text = plan(query(spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
