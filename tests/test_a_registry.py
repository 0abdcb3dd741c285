"""A query leaves no plugin behind."""

from sonoplan import plugins
from sonoplan.plans import files, queries


def test_analysis_query_leaves_no_plugin(spark):
    before = [p.name for p in plugins.list_plugins()]
    assert queries.QUERIES["analyze_job"](spark, "/root/testdata/sf0.001").where("status = 'analyzed'").count() > 0
    assert files and [p.name for p in plugins.list_plugins()] == before
