import re

from spindrift.llm.queries import op2_url_filter


def test_url_filter_runs_no_python(spark):
    plan = op2_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
