"""Ways of one file are dealt to tasks by their number, as the policy is much work for few bytes."""

from sitewright.plans import records


def test_policy_runs_in_tasks_by_rows(spark, sf, monkeypatch):
    query = records.QUERIES["txt15_way_policy"][0]
    want = sorted(map(tuple, query(spark, sf).collect()), key=repr)
    monkeypatch.setattr(records, "WAYS_A_TASK", 50)
    many = query(spark, sf)
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect()), key=repr) == want
