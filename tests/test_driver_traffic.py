"""Whole queries plan no join by broadcast: neither the tables that labelling writes nor the result go through the driver."""

import pytest

from tessera import registry
from tessera.operators import regions

DIR = "/root/testdata/sf0.001"
QUERIES = ["join_label_overlap", "fea_hull", "fea_morphometry", "fea_intensity", "cc_fill_holes", "cc_fill_seeds", "cc_label4_numbered", "cc_select"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_plan_broadcasts(spark, monkeypatch, name):
    plans, cut = [], regions.cut
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(regions, "cut", lambda df: plan(df) or cut(df))
    plan(registry.QUERIES[name](spark, DIR))
    assert len(plans) >= 3 and any("Join" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]
