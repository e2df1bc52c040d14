import pytest
from pyspark.sql import functions as F

from tessera.plans import logs, rollup


def test_bad_values_and_rollup(spark):
    df = spark.createDataFrame([("a", 1, [1.0, float("nan")]), ("a", 2, [3.0, float("inf")])], "image string, tile int, features array<double>")
    tiles = rollup.tile_sum(rollup.features_long(df, ["image", "tile"]), ["image", "tile"])
    got = {r.feature_idx: r for r in rollup.finalize(rollup.merge_sums(tiles, ["image"])).collect()}
    assert (got[0].nu_count, got[0].bad_count, got[0].nu_mean, got[0].nu_stdev) == (2, 0, 2.0, 1.0)
    assert (got[1].bad_count, got[1].nu_mean) == (2, None)


def test_resample_keeps_the_attribute(spark):
    log = spark.createDataFrame([(1, 5, 5, 100), (1, 8, 27, 230), (2, 1, 10, 7)], "eventType int, startT long, endT long, attribute long")
    got = logs.resample(log, 10)
    assert abs(got.agg(F.sum("value")).first()[0] - 337) < 1e-9
    assert got.filter("eventType = 1 and bucket = 2").first().value == pytest.approx(115)  # 10 of the 20 ticks from 8 to 27


def test_filter_events(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b")], "pid int, eventName string")
    assert logs.filter_events(log, {"~eventName": ["a"], "other": [1]}).count() == 1
    with pytest.raises(ValueError):
        logs.filter_events(log, {"eventName": ["a"], "~eventName": ["b"]})
