"""Clustering, classification and selection against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import learning


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    return np.vstack([rng.normal(c, s, (60, 3)) for c, s in (((0, 0, 0), 1.0), ((9, 0, 3), 0.5), ((0, 9, -3), 1.5))])


@pytest.fixture(scope="module")
def table(spark, cloud):
    return spark.createDataFrame([(i, i // 60, list(map(float, r))) for i, r in enumerate(cloud)], "id long, label int, features array<double>")


def test_kmeans_finds_the_clouds(table):
    centers, given = learning.kmeans(table, learning.furthest_first(table, 3))
    rows = given.join(table.select("id", "label"), "id").groupBy("label").agg(F.countDistinct("center").alias("c")).collect()
    assert [r.c for r in rows] == [1, 1, 1] and len(centers) == 3


def test_an_empty_cluster_keeps_its_centre(table):
    centers, _ = learning.kmeans(table, [[0.0, 0.0, 0.0], [1e6, 0.0, 0.0]], rounds=5)
    assert centers[1] == [1e6, 0.0, 0.0]


def test_figures_and_discriminant(table, cloud):
    figures = learning.class_figures(table, "label")
    for c in range(3):
        assert figures[c][0] == 60 and np.allclose(figures[c][1], cloud[c * 60 : c * 60 + 60].mean(0)) and np.allclose(figures[c][2], np.cov(cloud[c * 60 : c * 60 + 60].T))
    assert learning.cross_validated(table, "label").filter("predicted = label").count() >= 176
    odd = table.limit(1).select(F.lit(-1).alias("id"), F.lit(None).cast("array<double>").alias("features"))
    assert learning.quadratic_discriminant(odd, figures).first().predicted is None
    middle = table.limit(1).select(F.array(F.lit(4.5), F.lit(1.0), F.lit(1.0)).alias("features"))
    assert learning.quadratic_discriminant(middle, figures, reject=1.1).first().predicted is None


def test_principal_components(table, cloud):
    rows, variances = learning.principal_components(table, 2)
    want = np.linalg.svd(cloud - cloud.mean(0))
    assert np.allclose(variances, want[1][:2] ** 2 / (len(cloud) - 1)) and np.allclose(np.abs(rows), np.abs(want[2][:2]))
    got = table.orderBy("id").select(learning.project(F.col("features"), cloud.mean(0).tolist(), rows).alias("p")).toPandas()
    assert np.allclose(np.vstack(got.p), (cloud - cloud.mean(0)) @ rows.T)


def test_selection():
    worth = {"a": 1, "b": 2, "c": 2, "d": 0}
    score = lambda s: sum(worth[x] for x in s) - 2 * (("b" in s) and ("c" in s) and "a" not in s)
    assert learning.select_forward(list(worth), score, 3) == [(["c"], 2), (["c", "a"], 3), (["c", "a", "b"], 5)]
    assert learning.select_forward(list(worth), score, 3, floating=True)[-1][1] == 5


def test_kmeans_keeps_the_feature_that_no_row_of_a_cluster_has(spark):
    rows = [(1, [0.0, 0.0]), (2, [2.0, 4.0]), (3, [10.0, 10.0]), (4, None), (5, [None, 10.0]), (6, [12.0, 10.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    centers, given = learning.kmeans(df, [[0.0, 1.0], [11.0, 10.0]])
    # rows without a distance go to centre 0; what they have counts
    assert centers == [[1.0, 14.0 / 3], [11.0, 10.0]]
    assert {r.id: r.center for r in given.collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1}
    assert {r.d is None for r in given.filter("id in (4, 5)").collect()} == {True}
    centers, _ = learning.kmeans(df.filter("id > 3"), [[0.0, 1.0], [11.0, 10.0]], rounds=1)
    assert centers == [[0.0, 10.0], [12.0, 10.0]]
