"""Boosted trees on binned rows: Spark's trees and scores, whatever the number of tasks, also when rows are lost."""

import random
import shutil

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskspark.operators import boosting, ml

INPUTS = ["a", "b", "c"]


def _rows(spark, n=3000):
    rng = random.Random(5)
    rows = []
    for _ in range(n):
        a, b, c = rng.randrange(40), rng.randrange(7), rng.randrange(50) / 8
        rows.append((float(a), float(b), c, float(rng.random() < (0.7 if (a > 20) == (c > 3) else 0.1))))
    return spark.createDataFrame(rows, "a double, b double, c double, label double").repartition(5).cache()


def _fit(d, tasks, depth=4, rounds=6, weight=2.5):
    gbt = GBTClassifier(maxDepth=depth, maxIter=rounds, stepSize=0.1, maxBins=64, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="features", handleInvalid="keep"),
                            boosting.BoostedTrees(gbt, INPUTS, "label", weight, tasks)]).fit(d)


def _text(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.stages[-1].trees]


def test_trees_and_losses_are_those_of_spark(spark):
    d = _rows(spark)
    weighted = d.withColumn("_w", F.when(F.col("label") == 1, 2.5).otherwise(1.0))
    features = VectorAssembler(inputCols=INPUTS, outputCol="features", handleInvalid="keep")
    want = Pipeline(stages=[features, GBTClassifier(weightCol="_w", maxDepth=4, maxIter=6, stepSize=0.1, maxBins=64, seed=1)]).fit(weighted)
    got = _fit(d, 1)
    assert got.stages[-1].getNumTrees == 6 and got.stages[-1].treeWeights == want.stages[-1].treeWeights
    # Spark may split a node of like gradients once more, for a gain that is rounding
    p = lambda m: [r[0] for r in m.transform(d).select(vector_to_array("probability")[1]).collect()]
    assert np.allclose(p(got), p(want), atol=1e-9)
    assert np.allclose(got.stages[-1].featureImportances.toArray(), want.stages[-1].featureImportances.toArray(), atol=1e-6)
    ours = [r[0] for r in d.select(boosting.probability(got.stages[-1])(*INPUTS)).collect()]
    assert np.allclose(ours, p(got), atol=1e-12)
    v = features.transform(d.withColumn("_w", F.lit(1.0)))
    assert np.allclose(boosting.losses(want.stages[-1], d.select(*INPUTS, "label")), want.stages[-1].evaluateEachIteration(v), atol=1e-9)


def test_trees_do_not_depend_on_the_tasks(spark):
    d = _rows(spark)
    assert _text(_fit(d, 1)) == _text(_fit(d, 7))


def test_lost_rows_are_laid_again(spark, monkeypatch):
    d = _rows(spark)
    want, count, job = _text(_fit(d, 2)), [0], boosting.Training.job

    def losing(self, level, step):
        count[0] += 1
        if count[0] in (1, 9, 14):  # before the first tree, at its later levels, between two trees
            fit = self.fit
            self.pins.foreach(lambda part: shutil.rmtree(boosting.folder_of(fit, part)))
        return job(self, level, step)

    monkeypatch.setattr(boosting.Training, "job", losing)
    assert _text(_fit(d, 2)) == want and count[0] == 24


def test_a_fit_leaves_nothing_behind(spark):
    d = _rows(spark, 500)
    d.count()
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    _fit(d, 2, depth=2, rounds=2)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == kept


def test_few_values_have_a_cut_between_each_and_many_have_equal_shares():
    assert boosting.cuts_of(np.array([1.0, 2.0, 4.0]), np.array([1, 1, 1]), 64).tolist() == [1.5, 3.0]
    v = np.arange(1000.0)
    cuts = boosting.cuts_of(v, np.ones(1000, int), 64)
    assert len(cuts) == 63 and np.diff(np.searchsorted(v, cuts, side="right")).max() <= 17
    assert boosting.cuts_of(np.array([5.0]), np.array([9]), 64).tolist() == [] == boosting.cuts_of(np.zeros(0), np.zeros(0, int), 64).tolist()
    w, c = boosting.thinned(v, np.ones(1000, int), 100)
    assert len(w) <= 101 and c.sum() == 1000 and w[-1] == 999


def test_odd_labels_and_no_rows_are_refused(spark):
    d = spark.createDataFrame([(1.0, 1.0, 1.0, None)], "a double, b double, c double, label double")
    with pytest.raises(Exception, match="neither 0 nor 1"):
        _fit(d, 1)
    with pytest.raises(Exception, match="not a finite number"):
        _fit(d.selectExpr("a", "b", "double('NaN') as c", "1.0D as label"), 1)
    with pytest.raises(ValueError, match="no rows"):
        _fit(d.limit(0), 1)


def test_nodes_without_gain_are_leaves(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0, float(i % 2)) for i in range(10)], "a double, b double, c double, label double")
    m = _fit(d, 1, rounds=3).stages[-1]
    assert m.getNumTrees == 3 and all(t.numNodes == 1 for t in m.trees)
    assert ml.best_round([1.0], 1) == 1
