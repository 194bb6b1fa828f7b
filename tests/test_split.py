import math

import pytest
from pyspark.sql import functions as F

from beatwire.dims import TAX6
from beatwire.operators.evaluate import fit_svm, predict_svm
from beatwire.operators.split import split_approx, split_exact
from beatwire.sources.synthetic import synthetic_articles


@pytest.mark.parametrize("n,digits,frac", [(1000, 4, 0.8), (1000, 1, 0.8), (7, 2, 0.5),
                                           (3, 4, 1.0), (1, 4, 0.8)])
def test_exact(spark, n, digits, frac):
    df = split_exact(spark.range(n), "id", frac, digits=digits)
    parts = {r.id: r.part for r in df.collect()}
    assert len(parts) == n
    assert sum(p == "train" for p in parts.values()) == math.floor(frac * n)
    if digits == 4:  # the same rows whatever the bucket size
        coarse = {r.id: r.part for r in split_exact(spark.range(n), "id", frac, digits=1).collect()}
        assert coarse == parts


def test_approximate(spark):
    n = split_approx(spark.range(4000), "id").where("part = 'train'").count()
    assert 3000 < n < 3400


def test_svm_learns_the_vocabulary(spark):
    df = synthetic_articles(spark.range(200).withColumnRenamed("id", "k"), "k")
    model = fit_svm(df, TAX6[:2], features=512, max_iter=8)
    got = predict_svm(model, df, TAX6[:2])
    right = got.agg(F.avg((F.col("theft") == F.col("p_theft")).cast("int"))).first()[0]
    assert right > 0.9 and "_features" not in got.columns
