"""Dear expressions appear once in a plan, whatever is filtered on them."""

from pathlib import Path

import pytest

from beatwire.catalog import QUERIES
from beatwire.catalog.views import PHRASES
from beatwire.dims import CRITICAL, TAX11
from beatwire.operators.classify import lexicon_scorer
from beatwire.operators.select import with_alert
from beatwire.plans.batch import clean_articles, label_articles

DATA = Path("/root/testdata/sf0.001")
CLEANING = "(http|www)"  # of the first step of cleaning


def times(df, text):
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["critical_alerts", "filter_category", "clean_nonempty", "active_labels"])
def test_queries_clean_and_score_once(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert times(df, CLEANING) == 1
    if name != "clean_nonempty":
        assert times(df, "array_intersect(split(") == 1


def test_plans_clean_and_score_once(spark):
    raw = spark.createDataFrame([("Two killed in attack at Delhi", "x", "2024-01-01", "u", "s")],
                                "text string, title string, date string, url string, source string")
    scorer = lexicon_scorer(PHRASES, hits_for_one=2)
    alerts = with_alert(label_articles(clean_articles(raw), TAX11, scorer), CRITICAL)
    assert times(alerts, CLEANING) == 1
    assert times(alerts, "array_intersect(split(") == 1
