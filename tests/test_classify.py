import numpy as np
from pyspark.sql import functions as F

from beatwire.dims import GROUPS, TAX6, TAX11, VOCAB6, phrase_vocab
from beatwire.functions.labels import (
    active_labels, display_name, key_of, label_groups, label_key,
)
from beatwire.operators.classify import (
    classify, lexicon_scorer, model_scorer, predict_labels, scores_long, threshold_labels,
)
from beatwire.operators.evaluate import multilabel_metrics
from beatwire.operators.select import critical_alerts, filter_category, label_lite, with_alert
from beatwire.sources.synthetic import synthetic_articles

CATS = ["theft", "accident", "non_crime"]


def test_threshold(spark):
    df = spark.createDataFrame(
        [(1, "long enough text", [0.4, 0.41, 0.0]), (2, "long enough text", [0.1, 0.2, 0.3]),
         (3, "   short  9", [0.9, 0.9, 0.9]), (4, "long enough text", [0.9, 0.0, 0.9]),
         (5, "long enough text", None), (6, None, [0.9, 0.9, 0.9]), (7, "0123456789", [1.0, 0., 0.])],
        "id int, t string, scores array<double>")
    got = {r.id: (r.theft, r.accident, r.non_crime)
           for r in threshold_labels(df, CATS, "t").collect()}
    assert got == {1: (0, 1, 0), 2: (0, 0, 1), 3: (0, 0, 0), 4: (1, 0, 1), 5: (0, 0, 0),
                   6: (0, 0, 0), 7: (1, 0, 0)}


def test_lexicon(spark):
    df = spark.createDataFrame([(1, "Police BEAT the thief, stolen money MONEY"), (2, None)],
                               "id int, t string")
    rows = scores_long(lexicon_scorer(VOCAB6)(df, "t"), "id", TAX6).collect()
    got = {(r.id, r.label): r.score for r in rows}
    assert got[1, "assault"] == 2 / 3 and got[1, "theft"] == 2 / 3   # "thief," is another word
    assert got[1, "accident"] == 0 and got[2, "theft"] == 0
    assert "non_crime" in phrase_vocab() and phrase_vocab()["non_crime"] == []


def test_model_scorer(spark):
    """Phrases are passed, and a text on which the model fails is the only one without scores."""
    def load():
        def model(texts, phrases):
            if any(t.startswith("bad") for t in texts):
                raise ValueError("cannot read this")
            return np.array([[len(t) / 100, len(phrases) / 6, 0.0] for t in texts])
        return model

    df = spark.createDataFrame([(1, "x" * 80), (2, "y" * 20), (3, "bad " * 10), (4, None)],
                               "id int, t string").coalesce(1)
    scorer = model_scorer("length", load, CATS)
    got = {r.id: r.labels for r in predict_labels(df, scorer, CATS, "t").collect()}
    assert got == {1: ["theft", "accident"], 2: ["accident"], 3: ["unclassified"],
                   4: ["unclassified"]}


def test_synthetic_articles_are_recovered(spark):
    true = synthetic_articles(spark.range(400).withColumnRenamed("id", "k"), "k", seed=7)
    rows = true.collect()
    for r in rows:
        flags = [c for c in TAX6 if r[c]]
        words = r.clean_text.split(" ")
        assert 1 <= len(flags) <= 2 and (flags == ["non_crime"] or "non_crime" not in flags)
        assert 15 + 3 * len(flags) <= len(words) <= 15 + 6 * len(flags)
        assert r.title.lower() == " ".join(words[:3]).lower()
        assert "2023-01-01" <= r.date <= "2023-12-28"
    guess = classify(true.select("k", "clean_text", *[F.col(c).alias("t_" + c) for c in TAX6]),
                     lexicon_scorer(VOCAB6), TAX6)
    m = multilabel_metrics(guess, TAX6, truth="t_", pred="").first()
    assert (m.n_rows, m.accuracy, m.hamming_loss) == (400, 1.0, 0.0)
    again = synthetic_articles(spark.range(400).withColumnRenamed("id", "k"), "k", seed=7)
    assert sorted(again.collect()) == sorted(rows)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0, 1, 0), (1, 0, 0, 0), (0, 0, 1, 0), (1, 0, 1, 1)],
                               "a int, b int, p_a int, p_b int")
    m = multilabel_metrics(df, ["a", "b"]).first()
    assert (m.n_rows, m.accuracy, m.hamming_loss) == (4, 0.25, 3 / 8)
    assert abs(m.macro_f1 - (2 * 2 / (2 * 2 + 1 + 1)) / 2) < 1e-12


def test_labels_and_alerts(spark):
    rows = [(1, "A", {"murder": 1, "rape": 1}), (2, "B", {"theft": 1}), (3, None, {"kidnapping": 1}),
            (4, "D", {})]
    df = spark.createDataFrame([(i, t, *[f.get(c, 0) for c in TAX11]) for i, t, f in rows],
                               "id int, title string, " + ", ".join(f"{c} int" for c in TAX11))
    labels = {r.id: r.l for r in df.select("id", active_labels(TAX11).alias("l")).collect()}
    assert labels == {1: ["murder", "rape"], 2: ["theft"], 3: ["kidnapping"], 4: ["unclassified"]}
    groups = df.select(label_groups(active_labels(TAX11), GROUPS)).collect()
    assert [r[0] for r in groups] == [["crime", "crime"], ["crime"], ["crime"], [""]]
    alerts = critical_alerts(df, "id").collect()
    assert [(a.id, a.message) for a in alerts] == [
        (1, "🚨 A (Murder, Rape)"), (3, "🚨  (Kidnapping)")]
    assert with_alert(df, ["theft"]).count() == 1
    assert [r.id for r in filter_category(df, "Theft").collect()] == [2]
    assert filter_category(df, "No Such Thing").count() == 4
    assert filter_category(df, "All Categories").count() == 4
    lite = label_lite(df.select("id"), TAX11).first()
    assert lite.non_crime == 1 and lite.murder == 0


def test_names(value):
    assert value(display_name, "crime_against_children") == ["Crime Against Children"]
    assert value(label_key, "Fraud Cheating") == ["fraud_cheating"]
    assert key_of("Fraud Cheating") == "fraud_cheating"


def test_the_baseline_is_applied_to_every_labelled_text(spark, tmp_path):
    from beatwire.catalog import QUERIES
    rows = [(i, ("storm flood " if i % 3 else "match goal ") + f"number{i % 7}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(30)],
                           "doc_id long, quality int, toxic int")
     .write.parquet(f"{tmp_path}/labels.parquet"))
    got = {r.label: r for r in QUERIES["svm_baseline"](spark, str(tmp_path)).collect()}
    for label, positives in (("quality", 20), ("toxic", 10)):
        r = got[label]
        assert (r.n_rows, r.n_train, r.n_test, r.positives) == (30, 24, 6, positives)
        assert r.fits_better_than_majority and r.same_after_reload == 30
