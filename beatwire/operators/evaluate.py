"""Multi-label quality figures and the linear baseline."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from beatwire.functions.text import WS, words
from beatwire.session import written

BROADCAST_WEIGHTS = 200_000  # words with a weight that are broadcast; beyond, the join shuffles


def multilabel_metrics(df: DataFrame, categories: Sequence[str], truth: str = "",
                       pred: str = "p_") -> DataFrame:
    """Accuracy (same label set), macro F1 and Hamming loss, in one pass.

    A row carries the true flags under prefix ``truth`` and the predicted ones
    under prefix ``pred``. F1 of a label without a true positive is 0.
    """
    t = {c: F.col(truth + c) for c in categories}
    p = {c: F.col(pred + c) for c in categories}
    wrong = F.lit(0)
    for c in categories:
        wrong = wrong + F.when(t[c] != p[c], 1).otherwise(0)
    sums = [F.count(F.lit(1)).alias("n_rows"),
            F.count_if(wrong == 0).alias("exact"), F.sum(wrong).alias("wrong")]
    for c in categories:
        sums += [F.count_if((t[c] == 1) & (p[c] == 1)).alias(f"tp_{c}"),
                 F.count_if((t[c] == 1) | (p[c] == 1)).alias(f"any_{c}")]
    f1 = F.lit(0.0)
    for c in categories:
        # 2tp / (2tp + fp + fn), where tp + fp + fn counts rows flagged on a side
        tp = F.col(f"tp_{c}")
        f1 = f1 + F.coalesce(F.try_divide(2.0 * tp, tp + F.col(f"any_{c}")), F.lit(0.0))
    return df.agg(*sums).select(
        "n_rows", F.try_divide("exact", "n_rows").alias("accuracy"),
        (f1 / len(categories)).alias("macro_f1"),
        F.try_divide("wrong", F.col("n_rows") * len(categories)).alias("hamming_loss"))


def confusion(df: DataFrame, categories: Sequence[str], truth: str = "",
              pred: str = "p_") -> DataFrame:
    """(label, tp, fp, fn, tn): exact counts of one pass, a row per label."""
    counts = [F.struct(F.lit(c).alias("label"), *[
        F.count_if((F.col(truth + c) == t) & (F.col(pred + c) == p)).alias(name)
        for name, t, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
        for c in categories]
    return df.agg(F.array(*counts).alias("a")).select(F.inline("a"))


def fit_word_weights(rows: DataFrame, category: str, text_col: str = "clean_text") -> DataFrame:
    """(word, weight): how much oftener texts with the flag hold a word, as a log ratio.

    The word null carries the log ratio of the texts themselves. A linear model
    with a closed form: every number follows from counts, whatever the order of
    the rows, so any engine can recompute it.
    """
    flagged = F.count_if(F.col(category) == 1)
    sizes = rows.agg(flagged.alias("ones"), F.count_if(F.col(category) == 0).alias("zeros"))
    held = rows.select(category, F.explode(distinct_words(F.col(text_col))).alias("word"))
    counts = held.groupBy("word").agg(flagged.alias("n1"), F.count_if(F.col(category) == 0).alias("n0"))
    ratio = (F.log((F.col("n1") + 1.0) / (F.col("ones") + 2.0))
             - F.log((F.col("n0") + 1.0) / (F.col("zeros") + 2.0)))
    per_word = counts.join(F.broadcast(sizes)).select("word", ratio.alias("weight"))  # one row of sizes
    prior = F.log(F.col("ones") + 1.0) - F.log(F.col("zeros") + 1.0)
    return written(per_word.unionByName(
        sizes.select(F.lit(None).cast("string").alias("word"), prior.alias("weight"))), "word-weights")


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: w != ""))


def score_words(rows: DataFrame, weights: DataFrame, key: str, text_col: str = "clean_text") -> DataFrame:
    """(key, score): the prior and the weights of a text's distinct words; over 0 is a yes."""
    prior = weights.where("word IS NULL").select(F.col("weight").alias("prior"))
    known = weights.where("word IS NOT NULL")
    known = F.broadcast(known) if known.count() <= BROADCAST_WEIGHTS else known
    # a text without words keeps its row
    held = rows.select(F.col(key), F.explode_outer(distinct_words(F.col(text_col))).alias("word"))
    sums = held.join(known, "word", "left").groupBy(key).agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("sum"))
    return sums.join(F.broadcast(prior)).select(key, (F.col("sum") + F.col("prior")).alias("score"))


def fit_svm(df: DataFrame, categories: Sequence[str], text_col: str = "clean_text",
            features: int = 1 << 16, max_iter: int = 20) -> PipelineModel:
    """TF-IDF features and one linear SVM per category.

    The rows are written once to the shared folder, so that no pass repeats
    the work behind them, and their features are kept in memory or on disk. The
    SVMs are fitted side by side: a pass is short and would leave most of a
    cluster idle. Each pass sends one number per feature from every partition
    up a tree, so ``features`` should fit the vocabulary.
    """
    spark = df.sparkSession
    prepare = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=f"[{WS}]+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
    ])
    rows = written(df.select(text_col, *categories), "svm-texts")
    prepared = prepare.fit(rows)
    ready = prepared.transform(rows).select("_features", *categories).persist(
        StorageLevel.MEMORY_AND_DISK)

    def fit(category: str):
        return LinearSVC(
            featuresCol="_features", labelCol=category, predictionCol=f"p_{category}",
            rawPredictionCol=f"_raw_{category}", maxIter=max_iter, regParam=0.01).fit(ready)

    try:
        with ThreadPool(len(categories)) as pool:
            svms = pool.map(inheritable_thread_target(spark)(fit), categories)
    finally:
        ready.unpersist()
    return PipelineModel(stages=[*prepared.stages, *svms])


def predict_svm(model: PipelineModel, df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Flags under the prefix ``p_``; helper columns are dropped."""
    helpers = ["_tokens", "_counts", "_features", *[f"_raw_{c}" for c in categories]]
    return model.transform(df).drop(*helpers).withColumns(
        {f"p_{c}": F.col(f"p_{c}").cast("int") for c in categories})


def save_svm(model: PipelineModel, path: str) -> None:
    """Write the baseline where every executor can read it, replacing an older one."""
    model.write().overwrite().save(path)


def load_svm(path: str) -> PipelineModel:
    return PipelineModel.load(path)
