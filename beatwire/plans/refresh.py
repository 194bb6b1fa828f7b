"""Articles as they land: clean, label, place, merge; alerts beside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from beatwire.dims import CRITICAL
from beatwire.operators.classify import Scorer
from beatwire.plans.batch import clean_articles, label_articles
from beatwire.streaming.streams import start_append, start_merge, stream_alerts, stream_dedupe


def start_refresh(sdf: DataFrame, table: str, checkpoint: str, categories: Sequence[str],
                  scorer: Scorer | None, order: Sequence[str] = ("ord",),
                  cap: int | None = 500, once: bool = False) -> StreamingQuery:
    """Keep the labelled table up to date with what lands."""
    def prepare(batch: DataFrame) -> DataFrame:
        return label_articles(clean_articles(batch), categories, scorer)

    return start_merge(sdf, table, checkpoint, order=order, cap=cap, prepare=prepare, once=once)


def start_alerts(sdf: DataFrame, path: str, checkpoint: str, categories: Sequence[str],
                 scorer: Scorer, event_time: str = "ts", delay: str = "1 day",
                 keys: Sequence[str] = CRITICAL, once: bool = False) -> StreamingQuery:
    """Append an alert for every critical article, once per address."""
    labelled = label_articles(clean_articles(sdf), categories, scorer)
    fresh = stream_dedupe(stream_alerts(labelled, keys), event_time=event_time, delay=delay)
    return start_append(fresh, path, checkpoint, once)
