"""Expressions over category flags and category names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SIREN = "\U0001F6A8"


def display_name(key: Column) -> Column:
    """``crime_against_children`` becomes ``Crime Against Children``."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def label_key(display: Column) -> Column:
    """The inverse of :func:`display_name`."""
    return F.replace(F.lower(display), F.lit(" "), F.lit("_"))


def key_of(display: str) -> str:
    """The same for a name known when the plan is written."""
    return display.lower().replace(" ", "_")


def flagged(keys: Sequence[str]) -> Column:
    """The keys whose flag is 1, in the given order; null flags count as 0."""
    return F.array_compact(F.array(*[F.when(F.col(k) == 1, F.lit(k)) for k in keys]))


def active_labels(categories: Sequence[str]) -> Column:
    """Labels set on a row; ``unclassified`` stands alone when there are none."""
    labels = flagged(categories)
    return F.when(F.size(labels) == 0, F.array(F.lit("unclassified"))).otherwise(labels)


def label_groups(labels: Column, groups: Mapping[str, str]) -> Column:
    """Display group of each label; empty for a label without a group."""
    pairs = F.create_map(*[F.lit(v) for kv in groups.items() for v in kv])
    return F.transform(labels, lambda k: F.coalesce(F.try_element_at(pairs, k), F.lit("")))


def alert_message(title: Column, matched: Column) -> Column:
    """``title (Murder, Rape)`` behind a siren."""
    return F.concat(F.lit(SIREN + " "), F.coalesce(title, F.lit("")), F.lit(" ("),
                    F.initcap(F.array_join(matched, ", ")), F.lit(")"))
