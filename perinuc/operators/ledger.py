"""Status of each nucleus from its events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perinuc.scale import positions

NUCLEUS = ["channel", "fov_id", "ne_label"]
# State of a nucleus before any event says otherwise.
DEFAULTS = {"registration": "pending", "paired": "unknown", "refined_fit": "pending", "detection": None}


def ledger_state(events: DataFrame, order: Sequence[str] = ("ts", "event_id"), by: Sequence[str] = NUCLEUS) -> DataFrame:
    """Latest value of every attribute, with defaults for what was never set.

    Latest means largest ``order``; it is an aggregate, so it merges partial results and needs no sort.
    """
    when = F.struct(*order)
    return events.groupBy(*by).agg(
        *[
            F.coalesce(
                F.max_by(F.when(F.col("attribute") == a, F.col("value")), F.when(F.col("attribute") == a, when)), F.lit(d)
            ).alias(a)
            for a, d in DEFAULTS.items()
        ]
    )


def ledger_history(
    events: DataFrame, key: dict[str, str] | None = None, order: Sequence[str] = ("ts", "event_id"), by: Sequence[str] = NUCLEUS
) -> DataFrame:
    """Events numbered in order per nucleus, or of the one nucleus that ``key`` names."""
    for c, value in (key or {}).items():
        events = events.filter(F.col(c) == value)
    return positions(events, by, order, "seq")


def pruned_report(events: DataFrame, order: Sequence[str] = ("ts", "event_id"), by: Sequence[str] = NUCLEUS) -> DataFrame:
    """Nuclei whose registration failed in the end, with their last event."""
    state = ledger_state(events, order, by).filter(F.col("registration").startswith("failed"))
    last = events.groupBy(*by).agg(F.max_by(F.struct("event", "metric"), F.struct(*order)).alias("_last"))
    return state.join(last, list(by)).select(
        *by, "registration", F.col("_last.event").alias("last_event"), F.col("_last.metric").alias("last_metric")
    )


def pruned_totals(report: DataFrame, channels: DataFrame) -> DataFrame:
    """Pruned nuclei per channel, also channels with none, and the grand total as the row of NULL channel."""
    counts = report.groupBy("channel").agg(F.count("*").alias("pruned"))
    every = channels.select("channel").distinct().join(counts, "channel", "left").fillna(0, ["pruned"])
    return every.rollup("channel").agg(F.sum("pruned").alias("pruned"))
