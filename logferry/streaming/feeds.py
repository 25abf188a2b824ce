"""Continuous variants: redaction of a growing feed, findings per time window, call in progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.secrets import redacted
from ..plans.corpus import _rule_counts, redact_corpus


def redact_feed(feed: DataFrame, text: str) -> DataFrame:
    """The same expressions as for a stored table; stateless, so any feed rate scales with its partitions."""
    return redact_corpus(feed, text)


def findings_per_window(feed: DataFrame, text: str, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Findings per rule and time window, with late rows accepted up to ``late``."""
    rows = feed.withWatermark(time, late).select(time, redacted(text)["found"].alias("found"))
    counts = _rule_counts(rows)
    return (
        counts.groupBy(F.window(time, width), "rule")
        .agg(F.sum("n").cast("bigint").alias("n"), F.count("*").cast("bigint").alias("n_docs"))
        .select(F.col("window.start").alias("start"), "rule", "n", "n_docs")
    )


OWNED = "session string, line_no bigint, kind string, id string, owner string"


class CallInProgress(StatefulProcessor):
    """Keeps each session's running call across micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("line_no")
        current = self.running.get()[0] if self.running.exists() else None
        calls, outputs = frame["kind"] == "call", frame["kind"] == "output"
        # The id in force before each line: the last call's, unless an output closed it.
        moves = pd.Series(pd.NA, index=frame.index, dtype="object")
        moves[calls] = frame["id"][calls].fillna("")
        moves[outputs] = ""
        after = moves.ffill().fillna(current or "")
        before = after.shift(1).fillna(current or "")
        owner = frame["id"].where(calls | outputs, before.where(frame["kind"] == "item"))
        frame["owner"] = owner.replace("", None)
        last = after.iloc[-1]
        if last:
            self.running.update((last,))
        else:
            self.running.clear()
        frame["session"] = key[0]
        yield frame[["session", "line_no", "kind", "id", "owner"]]

    def close(self) -> None:
        pass


def owners_feed(feed: DataFrame) -> DataFrame:
    """``session, line_no, kind, id, owner`` for a feed of ``session, line_no, kind, id``."""
    return feed.groupBy("session").transformWithStateInPandas(
        statefulProcessor=CallInProgress(), outputStructType=OWNED, outputMode="Append", timeMode="None"
    )
