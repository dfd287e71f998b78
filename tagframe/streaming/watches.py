"""Watches as keyed state: what each poll of a watch has to tell, as the change feed and the polls come in.

The state of a watch is its ids with the version of their last change, and the version of its last poll; both are bounded by
the ids that a watch may have. A poll tells the ids that changed since the last one and moves the watch to the
poll's version; after a gap in the log it tells all ids. Which of them still exist, and how they look, the
caller joins from the entities (``told``).

Rows are ``watch_id, kind, id, version, floor``: ``watch`` and ``unwatch`` an id, ``close`` the watch, ``change`` of an id, ``poll`` at a version of
the graph with the log's floor then. Rows of a micro-batch are taken by version, polls after changes of their version.
Defined cases: a poll of a watch that isn't there, or at the version of the last one, tells nothing; changes of ids that a watch doesn't have are none; an id
watched again keeps its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "watch_id string, kind string, id string, version long, floor long"
TOLD = "watch_id string, version long, id string"
_ORDER = {"watch": 0, "unwatch": 1, "change": 2, "poll": 3, "close": 4}


class Watch(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "id string", "version long")
        self.last = handle.getValueState("last", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True)
        events = events.assign(o=events["kind"].map(_ORDER)).sort_values(["version", "o"], kind="stable")
        told = []
        for kind, ident, version, floor in zip(events["kind"], events["id"], events["version"], events["floor"], strict=True):
            there = self.last.exists()
            if kind == "watch":
                if not there:
                    self.last.update((int(version),))
                if not self.ids.containsKey((ident,)):
                    self.ids.updateValue((ident,), (0,))
            elif kind == "unwatch" and there:
                if self.ids.containsKey((ident,)):
                    self.ids.removeKey((ident,))
            elif kind == "change" and there:
                if self.ids.containsKey((ident,)):
                    self.ids.updateValue((ident,), (int(version),))
            elif kind == "poll" and there:
                last = self.last.get()[0]
                if version > last:
                    gap = pd.notna(floor) and 0 < floor and last < floor
                    told += [(key[0], int(version), k[0]) for k, v in self.ids.iterator() if gap or v[0] > last]
                    self.last.update((int(version),))
            elif kind == "close":
                self.ids.clear()
                self.last.clear()
        yield pd.DataFrame(told, columns=["watch_id", "version", "id"])

    def close(self) -> None:
        pass


def change_events(changes: DataFrame, watches: DataFrame) -> DataFrame:
    """Changes (a stream or a table) as events of the watches that have their ids: ``watches`` is ``watch_id, id``."""
    hits = changes.select(F.col("ref").alias("id"), "version").join(watches.select("watch_id", "id"), "id")
    return hits.select("watch_id", F.lit("change").alias("kind"), "id", F.col("version").cast("long").alias("version"), F.lit(0).cast("long").alias("floor"))


def polls(events: DataFrame) -> DataFrame:
    """``watch_id, version, id`` that polls tell, from a stream of events (``EVENT``). The session needs the RocksDB state store."""
    return events.groupBy("watch_id").transformWithStateInPandas(Watch(), TOLD, "Append", "None")


def told(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Current rows of the ids that polls told; removed ones don't come."""
    return rows.join(entities, "id").select("watch_id", "version", "id", "tags")
