"""One-shot tokens as a stream (an extension): each branch's armed token is state, which its next commit uses up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Tokens(StatefulProcessor):
    """``expires_after``: milliseconds of processing time after which an unused token is forgotten, None for never."""

    def __init__(self, expires_after: int | None = None):
        self.expires_after = expires_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.armed = handle.getValueState("armed", "at timestamp", self.expires_after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows), ignore_index=True)
        commit = whole["change_id"].notna()
        used = []
        armed = self.armed.exists()
        # Arming comes before a commit of the same moment.
        for n in whole.assign(c=commit).sort_values(["at", "c", "change_id"], kind="stable").index:
            if not commit[n]:
                armed, at = True, whole["at"][n]
                self.armed.update((at.to_pydatetime(),))
            elif armed:
                used.append(int(whole["change_id"][n]))
                armed = False
                self.armed.clear()
        if used:
            yield pd.DataFrame({"branch": key[0], "change_id": used})

    def close(self) -> None:
        pass


def bypassed(events: DataFrame, expires_after: int | None = None) -> DataFrame:
    """``branch, change_id`` of the commits whose gates a token skips, of a stream ``events(branch, at, change_id)``; a null ``change_id`` arms a token.

    A branch's events must come in order of time from one trigger to the next; within one they may be in any order. What comes out is what the batch
    form gives for the same events. Needs the RocksDB state store.
    """
    rows = events.where("branch is not null").select("branch", "at", "change_id")
    return rows.groupBy("branch").transformWithStateInPandas(Tokens(expires_after), "branch string, change_id long", "Append", "None" if expires_after is None else "ProcessingTime")
