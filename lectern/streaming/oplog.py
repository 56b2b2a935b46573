"""Operation logs and call failures as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Items that a document's state holds at most, the newest ones.
MOST_ITEMS = 2000
OUT = "doc_id bigint, id bigint, item string, created double, applied double"
STATE = "applied double, ids array<bigint>, items array<string>, created array<double>"


def fold_stream(ops: DataFrame) -> DataFrame:
    """Fold put and del operations of each document as they arrive: its live items after every batch.

    ops: doc_id, ts (seconds), op, id, item.  State holds a document's live
    items, the MOST_ITEMS newest, and its high-water mark, which is each
    document's own watermark: an operation not newer than it is late and
    dropped, as in a batch fold from that mark.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        applied, ids, items, created = state.get if state.exists else (float("-inf"), [], [], [])
        live = {i: (x, c) for i, x, c in zip(ids, items, created, strict=True)}
        new = pd.concat(list(frames))
        new = new[(new["ts"] > applied) & new["op"].isin(["put", "del"])].sort_values("ts", kind="stable")
        for ts, op, i, item in new[["ts", "op", "id", "item"]].itertuples(index=False):
            if op == "del":
                live.pop(i, None)
            else:
                live[i] = (item, live[i][1] if i in live else ts)
            applied = max(applied, ts)
        live = dict(sorted(live.items(), key=lambda x: x[1][1])[-MOST_ITEMS:])
        state.update((applied, list(live), [x for x, _ in live.values()], [c for _, c in live.values()]))
        yield pd.DataFrame([(key[0], i, x, c, applied) for i, (x, c) in live.items()], columns=["doc_id", "id", "item", "created", "applied"])

    return ops.groupBy("doc_id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def breaker_stream(calls: DataFrame, trips: int = 3, pause: float = 20.0) -> DataFrame:
    """Circuit breaker a source: rows where it opens, with the time until which it stays open.

    calls: source, ts (seconds), failed.  `trips` failures in a row open it.
    The state is two numbers a source.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, until = state.get if state.exists else (0, float("-inf"))
        out = []
        for ts, failed in pd.concat(list(frames)).sort_values("ts", kind="stable")[["ts", "failed"]].itertuples(index=False):
            if ts < until:
                continue
            streak = streak + 1 if failed else 0
            if streak >= trips:
                streak, until = 0, ts + pause
                out.append((key[0], ts, until))
        state.update((streak, until))
        yield pd.DataFrame(out, columns=["source", "ts", "until"])

    return calls.groupBy("source").applyInPandasWithState(
        run, "source string, ts double, until double", "streak int, until double", "append", GroupStateTimeout.NoTimeout
    )
