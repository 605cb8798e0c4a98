"""Reward functions of one's own over a document's scored rows, by name; and metrics of a running job for a callback."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..constants import FIELDS

Reward = Callable[[pd.DataFrame], float]
REWARDS: dict[str, Reward] = {}


def reward(name: str) -> Callable[[Reward], Reward]:
    """Register a function of a document's rows, one per field in order, that gives its reward."""

    def add(f: Reward) -> Reward:
        if name in REWARDS:
            raise ValueError(f"there is a reward {name} already")
        REWARDS[name] = f
        return f

    return add


def rewarded(rows: DataFrame, f: str | Reward, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(keys, doc_id, reward): the function, or the registered one of that name, for each document's scored rows.

    It is called with the columns of ``rows`` in order of field_pos. A document must have each field once, and the
    function must give one finite number: anything else is an error that names the document. Seven rows are a group, so
    groups are small whatever the table.
    """
    own = REWARDS[f] if isinstance(f, str) else f
    by = [*(k for k in keys if k in rows.columns), "doc_id"]
    expected = list(FIELDS)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        doc = frame["doc_id"].iloc[0]
        frame = frame.sort_values("field_pos", kind="stable").reset_index(drop=True)
        if frame["field"].tolist() != expected:
            raise ValueError(f"document {doc} has the fields {frame['field'].tolist()}")
        made = own(frame)
        if isinstance(made, bool) or not isinstance(made, (int, float)) and not hasattr(made, "__float__") or not math.isfinite(float(made)):
            raise ValueError(f"the reward of document {doc} is {made!r}, not a finite number")
        return pd.DataFrame([[*(frame[k].iloc[0] for k in by), float(made)]], columns=[*by, "reward"])

    kinds = {x.name: x.dataType.simpleString() for x in rows.schema}
    return rows.groupBy(*by).applyInPandas(one, ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", reward double")


def rewarded_at_once(rows: DataFrame, f: Callable[[pd.DataFrame], Sequence[float]], keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """As :func:`rewarded`, by a function of the rows of many whole documents, seven each: it gives their rewards in order.

    A call for each document costs milliseconds before the function begins; here a call takes a batch of documents.
    """
    by = [*(k for k in keys if k in rows.columns), "doc_id"]
    width = len(FIELDS)

    def rewards_of(frame: pd.DataFrame) -> pd.DataFrame:
        fields, marks = frame["field"].to_numpy(), frame["_document"].to_numpy()
        # a document's rows follow each other, so whole ones are blocks of as many rows as there are fields
        starts = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(frame))):
            if b - a != width or fields[a:b].tolist() != list(FIELDS):
                raise ValueError(f"document {frame['doc_id'].iloc[a]} has the fields {fields[a:b].tolist()}")
        made = np.asarray(f(frame.drop(columns="_document")), dtype="float64")
        if made.shape != (len(starts),):
            raise ValueError(f"{len(starts)} documents have rewards of shape {made.shape}")
        for i in np.flatnonzero(~np.isfinite(made))[:1]:
            raise ValueError(f"the reward of document {frame['doc_id'].iloc[starts[i]]} is {made[i]!r}, not a finite number")
        return pd.DataFrame({"_document": marks[starts], "reward": made})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            open_ = frame["_document"] == frame["_document"].iloc[-1] if len(frame) else None
            if open_ is None:
                continue
            # the last document of a batch may go on in the next
            rest, done = frame[open_].reset_index(drop=True), frame[~open_].reset_index(drop=True)
            if len(done):
                yield rewards_of(done)
        if rest is not None and len(rest):
            yield rewards_of(rest)

    made = rows.withColumn("_document", F.to_json(F.struct(*by))).repartition("_document").sortWithinPartitions("_document", "field_pos").mapInPandas(batches, "_document string, reward double")
    kinds = {x.name: x.dataType.simpleString() for x in rows.schema}
    return made.select(F.from_json("_document", ", ".join(f"`{k}` {kinds[k]}" for k in by)).alias("d"), "reward").select("d.*", "reward")


def observed(rows: DataFrame, on_log: Callable[[dict], None] | None, name: str = "scored", **metrics: Column) -> tuple[DataFrame, Callable[[], None]]:
    """rows, and what to call after the action on them: it hands the metrics of that very scan to the callback.

    Without ``metrics``: rows, documents (about), right values and unreadable ones. Without a callback nothing is observed.
    """
    if on_log is None:
        return rows, lambda: None
    made = metrics or {"rows": F.count(F.lit(1)), "documents": F.approx_count_distinct("doc_id"), "correct": F.count_if("correct"), "unparseable": F.count_if(F.col("error_type") == "unparseable")}
    watch = Observation(name)
    return rows.observe(watch, *[c.alias(k) for k, c in made.items()]), lambda: on_log({"name": name} | watch.get)


class BatchLog(StreamingQueryListener):
    """Hands each micro-batch of named queries (all, without names) to a callback: its id, rows, and observed metrics."""

    def __init__(self, on_log: Callable[[dict], None], *names: str) -> None:
        self.on_log, self.names = on_log, names

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not self.names or p.name in self.names:
            self.on_log({"name": p.name, "batch_id": p.batchId, "rows": p.numInputRows} | {f"{k}.{c}": v for k, row in p.observedMetrics.items() for c, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
