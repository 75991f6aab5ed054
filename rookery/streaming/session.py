"""Session state: the review trail and the settled hover, as batches and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def note(steps: list[str], at: int, step: str) -> tuple[list[str], int]:
    """The trail after a step: going back or forth moves, anything else cuts what lies ahead and is added."""
    if not steps:
        return [step], 0
    if steps[at] == step:
        return steps, at
    if at > 0 and steps[at - 1] == step:
        return steps, at - 1
    if at + 1 < len(steps) and steps[at + 1] == step:
        return steps, at + 1
    return [*steps[: at + 1], step], at + 1


def walked(steps: list[str], at: int, overview: str) -> list[str]:
    """Distinct steps since the overview was last passed, in order."""
    upto = steps[: at + 1]
    start = max((k + 1 for k, s in enumerate(upto) if s == overview), default=0)
    return list(dict.fromkeys(upto[start:]))


def trails(events: DataFrame, *, session: str, step: str, order: list[str], overview: str) -> DataFrame:
    """(session, at, n_steps, walked): each session's trail after all its events.

    Rows come to a task sorted by session and order and are folded as they pass;
    of a session only its trail is held.
    """
    rows = events.select(F.col(session).cast("string").alias("session"), F.col(step).alias("step"), *order)
    rows = rows.repartition("session").sortWithinPartitions("session", *order).select("session", "step")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, steps, at = None, [], 0

        def row() -> tuple:
            return now, at, len(steps), walked(steps, at, overview)

        for pdf in batches:
            out = []
            for who, what in zip(pdf["session"], pdf["step"], strict=True):
                if who != now:
                    if steps:
                        out.append(row())
                    now, steps, at = who, [], 0
                steps, at = note(steps, at, what)
            yield pd.DataFrame(out, columns=["session", "at", "n_steps", "walked"])
        if steps:
            yield pd.DataFrame([row()], columns=["session", "at", "n_steps", "walked"])

    return rows.mapInPandas(run, "session string, at int, n_steps int, walked array<string>")


def stream_trails(events: DataFrame, *, session: str, step: str, order: list[str]) -> DataFrame:
    """The same trails as a stream: after each batch a row (session, at, n_steps) for every session it touched."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, at = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        pdf = pd.concat(list(batches)).sort_values(order)
        for what in pdf[step]:
            steps, at = note(steps, at, what)
        state.update((json.dumps(steps), at))
        yield pd.DataFrame([(str(key[0]), at, len(steps))], columns=["session", "at", "n_steps"])

    return events.groupBy(session).applyInPandasWithState(update, "session string, at int, n_steps int", "steps string, at int", "update", GroupStateTimeout.NoTimeout)


def settled(events: DataFrame, *, session: str, at: str, order: list[str], wait: str) -> DataFrame:
    """Events after which nothing newer came within their own wait; the last always commits.

    ``at`` is seconds, ``wait`` the column of each event's wait in seconds.
    """
    following = F.lead(at).over(Window.partitionBy(session).orderBy(at, *order))
    return events.withColumn("next_at", following).where(F.col("next_at").isNull() | (F.col("next_at") - F.col(at) >= F.col(wait))).drop("next_at")


def stream_settled(events: DataFrame, *, session: str, at: str, order: list[str], wait: str, late: str = "1 minute") -> DataFrame:
    """The same as a stream: (session, at, order...) of each event once its wait is over; events come in any order.

    ``at`` is a timestamp, ``wait`` in seconds, ``order`` longs that tell equal times
    apart.  Events more than ``late`` behind the newest time seen are dropped.  What is
    newer than the watermark waits in a session's state.  An event is withdrawn as
    soon as a newer one lies within its wait, and commits when the watermark has
    passed its wait: one timer a session, for the first wait that ends.  So the last
    event commits when time has moved on, not when the input ends.
    """
    cols = ["session", "at", *order]
    rows = events.select(F.col(session).cast("string").alias("session"), F.col(at).alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), (F.col(wait) * 1e6).cast("long").alias("wait"), *order)
    rows = rows.where("session is not null").withWatermark("at", late)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        passed = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for pdf in batches:
                new = zip(pdf["us"], *(pdf[c] for c in order), pdf["wait"], strict=True)
                held += [tuple(map(int, x)) for x in new if x[0] >= passed]
        held.sort()
        done, left = [], []
        for k, (us, *rest) in enumerate(held):
            if k + 1 < len(held) and held[k + 1][0] - us < rest[-1]:
                continue
            (done if us + rest[-1] <= passed else left).append((us, *rest))
        if left:
            state.update((json.dumps(left),))
            state.setTimeoutTimestamp(max(min(us + rest[-1] for us, *rest in left) // 1000, passed // 1000) + 1)
        elif state.exists:
            state.remove()
        if done:
            out = pd.DataFrame([(key[0], *x[:-1]) for x in done], columns=cols)
            yield out.assign(at=pd.to_datetime(out["at"], unit="us"))

    kinds = ", ".join(f"{c} long" for c in order)
    return rows.groupBy("session").applyInPandasWithState(update, f"session string, at timestamp, {kinds}" if order else "session string, at timestamp", "held string", "append", GroupStateTimeout.EventTimeTimeout)
