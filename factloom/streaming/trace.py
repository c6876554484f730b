"""Call traces as a stream: per-thread call stacks become caller-callee edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "thread string, parent string, child string"


def unwound(stack: list[str], name: str) -> list[str]:
    """The stack after a return: cut at the last frame of that name, so missed returns don't matter; unmatched ones are ignored."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i] == name:
            return stack[:i]
    return stack


def _edges(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stack = list(state.get[0]) if state.exists else []
    out = []
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    for event, name in zip(rows["event"].tolist(), rows["name"].tolist(), strict=True):
        if event == "call":
            if stack:
                out.append((key[0], stack[-1], name))
            stack.append(name)
        else:
            stack = unwound(stack, name)
    state.update((stack,))
    yield pd.DataFrame(out, columns=["thread", "parent", "child"])


def stack_edges(events: DataFrame) -> DataFrame:
    """(thread, parent, child) of a stream of (thread, seq, event, name) rows; a thread's open calls are its state.

    All rows of a thread in one trigger are ordered by seq together. A return cuts the stack at its last frame of that name.
    """
    return events.groupBy("thread").applyInPandasWithState(_edges, SCHEMA, "stack array<string>", "append", GroupStateTimeout.NoTimeout)
