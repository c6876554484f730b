"""A collector of call traces: keyed state with timers, sampling flags and budgets, and a sink that takes each batch once.

Events (run, thread, seq, event, symbol_id, file, line) become observed nodes and edges of a run. The state of a (run, thread) is
its stack of open calls, each with the flag whether it was sampled, and a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run string, kind string, caller string, callee string, n long"
STACK = "symbols array<string>, files array<string>, flags array<boolean>"
DEPTH = 10_000  # open calls of a thread; deeper ones are counted as dropped
IDLE_MS = 600_000  # a thread without events for so long is forgotten


def sampled(rate: float) -> Column:
    """Whether an event is in the sample: a digest of its place, so the same events are at every attempt and on every executor."""
    return (F.xxhash64("run", "thread", "seq").bitwiseAND((1 << 53) - 1) / float(1 << 53)) < rate


def _walk(depth: int, idle_ms: int):
    """The step of one (run, thread): its new events, or its timer."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack = list(zip(*state.get, strict=True)) if state.exists else []
        run, out = key[0], []
        if state.hasTimedOut:
            state.remove()
            out = [(run, "abandoned", None, None, len(stack))] if stack else []
            yield pd.DataFrame(out, columns=["run", "kind", "caller", "callee", "n"])
            return
        events = pd.concat(list(batches)).sort_values("seq", kind="stable")
        nodes: dict[str, int] = {}
        edges: dict[tuple[str, str], int] = {}
        dropped = 0
        for event, symbol, file, taken in zip(events["event"].tolist(), events["symbol_id"].tolist(), events["file"].tolist(), events["sampled"].tolist(), strict=True):
            if event == "return":
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][:2] == (symbol, file)), None)
                stack = stack if at is None else stack[:at]
                continue
            if len(stack) >= depth:
                dropped += 1
                continue
            if taken:
                nodes[symbol] = nodes.get(symbol, 0) + 1
                if stack and stack[-1][2]:
                    edge = (stack[-1][0], symbol)
                    edges[edge] = edges.get(edge, 0) + 1
            stack.append((symbol, file, bool(taken)))
        if stack:
            state.update(tuple(list(x) for x in zip(*stack, strict=True)))
            state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        out = [(run, "node", None, s, n) for s, n in nodes.items()] + [(run, "edge", a, b, n) for (a, b), n in edges.items()] + ([(run, "dropped", None, None, dropped)] if dropped else [])
        yield pd.DataFrame(out, columns=["run", "kind", "caller", "callee", "n"])

    return step


def observations(events: DataFrame, rate: float = 1.0, depth: int = DEPTH, idle_ms: int = IDLE_MS, root: str | None = None) -> DataFrame:
    """(run, kind, caller, callee, n) of a stream of events: nodes and edges seen, calls dropped by the budget, calls abandoned.

    All events of a thread in one trigger are ordered by seq together. A return cuts the stack at its last frame of that symbol and
    file; unmatched ones are ignored. An edge counts if both ends are in the sample. Files outside of ``root`` are left out,
    events without a symbol or file too. Timers keep a stream going: with a trigger that is meant to end, set
    ``spark.sql.streaming.noDataMicroBatches.enabled`` to false.
    """
    kept = events.filter("symbol_id is not null and file is not null")
    kept = kept if root is None else kept.filter(F.col("file").startswith(root.rstrip("/") + "/"))
    rows = kept.withColumn("sampled", sampled(rate)).select("run", "thread", "seq", "event", "symbol_id", "file", "sampled")
    return rows.groupBy("run", "thread").applyInPandasWithState(_walk(depth, idle_ms), OUT, STACK, "append", GroupStateTimeout.ProcessingTimeTimeout)


def take_batch(path: str):
    """A sink for foreachBatch: a batch is one partition by its id, so one that is written again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("run", "kind", "caller", "callee").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def collected(spark: SparkSession, path: str) -> DataFrame:
    """(run, kind, caller, callee, n) over all batches."""
    return spark.read.parquet(path).groupBy("run", "kind", "caller", "callee").agg(F.sum("n").alias("n"))
