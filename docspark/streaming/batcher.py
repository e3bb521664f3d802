"""Batches that close at a count or after a wait, one result row per request."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def batched(requests: DataFrame, process: Callable[[list[str]], list[str]], size: int = 64, wait_ms: int = 15, key: str = "model") -> DataFrame:
    """``requests`` (key, request_id, payload) to (request_id, result, error) in batches of ``size``.

    What a trigger leaves over waits in state for the next rows or for ``wait_ms``. A batch whose results don't
    match its requests in number fails as a whole.
    """

    def close(rows: list[tuple[str, str]]) -> pd.DataFrame:
        try:
            results = process([p for _, p in rows])
            error = None if len(results) == len(rows) else "BATCH_SIZE_MISMATCH"
        except Exception as e:  # the requests must be answered
            results, error = [], str(e)[:300] or type(e).__name__
        return pd.DataFrame({"request_id": [r for r, _ in rows], "result": [None] * len(rows) if error else results, "error": [error] * len(rows)}, dtype=object)

    def work(name, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            if held:
                yield close(held)
            return
        for piece in pieces:
            held += list(zip(piece["request_id"].astype(str), piece["payload"].astype(str)))
        while len(held) >= size:
            yield close(held[:size])
            held = held[size:]
        if held:
            state.update(tuple(map(list, zip(*held))))
            state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()

    grouped = requests.groupBy(key)
    return grouped.applyInPandasWithState(work, "request_id string, result string, error string", "ids array<string>, payloads array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
