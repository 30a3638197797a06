"""Dependencies of an access log that arrives as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDGES = "handle long, pred long, succ long, kind string"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, reads = state.get if state.exists else (None, [])
    reads = list(reads)
    out: list[tuple] = []
    rows = pd.concat(list(frames)).sort_values("seq")
    for seq, mode in zip(rows["seq"].tolist(), rows["mode"].tolist(), strict=True):
        if mode & 2:
            out += [(key[0], r, seq, "WAR") for r in reads]
            if not reads and last is not None:
                out.append((key[0], last, seq, "WAW"))
            last, reads = seq, []
        else:
            if last is not None:
                out.append((key[0], last, seq, "RAW"))
            reads.append(seq)
    state.update((last, reads))
    yield pd.DataFrame(out, columns=["handle", "pred", "succ", "kind"])


def handle_edges(log: DataFrame) -> DataFrame:
    """Edges (handle, pred, succ, kind) of a stream of (handle, seq, mode), as the batch operator gives them.

    The state of a handle is its last write and the reads since. Accesses of a handle must arrive in program order
    from batch to batch; within a batch they are sorted.
    """
    grouped = log.select("handle", "seq", "mode").groupBy("handle")
    return grouped.applyInPandasWithState(_step, EDGES, "last long, reads array<long>", "append", GroupStateTimeout.NoTimeout)
