"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids and an end id are cut into full windows, which stand alone,
and a remainder.  Remainders are cut into pieces of ``piece`` ids at most and
packed in groups: multiway differencing keeps a heap of partial partitions and
always merges the two of largest spread, the heaviest slots of one onto the
lightest of the other, until one partition with near-equal windows is left.  A
group starts with the fewest windows that could hold it; whenever the heaviest
window exceeds the capacity the number rises by one and the group is
partitioned again.

Groups are formed within a task from the rows it streams, so packing needs no
shuffle, holds the ids of one group at a time, and loses nothing when an
executor goes: a task that runs again packs the same rows alike.

Defined results: a null or empty text is the end id alone; repeated rows and
ids are packed as rows of their own; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.tokens import encoder

WINDOW, PIECE, GROUP, END_ID = 2048, 512, 1024, 1

SCHEMA = "row_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("row_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, int]:
    """The window of each item and the heaviest window's load, by multiway differencing."""
    owner = np.arange(len(sizes))
    heap = []
    for i, size in enumerate(sizes):
        loads, firsts = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        loads[0], firsts[0] = size, i
        heap.append((-size if windows > 1 else 0, i, loads, firsts))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, loads, firsts = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        others = others[::-1]
        loads = loads + more[::-1]
        both = (firsts >= 0) & (others >= 0)
        owner[others[both]] = firsts[both]
        firsts = np.where(firsts >= 0, firsts, others)
        order = np.argsort(-loads, kind="stable")
        loads, firsts = loads[order], firsts[order]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), turn, loads, firsts))
        turn += 1
    _, _, loads, firsts = heap[0]
    while (up := owner[owner] != owner).any():
        owner[up] = owner[owner[up]]
    slot = np.full(len(sizes), -1, np.int64)
    slot[firsts[firsts >= 0]] = np.flatnonzero(firsts >= 0)
    return slot[owner], int(loads[0])


def balanced(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each item, none above ``capacity``: the number of windows rises until that holds."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        placed, heaviest = differencing(sizes, windows)
        if heaviest <= capacity:
            return placed
        windows += 1


def pack(
    df: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    piece: int = PIECE,
    group: int = GROUP,
    end_id: int = END_ID,
) -> DataFrame:
    """One row for each piece: its ids (little-endian, 32 bits each) and its place in a sequence.

    ``sequence_id`` is unique over the whole result; ``offset`` runs gapless
    from 0 in each sequence.
    """

    def emit(pieces, sequences, offsets):
        columns = list(zip(*pieces, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip([*columns, sequences, offsets], _ARROW, strict=True)], schema=_ARROW)

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        following = TaskContext.get().partitionId() << 40
        full, rest = [], []

        def flush():
            nonlocal following
            lengths = [p[2] for p in rest]
            placed = balanced(lengths, window)
            order = np.argsort(placed, kind="stable")
            sequences, offsets, at, last = [], [], 0, None
            for i in order:
                if placed[i] != last:
                    at, last, following = 0, placed[i], following + 1
                sequences.append(following)
                offsets.append(at)
                at += lengths[i]
            batch = emit([rest[i] for i in order], sequences, offsets)
            rest.clear()
            return batch

        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                n, start = len(ids), 0
                while start < n:
                    length = window if n - start >= window else min(piece, n - start)
                    item = (row_id, start, length, ids[start : start + length].tobytes(), n)
                    (full if length == window else rest).append(item)
                    start += length
                if len(full) >= group:
                    yield emit(full, range(following + 1, following + 1 + len(full)), [0] * len(full))
                    following += len(full)
                    full.clear()
                if len(rest) >= group:
                    yield flush()
        if full:
            yield emit(full, range(following + 1, following + 1 + len(full)), [0] * len(full))
            following += len(full)
        if rest:
            yield flush()

    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
