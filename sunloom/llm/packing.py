"""Packing documents into fixed windows by the sum-of-squares rule, each task over its own rows, no shuffle."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_arrow
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_id long"
#: Sequence and row ids are (task << this) + the sequence's or row's number in the task.
TASK_SHIFT = 40


class SumOfSquares:
    """Online packing of pieces shorter than ``size`` tokens.

    ``levels[f]`` counts open windows filled to ``f``. A piece of ``n`` tokens goes to the fill level (0: a new window)
    that leaves the sum of squared counts least: joining level ``f`` takes one window from ``levels[f]`` and adds one to
    ``levels[f + n]``, so with that sum's terms the change is ``2 * (levels[f + n] - levels[f]) + 2`` where both count.
    Ties go to the fullest level. Full windows are handed over at once.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def place(self, piece: tuple, n: int) -> list | None:
        """The window that became full with this piece, or None."""
        levels, size = self.levels, self.size
        change = 2 * (levels[n:size] - levels[: size - n]) + 2  # from f to f + n < size
        change[0] = 2 * levels[n] + 1  # a new window leaves no other level
        change[1:][levels[1 : size - n] == 0] = np.iinfo(np.int64).max
        if levels[size - n]:
            full = 1 - 2 * levels[size - n]  # a full window is counted no more
        else:
            full = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if full <= change[best]:
            best = size - n
        window = self.open[best].pop() if best else []
        if best:
            levels[best] -= 1
        window.append(piece)
        if best + n == size:
            return window
        levels[best + n] += 1
        self.open[best + n].append(window)
        return None

    def close(self) -> list[tuple[int, list]]:
        """The windows still open, fullest first."""
        return [(f, w) for f in range(self.size - 1, 0, -1) for w in self.open[f]]


def pack_rows(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int, task: int) -> Iterator[pa.RecordBatch]:
    """One task's documents to pieces: whole windows are cut off each document, its rest is packed; at the end, pieces
    of the emptiest windows are cut to fill the fullest, so one window at most stays partly filled."""
    encode, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
    packer, number, row = SumOfSquares(size), 0, task << TASK_SHIFT
    out: list[tuple] = []

    def emit(pieces: list[tuple]) -> None:
        nonlocal number
        at = 0
        for doc, start, ids, total, own in pieces:
            n = len(ids) // 4
            out.append((doc, start, n, zlib.crc32(ids), total, (task << TASK_SHIFT) + number, at, own))
            at += n
        number += 1

    def batch() -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id"]
        made = pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=names)
        out.clear()
        return made

    for rows in batches:
        docs = rows.column("doc_id").to_pylist()
        for doc, ids in zip(docs, encode(rows.column("text").to_pylist()), strict=True):
            ids += end
            total = len(ids) // 4
            whole = total - total % size
            for start in range(0, whole, size):
                emit([(doc, start, ids[4 * start : 4 * (start + size)], total, row)])
            if total > whole and (full := packer.place((doc, whole, ids[4 * whole :], total, row), total - whole)):
                emit(full)
            row += 1
        if out:
            yield batch()
    left = packer.close()
    while left:
        fill, window = left.pop(0)
        while fill < size and left:
            least, spare = left.pop()
            doc, start, ids, total, own = spare.pop()
            n, room = len(ids) // 4, size - fill
            take = min(n, room)
            window.append((doc, start + n - take, ids[4 * (n - take) :], total, own))
            fill += take
            if n > take:
                spare.append((doc, start, ids[: 4 * (n - take)], total, own))
            if spare:
                left.append((least - take, spare))
        emit(window)
        if len(out) > 10_000:
            yield batch()
    if out:
        yield batch()


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of whole documents in sequences of at most ``size`` tokens.

    A document's ids are its text's (null: empty) and ``end_id``. One row per piece; every id is in exactly one piece and
    a sequence's pieces follow each other from offset 0. ``docs`` needs ``doc_id`` and ``text``; other columns are not
    read. An empty table gives no rows; repeated rows are packed as often as they come, and ``row_id``, a number of the
    input row, tells their pieces apart; a null doc_id stays null.
    Sequence numbers hold the task's number, so a task that runs again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack_rows(batches, tokenizer_path, size, end_id, TaskContext.get().partitionId())

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
