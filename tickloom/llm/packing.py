"""Sum-of-squares packing of documents into windows of tokens."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_paths, encoder
from .common import prepare

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


@dataclass
class Window:
    number: int
    fill: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece.ids)


class Packer:
    """Online: each piece goes where it leaves the least sum of squared counts of windows by fill level."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.level = np.zeros(capacity + 1, np.int64)  # open windows by fill; 0 and the capacity stay 0
        self.open: dict[int, list[Window]] = defaultdict(list)

    def _new(self) -> Window:
        self.opened += 1
        return Window(self.opened - 1)

    def choose(self, size: int) -> int:
        """The fill level to place a piece of this size on; 0 is a new window. Ties go to the fullest."""
        fills = np.flatnonzero(self.level[: self.capacity - size + 1])
        if not len(fills):
            return 0
        after = fills + size
        change = np.where(after < self.capacity, 2 * self.level[after] + 1, 0) - (2 * self.level[fills] - 1)
        best = len(fills) - 1 - int(change[::-1].argmin())
        return int(fills[best]) if change[best] <= 2 * self.level[size] + 1 else 0

    def place(self, piece: Piece) -> Window | None:
        """The window that this piece has filled, if it did."""
        size = len(piece.ids)
        if size == self.capacity:
            window = self._new()
            window.add(piece)
            return window
        fill = self.choose(size)
        if fill:
            window = self.open[fill].pop()
            self.level[fill] -= 1
        else:
            window = self._new()
        window.add(piece)
        if window.fill == self.capacity:
            return window
        self.open[window.fill].append(window)
        self.level[window.fill] += 1
        return None

    def drain(self) -> Iterator[Window]:
        """What is still open: the emptiest windows' pieces are cut into the gaps of the fullest; one window stays part-filled at most."""
        rest = [w for fill in sorted(self.open, reverse=True) for w in self.open[fill]]
        i, j = 0, len(rest) - 1
        while i < j:
            piece = rest[j].pieces.pop()
            rest[j].fill -= len(piece.ids)
            gap = self.capacity - rest[i].fill
            if len(piece.ids) > gap:
                piece, left = piece.cut(gap)
                rest[j].add(left)
            rest[i].add(piece)
            if rest[i].fill == self.capacity:
                yield rest[i]
                i += 1
            if not rest[j].pieces:
                j -= 1
        if i == j and rest[i].pieces:
            yield rest[i]


def _rows(window: Window, base: int) -> Iterator[tuple]:
    at = 0
    for p in window.pieces:
        yield p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, base + window.number, at
        at += len(p.ids)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, end_id: int, paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    encode, packer, base = encoder(*paths).ids, Packer(capacity), TaskContext.get().partitionId() << 32
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, names=names)
        rows.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.append(encode(text or ""), np.uint16(end_id))
            for lo in range(0, len(ids), capacity):
                done = packer.place(Piece(doc_id, lo, ids[lo : lo + capacity], len(ids)))
                if done:
                    rows.extend(_rows(done, base))
        yield flush()
    for done in packer.drain():
        rows.extend(_rows(done, base))
    yield flush()


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 0, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document in a window: SCHEMA.

    A document is its ids and end_id; null and empty texts are end_id alone. Documents longer than a window are cut
    into full windows and a rest; rests are placed online by the sum of squares, apart in each input partition, so
    nothing is shuffled and a task holds its open windows only. When a partition ends, open windows are merged by
    cutting, which leaves one padded window for each partition at most. Equal rows are packed once each; extra columns
    are not read; an empty table gives no rows. sequence_id is the partition's number times 2**32 plus the window's.
    """
    prepare(docs.sparkSession)
    paths = paths or default_paths()
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(lambda batches: _pack(batches, capacity, end_id, paths), SCHEMA)
