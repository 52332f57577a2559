"""Best-fit packing of token pieces into fixed-length training sequences.

Bounded-space online best-fit: each partition keeps a fixed number of open
sequences in a bitset keyed by free space. A piece goes to the open sequence
with the least sufficient space; when none fits and all places are in use, the
fullest open sequence closes. No state leaves a task, so a lost task is simply
run again over the same rows.

Defined results: a null text counts as empty (its end token is still packed); a
row with a null id is packed like any other and carries the null along; repeated
rows are packed once each; an empty table gives no rows; further columns of the
input play no part.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import tokens

#: Sequence numbers of one partition lie below this bound.
_PER_PARTITION = 1 << 40

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenSequences:
    """At most ``places`` open sequences of ``size`` tokens, found by free space in a bitset."""

    def __init__(self, size: int, places: int):
        self.size, self.places = size, places
        self.bits = 0
        self.by_free: dict[int, deque[int]] = {}
        self.open = 0
        self.made = 0

    def _hold(self, free: int, number: int) -> None:
        if free:
            self.by_free.setdefault(free, deque()).append(number)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.popleft()
        if not held:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Sequence number and offset for a piece of 1 to ``size`` tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
            self._hold(free - length, number)
            return number, self.size - free
        if self.open >= self.places and length < self.size:
            self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        number = self.made
        self.made += 1
        self._hold(self.size - length, number)
        return number, 0


def cuts(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else a shorter first piece and full ones."""
    if total <= size:
        return [(0, total)] if total else []
    first = total % size
    return ([(0, first)] if first else []) + [(at, size) for at in range(first, total, size)]


def pack(
    docs: DataFrame,
    *,
    vocabulary: str | None = None,
    end_id: int = 2,
    size: int = 1024,
    places: int = 1024,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every text with their place in a sequence; ``with_ids`` adds the token ids.

    Each document's ids end with ``end_id``. One pass over the rows where they
    lie: no shuffle, memory bounded by ``places`` and one slice of a batch.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = tokens.encoder(vocabulary, end_id).encode_column
        bins = OpenSequences(size, places)
        base = TaskContext.get().partitionId() * _PER_PARTITION
        for batch in (x for b in batches for x in tokens.slices(b)):
            rows: list[tuple] = []
            held: list[bytes] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                for number, (start, length) in enumerate(cuts(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    sequence, offset = bins.place(length)
                    rows.append((doc, number, start, length, zlib.crc32(part), base + sequence, offset))
                    if with_ids:
                        held.append(part)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                names.append("ids")
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in held], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
