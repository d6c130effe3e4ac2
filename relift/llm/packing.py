"""Best-fit packing of documents into sequences of bounded length.

Bounded-space online best-fit: a task keeps a fixed number of open bins.  A bitset has a bit for
each free space that some open bin has, so the tightest bin for a piece is the lowest set bit from
the piece's length on.  When a new bin is needed and all places are taken, the fullest bin closes.

Documents longer than a sequence are cut into full pieces and a shorter last one.  Each task packs
what it reads, without a shuffle: a bin never leaves its task, and a task that is run again after a
loss makes the same sequences.  A task leaves at most ``open_bins`` bins short of full.

Defined cases: NULL and empty texts are the end id alone; repeated rows are packed as often as they
occur; an empty table gives no rows; a NULL doc_id is carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_rows, steps
from .tokens import Encoder

CAPACITY = 2048
OPEN_BINS = 1024
END_ID = 0
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Places lengths of 1 to ``capacity`` into numbered bins; ``place`` returns (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count, self.opened = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space

    def _take(self, free: int) -> int:
        bins = self.at[free]
        taken = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.count -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count == self.open_bins:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.opened, self.capacity
            self.opened += 1
        left = free - length
        if left:
            if not self.at[left]:
                self.bits |= 1 << left
            self.at[left].append(bin_)
            self.count += 1
        return bin_, self.capacity - free


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: its document, place in it, length, checksum, sequence and place there.

    ``sequence_id`` is the task's number times 2**32 plus the bin's number in the task.
    ``with_ids`` adds the piece's ids as an array, for :func:`sequences`.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def work(batches) -> Iterator[dict]:
        from pyspark import TaskContext

        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        encoder, bins = Encoder.held(path), BestFit(capacity, open_bins)
        for batch in batches:
            for names, texts in steps(batch.column(0), batch.column(1)):
                out: dict[str, list] = {part.strip().split(" ")[0]: [] for part in schema.split(",")}
                for doc_id, ids in zip(names, encoder.encode(texts, end_id), strict=True):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        some = ids[start : start + capacity]
                        bin_, offset = bins.place(len(some))
                        row = (doc_id, k, start, len(some), zlib.crc32(some), base + bin_, offset)
                        for column, value in zip(out.values(), row, strict=False):
                            column.append(value)
                        if with_ids:
                            out["ids"].append(some.astype(np.int32))
                yield out

    return map_rows(documents(docs), work, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of ``pack(..., with_ids=True)``: one row with all ids a sequence."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(pieces.alias("pieces")).select("sequence_id", F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("ids"))
