"""Token ids as compressed binary files with short access to single documents.

A zstandard dictionary is trained on the serialized id arrays of a bounded sample; every document is
a zstandard frame of its own under that dictionary.  A file is

    magic "TKZ1" | id width, u32 | dictionary sha256, 32 bytes | documents, u64 | ids before it, u64
    | per document: doc_id i64, NULL flag u8 with 7 zero bytes, ids before it in this file u64, frame offset u64
    | one closing entry with the totals | frames

all little-endian.  The hash says which dictionary opens the file, the index gives one frame without
touching others.  Files hold documents in ascending doc_id order (NULL first), and so do the files
by (shard, number).  Files are rows (shard, number, bytes) of a Parquet table in the shared folder,
written by Spark's committer, so a lost task leaves nothing half written.

Defined cases: NULL and empty texts are the end id alone; repeated doc_ids keep one entry each,
ordered by their texts; texts of any length are one frame; other columns are not read; an empty table
has no files.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, documents, map_rows, steps, stored
from .tokens import Encoder

MAGIC = b"TKZ1"
END_ID = 2
#: Rows that the dictionary is trained on, at most about, and bytes of one's text; the dictionary's size in bytes.
SAMPLE_ROWS, SAMPLE_TEXT, DICTIONARY_BYTES = 1000, 65_536, 65_536
#: A file closes beyond so many bytes of frames.
FILE_BYTES = 8_000_000
#: Documents a shard, where there are more than the session's shuffle partitions can share.
SHARD_ROWS = 50_000
HEAD = struct.Struct("<4sI32sQQ")
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "<u8"), ("start", "<u8"), ("offset", "<u8")])


def _width(path: str | None) -> int:
    from tokenizers import Tokenizer

    from .tokens import default_path

    return 2 if Tokenizer.from_file(path or default_path()).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str | None = None, end_id: int = END_ID, sample_rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES, width: int = 2) -> bytes:
    """The dictionary's bytes; empty when the sample is too small to train one."""
    import zstandard

    def work(batches) -> Iterator[dict]:
        encoder = Encoder.held(path)
        for batch in batches:
            for _, texts in steps(batch.column(0), batch.column(1)):
                yield {"ids": [ids.astype(f"<u{width}").tobytes() for ids in encoder.encode(texts, end_id)]}

    sample = [row.ids for row in map_rows(bounded(documents(docs), sample_rows, "dictionary").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT).orderBy("doc_id"), work, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dict(data: bytes):
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def file_bytes(rows: list[tuple[int | None, int, bytes]], before: int, dictionary: bytes, width: int) -> bytes:
    """A whole file of (doc_id, number of ids, frame) rows."""
    index = np.zeros(len(rows) + 1, ENTRY)
    for i, (doc_id, n, frame) in enumerate(rows):
        index[i]["doc_id"], index[i]["null"] = doc_id or 0, doc_id is None
        index[i + 1]["start"], index[i + 1]["offset"] = index[i]["start"] + n, index[i]["offset"] + len(frame)
    head = HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest(), len(rows), before)
    return b"".join([head, index.tobytes(), *(frame for _, _, frame in rows)])


class TokenFile:
    """Reads one file's bytes; ``ids(i)`` decompresses only the i-th document's frame."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        magic, self.width, digest, self.n, self.before = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.index = np.frombuffer(data, ENTRY, self.n + 1, HEAD.size)
        self.body, self.data = HEAD.size + self.index.nbytes, data
        self.unzip = zstandard.ZstdDecompressor(**_dict(dictionary))

    def doc_id(self, i: int) -> int | None:
        return None if self.index[i]["null"] else int(self.index[i]["doc_id"])

    def ids(self, i: int) -> np.ndarray:
        a, b = (self.body + int(self.index[k]["offset"]) for k in (i, i + 1))
        return np.frombuffer(self.unzip.decompress(self.data[a:b]), f"<u{self.width}")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all entries with that doc_id, by binary search in the index."""
        nulls = int(self.index["null"][:-1].sum())
        keys = self.index["doc_id"][nulls:-1]
        return [self.ids(nulls + i) for i in range(*np.searchsorted(keys, [doc_id, doc_id + 1]))]


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, bytes]:
    """(files, dictionary): files has shard, number, docs, ids and bytes, and lies in the shared folder.

    Documents are dealt into ranges of doc_id, which Spark finds by its own sample; a range is a shard.
    """
    docs = documents(docs)
    spark = docs.sparkSession
    width = _width(path)
    dictionary = train_dictionary(docs, path, end_id, width=width)
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / SHARD_ROWS))

    def files(batches) -> Iterator[dict]:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId() if task else 0
        encoder, zip_ = Encoder.held(path), zstandard.ZstdCompressor(level=3, **_dict(dictionary))
        held, size, number, before = [], 0, 0, 0

        def close() -> dict:
            total = sum(n for _, n, _ in held)
            return {"shard": [shard], "number": [number], "docs": [len(held)], "ids": [total], "bytes": [file_bytes(held, before, dictionary, width)]}

        for batch in batches:
            for names, texts in steps(batch.column(0), batch.column(1)):
                for doc_id, ids in zip(names, encoder.encode(texts, end_id), strict=True):
                    if held and size >= FILE_BYTES:
                        yield close()
                        number, before = number + 1, before + sum(n for _, n, _ in held)
                        held, size = [], 0
                    frame = zip_.compress(ids.astype(f"<u{width}").tobytes())
                    held.append((doc_id, len(ids), frame))
                    size += len(frame)
        if held:
            yield close()

    ordered = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(map_rows(ordered, files, "shard int, number int, docs long, ids long, bytes binary"), "tokens"), dictionary


def read(files: DataFrame, dictionary: bytes) -> DataFrame:
    """One row a document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    The ids before a shard are the running sum of one total a shard; those before a file stand in its head.
    """
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # broadcast: 16 bytes a shard, which is SHARD_ROWS documents: 3 MB for 10**10 documents
    base = files.groupBy("shard").agg(F.sum("ids").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))

    def work(batches) -> Iterator[dict]:
        for batch in batches:
            for before, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(data.as_py(), dictionary)
                ids = [file.ids(i) for i in range(file.n)]
                starts = (before + file.before + file.index["start"][:-1].astype(np.int64)).tolist()
                yield {"doc_id": [file.doc_id(i) for i in range(file.n)], "start": starts, "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4")) for x in ids]}

    return map_rows(files.join(F.broadcast(base), "shard").select("base", "bytes"), work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def short_lookup(files: DataFrame, dictionary: bytes, doc_id: int) -> list[list[int]]:
    """The ids of one document, opening only files whose index holds it."""

    def work(batches) -> Iterator[dict]:
        for batch in batches:
            for data in batch.column(0):
                yield {"ids": pa.array([x.astype(np.int64).tolist() for x in TokenFile(data.as_py(), dictionary).find(doc_id)], pa.list_(pa.int64()))}

    return [row.ids for row in map_rows(files.select("bytes"), work, "ids array<long>").collect()]
