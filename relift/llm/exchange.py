"""Blocks of documents and an exchange of their keys.

Finding strings that documents share means bringing equal keys together, and then telling each
document.  Rows of single keys are many and small, and a passage in a third of all documents makes one
key very frequent.  So documents are gathered into blocks; a block names each of its keys once, however
many of its documents have it, packed by key range into few binary rows; what comes back about a block's
keys meets the block's own row.  No group is larger than the number of blocks, whatever the skew.

Blocks are written to the shared folder: they are read more than once, and a lost executor costs a read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import folder, map_rows, release, remember, stored

#: Bytes of text that close a block.
BLOCK_BYTES = 4_000_000
#: Bytes of input for one bucket of dealt blocks; Spark's own bound on buckets.
BUCKET_BYTES, MAX_BUCKETS = 128_000_000, 100_000
#: What a NULL doc_id counts as where ids are compared: larger than all others.
LAST = (1 << 63) - 1


def pack(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def make_blocks(df: DataFrame, text: str = "text", limit: int = BLOCK_BYTES, dealt: bool = False) -> DataFrame:
    """(block, payload) rows in the shared folder; a payload is an Arrow stream of whole rows of ``df``.

    Long texts fill a block alone.  ``dealt`` deals them into buckets by block, which pays if replies
    meet the blocks more than once.
    """
    at = df.columns.index(text)

    def work(batches) -> Iterator[dict]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
            first = 0
            while first < batch.num_rows:
                before = int(ends[first - 1]) if first else 0
                stop = min(int(np.searchsorted(ends, before + limit - size)) + 1, batch.num_rows)
                held.append(batch.slice(first, stop - first))
                size += int(ends[stop - 1]) - before
                first = stop
                if size >= limit:
                    yield {"block": [number], "payload": [pack(held)]}
                    held, size, number = [], 0, number + 1
        if held:
            yield {"block": [number], "payload": [pack(held)]}

    made = map_rows(df, work, "block long, payload binary")
    return bucketed(made, "blocks", input_bytes(df)) if dealt else stored(made, "blocks")


def bucketed(df: DataFrame, what: str, size: int) -> DataFrame:
    """Write rows to the shared folder, dealt by block into buckets: one for ``BUCKET_BYTES`` of input, the session's partitions at least.

    Rows are shuffled by block first, so that a bucket is one file.  Meeting replies by block then
    shuffles the replies only.
    """
    spark = df.sparkSession
    name = f"relift_{what}_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{name}"
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    remember("folder", path)
    remember("table", name)
    df.repartition(buckets, "block").write.format("parquet").bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def input_bytes(df: DataFrame) -> int:
    """What Spark takes the input's size for; 0 if it does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def expand(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    wide = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(wide)
    out, at = [], 0
    for kind, w in zip(kinds, wide, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(kind).ravel())
        at += n * w
    return out


def ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each uint64 key: equal ranges of the key space."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(block: int, buckets: int, keys: np.ndarray, *columns: np.ndarray) -> dict[str, list]:
    """Rows (block, bucket, blob) of one block's distinct keys and their columns, by ascending key."""
    order = np.argsort(keys)
    keys, columns = keys[order], [c[order] for c in columns]
    at = ranges(keys, buckets)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]) if len(at) else np.zeros(1, int)
    parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return {"block": [block] * len(parts), "bucket": [int(at[a]) for a, _ in parts], "blob": [squeeze(keys[a:b], *(c[a:b] for c in columns)) for a, b in parts]}


def bucket_count(blocks: DataFrame) -> int:
    """Buckets for the keys of so many blocks: about four blocks' worth each, the session's partitions at least."""
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // 4))


def exchange(keys: DataFrame, kinds: tuple[str, ...], judge: Callable[..., tuple[np.ndarray, list[np.ndarray]]], buckets: int) -> DataFrame:
    """Bring the keys of each bucket together and send each block what ``judge`` says of its keys.

    ``keys`` has (block, bucket, blob); a blob holds uint64 keys and columns of ``kinds``.  ``judge``
    gets key, block number and columns sorted by key, and returns which rows to answer, and the
    answer's columns for those.  The result has (block, blob) rows: keys and answers.
    """

    def reduce(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        parts = [expand(blob.as_py(), "<u8", *kinds) for blob in table.column("blob")]
        sizes = [len(p[0]) for p in parts]
        owner = np.repeat(np.arange(len(parts)), sizes)
        key, *columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(key)
        rows, answers = judge(key[order], blocks[owner[order]], *(c[order] for c in columns))
        back = owner[order][rows]
        key = key[order][rows]
        out = {"block": [], "blob": []}
        by = np.argsort(back, kind="stable")
        edges = np.searchsorted(back[by], np.arange(len(parts) + 1))
        for i in range(len(parts)):
            some = by[edges[i] : edges[i + 1]]
            if len(some):
                out["block"].append(int(blocks[i]))
                out["blob"].append(squeeze(key[some], *(a[some] for a in answers)))
        release()
        return pa.table({"block": pa.array(out["block"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})

    return keys.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(reduce, "block long, blob binary")


def groups(key: np.ndarray) -> np.ndarray:
    """First places of runs of equal keys in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)


def pair_groups(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """First places of runs of equal pairs in arrays sorted by them."""
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])])) if len(key) else np.zeros(0, int)


def least_owner(key: np.ndarray, block: np.ndarray, more: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For 128-bit digests (``key`` and ``more``) of several blocks: the least owner of all, to those that have a larger one."""
    if not len(key):
        return np.zeros(0, np.int64), [more, owner]
    order = np.lexsort((more, key))
    first = pair_groups(key[order], more[order])
    least = np.empty(len(key), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owner[order], first), np.diff(np.append(first, len(key))))
    rows = np.flatnonzero(least < owner)
    return rows, [more[rows], least[rows]]


def meet(blocks: DataFrame, replies: DataFrame, work: Callable[[int, pa.Table, list[bytes], list[bytes]], dict | pa.Table], schema: str | StructType, state: DataFrame | None = None) -> DataFrame:
    """Each block's row with the replies for it; ``state`` adds the block's rows of an earlier step.

    ``work`` gets block, payload as a table, replies and state blobs, and returns columns.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    more = replies.select("block", "blob", F.lit(0).alias("kind"))
    if state is not None:
        more = more.unionByName(state.select("block", "blob", F.lit(1).alias("kind")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        kinds, blobs = right.column("kind").to_pylist(), right.column("blob").to_pylist()
        out = work(left.column("block")[0].as_py(), unpack(left.column("payload")[0].as_py()), [b for b, k in zip(blobs, kinds, strict=True) if k == 0], [b for b, k in zip(blobs, kinds, strict=True) if k == 1])
        release()
        if isinstance(out, pa.Table):
            return out.cast(arrow)
        return pa.table([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return blocks.groupBy("block").cogroup(more.groupBy("block")).applyInArrow(run, schema)
