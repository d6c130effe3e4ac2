"""What several operators share: batches, folds, seeded samples and the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import ship

#: Bytes of text that one vectorised step works on; a longer text makes a step of its own.
STEP_BYTES = 1_000_000
#: What open scopes will remove: folders and tables, innermost scope last.
_SCOPES: list[list[tuple[str, str]]] = []
_LETTERS: list[np.ndarray] = []


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` as string, and the named further columns; nothing else."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def fold(column: str, n: int) -> Column:
    """crc32 of the column's decimal text modulo ``n``; NULL counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def steps(ids: pa.Array, texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) of consecutive rows with about ``limit`` bytes of text each."""
    names, values = ids.to_pylist(), texts.to_pylist()
    first = size = 0
    for i, value in enumerate(values):
        size += len(value) if value else 0
        if size >= limit:
            yield names[first : i + 1], values[first : i + 1]
            first, size = i + 1, 0
    if first < len(values):
        yield names[first:], values[first:]


def letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point of Unicode: whether it is a letter, and its lower case as one code point."""
    if not _LETTERS:
        known, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x40000):  # planes beyond have none
            if (c := chr(i)).isalpha():
                known[i] = True
            if (low := c.lower()) != c:
                lower[i] = ord(low[0])
        _LETTERS.extend([known, lower])
    return _LETTERS[0], _LETTERS[1]


def release() -> None:
    """Give memory that is free in this worker back to the system; reused workers would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        return


def map_texts(df: DataFrame, work: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """``work()`` is called once a task and returns a function from (ids, texts) to columns."""
    fields = [part.strip().split(" ")[0] for part in schema.split(",")]
    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        f = work()
        for batch in batches:
            for ids, texts in steps(batch.column(0), batch.column(1)):
                out = f(ids, texts)
                yield pa.RecordBatch.from_arrays([pa.array(out[name], type=arrow.field(name).type) for name in fields], schema=arrow)
        f = None
        release()

    return documents(df).mapInArrow(run, schema)


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow whose function yields dicts of columns."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for out in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        release()

    return df.mapInArrow(run, schema)


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what tests set in its place."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            at = tempfile.mkdtemp(prefix="relift-")  # local mode: driver and executors are one machine
            spark.sparkContext.setCheckpointDir(at)
        else:
            at = found.get()
    return at.rstrip("/")


def stored(df: DataFrame, what: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    ``lasting`` results stay when the innermost scope ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/relift-{what}-{uuid.uuid4().hex}"
    remember("folder", path, lasting)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remember(kind: str, name: str, lasting: bool = False) -> None:
    """Have the innermost scope, or for ``lasting`` ones the next, remove a folder or a table."""
    if len(_SCOPES) > lasting:
        _SCOPES[-1 - lasting].append((kind, name))


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes, when it ends, what operators called inside have written to the shared folder.

    Their results are lazy: they have to be written or collected inside.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for kind, name in reversed(_SCOPES.pop()):
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, bound: int, seed: str) -> DataFrame:
    """About ``bound`` rows, the same ones each time: those whose hash lies under a threshold.

    With fewer rows than that, all of them.  The threshold follows the row count, so the sample's
    size does not grow with the input; all columns are hashed, so that no one id decides for many rows.
    """
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) by Newton steps on the labelled margins."""
    a, b = 1.0, 0.0
    n1, n0 = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = logistic(a * margin + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)
