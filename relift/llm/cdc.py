"""Substring de-duplication by content-defined chunking.

A gear hash rolls over the text's bytes; a chunk ends at a blank where the hash's high bits are zero,
and where the last ``SIGHT`` bytes have no blank, after any character where more of them are.  So boundaries
depend on the bytes just before and find themselves again after an insertion, in unspaced text too.  Chunks are
compared by digest over all documents.  A chunk goes from a document if a document with a smaller doc_id
has it, and if it lies in a run of such chunks of at least ``MIN_RUN`` bytes or ``MIN_WORDS`` words: a short
chunk alone may be chance.  A run is of whole chunks, so the parts of a passage before its first and after its
last common boundary stay, and a passage whose run is shorter than both bounds stays whole.  A text that equals
the whole text of a smaller doc_id goes whatever its length.

Defined cases: NULL texts stay NULL and empty ones empty; chunks that repeat only within a document
stay; rows with the same doc_id do not remove each other; a NULL doc_id counts as larger than all
others, and such rows do not remove each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import documents, map_rows
from .exchange import LAST, bucket_count, by_bucket, exchange, expand, least_owner, make_blocks, meet, pair_groups, unpack

#: Bytes of a chunk, least and most; one blank in ``ONE_IN`` ends a chunk; bytes of a removed run at least.
MIN_CHUNK, MAX_CHUNK, ONE_IN, MIN_RUN = 16, 192, 4, 100
#: Words that make a run, however few bytes they have.
MIN_WORDS = 16
#: Bytes that the gear hash sees; where they have no blank, one character in ``ONE_CHARACTER_IN`` ends a chunk.
SIGHT, ONE_CHARACTER_IN = 32, 8
#: Bytes that one vectorised step works on.
STEP = 1_000_000


def _gear() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] modulo 2**32, by doubling: 32 bytes back reach every bit."""
    h = GEAR[data].astype(np.uint32)
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def _places(raw: bytes, one_in: int) -> list[int]:
    """Where chunks may end: after chosen blanks, and after chosen characters with no blank in sight."""
    data, places = np.frombuffer(raw, np.uint8), []
    for a in range(0, len(raw), STEP):
        lead = min(a, SIGHT - 1)
        part = data[a - lead : a + STEP]
        h = gear_hash(part)
        blank = (part == 32) | (part - np.uint8(9) < 5)
        found = np.flatnonzero(blank & (h < (1 << 32) // one_in))
        edges = np.concatenate([[-1], np.flatnonzero(blank), [len(part)]])
        if (np.diff(edges) > SIGHT).any():
            after = np.append(part[1:], data[a + STEP] if a + STEP < len(raw) else np.uint8(0))
            more = np.flatnonzero(~blank & (h < (1 << 32) // ONE_CHARACTER_IN) & (after & 0xC0 != 0x80))
            far = more - edges[np.searchsorted(edges, more) - 1] >= SIGHT
            found = np.sort(np.concatenate([found, more[far]]))
        places.append(found[found >= lead] + (a - lead + 1))
    return np.concatenate(places).tolist() if places else []


def _forced(raw: bytes, last: int, least: int, most: int) -> int:
    """The end of a chunk without a boundary: the whole character of the least hash, the last such.

    It depends on the bytes, not on where the chunk began, so that these ends find themselves again too.
    """
    lead = min(last, SIGHT - 1)
    part = np.frombuffer(raw, np.uint8, most + lead + 1, last - lead)
    h = gear_hash(part[:-1])[lead:].astype(np.int64)
    h[(part[lead + 1 :] & 0xC0) == 0x80] = 1 << 32
    h[: least - 1] += 1 << 33
    return last + most - int(np.argmin(h[::-1]))


def cut(raw: bytes, least: int = MIN_CHUNK, most: int = MAX_CHUNK, one_in: int = ONE_IN) -> list[int]:
    """Ends of the chunks of a text's UTF-8 bytes.

    Only a stretch of ``most`` bytes without a boundary is cut elsewhere, where its hash is least.
    """
    ends, last = [], 0
    for end in [*_places(raw, one_in), len(raw)]:
        while end - last > most:
            last = _forced(raw, last, least, most)
            ends.append(last)
        if end - last >= least or end == len(raw):
            if end > last:
                ends.append(end)
            last = end
    return ends


def digests(raw: bytes, ends: list[int]) -> np.ndarray:
    """The chunks' 128-bit digests, as rows of two words, and, of a text too short to make a run, the whole text's in the end."""
    import xxhash

    h, a, out = xxhash.xxh3_128_digest, 0, []
    for b in ends:
        out.append(h(raw[a:b]))
        a = b
    if 0 < len(raw) < MIN_RUN:
        out.append(h(raw, 1))  # its own seed: it meets whole texts only
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


def _owners(table: pa.Table) -> list[int]:
    return [LAST if x is None else x for x in table.column("doc_id").cast(pa.int64()).to_pylist()]


def _chunks(table: pa.Table) -> Iterator[tuple[int, bytes, list[int], np.ndarray]]:
    for text in table.column("text").to_pylist():
        raw = (text or "").encode("utf-8", "surrogatepass")
        ends = cut(raw)
        yield raw, ends, digests(raw, ends)


def _keys(blocks: DataFrame, buckets: int) -> DataFrame:
    def work(batches) -> Iterator[dict]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = unpack(payload.as_py())
                found = [(np.full(len(d), owner), d) for owner, (_, _, d) in zip(_owners(table), _chunks(table), strict=True)]
                owner, (key, more) = np.concatenate([o for o, _ in found]), np.concatenate([d for _, d in found]).T
                order = np.lexsort((owner, more, key))
                first = order[pair_groups(key[order], more[order])]
                yield by_bucket(block, buckets, key[first], more[first], owner[first].astype(np.int64))

    return map_rows(blocks, work, "block long, bucket int, blob binary")


def removed_runs(owner: int, raw: bytes, ends: list[int], least: np.ndarray, shortest: int = MIN_RUN, words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, least doc_id there) of what goes; ``least`` has the least doc_id of each of :func:`digests`."""
    if len(least) > len(ends) and least[-1] < owner:
        return [(0, len(raw), int(least[-1]))]
    out, a, run, who = [], 0, None, LAST
    for end, first in zip([*ends, 0], [*least[: len(ends)].tolist(), LAST], strict=True):
        if first < owner:
            run, who = (a if run is None else run), min(who, first)
        elif run is not None:
            if a - run >= shortest or len(raw[run:a].split()) >= words:
                out.append((run, a, who))
            run, who = None, LAST
        a = end
    return out


def _apply(table: pa.Table, replies: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """For each row of a block its bytes and removed runs."""
    owners, rows = _owners(table), list(_chunks(table))
    told = [np.concatenate(c) for c in zip(*(expand(b, "<u8", "<u8", "<i8") for b in replies), strict=True)] if replies else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]
    # the block's own chunks, then what others say of them: the least owner of each digest counts
    key, more = (np.concatenate([*(d[:, k] for *_, d in rows), told[k]]) for k in (0, 1))
    who = np.concatenate([np.repeat(np.array(owners, np.int64), [len(d) for *_, d in rows]), told[2]])
    order = np.lexsort((more, key))
    first, least = pair_groups(key[order], more[order]), np.full(len(key), LAST)
    if len(key):
        least[order] = np.repeat(np.minimum.reduceat(who[order], first), np.diff(np.append(first, len(key))))
    a = 0
    for who, (raw, ends, d) in zip(owners, rows, strict=True):
        yield raw, removed_runs(who, raw, ends, least[a : a + len(d)])
        a += len(d)


def _met(blocks: DataFrame, work, schema: str) -> DataFrame:
    buckets = bucket_count(blocks)
    return meet(blocks, exchange(_keys(blocks, buckets), ("<u8", "<i8"), least_owner, buckets), work, schema)


def removed(docs: DataFrame) -> DataFrame:
    """One row a removed run: doc_id, start and end in UTF-8 bytes, the least doc_id that has a part of it, its text."""

    def work(block: int, table: pa.Table, replies: list[bytes], _) -> dict:
        out = {k: [] for k in ("doc_id", "start", "end", "first_doc_id", "text")}
        for doc_id, (raw, runs) in zip(table.column("doc_id").to_pylist(), _apply(table, replies), strict=True):
            for a, b, who in runs:
                for column, value in zip(out.values(), (doc_id, a, b, who, raw[a:b].decode("utf-8", "replace")), strict=True):
                    column.append(value)
        return out

    return _met(make_blocks(documents(docs)), work, "doc_id long, start long, end long, first_doc_id long, text string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text`` (and ``n_chars`` counted anew); all rows stay."""
    ship(docs.sparkSession)
    kinds = docs.schema

    def work(block: int, table: pa.Table, replies: list[bytes], _) -> pa.Table:
        texts = table.column("text").to_pylist()
        for i, (raw, runs) in enumerate(_apply(table, replies)):
            if runs:
                edges = [0, *(x for a, b, _ in runs for x in (a, b)), len(raw)]
                texts[i] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "replace")
        return table.set_column(table.column_names.index("text"), table.schema.field("text"), pa.array(texts, table.schema.field("text").type))

    out = _met(make_blocks(docs), work, kinds)
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"].dataType)) if "n_chars" in docs.columns else out
