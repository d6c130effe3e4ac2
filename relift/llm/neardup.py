"""Near-duplicates by HyperMinHash: sketches of shingle sets, banded registers, estimates, full sets.

A document's words are its UTF-8 bytes between blanks, A-Z in lower case; its set is that of its distinct
shingles of ``words`` words.  Its sketch has, for each of ``REGISTERS`` buckets of hash values, the least
value there as a leading-zero count and ten mantissa bits; an empty bucket takes another's register, the
same one in equal sets.  ``ROWS`` registers make a band; documents with an equal band are candidates.
A pair at the similarity has a band in common but for a chance of about (1 - 0.8**6)**60 = 1e-8.

1. Equal sets, by 128 bits of digest, are linked at once, in each block and then over all; the least
   document of each goes on.
2. Candidates in one block are joined into local groups, and each band key leaves the block once.  Keys
   of several blocks link local groups; components of these links are the coarse groups, outside which
   no candidates are.
3. Each coarse group's sketches meet, large groups in one task for each pair of chunks.  There pairs that
   have a band in common and are not yet connected are estimated by their registers, corrected for
   registers that agree by chance; likely ones make the close groups.
4. The texts of each close group meet in the same way, and its pairs are confirmed on the full sets.

Defined cases: NULL and empty texts and texts without words have an empty set and no links; rows with a
NULL doc_id have no links, a NULL component and are kept; doc_id is a key: rows that repeat it with the
same text are one document, and where their texts differ, the links of any one of them stand for all; texts of
any length are sketched whole; other columns are not read, and a filter hands them on; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import documents, map_rows, stored
from .components import components
from .exchange import bucket_count, by_bucket, exchange, expand, groups, make_blocks, meet, pack, squeeze, unpack

#: Words of a shingle; the similarity of a link in hundredths.
WORDS, SIMILAR = 2, 80
BANDS, ROWS = 60, 6
REGISTERS, MANTISSA = BANDS * ROWS, 10
#: Sets below this size are compared without an estimate; standard deviations that an estimate may be too low by.
SMALL, DEVIATIONS = 150, 5.0
#: Rows in a chunk of a large group, at least and most; in between it grows with the group's root.
CHUNK = (96, 4000)
ODD, MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Which full bucket an empty one takes its register from: the one first in the row's order.
CHOICE = np.random.default_rng(11).permuted(np.tile(np.arange(REGISTERS, dtype=np.uint16), (REGISTERS, 1)), axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(raw: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text's bytes."""
    split = raw.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))
    n = min(words, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * ODD + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(out + np.uint64(n)))


def registers(own: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set: leading zeros and mantissa of each bucket's least value, uint16."""
    bucket = (own >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
    value = np.sort(bucket << np.uint64(52) | _mix(own * MORE) >> np.uint64(12))
    first = groups(value >> np.uint64(52))
    full = (value[first] >> np.uint64(52)).astype(np.int64)
    least = (value[first] & np.uint64((1 << 52) - 1)).astype(np.float64) + 1
    bits = least.view(np.uint64) >> np.uint64(52 - MANTISSA)  # exponent and mantissa of the float
    out = np.empty(REGISTERS, np.uint16)
    out[full] = bits.astype(np.int64) - (1023 << MANTISSA)
    if len(full) < REGISTERS:
        empty = np.setdiff1d(np.arange(REGISTERS), full)
        out[empty] = out[full[CHOICE[np.ix_(empty, full)].argmin(1)]]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, of sketches [n, REGISTERS]."""
    x = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * MORE, x.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix(key * ODD + x[:, :, k])
    return key


def estimate(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jaccard estimates: the share of equal registers, less those that agree by chance.

    Two registers of different values agree when both have the same leading zeros (one case in three)
    and the same mantissa.
    """
    chance = 1 / 3 / (1 << MANTISSA)
    return ((others == sketch).mean(1) - chance) / (1 - chance)


class Sets:
    """Union-find over small integers; the root is the least."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


def _digest(own: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


def _sketch_blocks(blocks: DataFrame, words: int, buckets: int) -> DataFrame:
    """Kind 1 rows: digests with their least doc_id; kind 2: sets; kind 3: sketches as an Arrow stream.

    A kind 2 row stands for one block: arrays of its distinct sets' least doc_id and size, and for every
    document which set it has; documents without words have set -1.
    """

    def work(batches) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = unpack(payload.as_py())
                ids, rows, at, least, sketches, sizes, known = [], [], {}, [], [], [], {}
                for doc_id, text in zip(table.column("doc_id").cast(pa.int64()).to_pylist(), table.column("text").to_pylist(), strict=True):
                    if doc_id is None:
                        continue
                    ids.append(doc_id)
                    if (text or "") not in known:
                        own = shingle_set((text or "").encode("utf-8", "surrogatepass"), words, hashes)
                        if not len(own):
                            known[text or ""] = -1
                        else:
                            digest = _digest(own)
                            if digest not in at:
                                at[digest] = len(at)
                                least.append(doc_id)
                                sizes.append(len(own))
                                sketches.append(registers(own).tobytes())
                            known[text or ""] = at[digest]
                    k = known[text or ""]
                    rows.append(k)
                    if k >= 0:
                        least[k] = min(least[k], doc_id)
                out = {"kind": [2], "block": [block], "bucket": [0], "blob": [squeeze(np.concatenate([[len(at), len(ids)], least, sizes, ids, rows]).astype("<i8"))]}
                if at:
                    made = by_bucket(block, buckets, *np.frombuffer(b"".join(at), "<u8").reshape(-1, 2).T, np.array(least, np.int64))
                    out["blob"] += [*made["blob"], pack([pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["rep", "size", "sketch"])])]
                    out["kind"] += [1] * len(made["block"]) + [3]
                    out["block"] += [*made["block"], block]
                    out["bucket"] += [*made["bucket"], 0]
                yield out

    return map_rows(blocks, work, "kind int, block long, bucket int, blob binary")


def _sets_of(blob: bytes) -> tuple[np.ndarray, ...]:
    (flat,) = expand(blob, "<i8")
    n, m = int(flat[0]), int(flat[1])
    return tuple(np.split(flat[2:], [n, 2 * n, 2 * n + m]))


def _judge_digests(key: np.ndarray, block: np.ndarray, check: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For equal digests (both halves), the owners other than the least, and the least."""
    order = np.lexsort((owner, check, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    lead = np.empty(len(key), np.int64)
    lead[order] = np.repeat(owner[order][first], np.diff(np.append(first, len(key))))
    rows = np.flatnonzero(lead != owner)
    return rows, [owner[rows], lead[rows]]


def _local_groups(sketches: DataFrame, equal: DataFrame, buckets: int) -> DataFrame:
    """Kind 0 rows: band keys with their local group; kind 4: sets and their groups.

    Only the first document of an equal set goes on; its candidates within the block are one group.
    """

    def work(block: int, table: pa.Table, replies: list[bytes], _) -> dict:
        gone = set(np.concatenate([expand(r, "<u8", "<i8", "<i8")[1] for r in replies]).tolist()) if replies else set()
        reps = np.array(table.column("rep").to_pylist(), np.int64)
        keep = np.array([x not in gone for x in reps.tolist()], bool)
        sketch = np.stack([np.frombuffer(x, np.uint16) for x in table.column("sketch").to_pylist()])[keep]
        order = np.argsort(reps[keep], kind="stable")
        reps, sketch = reps[keep][order], sketch[order]
        n = len(reps)
        if not n:
            return {"kind": [], "block": [], "bucket": [], "blob": []}
        flat, owner = band_keys(sketch).ravel(), np.repeat(np.arange(n), BANDS)
        by = np.argsort(flat, kind="stable")
        first = groups(flat[by])
        stops, sets = np.append(first[1:], len(by)), Sets(n)
        many = stops - first > 1
        for a, b in zip(first[many].tolist(), stops[many].tolist(), strict=True):
            lead = int(owner[by[a]])
            for x in owner[by[a + 1 : b]].tolist():
                sets.join(lead, x)
        group = reps[sets.roots()]
        made = by_bucket(block, buckets, flat[by[first]], group[owner[by[first]]])
        count = len(made["block"])
        return {"kind": [0] * count + [4], "block": [*made["block"], block], "bucket": [*made["bucket"], 0], "blob": [*made["blob"], squeeze(reps.astype("<i8"), group.astype("<i8"))]}

    return meet(sketches.select("block", F.col("blob").alias("payload")), equal, work, "kind int, block long, bucket int, blob binary")


def _group_links(keys: DataFrame, buckets: int) -> DataFrame:
    """(u, v): for band keys of several blocks, each local group and the least."""

    def reduce(table: pa.Table) -> pa.Table:
        key, owner = (np.concatenate(c) for c in zip(*(expand(blob.as_py(), "<u8", "<i8") for blob in table.column("blob")), strict=True))
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = groups(key)
        lead = np.repeat(owner[first], np.diff(np.append(first, len(key))))
        pairs = np.unique(np.stack([owner, lead], 1)[owner != lead], axis=0)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return keys.select("bucket", "blob").repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(reduce, "u long, v long").distinct()


def _columns(df: DataFrame, kinds: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """Blobs as rows of block and long columns; columns named '' are left out."""
    wanted = [(i, n) for i, n in enumerate(names) if n]

    def flat(batches) -> Iterator[dict]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns = expand(blob.as_py(), *kinds)
                yield {"block": np.full(len(columns[0]), block)} | {n: columns[i] for i, n in wanted}

    return map_rows(df.select("block", "blob"), flat, "block long, " + ", ".join(f"{n} long" for _, n in wanted))


def candidates(sketch: np.ndarray) -> Callable[[int], np.ndarray]:
    """A function that gives the earlier rows with which a row has a band in common."""
    n = len(sketch)
    flat = band_keys(sketch).ravel()
    order = np.argsort(flat, kind="stable")  # rows of a key ascend
    first = groups(flat[order])
    start, place, row = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64), order // BANDS
    start[order] = np.repeat(first, np.diff(np.append(first, len(flat))))
    place[order] = np.arange(len(flat))
    start, place = start.reshape(n, BANDS), place.reshape(n, BANDS)

    def before(i: int) -> np.ndarray:
        spans = [row[a:b] for a, b in zip(start[i].tolist(), place[i].tolist(), strict=True) if a < b]
        return np.unique(np.concatenate(spans)) if spans else row[:0]

    return before


def connect(ids: list[int], sketch: np.ndarray, size: np.ndarray, similar: int, part: list[int], sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect all that links connect; estimated ones, or with ``sets`` confirmed ones.

    Pairs are those with a band in common and not yet connected; of several parts, those between two.
    """
    found, root, parts, before = [], np.arange(len(ids)), np.array(part), candidates(sketch)
    across = len(set(part)) > 1
    for i in range(1, len(ids)):
        others = before(i)
        others = others[(root[others] != root[i]) & ((parts[others] != parts[i]) | (not across))]
        if not len(others):
            continue
        small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        likely = estimate(sketch[i], sketch[others])
        slack = DEVIATIONS * np.sqrt(similar / 100 * (1 - similar / 100) / np.minimum(REGISTERS, large))
        maybe = (100 * small >= similar * large) & ((small < SMALL) | (likely >= similar / 100 - slack))
        for j in others[maybe][np.argsort(-likely[maybe], kind="stable")].tolist():
            if root[j] == root[i]:
                continue
            if sets is not None:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both < similar * (size[i] + size[j] - both):
                    continue
            found.append((ids[i], ids[j]))
            low, high = sorted((int(root[i]), int(root[j])))
            root[root == high] = low
    return found


def _by_pairs(blocks: DataFrame, members: DataFrame, read: Callable[[pa.Table], Iterator[tuple[int, bytes]]], judge: Callable[..., list[tuple[int, int]]], tasks: int, what: str) -> DataFrame:
    """Links (u, v) that ``judge`` finds in groups: ``members`` has block, rep and grp, ``read`` the reps' bytes in a block.

    Small groups share partitions by hash; a large one is dealt into chunks, and its pairs of chunks go
    to one partition after the other, so that no partition has much more of them than another.  A
    partition is sorted, and a pair of chunks is held at a time.  ``judge`` gets reps, bytes and chunks.
    """
    # written, so that the join has two plain shuffles whose hot keys Spark can split
    counts = stored(members.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    chunk = F.greatest(F.lit(CHUNK[0]), F.least(F.lit(CHUNK[1]), F.sqrt("n") * 3))
    active = members.join(counts, "grp").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    wanted = active.groupBy("block").agg(F.collect_list(F.struct("rep", "grp", "chunks", "chunk")).alias("wanted"))
    wanted = wanted.select("block", F.to_json("wanted").cast("binary").alias("blob"))
    places = 4 * tasks

    def send(block: int, table: pa.Table, replies: list[bytes], _) -> dict:
        import json

        out = {k: [] for k in ("place", "grp", "a", "b", "chunk", "rep", "raw")}
        need = {x["rep"]: x for blob in replies for x in json.loads(blob)}
        for rep, raw in read(table) if need else ():
            if (x := need.pop(rep, None)) is None:
                continue
            n, c = x["chunks"], x["chunk"]
            for a, b in [(min(c, k), max(c, k)) for k in range(n)]:
                place = (hash((x["grp"],)) + a * n - a * (a - 1) // 2 + b - a) % places
                for column, value in zip(out.values(), (place, x["grp"], a, b, c, rep, raw), strict=True):
                    column.append(value)
        return out

    def check(batches) -> Iterator[dict]:
        now, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("grp", "a", "b")), strict=True)
            rows = zip(batch.column("rep").to_pylist(), batch.column("raw"), batch.column("chunk").to_pylist(), strict=True)
            for key, (rep, raw, chunk) in zip(keys, rows, strict=True):
                if key != now:
                    yield links(held)
                    now, held = key, []
                held.append((rep, raw.as_py(), chunk))
        yield links(held)

    def links(held: list[tuple[int, bytes, int]]) -> dict:
        found = judge(*map(list, zip(*held, strict=True))) if held else []
        return {"u": [u for u, _ in found], "v": [v for _, v in found]}

    sent = meet(blocks, wanted, send, "place int, grp long, a int, b int, chunk int, rep long, raw binary")
    return stored(map_rows(sent.repartitionById(places, "place").sortWithinPartitions("grp", "a", "b", "rep"), check, "u long, v long"), what)


def groups_of(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, blocks: DataFrame | None = None) -> DataFrame:
    """(block, doc_id, n_shingles, component_id), a row for every row of ``docs`` with a doc_id."""
    ship(docs.sparkSession)
    blocks = make_blocks(documents(docs)) if blocks is None else blocks
    buckets = bucket_count(blocks)
    made = stored(_sketch_blocks(blocks, words, buckets), "sketches")
    same = stored(exchange(made.where("kind = 1").select("block", "bucket", "blob"), ("<u8", "<i8"), _judge_digests, buckets), "equal")
    local = stored(_local_groups(made.where("kind = 3"), same, buckets), "groups")
    coarse = components(_group_links(local.where("kind = 0"), buckets))

    def flat(batches) -> Iterator[dict]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                least, sizes, ids, which = _sets_of(blob.as_py())
                by = np.argsort(which, kind="stable")
                edges = np.searchsorted(which[by], np.arange(-1, len(least) + 1))
                docs_of = [ids[by[edges[k] : edges[k + 1]]].tolist() for k in range(len(least) + 1)]
                yield {"block": [block] * (len(least) + 1), "rep": [None, *least.tolist()], "size": [0, *sizes.tolist()], "docs": docs_of}

    every = map_rows(made.where("kind = 2").select("block", "blob"), flat, "block long, rep long, size long, docs array<long>")
    sets = every.where("rep IS NOT NULL")
    equal = _columns(same, ("<u8", "<i8", "<i8"), ("", "rep", "first")).select("rep", "first").distinct()
    # the least document of each distinct set, with its coarse group
    firsts = _columns(local.where("kind = 4"), ("<i8", "<i8"), ("rep", "grp")).join(coarse.withColumnRenamed("node", "grp"), "grp", "left").select("block", "rep", F.coalesce("component", "grp").alias("grp"))
    firsts = stored(firsts.dropDuplicates(["rep"]), "sets")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)

    def sketched(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        for rep, size, sketch in zip(table.column("rep").to_pylist(), table.column("size").to_pylist(), table.column("sketch").to_pylist(), strict=True):
            yield rep, size.to_bytes(8, "little") + sketch

    def estimated(reps: list[int], raws: list[bytes], chunks: list[int]) -> list[tuple[int, int]]:
        sketch = np.stack([np.frombuffer(r, np.uint16, REGISTERS, 8) for r in raws])
        return connect(reps, sketch, np.array([int.from_bytes(r[:8], "little") for r in raws]), similar, chunks)

    def written(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
            yield doc_id, (text or "").encode("utf-8", "surrogatepass")

    def confirmed(reps: list[int], raws: list[bytes], chunks: list[int]) -> list[tuple[int, int]]:
        hashes = WordHashes()
        sets = [shingle_set(r, words, hashes) for r in raws]
        return connect(reps, np.stack([registers(x) for x in sets]), np.array([len(x) for x in sets]), similar, chunks, sets)

    sketches = made.where("kind = 3").select("block", F.col("blob").alias("payload"))
    close = components(_by_pairs(sketches, firsts, sketched, estimated, tasks, "likely"))
    tight = stored(firsts.drop("grp").join(close.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "rep"), "tight")
    links = _by_pairs(blocks, tight, written, confirmed, tasks, "links")
    found = components(links)
    # each block's sets, then the first of an equal set, then its component, then the set's documents
    last = sets.join(equal, "rep", "left").withColumn("first", F.coalesce("first", "rep")).join(found.select(F.col("node").alias("first"), "component"), "first", "left")
    linked = last.select("block", F.coalesce("component", "first").alias("component_id"), "size", "docs")
    alone = every.where("rep IS NULL").select("block", F.lit(None).cast("long").alias("component_id"), "size", "docs")
    rows = linked.unionByName(alone).select("block", F.explode("docs").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")
    return rows.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of ``docs``."""
    out = groups_of(docs, words, similar).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    none = documents(docs).where("doc_id IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)


def deduplicated(docs: DataFrame, words: int = 5, similar: int = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that are the least doc_id of their group, with all columns; rows with a NULL doc_id stay."""
    blocks = make_blocks(docs)
    gone = groups_of(docs, words, similar, blocks).where("doc_id <> component_id")
    told = gone.groupBy("block").agg(F.to_json(F.collect_set("doc_id")).cast("binary").alias("blob"))

    def keep(block: int, table: pa.Table, replies: list[bytes], _) -> pa.Table:
        import json

        drop = {x for blob in replies for x in json.loads(blob)}
        return table.filter(pa.array([x not in drop for x in table.column("doc_id").to_pylist()], pa.bool_()))

    return meet(blocks, told, keep, docs.schema)
