"""Exact substring de-duplication: repeated byte strings by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``MIN`` bytes that covers it also starts in a document with a smaller doc_id.

1. Every window of ``MIN`` bytes has one anchor: the least hash of its 16-byte grams, the leftmost of
   equals.  Equal windows have equal anchors, so only texts that share an anchor can share a window;
   they then also share the ``SIDE`` bytes to its left or to its right.  The windows of one anchor are
   neighbours; the text they cover is a stretch.  Anchors only route: each block of documents names its
   anchors once, and hears which of them agree with another block's on a side.
2. Each block sends its distinct stretches of shared anchors, as bytes with their least doc_id, to the
   task of the anchor's key range, so that all windows which may be equal meet there.
3. There, equal stretches are one; those of anchors that still have several are joined into one text.
   Its suffixes are sorted, and intervals of the transform are expanded breadth first, one byte to the
   left a level, which finds the longest common prefixes of neighbours by increasing value; levels stop
   at ``MIN``, and places that no level has reached join suffixes which share ``MIN`` bytes or more.
   So every window gets the least doc_id of all that have it, and each block hears which windows of
   its stretches start in a smaller one than its own.

What goes is decided by common prefixes and by comparing bytes; hashes (48 bits of an anchor, 8 of each
side) only choose what is compared.

Defined cases: NULL text is empty; windows never cross documents; rows with the same doc_id do not
remove each other; a NULL doc_id counts as larger than all others, and such rows do not remove each
other; texts under ``MIN`` bytes lose nothing; texts of any length are taken whole, in overlapping steps;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_rows, release, stored
from .exchange import LAST, bucket_count, by_bucket, exchange, expand, groups, make_blocks, meet, ranges, squeeze, unpack

#: Bytes of a repeated string; of an anchor's gram.
MIN, GRAM = 50, 16
#: Bytes beside an anchor, on one side at least, that equal windows share; bits of an anchor's key that are kept.
SIDE, KEPT = 16, ~np.uint64(0xFFFF)
#: Bytes that one vectorised step works on, and the bits that a place in a step takes in an anchor's order.
STEP, PLACE = 1 << 16, np.uint64(16)
#: Parts of a bucket's key range that are compared one after another.
PARTS = 64
#: Between stretches: a byte that UTF-8 does not have.
BETWEEN = b"\xff"
ODD, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes that start at each place."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    n = len(data) - GRAM + 1
    out = x[:n] * ODD
    for k in range(8, GRAM, 8):
        out = _mix(out ^ x[k : k + n])
    return out


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def steps(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, text of each piece, its place in that text): texts together up to STEP bytes.

    Longer ones are cut into pieces that overlap by MIN - 1 bytes, so every window is in one piece.
    """
    held, where, size = [], [], 0

    def close():
        ends = np.cumsum([len(x) for x in held])
        return np.frombuffer(b"".join(held), np.uint8), ends, np.array([w for w, _ in where]), np.array([a for _, a in where])

    for i, raw in enumerate(raws):
        for a in range(0, max(1, len(raw) - MIN + 1), STEP - MIN + 1):
            piece = raw[a : a + STEP]
            if held and size + len(piece) > STEP:
                yield close()
                held, where, size = [], [], 0
            held.append(piece)
            where.append((i, a))
            size += len(piece)
    if held:
        yield close()


class Anchors:
    """Anchors of texts: key, hashes of both sides, text, first window, one past the last, the gram's place."""

    def __init__(self, raws: list[bytes]):
        parts = [found for step in steps(raws) if (found := self._step(*step)) is not None]
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 4)
        self.key, self.left, self.right, self.text, self.first, self.stop, self.place = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else empty

    @staticmethod
    def _step(data: np.ndarray, ends: np.ndarray, text: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...] | None:
        n = len(data) - MIN + 1
        if n < 1:
            return None
        h = gram_hashes(data)
        order = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
        least = window_least(order, MIN - GRAM + 1)[:n]
        turn = np.concatenate([[True], least[1:] != least[:-1]])
        # windows that cross an end belong to no anchor
        inside = np.ones(n + 1, bool)
        for e in ends.tolist():
            inside[max(0, e - MIN + 1) : e] = False
        inside[n:] = False
        inside = inside[:n]
        begins = inside & turn
        begins[1:] |= inside[1:] & ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= turn[1:] | ~inside[1:]
        first, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        at = (least[first] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
        piece = np.searchsorted(ends, first, "right")
        move = shift[piece] - np.concatenate([[0], ends[:-1]])[piece]
        # bytes of other texts may show beside an anchor at a text's ends, where only the other side can count
        sides = [(h[x] >> np.uint64(56)).astype(np.uint8) | np.uint8(1) for x in (np.maximum(at - SIDE, 0), np.minimum(at + GRAM, len(h) - 1))]
        # keys are least hashes: mixed again, so that ranges of keys hold alike
        return _mix(h[at] ^ OTHER) & KEPT, *sides, text[piece], first + move, stop + move, at + move


class Texts:
    """The distinct texts of a block with their least doc_ids, and each row's doc_id and text."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").cast(pa.int64()).to_pylist()
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        self.rows, at = [], {}
        for raw in raws:
            self.rows.append(at.setdefault(raw, len(at)))
        self.raws = list(at)
        self.owner = np.full(len(self.raws), LAST)
        for doc_id, text in zip(self.ids, self.rows, strict=True):
            if doc_id is not None:
                self.owner[text] = min(self.owner[text], doc_id)
        self.base = np.concatenate([[0], np.cumsum([len(x) + MIN for x in self.raws])]).astype(np.int64)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` or more symbols, by doubling from 7 on; settled ones are not sorted again."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = padded[:n].copy()
    for k in range(1, 7):  # 9 bits a symbol: seven fit
        key = key << np.uint64(9) | padded[k : k + n]
    order = np.argsort(key)
    first = groups(key[order])
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    tied, known = np.flatnonzero(np.repeat(size, size) > 1), 7
    while known < depth and len(tied):
        some = order[tied]
        later = np.zeros(len(some), np.uint64)
        inside = some + known < n
        later[inside] = rank[some[inside] + known] + 1
        key = rank[some].astype(np.uint64) * np.uint64(n + 1) + later
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[tied] = some
        first = groups(key)
        size = np.diff(np.append(first, len(key)))
        rank[some] = np.repeat(tied[first], size)
        tied = tied[np.repeat(size, size) > 1]
        known *= 2
    return order


def prefix_groups(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, the number of each one's group): groups share ``least`` symbols or more.

    The longest common prefix of neighbours is found by increasing value.  The queue of a level holds
    intervals of suffixes that begin with the same string of that length; extending the string by each
    symbol before it maps an interval to one interval a symbol.  Where the new interval ends at a place
    without a value, the value is the level's, and the interval joins the next queue.  Only the order by
    ``least`` symbols matters for that, as intervals of shorter strings do not depend on the rest.
    """
    n = len(data)
    order = suffix_order(data, least)
    # row 0 is the empty suffix, which the last symbol precedes; 0 stands before the whole text
    symbols = data.astype(np.uint16) + np.uint16(1)
    bwt = np.concatenate([symbols[-1:] if n else np.zeros(1, np.uint16), np.where(order > 0, symbols[order - 1], 0)]).astype(np.uint16)
    back = np.argsort(bwt, kind="stable").astype(np.int32)
    step = np.empty(n + 1, np.int32)  # from a row to that of the suffix one symbol longer
    step[back] = np.arange(n + 1, dtype=np.int32)
    # runs of one symbol, whose rows move alike: repetitive text has few
    begin = groups(bwt).astype(np.int32)
    end = np.append(begin[1:], n + 1).astype(np.int32)
    run = np.repeat(np.arange(len(begin), dtype=np.int32), end - begin)
    letter, move = bwt[begin], step[begin] - begin
    value = np.full(n + 2, -1, np.int16)  # of rows i - 1 and i
    value[0] = value[n + 1] = 0
    low, high = np.array([0], np.int32), np.array([n + 1], np.int32)
    for level in range(least):
        if not len(low):
            break
        first = run[low]
        sizes = run[high - 1] - first + 1
        ends = np.cumsum(sizes)
        number = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
        which = np.arange(ends[-1], dtype=np.int32) + (first - (ends - sizes).astype(np.int32))[number]
        start = np.maximum(begin[which], low[number]) + move[which]
        stop = np.minimum(end[which], high[number]) + move[which]
        # the parts that an interval has in runs of one symbol are neighbours where they go
        sort = np.argsort(start)
        start, stop, number, symbol = start[sort], stop[sort], number[sort], letter[which[sort]]
        first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (symbol[1:] != symbol[:-1])]))
        low, high = start[first], stop[np.append(first[1:], len(start)) - 1]
        fresh = value[high] < 0
        value[high[fresh]] = level
        low, high = low[fresh], high[fresh]
    return order, np.cumsum(value[1 : n + 1] >= 0) - 1


def _twice(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another row has the same key and side; the key's low bits are free for the side."""
    both = key | side
    order = np.argsort(both)
    same = both[order][1:] == both[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _anchor_rows(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's distinct anchors with the hash of each side, 0 where it has several."""

    def work(batches) -> Iterator[dict]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = Anchors(Texts(unpack(payload.as_py())).raws)
                if not len(a.key):
                    continue
                order = np.argsort(a.key)
                first = groups(a.key[order])
                one = []
                for side in (a.left[order], a.right[order]):
                    low = np.minimum.reduceat(side, first)
                    one.append(np.where(low == np.maximum.reduceat(side, first), low, 0).astype(np.uint8))
                yield by_bucket(block, buckets, a.key[order][first], *one)

    return map_rows(blocks, work, "block long, bucket int, blob binary")


def _judge_anchors(key: np.ndarray, block: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The anchors that agree with another block's on a side: 1 for the left one, 2 for the right one, 3 for both.

    Where a block has several sides for a key, all count.
    """
    first = groups(key)
    if not len(first):
        return first, [left]
    count = np.diff(np.append(first, len(key)))
    several = np.maximum.reduceat((left == 0) | (right == 0), first)
    sides = np.where(np.repeat(several, count), 3, _twice(key, left) + 2 * _twice(key, right)).astype(np.uint8)
    rows = np.flatnonzero(np.repeat(count > 1, count) & (sides > 0))
    return rows, [sides[rows]]


def _read(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    if not blobs:
        return [np.zeros(0, k) for k in kinds]
    return [np.concatenate(c) for c in zip(*(expand(b, *kinds) for b in blobs), strict=True)]


def _shared_windows(texts: Texts, a: Anchors, replies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, one past the last) of windows that another text's may equal, in order of keys."""
    known, told = _read(replies, "<u8", "<u1")
    by = np.argsort(known)
    known, told = known[by], told[by]
    order = np.argsort(a.key, kind="stable")
    key, mine = a.key[order], texts.owner[a.text[order]]
    first = groups(key)
    if not len(first):
        return order, order, order
    count = np.diff(np.append(first, len(key)))
    several = np.minimum.reduceat(mine, first) != np.maximum.reduceat(mine, first)
    # within the block, texts have to agree on a side too
    sides = np.where(np.repeat(several, count), _twice(key, a.left[order]) + 2 * _twice(key, a.right[order]), 0).astype(np.uint8)
    if len(known):
        at = np.minimum(np.searchsorted(known, key[first]), len(known) - 1)
        sides |= np.repeat(np.where(known[at] == key[first], told[at], 0), count).astype(np.uint8)
    some = sides > 0
    order, sides = order[some], sides[some]
    # windows that hold a whole side on which texts agree
    middle = a.place[order] - SIDE
    low = np.where(sides & 1, a.first[order], np.maximum(a.first[order], middle))
    high = np.where(sides & 2, a.stop[order], np.minimum(a.stop[order], middle + 1))
    there = low < high
    return order[there], low[there], high[there]


def _stretch_rows(block: int, table: pa.Table, replies: list[bytes], buckets: int) -> dict[str, list]:
    """Kind 0: by bucket, the distinct stretches in order of keys; kind 1: where the block has them.

    A stretch has a number in its block; a bucket's blob has the first one's.
    """
    texts = Texts(table)
    a = Anchors(texts.raws)
    anchor, low, high = _shared_windows(texts, a, replies)
    out: dict[str, list] = {"kind": [], "block": [], "bucket": [], "blob": []}
    if not len(anchor):
        return out
    text = a.text[anchor]
    whole, at = b"".join(texts.raws), low + (texts.base[:-1] - MIN * np.arange(len(texts.raws)))[text]
    found = [whole[i:j] for i, j in zip(at.tolist(), (at + high - low + MIN - 1).tolist(), strict=True)]
    known = {x: i for i, x in enumerate(dict.fromkeys(found))}
    number = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
    new = np.concatenate([[True], number[1:] > np.maximum.accumulate(number)[:-1]])
    key = a.key[anchor[new]]
    owner = np.full(len(known), LAST)
    np.minimum.at(owner, number, texts.owner[text])
    every = list(known)
    size = np.fromiter(map(len, every), np.uint8, len(every))
    part = ranges(key, buckets * PARTS)
    edges = np.searchsorted(part, np.arange(buckets + 1) * PARTS).tolist()
    for bucket, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if i < j:
            count = np.bincount(part[i:j] - bucket * PARTS, minlength=PARTS)
            tag = (key[i:j] >> np.uint64(16)).astype(np.uint16)  # bits beyond the part's
            head = np.concatenate([[i, j - i], count]).astype("<u4").tobytes()
            out["kind"].append(0)
            out["block"].append(block)
            out["bucket"].append(bucket)
            out["blob"].append(squeeze(np.frombuffer(head + _planes(tag, size[i:j], owner[i:j].astype("<i8")) + b"".join(every[i:j]), np.uint8)))
    place = texts.base[text] + low
    by = np.argsort(place)
    state = squeeze(np.diff(place[by], prepend=0).astype("<u4"), (high - low)[by].astype("<u1"), number[by].astype("<u4"))
    return {"kind": [*out["kind"], 1], "block": [*out["block"], block], "bucket": [*out["bucket"], 0], "blob": [*out["blob"], state]}


def _planes(*columns: np.ndarray) -> bytes:
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


class Sent:
    """One block's stretches in a bucket, read again: number of the first, tags, sizes, owners, bytes and parts' edges."""

    def __init__(self, blob: bytes):
        (raw,) = expand(blob, "<u1")
        self.first, n, *count = np.frombuffer(raw[: 4 * (PARTS + 2)].tobytes(), "<u4").tolist()
        self.edges = np.concatenate([[0], np.cumsum(count)]).tolist()
        at = 4 * (PARTS + 2)
        column = lambda kind, a, wide: np.ascontiguousarray(raw[a : a + n * wide].reshape(wide, n).T).view(kind).ravel()
        self.tag, self.size, self.owner = column("<u2", at, 2), column("<u1", at + 2 * n, 1), column("<i8", at + 3 * n, 8)
        self.ends = np.cumsum(self.size, dtype=np.int64)
        self.raw = raw[at + 11 * n :].tobytes()

    def part(self, k: int) -> tuple[int, list[bytes], np.ndarray, np.ndarray]:
        a, b = self.edges[k], self.edges[k + 1]
        edges = [int(self.ends[a - 1]) if a else 0, *self.ends[a:b].tolist()]
        return self.first + a, [self.raw[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)], self.owner[a:b], self.tag[a:b]


def _least_owners(distinct: list[bytes], owner: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least doc_id of each window of the distinct stretches one after another, where each stretch's windows begin).

    Stretches with a tag of their own hold windows that no other one has.
    """
    windows = np.array([len(x) - MIN + 1 for x in distinct], np.int64)
    begin = np.concatenate([[0], np.cumsum(windows)])
    least = np.repeat(owner, windows)
    seen, at, count = np.unique(tag, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[at] > 1)
    if not len(some):
        return least, begin
    joined = np.frombuffer(BETWEEN.join([*(distinct[i] for i in some.tolist()), b""]), np.uint8)
    sizes = windows[some] + MIN  # with what stands between
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order, group = prefix_groups(joined, MIN)
    # the window that starts at each place, if one does
    into = np.full(len(joined), -1)
    run = np.arange(windows[some].sum()) - np.repeat(np.concatenate([[0], np.cumsum(windows[some])[:-1]]), windows[some])
    into[np.repeat(start, windows[some]) + run] = np.repeat(begin[some], windows[some]) + run
    window = into[order]
    real = window >= 0
    window, group = window[real], group[real]
    first = groups(group)
    least[window] = np.repeat(np.minimum.reduceat(least[window], first), np.diff(np.append(first, len(window))))
    return least, begin


def _answers(part: list[tuple[int, list[bytes], np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some blocks' stretches: (sender, numbers, first window, windows) of runs that start in a smaller doc_id."""
    known = {x: i for i, x in enumerate(dict.fromkeys(x for _, texts, _, _ in part for x in texts))}
    if not known:
        return
    which = [np.fromiter(map(known.__getitem__, texts), np.int64, len(texts)) for _, texts, _, _ in part]
    every = np.concatenate(which)
    owner, tag = np.full(len(known), LAST), np.zeros(len(known), np.uint16)
    np.minimum.at(owner, every, np.concatenate([o for *_, o, _ in part]))
    tag[every] = np.concatenate([t for *_, t in part])
    least, begin = _least_owners(list(known), owner, tag)
    lowest = np.minimum.reduceat(least, begin[:-1])
    for k, ((first, _, own, _), at) in enumerate(zip(part, which, strict=True)):
        some = np.flatnonzero(lowest[at] < own)
        if not len(some):
            continue
        a, n = begin[at[some]], (begin[1:] - begin[:-1])[at[some]]
        edge = np.concatenate([[0], np.cumsum(n)])
        inside = np.arange(edge[-1]) - np.repeat(edge[:-1], n)
        over = least[np.repeat(a, n) + inside] < np.repeat(own[some], n)
        starts = over.copy()
        starts[1:] &= ~over[:-1] | (inside[1:] == 0)
        stops = over.copy()
        stops[:-1] &= ~over[1:] | (inside[1:] == 0)
        i, j = np.flatnonzero(starts), np.flatnonzero(stops)
        yield k, first + some[np.searchsorted(edge, i, "right") - 1], inside[i], j - i + 1


def _compared(rows: DataFrame, buckets: int) -> DataFrame:
    """(block, blob): numbers of a block's stretches, and runs of windows there that start in a smaller doc_id."""

    def reduce(table: pa.Table) -> pa.Table:
        blocks, sent = table.column("block").to_pylist(), [Sent(b.as_py()) for b in table.column("blob")]
        found: list[list] = [[] for _ in sent]
        for k in range(PARTS):
            for who, *columns in _answers([s.part(k) for s in sent]):
                found[who].append(columns)
        release()
        told = [(b, squeeze(*(np.concatenate(c).astype(kind) for c, kind in zip(zip(*f, strict=True), ("<u4", "<u1", "<u1"), strict=True)))) for b, f in zip(blocks, found, strict=True) if f]
        return pa.table({"block": pa.array([b for b, _ in told], pa.int64()), "blob": pa.array([x for _, x in told], pa.binary())})

    return rows.where("kind = 0").select("block", "bucket", "blob").repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(reduce, "block long, blob binary")


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that spans cover."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(starts)) - 1
    return starts[new], ends[last]


def _last_pass(table: pa.Table, replies: list[bytes], state: list[bytes]) -> Iterator[tuple[int | None, bytes, np.ndarray, np.ndarray]]:
    """For each row: doc_id, bytes, and the starts and ends of what goes."""
    texts = Texts(table)
    starts = ends = np.zeros(0, np.int64)
    if state:
        gap, windows, number = expand(state[0], "<u4", "<u1", "<u4")
        place, windows, number = np.cumsum(gap, dtype=np.int64), windows.astype(np.int64), number.astype(np.int64)
        mine = texts.owner[np.searchsorted(texts.base, place, "right") - 1]
        least = np.full(int(number.max()) + 1, LAST)
        np.minimum.at(least, number, mine)
        over = least[number] < mine  # the block itself has the stretch in a smaller doc_id
        which, first, many = _read(replies, "<u4", "<u1", "<u1")
        by = np.argsort(which)
        which, first, many = which[by], first[by].astype(np.int64), many[by].astype(np.int64)
        low, high = np.searchsorted(which, number), np.searchsorted(which, number, "right")
        low[over] = high[over]
        count = high - low
        run = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.repeat(low, count)
        again = np.repeat(place, count) + first[run]
        starts, ends = merge(np.concatenate([place[over], again]), np.concatenate([(place + windows)[over], again + many[run]]) + MIN - 1)
    edges = np.searchsorted(starts, texts.base)
    for doc_id, text in zip(texts.ids, texts.rows, strict=True):
        raw = texts.raws[text]
        if len(raw) >= MIN and (LAST if doc_id is None else doc_id) > texts.owner[text]:  # a copy
            yield doc_id, raw, np.array([0]), np.array([len(raw)])
        else:
            some = slice(edges[text], edges[text + 1])
            yield doc_id, raw, starts[some] - texts.base[text], ends[some] - texts.base[text]


def _met(docs: DataFrame, work, schema) -> DataFrame:
    blocks = make_blocks(docs, dealt=True)
    buckets = bucket_count(blocks)
    heard = exchange(_anchor_rows(blocks, buckets), ("<u1", "<u1"), _judge_anchors, buckets)
    rows = stored(meet(blocks, heard, lambda block, table, replies, _: _stretch_rows(block, table, replies, buckets), "kind int, block long, bucket int, blob binary"), "stretches")
    return meet(blocks, _compared(rows, buckets), work, schema, rows.where("kind = 1"))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the spans as an array of (start, end), one row a document."""

    def work(block: int, table: pa.Table, replies: list[bytes], state: list[bytes]) -> dict:
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for doc_id, raw, starts, ends in _last_pass(table, replies, state):
            a, b = starts.tolist(), ends.tolist()
            kept = b"".join([raw[i:j] for i, j in zip([0, *b], [*a, len(raw)], strict=True)]) if a else raw
            spans = [{"start": i, "end": j} for i, j in zip(a, b, strict=True)]
            for column, value in zip(out.values(), (doc_id, len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), spans), strict=True):
                column.append(value)
        return out

    return _met(documents(docs), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
