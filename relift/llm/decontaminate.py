"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap of question and answer.

The index holds the test items; every passage of every training text is a query.  Items are classed by
length, each class twice as long as the one before; for a class, passages are windows of twice its
longest item's words, half overlapping, so that any leaked item lies whole in one.
An item's BM25 score is divided by the score of the item against itself, so one threshold serves all.
A class's items are numbered by length and cut into ranges; a term's greatest impact in each range bounds what a
passage can score there.  These block-max sums are taken for all windows of a batch by array operations,
and end most passages; the rest run block-max WAND over the posting lists.
Retrieved items are then verified: the passage must hold most of the word shingles of the item's
question, and of its answer (its last sentence; both are the whole, if it has one sentence only).  One changed
word takes most shingles of a short part; so a passage with most shingles of the whole item is a leak too if it
lacks one word of the item at most, or a fifth of the words of its shorter part, and no part wholly.

Items are indexed in blocks of bounded size, with document frequencies and lengths of the whole
benchmark; texts are probed by one block after another and never shuffled.  A block takes one scan of
the texts, and has room for 16 MB of items: benchmarks within that are one block.

Defined cases: NULL and empty texts hold nothing; items without words are never found; items and
documents that repeat are reported each; texts of any length are windows from start to end; of a text's
passages with equal scores for an item the first is reported; other columns are not read, and a filter
hands them on; an empty benchmark finds nothing, and an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import documents, map_rows, map_texts, release, steps, stored

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach; share of its shingles; their words.
THRESHOLD, OVERLAP, SHINGLE = 0.7, 0.8, 5
#: Items and bytes of text in one block of the index; postings in one block of a list.
BLOCK_ITEMS, BLOCK_BYTES, POSTINGS = 200_000, 16_000_000, 64
#: Words of the shortest class's items at most; items in a range, at least; ranges of a class, at most.
SHORT, RANGE, RANGES = 16, 8, 64
#: Segments of text whose bounds are held at once.
SEGMENTS = 5000
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def parts(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and answer."""
    found = [w for w in map(tokens, SENTENCE.split(text)) if w]
    if len(found) < 2:
        whole = found[0] if found else []
        return whole, whole
    return [w for s in found[:-1] for w in s], found[-1]


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's distinct shingles (fewer words: the part as one) that the passage holds."""
    n = min(SHINGLE, len(part))
    if not n:
        return 1.0
    own = shingles(part, n)
    return len(own & shingles(passage, n)) / len(own)


def nearly_whole(question: list[str], answer: list[str], passage: list[str], share: float) -> bool:
    """Whether a passage has the item but for a few words, whichever part they are in."""
    whole = question if question is answer else question + answer
    few, held = max(1, min(len(question), len(answer)) // 5), Counter(passage)
    if (Counter(whole) - held).total() > few or overlap(whole, passage) < share:
        return False
    return question is answer or all((Counter(p) - (held - Counter(o))).total() < len(p) for p, o in ((question, answer), (answer, question)))


class Index:
    """One length class of a block: postings ordered by item, with block maxima of normalised impacts."""

    def __init__(self, items: list[tuple[int | None, str]], vocabulary: dict[str, int], frequency: dict[str, int], n: int, mean: float):
        items = sorted(items, key=lambda item: len(tokens(item[1])))
        self.ids = [item_id for item_id, _ in items]
        self.parts = [parts(text) for _, text in items]
        self.longest = 1
        lists: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        for at, (_, text) in enumerate(items):
            words = tokens(text)
            self.longest = max(self.longest, len(words))
            long = K1 * (1 - B + B * len(words) / mean)
            impact = {t: math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * tf * (K1 + 1) / (tf + long) for t, tf in Counter(words).items()}
            whole = sum(impact.values())
            for t, x in impact.items():
                lists[vocabulary[t]].append((at, x / whole))
        self.docs = [[d for d, _ in p] for p in lists]
        self.impacts = [[x for _, x in p] for p in lists]
        self.tops = [max(x, default=0.0) for x in self.impacts]
        self.maxima = [[max(x[i : i + POSTINGS]) for i in range(0, len(x), POSTINGS)] for x in self.impacts]
        # greatest impacts by range of items, one term after another
        self.width = max(RANGE, -(-len(items) // RANGES))
        self.ranges = -(-len(items) // self.width)
        bounds: list[dict[int, float]] = []
        for docs, impacts in zip(self.docs, self.impacts, strict=True):
            own: dict[int, float] = {}
            for d, x in zip(docs, impacts, strict=True):
                own[d // self.width] = max(own.get(d // self.width, 0.0), x)
            bounds.append(own)
        self.first = np.concatenate([[0], np.cumsum([len(b) for b in bounds])]).astype(np.int64)
        self.range_of = np.array([r for b in bounds for r in b], np.int64)
        self.range_top = np.array([x for b in bounds for x in b.values()], float)

    def search(self, terms: list[int], threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """(item's place, score) of the items from ``low`` to ``high`` whose normalised score reaches the threshold.

        Block-max WAND over the posting lists of distinct terms.
        """
        need = threshold - 1e-9
        docs, tops = self.docs, self.tops
        high = len(self.ids) if high is None else high
        at = {t: bisect_left(docs[t], low) for t in terms}
        live = [t for t in terms if at[t] < len(docs[t]) and docs[t][at[t]] < high]
        found = []
        while True:
            live.sort(key=lambda t: docs[t][at[t]])
            bound, pivot = 0.0, -1
            for i, t in enumerate(live):
                bound += tops[t]
                if bound >= need:
                    pivot = i
                    break
            if pivot < 0:
                return found
            doc = docs[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and docs[live[pivot + 1]][at[live[pivot + 1]]] == doc:
                pivot += 1
            bound, ends = 0.0, []
            for t in live[: pivot + 1]:
                place = bisect_left(docs[t], doc, at[t])
                if place < len(docs[t]):
                    block = place // POSTINGS
                    bound += self.maxima[t][block]
                    ends.append(docs[t][min((block + 1) * POSTINGS, len(docs[t])) - 1])
            if bound < need:  # no item up to the nearest block end can reach it
                after = min(ends) + 1
                if pivot + 1 < len(live):
                    after = min(after, docs[live[pivot + 1]][at[live[pivot + 1]]])
                target, move = max(after, doc + 1), live[: pivot + 1]
            elif docs[live[0]][at[live[0]]] == doc:
                score = sum(self.impacts[t][at[t]] for t in live[: pivot + 1])
                if score >= need:
                    found.append((doc, score))
                target, move = doc + 1, live[: pivot + 1]
            else:
                target, move = doc, [t for t in live[:pivot] if docs[t][at[t]] < doc]
            for t in move:
                at[t] = bisect_left(docs[t], target, at[t])
            live = [t for t in live if at[t] < len(docs[t]) and docs[t][at[t]] < high]

    def _promising(self, each: np.ndarray, term: np.ndarray, last: np.ndarray, threshold: float) -> np.ndarray:
        """(window, range) rows whose bound reaches the threshold; a window is a segment and, unless it is a text's last, the next.

        ``each`` and ``term`` are the distinct terms of each segment, by segment.
        """
        found = []
        edges = np.searchsorted(each, np.arange(0, len(last) + SEGMENTS, SEGMENTS))
        for k, a in enumerate(range(0, len(last) - 1, SEGMENTS)):
            n = min(SEGMENTS + 1, len(last) - a)  # one more: the next of the last one
            stop = np.searchsorted(each, a + n)
            s, t = each[edges[k] : stop] - a, term[edges[k] : stop]
            many = self.first[t + 1] - self.first[t]
            place = np.repeat(self.first[t] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            key = np.repeat(s * self.ranges, many) + self.range_of[place]
            bound = np.bincount(key, self.range_top[place], n * self.ranges).astype(float).reshape(n, self.ranges)
            own = min(SEGMENTS, len(last) - 1 - a)
            both = bound[:own].copy()
            both += np.where(last[a : a + own, None], 0.0, np.concatenate([bound[1:], bound[:1] * 0])[:own])
            found.append(np.argwhere(both >= threshold - 1e-9) + [a, 0])
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def probe(self, split: list[list[str]], sizes: np.ndarray, known: np.ndarray, none: int, threshold: float, share: float, out: list[dict]) -> None:
        """Add to each text's dict what :meth:`Block.probe` promises, for this class."""
        wide = self.longest
        segments = -(-sizes // wide)
        base = np.concatenate([[0], np.cumsum(segments)])
        start = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(split)), sizes)
        segment = base[owner] + (np.arange(len(known)) - start[owner]) // wide
        keep = known < none
        each, term = np.divmod(np.unique(segment[keep] * (none + 1) + known[keep]), none + 1)
        last = np.zeros(base[-1] + 1, bool)
        last[base[1:][segments > 0] - 1] = True
        terms: list[int] = []
        before = -1
        for window, part in self._promising(each, term, last, threshold).tolist():
            if window != before:
                a, b = np.searchsorted(each, [window, window + (1 if last[window] else 2)])
                terms, before = np.unique(term[a:b]).tolist(), window
                text = int(np.searchsorted(base, window, "right") - 1)
                first = (window - int(base[text])) * wide
            for item, score in self.search(terms, threshold, part * self.width, (part + 1) * self.width):
                passage = split[text][first : first + 2 * wide]
                question, answer = (overlap(p, passage) for p in self.parts[item])
                key = (self.ids[item], item, self.longest)
                leaked = min(question, answer) >= share or nearly_whole(*self.parts[item], passage, share)
                if leaked and out[text].get(key, (0.0,))[0] < score:
                    out[text][key] = (float(score), question, answer, first)


class Block:
    """A bounded part of the items: one index a length class, one vocabulary."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[str, int], n: int, mean: float):
        self.vocabulary: dict[str, int] = {}
        classes: dict[int, list] = {}
        for item in items:
            words = tokens(item[1])
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
            classes.setdefault(max(0, (len(words) - 1) // SHORT).bit_length(), []).append(item)
        self.classes = [Index(classes[k], self.vocabulary, frequency, n, mean) for k in sorted(classes)]

    def probe(self, texts: list[str | None], threshold: float, share: float) -> list[dict[tuple, tuple]]:
        """For each text the verified items: (item_id, ...) -> (score, question, answer, first word) of its best passage."""
        out: list[dict[tuple, tuple]] = [{} for _ in texts]
        get, none = self.vocabulary.get, len(self.vocabulary)
        split = [tokens(t) for t in texts]
        sizes = np.array([len(w) for w in split])
        if sizes.sum():
            known = np.array([get(w, none) for words in split for w in words], np.int64)
            for index in self.classes:
                index.probe(split, sizes, known, none, threshold, share, out)
        return out


def blocks(items: DataFrame) -> Iterator[Block]:
    """The index, one bounded block after another."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")

    def words(batches) -> Iterator[dict]:
        for batch in batches:
            for ids, texts in steps(batch.column(0), batch.column(1)):
                split = [tokens(t) for t in texts]
                yield {"item_id": ids, "text": texts, "n": [len(w) for w in split], "terms": pa.array([sorted(set(w)) for w in split], pa.list_(pa.string()))}

    worded = stored(map_rows(items, words, "item_id long, text string, n long, terms array<string>").where("n > 0"), "items")
    total = worded.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not total.rows:
        return
    counts = stored(worded.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    many = max(math.ceil(total.rows / BLOCK_ITEMS), math.ceil(total.bytes / BLOCK_BYTES))
    for k in range(many):
        some = worded.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(many)) == k)
        held = sorted(((r.item_id, r.text) for r in some.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if held:
            own = some.select(F.explode("terms").alias("term")).distinct()
            yield Block(held, {r.term: r.df for r in counts.join(own, "term", "left_semi").collect()}, total.rows, total.n / total.rows)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, share: float = OVERLAP) -> DataFrame:
    """One row a document and item that leaked into it, with the best passage's score and overlaps."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], SCHEMA)
    for block in blocks(items):
        held = spark.sparkContext.broadcast(block)  # BLOCK_BYTES of text at most

        def work(held=held):
            def columns(ids: list, texts: list) -> dict:
                out = {part.strip().split(" ")[0]: [] for part in SCHEMA.split(",")}
                for doc_id, hits in zip(ids, held.value.probe(texts, threshold, share), strict=True):
                    for key, row in hits.items():
                        for column, value in zip(out.values(), (doc_id, key[0], *row), strict=True):
                            column.append(value)
                return out

            return columns

        found = found.unionByName(map_texts(docs, work, SCHEMA))
    return found


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, share: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    ship(docs.sparkSession)
    out, at = docs, docs.columns.index("text")
    for block in blocks(items):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, held=held):
            for batch in batches:
                clean: list[bool] = []
                for _, texts in steps(batch.column(at), batch.column(at)):
                    clean += [not hits for hits in held.value.probe(texts, threshold, share)]
                yield batch.filter(pa.array(clean, pa.bool_()))
            release()

        out = out.mapInArrow(keep, docs.schema)
    return out
