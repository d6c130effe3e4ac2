import random
from collections import Counter

import numpy as np
import pytest
from relift.llm import decontaminate as d

from .conftest import frame, prose


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    return [(i, prose(rng, rng.randint(4, 60)) + ". " + prose(rng, rng.randint(1, 12)) + ".") for i in range(60)]


def index(items):
    words = [d.tokens(t) for _, t in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for w in words for t in w}))}
    return vocabulary, d.Index(items, vocabulary, Counter(t for w in words for t in set(w)), len(items), sum(map(len, words)) / len(items))


@pytest.mark.parametrize("postings", [1, 3, 64])
@pytest.mark.parametrize("threshold", [0.02, 0.1, 0.3, 0.6])
def test_wand_finds_all_above_the_threshold(items, monkeypatch, postings, threshold):
    monkeypatch.setattr(d, "POSTINGS", postings)
    vocabulary, found = index(items)
    rng = random.Random(postings)
    for _ in range(40):
        words = set(d.tokens(prose(rng, 30)) + rng.sample(d.tokens(items[rng.randrange(60)][1]), 4))
        terms = sorted(vocabulary[w] for w in words if w in vocabulary)
        scores = Counter()
        for t in terms:
            for doc, x in zip(found.docs[t], found.impacts[t], strict=True):
                scores[doc] += x
        want = {doc: s for doc, s in scores.items() if s >= threshold}
        got = dict(found.search(terms, threshold))
        parts = dict(x for low in range(0, 60, 7) for x in found.search(terms, threshold, low, low + 7))
        assert parts.keys() == got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def brute(rows, items):
    """Documents and items by overlap in any window, without any index."""
    longest = max(len(d.tokens(t)) for _, t in items)
    out = set()
    for i, text in rows:
        words = d.tokens(text)
        for a in range(0, max(1, len(words)), longest):
            passage = words[a : a + 2 * longest]
            for item, t in items:
                if d.tokens(t) and all(d.overlap(p, passage) >= d.OVERLAP for p in d.parts(t)):
                    out.add((i, item))
    return out


def test_leaks(spark, odd, items):
    rng = random.Random(10)
    planted = [(1000 + k, prose(rng, 50 * (k % 4)) + " " + t.upper().replace(". ", " ;  ") + "\n" + prose(rng, 20)) for k, (_, t) in enumerate(items[:20])]
    near = [w if k != 9 else "changed" for k, w in enumerate(items[5][1].split())]
    planted += [(1100, " ".join(near)), (1101, items[7][1].rsplit(". ", 1)[0]), (1101, None)]
    rows = odd + planted
    table = spark.createDataFrame([*items, (98, None), (99, ""), (None, "gat ka mi ten fi lo pri no. sul")], "item_id long, text string")
    docs = frame(spark, rows).repartition(2)
    got = d.contaminated(docs, table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(rows, items) and len(got) >= 20
    assert {1000 + k for k in range(20)} <= {r.doc_id for r in got} and all(r.score >= d.THRESHOLD - 1e-9 for r in got)
    clean = d.decontaminated(docs, table)
    assert clean.schema == docs.schema
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, t in rows if i not in {r.doc_id for r in got} or (i, t) == (1101, None))


def test_a_changed_word_in_a_short_part(spark):
    rng = random.Random(15)
    items = [(i, prose(rng, 40) + ". " + prose(rng, n) + ".") for i, n in enumerate((1, 2, 3, 5, 8, 8))]
    rows = []
    for i, text in items:
        words = text.split()
        rows += [(100 * i + k, prose(rng, 9) + " " + " ".join([*words[:k], "changed", *words[k + 1 :]])) for k in range(len(words))]
    rows += [(1000 + i, text.rsplit(". ", 1)[0]) for i, text in items]  # no answer
    got = {(r.doc_id, r.item_id) for r in d.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    whole = {i: d.tokens(t) for i, t in items}
    assert len(d.parts(items[0][1])[0]) == 40  # so 40 has no answer either
    near = {(k, k // 100) for k, t in rows if k < 1000 and k != 40 and d.overlap(whole[k // 100], d.tokens(t)) >= d.OVERLAP}
    assert near <= got and len(near) > 200 and not any(k >= 1000 for k, _ in got)


def test_blocks(spark, items, monkeypatch):
    docs = frame(spark, [(i, t) for i, t in items[:10]])
    table = spark.createDataFrame(items + [(500, prose(random.Random(1), 300))], "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in d.contaminated(docs, table).collect()}
    monkeypatch.setattr(d, "BLOCK_ITEMS", 20)
    assert len(list(d.blocks(table))) > 3
    assert {(r.doc_id, r.item_id) for r in d.contaminated(docs, table).collect()} == whole >= {(i, i) for i in range(10)}


def test_empty(spark, odd_docs, no_docs, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(odd_docs, none).count() == 0 and d.decontaminated(odd_docs, none).count() == len(odd)
    assert d.contaminated(no_docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
