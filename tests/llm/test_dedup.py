import collections
import hashlib
import random

import numpy as np
import pytest
from relift.llm import cdc, components, neardup, suffix
from relift.llm.exchange import by_bucket, expand, make_blocks

from .conftest import frame, prose

LAST = 1 << 63


def sets_of(rows, n):
    out = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        out.append((i, frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()))
    return out


def brute_groups(rows, n=2):
    """doc_id -> (set sizes, component), all pairs."""
    sets = [(i, s) for i, s in sets_of(rows, n) if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in sets}


@pytest.mark.parametrize("limit", [3000, 10**7])
def test_near_duplicates(spark, odd, odd_docs, monkeypatch, limit):
    monkeypatch.setattr(neardup, "make_blocks", lambda df, **more: make_blocks(df, limit=limit, **more))
    want = brute_groups(odd)
    rows = neardup.near_duplicates(odd_docs).collect()
    sizes = collections.defaultdict(set)
    for i, s in sets_of(odd, 2):
        sizes[i].add(len(s))
    assert len(rows) == len(odd)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept and r.n_shingles == 0
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) and r.n_shingles in sizes[r.doc_id]
    assert any(i != c for i, c in want.items())


def test_large_groups_in_chunks(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(rng, 60).split()
    rows = [(i, " ".join(w if rng.random() > 0.04 else prose(rng, 1) for w in base)) for i in range(60)]
    monkeypatch.setattr(neardup, "CHUNK", (7, 7))
    monkeypatch.setattr(neardup, "make_blocks", lambda df: make_blocks(df, limit=2000))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows).repartition(2)).collect()}
    assert got == brute_groups(rows)


def test_filter_keeps_columns(spark, odd, odd_docs):
    kept = neardup.deduplicated(odd_docs)
    want = brute_groups(odd, 5)
    assert kept.schema == odd_docs.schema
    rows = kept.collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in odd if i is None or want[i] == i)
    assert all(r.block == 7 and r.kept for r in rows)


def test_sketches():
    rng = np.random.default_rng(1)
    make = lambda n: np.unique(rng.integers(0, 1 << 64, n, np.uint64))
    a, other = make(3000), make(3000)
    b = np.unique(np.concatenate([rng.permutation(a)[:2400], make(600)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = neardup.registers(a), neardup.registers(b)
    assert abs(neardup.estimate(x, y[None])[0] - true) < 0.1
    assert (neardup.registers(a[:3]) == neardup.registers(a[:3])).all() and neardup.estimate(x, neardup.registers(other)[None])[0] < 0.02
    assert len(np.unique(neardup.band_keys(x[None]))) == neardup.BANDS


def test_candidates_are_pairs_with_a_common_band(monkeypatch):
    """2,000 sets of similarity 0.4 to 0.6 to their neighbours: as many estimates as pairs with a band in common."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 64, 240, np.uint64)
    sets = [np.unique(np.concatenate([common[rng.random(240) < 0.8], rng.integers(0, 1 << 64, 30, np.uint64)])) for _ in range(2000)]
    sketch = np.stack([neardup.registers(s) for s in sets])
    sample = [(len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))) for i, j in rng.integers(0, 2000, (200, 2)) if i != j]
    assert 0.4 < min(sample) and max(sample) < 0.68
    keys, estimated, compare = neardup.band_keys(sketch), [], neardup.estimate
    monkeypatch.setattr(neardup, "estimate", lambda a, b: estimated.append(len(b)) or compare(a, b))
    found = neardup.connect(list(range(2000)), sketch, np.array([len(s) for s in sets]), 80, [0] * 2000, sets)
    shared = sum(int((keys[:i] == keys[i]).any(1).sum()) for i in range(2000))
    assert found == [] and sum(estimated) == shared < 2000 * 1999 / 2


def test_recall_of_sketches():
    """Pairs at the similarity: each has a band in common, and no estimate is lower than the slack allows."""
    rng = np.random.default_rng(4)
    for size in (5, 20, 60, 150, 400, 1000):
        for _ in range(60):
            same = rng.integers(0, 1 << 64, size, np.uint64)
            more = max(0, size // 4)
            a, b = np.unique(np.concatenate([same, rng.integers(0, 1 << 64, more // 2, np.uint64)])), np.unique(np.concatenate([same, rng.integers(0, 1 << 64, more - more // 2, np.uint64)]))
            sketch = np.stack([neardup.registers(a), neardup.registers(b)])
            assert len(neardup.candidates(sketch)(1)) == 1
            assert neardup.connect([1, 2], sketch, np.array([len(a), len(b)]), 80, [0, 0]) == [(2, 1)]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    up = {x: x for link in links for x in link}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for u, v in links:
        x, y = sorted((root(u), root(v)))
        up[y] = x
    assert got == {x: root(x) for link in links for x in link if x in got} and set(got) >= {x for u, v in links if u != v for x in (u, v)}


def brute_repeats(rows):
    """For each row: bytes, removed, spans, digest of what stays."""
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            w = raw[k : k + 50]
            first[w] = min(first.get(w, LAST), LAST if i is None else i)
    out = collections.Counter()
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < (LAST if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, x in zip(raw, gone, strict=True) if not x)
        out[i, len(raw), sum(gone), sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("limit", [3000, 10**7])
def test_repeated_strings(spark, odd, odd_docs, monkeypatch, limit):
    monkeypatch.setattr(suffix, "make_blocks", lambda df, **more: make_blocks(df, limit=limit, **more))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removals(odd_docs).collect())
    assert got == brute_repeats(odd)


def test_long_texts(spark):
    rng = random.Random(8)
    rows = [(1, prose(rng, 14_000)), (2, prose(rng, 100)), (3, "")]
    rows += [(4, rows[0][1][900:1700] + prose(rng, 50)), (5, prose(rng, 300) + rows[1][1][30:300]), (6, rows[0][1][65_000:66_500] + "x" + rows[0][1][-70_000:])]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removals(frame(spark, rows)).collect())
    assert got == brute_repeats(rows)


def test_steps_do_not_move_anchors(monkeypatch):
    rng = random.Random(9)
    raws = [prose(rng, n).encode() for n in (0, 400, 3, 30, 300, 9, 9, 900)] + [b"w" * 700]

    def windows():
        a = suffix.Anchors(raws)
        found = {(t, i): k for t, k, f, s in zip(a.text.tolist(), a.key.tolist(), a.first.tolist(), a.stop.tolist(), strict=True) for i in range(f, s)}
        assert len(found) == int((a.stop - a.first).sum()) == sum(max(0, len(r) - 49) for r in raws)
        by: dict = {}
        assert all(by.setdefault(raws[t][i : i + 50], k) == k for (t, i), k in found.items())
        return found

    want = windows()
    monkeypatch.setattr(suffix, "STEP", 300)
    assert windows() == want


def test_common_prefixes_decide(monkeypatch):
    rng = random.Random(10)
    one, tag = prose(rng, 40).encode(), np.array([3, 3, 3, 4], np.uint16)
    parts, owner = [one[:80], one[10:84], one[30:82], one[:80] + b"!"], np.array([9, 7, 8, 1])

    def least():
        found, begin = suffix._least_owners(parts, owner, tag)
        return [found[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]

    first = {}
    for p, o, t in zip(parts, owner, tag, strict=True):
        for k in range(len(p) - 49):
            first[t, p[k : k + 50]] = min(first.get((t, p[k : k + 50]), LAST), o)
    want = [[first[t, p[k : k + 50]] for k in range(len(p) - 49)] for p, t in zip(parts, tag, strict=True)]
    assert least() == want
    monkeypatch.setattr(suffix, "prefix_groups", lambda data, n: (np.arange(len(data)), np.arange(len(data))))
    assert least() != want


@pytest.mark.parametrize("n", [1, 2, 50, 700])
@pytest.mark.parametrize("least", [1, 2, 3, 5, 50])
def test_prefix_groups(n, least):
    data = np.random.default_rng(n).integers(0, 3, n)
    data[n // 2 : n // 2 + n // 4] = data[: n // 4]
    order, group = suffix.prefix_groups(data, least)
    assert sorted(order) == list(range(n))
    for a, b, same in zip(order, order[1:], group[1:] == group[:-1], strict=False):
        x, y = data[a : a + least].tolist(), data[b : b + least].tolist()
        assert same == (x == y and len(x) == least)


def test_chunks_find_themselves_again():
    rng = random.Random(6)
    a = prose(rng, 3000).encode()
    b = b"inserted here " + a[:5000] + b" and here" + a[5000:]
    assert b"".join(a[x:y] for x, y in zip([0, *cdc.cut(a)], cdc.cut(a), strict=False)) == a
    chunks = [{raw[x:y] for x, y in zip([0, *cdc.cut(raw)], cdc.cut(raw), strict=False)} for raw in (a, b)]
    assert len(chunks[0] & chunks[1]) > 0.97 * len(chunks[0])
    assert all(y - x <= cdc.MAX_CHUNK for x, y in zip([0, *cdc.cut(a)], cdc.cut(a), strict=False))
    accents = ("é" * 5000).encode()
    assert all(accents[x : x + 1] != b"\xa9" for x in cdc.cut(accents)[:-1]) and cdc.cut(b"") == []


@pytest.mark.parametrize("kind", ["han", "tabs", "nbsp", "encoded"])
def test_chunks_of_unspaced_text_find_themselves_again(kind):
    rng = random.Random(7)
    make = {
        "han": lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n)),
        "tabs": lambda n: prose(rng, n // 2).replace(" ", "\t"),
        "nbsp": lambda n: prose(rng, n // 2).replace(" ", "\xa0"),
        "encoded": lambda n: "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=3 * n)),
    }[kind]
    shared = 0
    for _ in range(30):
        passage, found = make(400), []
        for _ in range(2):
            raw = (make(rng.randint(1, 200)) + passage + make(100)).encode()
            ends = cdc.cut(raw)
            assert ends[-1] == len(raw) and all(b - a <= cdc.MAX_CHUNK for a, b in zip([0, *ends], ends, strict=False))
            found.append({raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)})
        shared += sum(len(c.encode()) for c in found[0] & found[1] if c in passage) >= 0.7 * len(passage.encode())
    assert shared >= 28


def test_steps_do_not_move_boundaries(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choices("日本語テスト ab", [9, 9, 9, 9, 9, 9, 1, 5, 5], k=2000)), prose(rng, 500), "é" * 3000]
    want = [cdc.cut(t.encode()) for t in texts]
    monkeypatch.setattr(cdc, "STEP", 101)
    assert [cdc.cut(t.encode()) for t in texts] == want


def test_gear_hash_is_rolling():
    data = np.frombuffer(prose(random.Random(1), 50).encode(), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (2 * h + int(cdc.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert cdc.gear_hash(data).tolist() == want


def brute_chunks(rows):
    first = {}
    cut = []
    for i, text in rows:
        raw = (text or "").encode()
        ends = cdc.cut(raw)
        chunks = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        cut.append((LAST if i is None else i, chunks))
        for c in chunks:
            first[c] = min(first.get(c, LAST), cut[-1][0])
    out = []
    for (i, text), (who, chunks) in zip(rows, cut, strict=True):
        a, run, spans = 0, None, []
        for c in [*chunks, b""]:
            if c and first[c] < who:
                run = a if run is None else run
            elif run is not None:
                spans += [(run, a)] if a - run >= cdc.MIN_RUN else []
                run = None
            a += len(c)
        out += [(i, x, y) for x, y in spans]
    return collections.Counter(out)


def test_repeated_chunks(spark, odd, odd_docs):
    got = cdc.removed(odd_docs).collect()
    assert collections.Counter((r.doc_id, r.start, r.end) for r in got) == brute_chunks(odd)
    assert {r.doc_id for r in got} >= {301, 302, 303, 101} and all(r.first_doc_id < r.doc_id for r in got if r.doc_id is not None)
    clean = cdc.deduplicated(odd_docs)
    assert clean.schema == odd_docs.schema
    rows = clean.collect()
    gone = collections.Counter()
    for r in got:
        gone[r.doc_id] += r.end - r.start
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in odd)
    before = collections.Counter()
    for i, t in odd:
        before[i] += len((t or "").encode())
    after = collections.Counter()
    for r in rows:
        after[r.doc_id] += len((r.text or "").encode())
        assert r.n_chars == (len(r.text) if r.text is not None else None)
    assert all(before[i] - after[i] == gone[i] for i in before)
    assert sorted(r.doc_id for r in rows if r.text is None and r.doc_id) == [400]


def test_short_words_and_short_copies(spark, monkeypatch):
    rng = random.Random(13)
    short = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 3))) for _ in range(n))
    passages = [short(51) for _ in range(40)]
    rows = [(i, short(30) + " " + p + " " + short(30)) for i, p in enumerate(passages)]
    rows += [(100 + i, short(25) + " " + p + " " + short(40)) for i, p in enumerate(passages)]
    rows += [(200, "A short text."), (201, "A short text."), (202, "A short text. And more"), (203, "x"), (204, "x"), (204, "x"), (None, "x"), (205, "")]
    monkeypatch.setattr(cdc, "make_blocks", lambda df, **more: make_blocks(df, limit=500, **more))
    got = cdc.removed(frame(spark, rows).repartition(3)).collect()
    assert len({r.doc_id for r in got if r.doc_id in range(100, 140)}) >= 36
    assert sorted((r.doc_id or 0, r.start, r.end, r.first_doc_id) for r in got if r.doc_id is None or r.doc_id >= 200) == [(0, 0, 1, 203), (201, 0, 13, 200), (204, 0, 1, 203), (204, 0, 1, 203)]
    kept = {r.doc_id: r.text for r in cdc.deduplicated(frame(spark, rows)).collect()}
    assert (kept[200], kept[201], kept[202], kept[203], kept[None]) == ("A short text.", "", "A short text. And more", "x", "")


def test_empty(no_docs):
    for run in (neardup.near_duplicates, neardup.deduplicated, suffix.removals, cdc.removed, cdc.deduplicated):
        assert run(no_docs).count() == 0


def test_blobs():
    keys, owner = np.array([9 << 60, 5, 1 << 63], np.uint64), np.array([1, -2, 3])
    made = by_bucket(4, 16, keys, owner)
    assert made["bucket"] == [0, 8, 9] and made["block"] == [4] * 3
    assert [expand(b, "<u8", "<i8")[1].tolist() for b in made["blob"]] == [[-2], [3], [1]]
