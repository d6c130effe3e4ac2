import random
import zlib

import numpy as np
import pytest
from relift.llm.packing import BestFit, pack, sequences
from relift.llm.tokens import Encoder, default_path

from .conftest import frame


def library(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_encoder_is_the_library(odd):
    texts = [t for _, t in odd] + ["Ünïté it's I'LL 3.14 Œuvre ÀÉß ...don't<|endoftext|>x", "naïve café ﬁ Σίσυφος ΟΔΟΣ", "a\x1cc d", "İ ß ẞ ª", "<|startoftext|> ~!@#"]
    assert [x.tolist() for x in Encoder(kept=200).encode(texts, 7)] == library(texts, 7)
    small = Encoder(kept=200)
    assert [x.tolist() for t in texts for x in small.encode([t], 7)] == library(texts, 7)


def test_best_fit_takes_the_tightest_bin():
    bins = BestFit(10, 3)
    assert [bins.place(n) for n in (6, 5, 9, 4, 1, 5)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 9), (1, 5)]
    full = BestFit(10, 2)  # the fullest closes when a third is opened
    assert [full.place(n)[0] for n in (6, 7, 8, 3, 2)] == [0, 1, 2, 0, 2]


@pytest.mark.parametrize("open_bins", [1, 4, 64])
def test_best_fit_never_overfills(open_bins):
    rng = random.Random(open_bins)
    bins, used = BestFit(50, open_bins), {}
    for _ in range(3000):
        n = rng.randint(1, 50)
        b, at = bins.place(n)
        assert used.get(b, 0) == at and at + n <= 50
        used[b] = at + n
        assert bins.count <= open_bins and bins.count == sum(map(len, bins.at))


def test_pack(spark, odd, odd_docs):
    rows = pack(odd_docs, capacity=64).collect()
    docs = sorted((str(i), ids) for (i, _), ids in zip(odd, library([t for _, t in odd], 0), strict=True))
    pieces, at = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    want = sorted((i, k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(np.array(ids[k * 64 : k * 64 + 64], "<u4").tobytes())) for i, ids in docs for k in range(-(-len(ids) // 64)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(len(ids) for _, ids in docs)
    assert len(at) <= 1.1 * total / 64 + 3


def test_sequences_have_the_ids(spark):
    docs = frame(spark, [(1, "one two three"), (2, "four"), (3, None)])
    packed = pack(docs.coalesce(1), capacity=8, with_ids=True)
    found = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in packed.collect():
        assert found[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_empty(no_docs):
    assert pack(no_docs).count() == 0
