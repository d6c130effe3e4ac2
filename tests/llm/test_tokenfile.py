import zlib

import numpy as np
import pytest
from relift.llm.tokenfile import TokenFile, read, short_lookup, write

from .test_packing import library


def test_round_trip(spark, odd, odd_docs):
    files, dictionary = write(odd_docs)
    rows = sorted(read(files, dictionary).collect(), key=lambda r: r.start)
    ids = {i: set() for i, _ in odd}
    for (i, _), x in zip(odd, library([t for _, t in odd], 2), strict=True):
        ids[i].add(tuple(x))
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys) and len(rows) == len(odd)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        assert any(len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert [tuple(x) for x in short_lookup(files, dictionary, 404)] == list(ids[404])
    assert len(short_lookup(files, dictionary, 500)) == 2 and short_lookup(files, dictionary, 12345) == []


def test_another_dictionary_is_refused(spark, odd_docs):
    files, dictionary = write(odd_docs)
    data = files.first().bytes
    with pytest.raises(ValueError, match="another dictionary"):
        TokenFile(data, dictionary + b"x")
    with pytest.raises(ValueError, match="not a token file"):
        TokenFile(b"x" + data[1:], dictionary)


def test_empty(no_docs):
    assert read(*write(no_docs)).count() == 0


def test_lookup_in_no_files(spark, no_docs):
    assert short_lookup(*write(no_docs), 1) == []
