import hashlib
import random
import zlib

import numpy as np
import pytest
from relift.llm import jpeg
from relift.llm.media import avi, clips, cuts, digests, encode, encode_text, parse

from .conftest import frame


def bits_to_bytes(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def signed(v):
    s = abs(v).bit_length()
    return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""


def baseline(image, quant=1):
    """A plain baseline encoder: 8-bit codes for every symbol."""
    h, w = image.shape
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    dc = list(range(12))
    ac = [0x00, 0xF0] + [r << 4 | s for r in range(15) for s in range(1, 12)]
    code = lambda table, x: format(table.index(x), "08b")
    bits, before = "", 0
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            z = np.round(basis @ (image[y : y + 8, x : x + 8] - 128.0) @ basis.T / quant).astype(int).ravel()[jpeg.ZIGZAG]
            s, more = signed(int(z[0]) - before)
            before = int(z[0])
            bits += code(dc, s) + more
            run = 0
            for v in map(int, z[1:]):
                if v == 0:
                    run += 1
                    continue
                while run > 14:
                    bits += code(ac, 0xF0)
                    run -= 16
                if run < 0:
                    raise AssertionError
                s, more = signed(v)
                bits += code(ac, run << 4 | s) + more
                run = 0
            if run:
                bits += code(ac, 0)
    table = lambda kind, symbols: jpeg._segment(0xC4, bytes([kind]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + bytes([quant] * 64)) + table(0, dc) + table(0x10, ac)
    head += jpeg._segment(0xC0, bytes([8, 0, h, 0, w, 1, 1, 0x11, 0])) + jpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return head + bits_to_bytes(bits) + b"\xff\xd9"


def test_baseline_frames():
    y, x = np.mgrid[0:16, 0:24]
    image = (x * 5 + y * 3 + 40).astype(np.uint8)
    assert np.abs(jpeg.decode(baseline(image)).astype(int) - image).max() <= 1


@pytest.mark.parametrize("shape", [(1, 8), (64, 64), (3, 16)])
def test_lossless_frames(shape):
    image = np.random.default_rng(3).integers(0, 256, (2, *shape)).astype(np.uint8)
    image[0] = 255
    for data, frame_ in zip(jpeg.encode_lossless(image), image, strict=True):
        assert (jpeg.decode(data) == frame_).all()


def test_other_huffman_tables():
    image = np.random.default_rng(4).integers(0, 256, (2, 8)).astype(np.uint8)
    d = image.astype(int)
    d[:, 1:] -= image[:, :-1]
    d[1, 0] -= image[0, 0]
    d[0, 0] -= 128
    bits = "".join(format(s, "08b") + more for s, more in map(signed, d.ravel().tolist()))
    table = bytes([0] * 7 + [9] + [0] * 8) + bytes(range(9))
    data = b"\xff\xd8" + jpeg._segment(0xC4, b"\0" + table) + jpeg._segment(0xC3, bytes([8, 0, 2, 0, 8, 1, 1, 0x11, 0])) + jpeg._segment(0xDA, bytes([1, 1, 0, 1, 0, 0])) + bits_to_bytes(bits) + b"\xff\xd9"
    assert (jpeg.decode(data) == image).all()


def test_digests(spark, odd, odd_docs):
    got = sorted(digests(encode(odd_docs)).collect(), key=repr)
    assert len(got) == len(odd)
    by = {}
    for i, t in odd:
        by.setdefault(i, []).append((t or "").encode())
    for r in got:
        raw = next(x for x in by[r.doc_id] if len(x) == r.n_bytes)
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(encode_text(raw.decode())).hexdigest()


def test_shots(spark):
    frames = np.zeros((9, 64, 64), np.uint8)
    frames[3:6] = 200
    frames[6:] = 90
    frames[:, 0, :8] = 17
    assert [i for i, _ in cuts(list(frames))] == [3, 6]
    media = spark.createDataFrame([(1, bytearray(avi(jpeg.encode_lossless(frames), 64, 64, b""))), (2, None)], "doc_id long, media binary")
    rows = clips(media).orderBy("clip").collect()
    assert [(r.doc_id, r.first_frame, r.frames, round(r.start_s, 2), round(r.end_s, 2)) for r in rows] == [(1, 0, 3, 0.0, 0.12), (1, 3, 3, 0.12, 0.24), (1, 6, 3, 0.24, 0.36)]


def test_files_without_an_index_and_broken_ones():
    data = avi(jpeg.encode_lossless(np.zeros((2, 8, 8), np.uint8)), 8, 8, b"n")
    whole = parse(data)
    cut = data[: data.index(b"idx1")]
    assert parse(cut).frames == whole.frames and len(whole.frames) == 2 and whole.note == b"n"
    with pytest.raises(ValueError):
        parse(b"RIFX" + data[4:])
    with pytest.raises(ValueError):
        parse(data[:300])


def test_repeatable(spark):
    rng = random.Random(1)
    text = "".join(rng.choices("abc \n", k=9000))
    rows = digests(encode(frame(spark, [(1, text), (2, text)]))).drop("doc_id").distinct()
    assert rows.count() == 1


def test_empty(no_docs):
    assert digests(encode(no_docs)).count() == 0
