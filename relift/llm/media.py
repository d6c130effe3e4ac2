"""Motion-JPEG in AVI as a binary column: texts stored as video, frames decoded, shots found.

``encode`` stores a payload losslessly: the text's UTF-8 bytes, zero bytes up to a positive multiple
of 64, as 8-bit samples of frames 64 wide and at most 64 high.  A shorter last frame is filled with
zeros; the payload's length stands in the file's INFO list.  ``read`` parses the RIFF chunks and the
idx1 index and decodes every frame.  Shots are cut where the difference of two frames' histograms is
above a floor and above mean plus three deviations of the differences shortly before.

Defined cases: NULL text is empty and makes one frame of zeros; NULL media has no clips; malformed
media raise an error; equal texts give equal bytes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import jpeg
from .common import map_rows, map_texts

WIDTH, HEIGHT, RATE = 64, 64, 25
#: Histogram bins; differences remembered; the least difference that can be a cut.
BINS, MEMORY, FLOOR = 32, 12, 0.25


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(chunks))


def avi(frames: list[bytes], width: int, height: int, note: bytes, rate: int = RATE) -> bytes:
    """An AVI file of JPEG frames, with an idx1 index."""
    most, n = max(map(len, frames)), len(frames)
    head = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, n, most, -1, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    movie, index, at = [], [], 4
    for frame in frames:
        movie.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movie[-1])
    body = _list(b"hdrl", _chunk(b"avih", head), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", form))) + _list(b"INFO", _chunk(b"ICMT", note)) + _list(b"movi", *movie) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def encode_text(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // WIDTH))
    high = min(rows, HEIGHT)
    n = -(-rows // high)
    samples = np.frombuffer(raw.ljust(n * high * WIDTH, b"\0"), np.uint8).reshape(n, high, WIDTH)
    return avi(jpeg.encode_lossless(samples), WIDTH, high, b"text %d payload %d" % (len(raw), rows * WIDTH))


@dataclass
class Video:
    rate: float
    note: bytes
    frames: list[bytes]

    def decode(self) -> list[np.ndarray]:
        return [jpeg.decode(f) for f in self.frames]


def parse(data: bytes) -> Video:
    """The frames that idx1 lists; without an index, those in movi."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, note, movi, index = 0.0, b"", None, b""

    def walk(at: int, end: int) -> None:
        nonlocal rate, note, movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if body + size > len(data):
                raise ValueError("a chunk is cut off")
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = (body, body + size)
                else:
                    walk(body + 4, body + size)
            elif name == b"avih":
                rate = 1e6 / max(1, struct.unpack_from("<I", data, body)[0])
            elif name == b"ICMT":
                note = data[body : body + size].rstrip(b"\0")
            elif name == b"idx1":
                index = data[body : body + size]
            at = body + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    if index:
        # offsets count from the word movi, in some files from the file's start
        base = 0 if len(index) >= 16 and struct.unpack_from("<I", index, 8)[0] >= movi[0] else movi[0]
        for name, _, offset, size in struct.iter_unpack("<4sIII", index):
            if name[2:] in (b"dc", b"db"):
                frames.append(data[base + offset + 8 : base + offset + 8 + size])
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return Video(rate, note, frames)


def cuts(frames: list[np.ndarray]) -> list[tuple[int, float]]:
    """(first frame, histogram difference) of every shot after the first."""
    found, past, last = [], [], None
    for i, frame in enumerate(frames):
        h = np.bincount(frame.ravel() >> 3, minlength=BINS) / frame.size
        if last is not None:
            d = float(np.abs(h - last).sum() / 2)
            if d > max(FLOOR, float(np.mean(past) + 3 * np.std(past)) if past else 0.0):
                found.append((i, d))
                past = []
            else:
                past = [*past, d][-MEMORY:]
        last = h
    return found


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, media: every text as an AVI file."""
    return map_texts(docs, lambda: lambda ids, texts: {"doc_id": ids, "media": [encode_text(t) for t in texts]}, "doc_id long, media binary")


def clips(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a shot of the ``media`` column: key, clip, first_frame, frames, start_s, end_s, difference."""

    def work(batches) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in (key, "clip", "first_frame", "frames", "start_s", "end_s", "difference")}
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (data := data.as_py()) is None:
                    continue
                video = parse(data)
                frames = video.decode()
                starts = [(0, 0.0), *cuts(frames)] if frames else []
                for k, (a, d) in enumerate(starts):
                    b = starts[k + 1][0] if k + 1 < len(starts) else len(frames)
                    for column, value in zip(out.values(), (name, k, a, b - a, a / video.rate, b / video.rate, d), strict=True):
                        column.append(value)
            yield out

    return map_rows(media.selectExpr(f"cast(`{key}` as long) as `{key}`", "media"), work, f"{key} long, clip int, first_frame int, frames int, start_s double, end_s double, difference double")


def digests(media: DataFrame) -> DataFrame:
    """What was stored, read back from the media column, with a feature string of its frames and shots."""

    def work(batches) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                video = parse(data)
                frames = video.decode()
                n, size = map(int, re.fullmatch(rb"text (\d+) payload (\d+)", video.note).groups())
                payload = b"".join(f.tobytes() for f in frames)[:size]
                found = cuts(frames)
                mean = float(np.mean(np.frombuffer(payload, np.uint8)))
                feature = f"frames={len(frames)} shots={len(found) + 1} cuts={','.join(str(i) for i, _ in found)} mean={mean:.3f}"
                row = (name, n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            yield out

    return map_rows(media.select("doc_id", "media"), work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
