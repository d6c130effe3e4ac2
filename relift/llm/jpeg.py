"""Intra frames: lossless JPEG written and read, baseline JPEG read.

The writer makes lossless frames (SOF3, 8-bit samples, left predictor).  Its Huffman table gives a
difference of s bits a code of 9 - s bits, so that every sample takes 9 bits and packing is array
arithmetic.  The reader takes any Huffman table; that one by the same arithmetic, others bit by bit.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH_BITS = 9
#: Fixed values of the JPEG format: the zig-zag order of an 8 by 8 block's coefficients.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
#: Number of codes of 1 to 16 bits, and the difference sizes they stand for: 8 bits shortest.
LENGTHS, SIZES = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))


def _codes() -> tuple[np.ndarray, np.ndarray]:
    to, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (WIDTH_BITS - s)) - 2  # ones and a zero: 9 - s bits
        value = prefix << s | (d if d > 0 else d + (1 << s) - 1 if d else 0)
        to[d + 255], back[value] = value, d
    return to, back


TO_CODE, FROM_CODE = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """JPEG bytes of uint8 frames [n, height, width]; width a multiple of 8."""
    n, h, w = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    v = TO_CODE[d + 255].reshape(n, -1, 8)
    out = np.empty((n, v.shape[1], 9), np.uint8)
    out[:, :, 0] = v[:, :, 0] >> 1
    for k in range(1, 8):
        out[:, :, k] = (v[:, :, k - 1] << (8 - k) | v[:, :, k] >> (k + 1)) & 0xFF
    out[:, :, 8] = v[:, :, 7] & 0xFF
    head = b"\xff\xd8" + _segment(0xC4, b"\x00" + LENGTHS + SIZES) + _segment(0xC3, struct.pack(">BHHB3B", 8, h, w, 1, 1, 0x11, 0)) + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
    return [head + out[i].tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(n)]


class Bits:
    """A bit reader over entropy-coded bytes without stuffing."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the frame's data end early")
        return self.value >> self.left & ((1 << n) - 1) if n else 0

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, s: int) -> int:
        if not s:
            return 0
        v = self.take(s)
        return v if v >> (s - 1) else v - (1 << s) + 1


def _huffman(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode(data: bytes) -> np.ndarray:
    """The frame's luminance samples, uint8 [height, width]."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, tables, raw, quant, frame, restart = 2, {}, {}, {}, None, 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                lengths, n = body[1:17], sum(body[1:17])
                raw[body[0]] = (lengths, body[17 : 17 + n])
                tables[body[0]] = None
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker in (0xC0, 0xC1, 0xC3):
            depth, h, w, parts = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only 8-bit samples are read")
            frame = (marker, h, w, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)])
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("this kind of JPEG is not read")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            break
    end = data.rfind(b"\xff\xd9")
    scan = data[at : end if end >= 0 else len(data)]
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if frame[0] == 0xC3:
        if len(frame[3]) != 1 or restart:
            raise ValueError("lossless frames have one component and no restarts")
        return _lossless(scan, frame[1], frame[2], raw[chosen[frame[3][0][0]] >> 4], body[1 + 2 * body[0]])
    full = {k: _huffman(*v) for k, v in raw.items()}
    return _baseline(scan, frame, quant, full, chosen, restart)


def _lossless(scan: bytes, h: int, w: int, table: tuple[bytes, bytes], predictor: int) -> np.ndarray:
    if predictor != 1:
        raise ValueError("only the left predictor is read")
    scan = scan.replace(b"\xff\x00", b"\xff")
    if table == (LENGTHS, SIZES) and h * w % 8 == 0:
        b = np.frombuffer(scan, np.uint8, h * w // 8 * 9).reshape(-1, 9).astype(np.uint16)
        v = np.empty((len(b), 8), np.uint16)
        for k in range(8):
            v[:, k] = (b[:, k] << (k + 1) | b[:, k + 1] >> (7 - k)) & 0x1FF
        d = FROM_CODE[v].reshape(h, w).astype(np.int64)
    else:
        bits, codes = Bits(scan), _huffman(*table)
        d = np.array([bits.signed(bits.symbol(codes)) for _ in range(h * w)]).reshape(h, w)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return np.cumsum(d, 1).astype(np.uint8)


def _baseline(scan: bytes, frame: tuple, quant: dict, tables: dict, chosen: dict, restart: int) -> np.ndarray:
    _, h, w, parts = frame
    hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, hm, vm = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-w // (8 * hm)), -(-h // (8 * vm))
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    name, lh, lv, _ = parts[0]
    out = np.zeros((down * 8 * lv, across * 8 * lh))
    pieces, last = [], 0
    for i in range(len(scan) - 1):
        if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
            pieces.append(scan[last:i])
            last = i + 2
    pieces.append(scan[last:])
    mcu = 0
    for piece in pieces:
        bits, before = Bits(piece.replace(b"\xff\x00", b"\xff")), {p[0]: 0 for p in parts}
        for _ in range(restart or across * down):
            if mcu >= across * down:
                break
            for part, ph, pv, q in parts:
                dc, ac = tables[chosen[part] >> 4], tables[0x10 | chosen[part] & 15]
                for y in range(pv):
                    for x in range(ph):
                        block = np.zeros(64)
                        before[part] += bits.signed(bits.symbol(dc))
                        block[0] = before[part] * quant[q][0]
                        i = 1
                        while i < 64:
                            s = bits.symbol(ac)
                            if s == 0:
                                break
                            i += s >> 4
                            if s & 15:
                                block[ZIGZAG[i]] = bits.signed(s & 15) * quant[q][i]
                            i += 1
                        if part == name:
                            r, c = (mcu // across * lv + y) * 8, (mcu % across * lh + x) * 8
                            out[r : r + 8, c : c + 8] = basis.T @ block.reshape(8, 8) @ basis
            mcu += 1
    return np.clip(np.round(out[:h, :w] + 128), 0, 255).astype(np.uint8)
