"""Baseline JPEG to arrays: Huffman codes, 8 bits, gray or three components, any sampling, restart marks.

Progressive and arithmetic files, and those of four components, need another decoder. Chroma is repeated, not
interpolated, so hashes of small images may differ in a bit from those of decoders that interpolate.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Places of a block by diagonals, each in the direction opposite to the one before.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Rows of the cosine transform of eight values.
COSINES = np.cos((2 * np.arange(8)[None] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


@dataclass
class Component:
    number: int
    across: int
    down: int
    table: int
    dc: int = 0
    ac: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.empty(0))


def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may stand next: the length of the code that they begin with times 256, and its symbol; 0 for none."""
    out, code, at = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            first, last = code << (16 - length), (code + 1) << (16 - length)
            if last > 65536:
                raise ValueError("broken code table")
            out[first:last] = [length * 256 + symbol] * (last - first)
            code += 1
        at += n
        code <<= 1
    return out


class Bits:
    """The bits between two marks."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        more = self.data[self.at : self.at + 6]
        # zeros behind the end: a file that is cut short runs into a code that isn't there, or out of patience
        self.held = (self.held << 48) | int.from_bytes(more.ljust(6, b"\0"), "big")
        self.n += 48
        self.at += 6
        if self.at > len(self.data) + 64:
            raise ValueError("data cut short")

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self.fill()
        found = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if not found:
            raise ValueError("broken code")
        self.n -= found >> 8
        self.held &= (1 << self.n) - 1
        return found & 255

    def value(self, size: int) -> int:
        """A signed number of ``size`` bits: those that begin with 0 are negative."""
        if not size:
            return 0
        if self.n < size:
            self.fill()
        self.n -= size
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1


def segments(data: bytes):
    """(mark, body) up to the scan, whose body is its header and all that follows."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no mark where one should be")
        mark = data[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if mark == 0xDA:
            yield mark, data[at + 4 :]
            return
        yield mark, data[at + 4 : at + 2 + n]
        at += 2 + n
    raise ValueError("no scan")


def stretches(data: bytes) -> list[bytes]:
    """The scan's data between restart marks, without stuffing."""
    out, start, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no end mark")
        mark = data[at + 1]
        if mark == 0 or mark == 0xFF:
            at += 2 if mark == 0 else 1
            continue
        out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= mark <= 0xD7:
            return out
        start = at = at + 2


def _block(bits: Bits, dc: list[int], ac: list[int], before: int, row: np.ndarray) -> int:
    """One block's numbers into ``row``; the first is a difference to ``before``."""
    now = before + bits.value(bits.symbol(dc))
    row[0] = now
    k = 1
    while k < 64:
        found = bits.symbol(ac)
        run, size = found >> 4, found & 15
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("broken block")
        row[ZIGZAG[k]] = bits.value(size)
        k += 1
    return now


def decode(data: bytes) -> np.ndarray:
    """Rows, columns and one or three channels; ValueError for what isn't a whole baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, list[int]] = {}
    parts: list[Component] = []
    height = width = interval = 0
    coloured = True
    try:
        for mark, body in segments(data):
            if mark == 0xDB:
                while body:
                    wide, n = body[0] >> 4, 128 if body[0] >> 4 else 64
                    table = np.zeros(64)
                    table[ZIGZAG] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8)
                    quant[body[0] & 15] = table
                    body = body[1 + n :]
            elif mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    codes[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif mark in (0xC0, 0xC1):
                depth, height, width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8 or n not in (1, 3) or not height or not width:
                    raise ValueError("unknown kind of JPEG")
                parts = [Component(c, s >> 4, s & 15, t) for c, s, t in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
            elif 0xC2 <= mark <= 0xCF:
                raise ValueError("not a baseline JPEG")
            elif mark == 0xDD:
                interval = struct.unpack(">H", body[:2])[0]
            elif mark == 0xEE and body[:5] == b"Adobe":
                coloured = body[11] != 0
            elif mark == 0xDA:
                _scan(body, parts, codes, width, height, interval)
        planes = [_plane(c, quant[c.table]) for c in parts]
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"broken JPEG: {e!r}") from None
    if not parts:
        raise ValueError("no frame")
    across, down = max(c.across for c in parts), max(c.down for c in parts)
    whole = [np.repeat(np.repeat(p, down // c.down, 0), across // c.across, 1)[:height, :width] for p, c in zip(planes, parts, strict=True)]
    image = np.stack(whole, 2)
    if len(parts) == 3 and coloured:
        y, b, r = image[:, :, 0], image[:, :, 1] - 128, image[:, :, 2] - 128
        image = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], 2)
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def _scan(body: bytes, parts: list[Component], codes: dict[int, list[int]], width: int, height: int, interval: int) -> None:
    n = body[0]
    if n != len(parts) or not parts:
        raise ValueError("not one scan of all components")
    for i in range(n):
        one = next(c for c in parts if c.number == body[1 + 2 * i])
        one.dc, one.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
    if n == 1:
        parts[0].across = parts[0].down = 1
    across, down = max(c.across for c in parts), max(c.down for c in parts)
    if any(across % c.across or down % c.down for c in parts):
        raise ValueError("unknown sampling")
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    for c in parts:
        c.coefficients = np.zeros((rows * c.down, columns * c.across, 64))
    pieces = stretches(body[4 + 2 * n :])
    step = interval or columns * rows
    if len(pieces) < -(-columns * rows // step):
        raise ValueError("data cut short")
    for start, piece in zip(range(0, columns * rows, step), pieces, strict=False):
        bits, before = Bits(piece), dict.fromkeys((c.number for c in parts), 0)
        for unit in range(start, min(start + step, columns * rows)):
            y, x = divmod(unit, columns)
            for c in parts:
                dc, ac = codes[c.dc], codes[16 + c.ac]
                for v in range(c.down):
                    for h in range(c.across):
                        before[c.number] = _block(bits, dc, ac, before[c.number], c.coefficients[y * c.down + v, x * c.across + h])


def _plane(c: Component, table: np.ndarray) -> np.ndarray:
    """The samples of a component from its blocks."""
    rows, columns, _ = c.coefficients.shape
    blocks = (c.coefficients * table).reshape(rows, columns, 8, 8)
    samples = COSINES.T @ blocks @ COSINES + 128
    return samples.transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
