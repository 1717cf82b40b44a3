"""The JPEG decoder against a plain encoder."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from stonecrop.operators import dedup
from stonecrop.sources import images, jpeg


def encoded(planes, sampling, width, height, restart=0, quant=1):
    """A baseline file of planes of samples, with codes of 4 and 8 bits and one quantum for all."""
    bits, out = [], []
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    padded = []
    for p, (h, v) in zip(planes, sampling, strict=True):
        need = (rows * v * 8, columns * h * 8)
        padded.append(np.pad(p.astype(float), ((0, need[0] - p.shape[0]), (0, need[1] - p.shape[1])), mode="edge") - 128)
    symbols = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0, 0xF0]

    def number(x):
        size = abs(x).bit_length()
        return size, [(x if x > 0 else x + (1 << size) - 1) >> i & 1 for i in reversed(range(size))]

    def put(code, n):
        bits.extend(code >> i & 1 for i in reversed(range(n)))

    def flush():
        while len(bits) % 8:
            bits.append(1)
        raw = np.packbits(bits).tobytes() if bits else b""
        bits.clear()
        return raw.replace(b"\xff", b"\xff\x00")

    before = [0] * len(planes)
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            out.append(flush() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]))
            before = [0] * len(planes)
        y, x = divmod(unit, columns)
        for c, (p, (h, v)) in enumerate(zip(padded, sampling, strict=True)):
            for j in range(v):
                for i in range(h):
                    block = p[(y * v + j) * 8 :][:8, (x * h + i) * 8 :][:, :8]
                    values = np.rint(jpeg.COSINES @ block @ jpeg.COSINES.T / quant).astype(int).ravel()[jpeg.ZIGZAG].tolist()
                    size, low = number(values[0] - before[c])
                    before[c] = values[0]
                    put(size, 4)
                    bits.extend(low)
                    run = 0
                    last = max((k for k in range(1, 64) if values[k]), default=0)
                    for k in range(1, last + 1):
                        if not values[k]:
                            run += 1
                            continue
                        while run > 15:
                            put(symbols.index(0xF0), 8)
                            run -= 16
                        size, low = number(values[k])
                        put(symbols.index(run << 4 | size), 8)
                        bits.extend(low)
                        run = 0
                    if last < 63:
                        put(symbols.index(0), 8)
    out.append(flush())
    seg = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    n = len(planes)
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, b"\0" + bytes([quant] * 64))
    head += seg(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += seg(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + seg(0xC4, b"\x10" + bytes([0] * 7 + [162] + [0] * 8) + bytes(symbols))
    head += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0") + b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("height,width", [(8, 8), (17, 30), (1, 1), (40, 9)])
def test_gray(height, width, restart):
    values = np.random.default_rng(height).integers(0, 256, (height, width))
    got = images.decode(encoded([values], [(1, 1)], width, height, restart))
    assert got.shape == (height, width, 1) and np.abs(got[:, :, 0].astype(int) - values).max() <= 3


@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)]])
def test_colours(sampling):
    """Colours that are constant in squares of two, so repeated chroma is exact."""
    g = np.random.default_rng(3)
    small = g.integers(40, 215, (12, 15, 3))
    rgb = np.repeat(np.repeat(small, 2, 0), 2, 1)
    y = rgb @ np.array([0.299, 0.587, 0.114])
    b, r = 128 + (rgb[:, :, 2] - y) / 1.772, 128 + (rgb[:, :, 0] - y) / 1.402
    planes = [p[:: sampling[0][1] // v, :: sampling[0][0] // h] for p, (h, v) in zip((y, b, r), sampling, strict=True)]
    got = images.decode(encoded(planes, sampling, 30, 24, 2))
    assert got.shape == (24, 30, 3) and np.abs(got.astype(int) - rgb).max() <= 6


def test_broken():
    whole = encoded([np.arange(400).reshape(20, 20) % 256], [(1, 1)], 20, 20)
    assert images.is_sound(whole, ".jpg") and not images.is_sound(whole[:-2], ".jpg")
    for bad in (b"\xff\xd8", whole[:30], whole[:200], whole[:-2], whole.replace(b"\xff\xc0", b"\xff\xc2"), whole[:-40] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            images.decode(bad)


def test_near_jpeg_groups(spark):
    """Copies of an image saved with other quanta are near by their hashes; another image isn't."""
    g = np.random.default_rng(5)
    smooth = lambda: np.kron(g.integers(20, 235, (5, 5)), np.ones((8, 8)))
    one, two = smooth(), smooth()
    files = [("a.jpg", encoded([one], [(1, 1)], 40, 40)), ("b.jpeg", encoded([one], [(1, 1)], 40, 40, quant=12)), ("c.jpg", encoded([two], [(1, 1)], 40, 40)), ("d.jpg", b"\xff\xd8no")]
    rows = images.profiles(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "path string, content binary"))
    status = {r["path"]: r["status"] for r in rows.collect()}
    assert [status[n] for n, _ in files[:3]] == ["ok"] * 3 and status["d.jpg"].startswith("error")
    assert {r["path"] for r in dedup.near_image_groups(rows.filter("status = 'ok'"), "dhash").collect()} == {"a.jpg", "b.jpeg"}
