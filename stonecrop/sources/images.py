"""Image arrays: statistics, and perceptual hashes.

PNG, BMP and baseline JPEG bytes are decoded here; other formats need a decoder, which the caller
may give. NumPy, TIFF and Zarr files have no profile.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonecrop.sources import jpeg

REPORT = "width int, height int, dtype string, min double, max double, mean double, nans long, infs long, `unique` long, std double, ahash string, dhash string, status string"
#: Suffixes without a profile.
NOT_IMPLEMENTED = (".npy", ".tif", ".tiff", ".zarr")
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


PNG = b"\x89PNG\r\n\x1a\n"
#: The passes of an interlaced PNG: first column and row, steps across and down.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes, bool]]:
    """(kind, body, whether its checksum holds) up to the last whole chunk."""
    at = 8
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(check) < 4:
            return
        yield kind, body, struct.unpack(">I", check)[0] == zlib.crc32(kind + body)
        at += 12 + n


def is_sound(data: bytes, suffix: str) -> bool:
    """Whether an image file is what its first bytes say, of those kinds that are checked, and whole. Without a checked suffix yes."""
    if suffix not in (".jpg", ".jpeg", ".png", ".bmp"):
        return True
    if data[:8] == PNG:
        seen = list(png_chunks(data))
        return bool(seen) and seen[0][0] == b"IHDR" and seen[-1][0] == b"IEND" and all(ok for _, _, ok in seen)
    if data[:2] == b"BM":
        return len(data) >= 26 and struct.unpack("<I", data[2:6])[0] <= len(data) and struct.unpack("<I", data[10:14])[0] < len(data)
    if data[:3] == b"\xff\xd8\xff":
        return _jpeg_ends(data)
    return data[:6] in (b"GIF87a", b"GIF89a") and data.rstrip(b"\0")[-1:] == b";"


def _jpeg_ends(data: bytes) -> bool:
    """Whether segments follow each other up to the scan and an end mark comes after it."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xDA:
            return data.find(b"\xff\xd9", at) > 0
        at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD7 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return False


def _unfiltered(raw: np.ndarray, line: int, step: int) -> np.ndarray:
    """The bytes of the rows of one pass: (rows, 1 + line) with a filter's number first."""
    out = np.zeros((len(raw), line), np.uint8)
    before = np.zeros(line, np.uint8)
    for y in range(len(raw)):
        kind, now = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            # sums along each channel, modulo 256
            for c in range(step):
                now[c::step] = np.cumsum(now[c::step], dtype=np.uint8)
        elif kind == 2:
            now += before
        elif kind in (3, 4):
            left, corner = [0] * step, [0] * step
            row, up = now.tolist(), before.tolist()
            for x in range(line):
                a, b = left[x % step], up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = corner[x % step]
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = left[x % step] = (row[x] + guess) & 255
                corner[x % step] = b
            now = np.array(row, np.uint8)
        out[y] = before = now
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Rows, columns and channels of a PNG of any depth, interlaced or not; ValueError for any other data."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    parts: dict[bytes, bytes] = {}
    for kind, body, _ in png_chunks(data):
        parts[kind] = parts.get(kind, b"") + body if kind == b"IDAT" else body
    if b"IHDR" not in parts or len(parts[b"IHDR"]) != 13:
        raise ValueError("no header")
    width, height, depth, colour, _, _, woven = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise ValueError("unknown kind of PNG")
    channels = CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(parts.get(b"IDAT", b"")), np.uint8)
    except zlib.error as e:
        raise ValueError(f"broken data: {e}") from None
    image, at = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8), 0
    for x0, y0, dx, dy in PASSES if woven else [(0, 0, 1, 1)]:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line = -(-w * channels * depth // 8)
        if at + h * (line + 1) > len(raw):
            raise ValueError("data cut short")
        rows = _unfiltered(raw[at : at + h * (line + 1)].reshape(h, line + 1), line, max(1, channels * depth // 8))
        at += h * (line + 1)
        if depth == 16:
            values = rows.view(">u2")
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
            values = (bits * (1 << np.arange(depth)[::-1])).sum(2)[:, : w * channels]
        else:
            values = rows
        image[y0::dy, x0::dx] = values.reshape(h, w, channels)
    if b"PLTE" in parts and colour == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[image[:, :, 0]]
    return image * np.uint8(255 // (2**depth - 1)) if depth < 8 else image


def encode_png(gray_: np.ndarray) -> bytes:
    """An 8-bit gray PNG of a matrix."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = gray_.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), gray_.astype(np.uint8)], 1)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_bmp(data: bytes) -> np.ndarray:
    """Rows, columns and channels of an uncompressed BMP of 8, 24 or 32 bits; ValueError for any other data."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP")
    start, head, width, height, _, depth, packing = struct.unpack("<IIiiHHI", data[10:34])
    if packing not in (0, 3) or depth not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("unknown kind of BMP")
    line = -(-width * depth // 32) * 4
    body = data[start : start + line * abs(height)]
    if len(body) < line * abs(height):
        raise ValueError("data cut short")
    rows = np.frombuffer(body, np.uint8).reshape(abs(height), line)[:, : width * depth // 8].reshape(abs(height), width, depth // 8)
    rows = rows if height < 0 else rows[::-1]
    if depth == 8:
        table = np.frombuffer(data[14 + head : start], np.uint8).reshape(-1, 4)
        return table[rows[:, :, 0]][:, :, 2::-1]
    return rows[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    """A PNG, baseline JPEG or BMP, by its first bytes; ValueError for any other data."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    return jpeg.decode(data) if data[:2] == b"\xff\xd8" else decode_png(data)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma by ITU-R 601."""
    image = image if image.ndim == 3 else image[:, :, None]
    return image[:, :, 0].astype(float) if image.shape[2] < 3 else image[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def resized(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """By Lanczos windows of three lobes, widened for shrinking."""
    def weights(n: int, m: int) -> np.ndarray:
        scale = max(n / m, 1.0)
        centre = (np.arange(m) + 0.5) * n / m
        x = (np.arange(n)[None] + 0.5 - centre[:, None]) / scale
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
        return w / w.sum(1, keepdims=True)

    return weights(values.shape[0], height) @ values @ weights(values.shape[1], width).T


def hex_bits(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):0{bits.size // 4}x}"


def average_hash(image: np.ndarray, size: int = 8) -> str:
    small = resized(gray(image), size, size)
    return hex_bits(small >= small.mean())


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    small = resized(gray(image), size, size + 1)
    return hex_bits(small[:, :-1] > small[:, 1:])


def array_report(values: np.ndarray) -> dict:
    """dtype, min, max, mean, nans, infs, unique, std of an array; null where there are no values, mean and std also with infinite ones."""
    v = values.astype(float)
    known = v[~np.isnan(v)]
    least, greatest = (float(known.min()), float(known.max())) if known.size else (None, None)
    mean = float(known.mean()) if known.size and np.isfinite(known).all() else None
    std = None if mean is None else float(known.std())
    return {"dtype": str(values.dtype), "min": least, "max": greatest, "mean": mean, "nans": int(v.size - known.size), "infs": int(np.isinf(v).sum()), "unique": int(len(np.unique(values))), "std": std}


def profiles(files: DataFrame, content_col: str = "content", path_col: str = "path", decode: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(path, ``REPORT``); status is ok, not implemented, or the decoder's error."""
    names = [x.split()[0].strip("`") for x in REPORT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                row = dict.fromkeys(names) | {"path": path}
                if str(path).lower().endswith(NOT_IMPLEMENTED):
                    row["status"] = "not implemented"
                else:
                    try:
                        image = decode(bytes(data))
                        row |= array_report(image) | {"width": image.shape[1], "height": image.shape[0], "ahash": average_hash(image), "dhash": difference_hash(image), "status": "ok"}
                    except Exception as e:  # whatever a decoder raises is the file's status
                        row["status"] = f"error: {e}"[:200]
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", *names]).astype({c: "Int64" for c in ("width", "height", "nans", "infs", "unique")})

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInPandas(run, f"path string, {REPORT}")
