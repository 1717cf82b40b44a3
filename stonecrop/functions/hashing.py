"""File hashes, bit distances and perceptual hashes."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fast_hash(name: Column, size: Column, mtime: Column) -> Column:
    """The first 16 hex digits of SHA-256 of ``name:size:mtime``."""
    return F.substring(F.sha2(F.concat_ws(":", name, size.cast("string"), mtime.cast("string")), 256), 1, 16)


def deep_hash(content: Column) -> Column:
    """32 hex digits over the first 4096 bytes, and the last 4096 too if there are over 8192."""
    data = content.cast("binary")
    head = F.substring(data, 1, 4096)
    return F.substring(F.sha2(F.when(F.octet_length(data) > 8192, F.concat(head, F.substring(data, -4096, 4096))).otherwise(head), 256), 1, 32)


def full_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of at most 16 hex digits."""
    number = lambda x: F.conv(x, 16, -10).cast("long")
    return F.bit_count(number(a).bitwiseXOR(number(b)))


@functools.cache
def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2**(radius + 1) - 1 masks of ``bits`` bits: any two numbers that differ in at most ``radius`` bits are equal under one of them.

    Each position has a vector of radius + 1 bits; a mask keeps the positions whose vector has an odd product with the
    mask's number. The vectors of ``radius`` positions don't span the space, so some mask leaves them all out. Each position
    in turn gets the vector that serves the masks with the fewest positions most, so that all keep about as many.
    """
    n = np.arange(1, 2 ** (radius + 1))
    odd = np.bitwise_count(n[:, None] & n[None]) % 2 == 1
    masks, alone = [0] * len(n), np.ones(len(n))
    for i in range(bits):
        kept = odd[np.argmax(odd @ alone)]
        alone[kept] /= 2
        masks = [m | int(k) << i for m, k in zip(masks, kept, strict=True)]
    return masks


def joining_masks(most: int, whole: int = 7) -> list[list[int]]:
    """Lists of masks, with fewer or more masks of fewer or more bits: two numbers that differ in at most ``most`` bits are equal under one of each list.

    The positions are dealt to parts of radii r whose r + 1 sum up to ``most + 1``. A pair that differed in more than r positions of
    each part would differ in more than ``most``, so covering masks of each part are a list. The parts are as wide as makes
    their masks keep about as many bits. Beyond ``whole`` bits there is one list only, of bands that are equal as a whole.
    """
    found = []
    for parts in _sums(most + 1, most + 1) if most <= whole else [[1] * (most + 1)]:
        wide = [(2**x - 1) / 2 ** (x - 1) for x in parts]
        ends = [round(64 * sum(wide[:i]) / sum(wide)) for i in range(len(parts) + 1)]
        found.append(list(dict.fromkeys(m << a for x, a, b in zip(parts, ends, ends[1:], strict=False) for m in covering_masks(x - 1, b - a))))
    return found


def _sums(n: int, most: int) -> list[list[int]]:
    """The ways to make ``n`` of numbers from 1 to ``most``, the largest first."""
    return [[x, *rest] for x in range(min(n, most), 0, -1) for rest in _sums(n - x, x)] if n else [[]]


def bits_to_hex(bits: Column) -> Column:
    """16 hex digits of an array of 64 zeros and ones, the first the highest."""
    return F.lpad(F.lower(F.conv(F.array_join(bits, ""), 2, 16)), 16, "0")


def average_hash(gray: Column) -> Column:
    """aHash of an array of 64 gray values: a bit is whether the value reaches the mean."""
    mean = F.aggregate(gray, F.lit(0.0), lambda s, x: s + x) / F.size(gray)
    return bits_to_hex(F.transform(gray, lambda x: (x >= mean).cast("int")))


def difference_hash(gray: Column) -> Column:
    """dHash of 72 gray values, eight rows of nine: a bit is whether a value exceeds the one to its right."""
    places = F.filter(F.sequence(F.lit(0), F.lit(70)), lambda i: i % 9 != 8)
    return bits_to_hex(F.transform(places, lambda i: (F.get(gray, i) > F.get(gray, i + 1)).cast("int")))


def sign_hash(vector: Column) -> Column:
    """16 hex digits of the signs of a vector's first 64 values."""
    return bits_to_hex(F.transform(F.slice(vector, 1, 64), lambda x: (x >= 0).cast("int")))
