"""Hashed character n-grams, for the classifiers."""

from __future__ import annotations

from functools import cache

import numpy as np

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F], np.uint64)


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, what isn't a letter as one space, a space at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    points = np.where(letters()[points], points, 32)
    return points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]


def gram_buckets(points: np.ndarray, size: int, bits: int) -> np.ndarray:
    """The bucket, of 2^bits, of each run of `size` code points."""
    n = len(points) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    points = points.astype(np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ points[k : k + n]) * _MULTIPLIERS[k]
        out ^= out >> np.uint64(29)
    return (out * _MULTIPLIERS[0] >> np.uint64(64 - bits)).astype(np.int64)
