"""Small numeric functions that Spark lacks."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def fnv1a(text: str) -> int:
    """32-bit FNV-1a of the UTF-8 bytes."""
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def seed_of(column, base: int = 42):
    """FNV-1a of a string column plus a base, modulo 2**32: a fold over its bytes."""
    data = F.encode(column, "UTF-8")
    at = F.sequence(F.lit(1), F.octet_length(data))
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    h = F.aggregate(at, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619)) % F.lit(1 << 32))
    h = F.when(F.octet_length(data) > 0, h).otherwise(F.lit(2166136261).cast("long"))
    return (h + base) % F.lit(1 << 32)


def bspline(x: np.ndarray, low: float, high: float, knots: int = 5, degree: int = 3) -> np.ndarray:
    """Basis on uniform knots from low to high, constant beyond them (Cox-de Boor)."""
    if not high > low:
        high = low + 1.0
    x = np.clip(np.asarray(x, float), low, high)
    step = (high - low) / (knots - 1)
    t = low + step * np.arange(-degree, knots + degree)
    n = len(t) - 1
    b = ((x[:, None] >= t[:-1]) & (x[:, None] < t[1:])).astype(float)
    b[x >= high, knots + degree - 2], b[x >= high, knots + degree - 1] = 1.0, 0.0
    for d in range(1, degree + 1):
        left = (x[:, None] - t[None, :n - d]) / (t[d:n] - t[:n - d])
        right = (t[None, d + 1:n + 1] - x[:, None]) / (t[d + 1:n + 1] - t[1:n - d + 1])
        b = left * b[:, :n - d] + right * b[:, 1:n - d + 1]
    return b
