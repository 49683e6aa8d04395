"""Threefry-2x64-20 (Salmon et al., 2011): random numbers as a function of key and counter.

A value depends on its key and counter alone, so a column of them is the same
whatever the partitioning, and a lost task makes the same numbers again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Rotation distances of each round, and the parity constant of the key schedule.
ROTATIONS = (16, 42, 12, 31, 16, 32, 24, 21)
PARITY = np.uint64(0x1BD11BDAA9FC1A22)


def threefry(k0: np.ndarray, k1: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k0, k1, c0, c1 = (np.asarray(v).astype(np.uint64) for v in (k0, k1, c0, c1))
    keys = (k0, k1, k0 ^ k1 ^ PARITY)
    with np.errstate(over="ignore"):
        a, b = c0 + keys[0], c1 + keys[1]
        for r in range(20):
            n = np.uint64(ROTATIONS[r % 8])
            a = a + b
            b = ((b << n) | (b >> (np.uint64(64) - n))) ^ a
            if r % 4 == 3:
                s = r // 4 + 1
                a, b = a + keys[s % 3], b + keys[(s + 1) % 3] + np.uint64(s)
    return a, b


def uniform01(x: np.ndarray) -> np.ndarray:
    """In (0, 1]: the middle of one of 2**64 equal steps."""
    return x.astype(np.float64) * 2.0**-64 + 2.0**-65


def uniform11(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64).astype(np.float64) * 2.0**-63 + 2.0**-64


def erfinv(y: np.ndarray) -> np.ndarray:
    """Giles' approximation, then two Newton steps on erf."""
    from math import erf, pi, sqrt

    y = np.asarray(y, float)
    w = -np.log(np.maximum((1 - y) * (1 + y), 1e-300))
    small, w1, w2 = w < 5, w - 2.5, np.sqrt(np.maximum(w, 0)) - 3
    p, q = np.zeros_like(w), np.zeros_like(w)
    for c in (2.81022636e-08, 3.43273939e-07, -3.5233877e-06, -4.39150654e-06, 0.00021858087, -0.00125372503, -0.00417768164, 0.246640727, 1.50140941):
        p = p * w1 + c
    for c in (-0.000200214257, 0.000100950558, 0.00134934322, -0.00367342844, 0.00573950773, -0.0076224613, 0.00943887047, 1.00167406, 2.83297682):
        q = q * w2 + c
    x = np.where(small, p, q) * y
    f = np.vectorize(erf, otypes=[float])
    for _ in range(2):
        x = x - (f(x) - y) / (2 / sqrt(pi) * np.exp(-x * x))
    return x


def gaussian(x: np.ndarray) -> np.ndarray:
    """By the inverse of the normal distribution, two-sided so that both tails are exact."""
    return np.sqrt(2.0) * erfinv(np.clip(uniform11(x), -1 + 2.0**-53, 1 - 2.0**-53))


def column(kind: str):  # noqa: ANN201
    """An Arrow UDF of (key1, key2, counter1, counter2): kind is uint64, uniform_01, uniform_m11 or gaussian."""
    if kind == "uint64":

        @F.pandas_udf("long")
        def bits(k0: pd.Series, k1: pd.Series, c0: pd.Series, c1: pd.Series) -> pd.Series:
            return pd.Series(threefry(k0.values, k1.values, c0.values, c1.values)[0].view(np.int64))

        return bits
    make = {"uniform_01": uniform01, "uniform_m11": uniform11, "gaussian": gaussian}[kind]

    @F.pandas_udf("double")
    def real(k0: pd.Series, k1: pd.Series, c0: pd.Series, c1: pd.Series) -> pd.Series:
        return pd.Series(make(threefry(k0.values, k1.values, c0.values, c1.values)[0]))

    return real


def name_uid(name):  # noqa: ANN001, ANN201
    """The low 31 bits of a name's MD5 read little-endian, as a column."""
    h = F.md5(name)
    swapped = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in (3, 2, 1, 0)])
    return F.conv(swapped, 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
