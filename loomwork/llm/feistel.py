"""Keyed pseudorandom permutations of [0, n), as Column expressions and over arrays.

A Feistel network over Z_a x Z_b with a = ceil(sqrt(n)) and b = ceil(n / a) permutes [0, a * b), which is less than
a larger than n. Cycle-walking brings results of n or more back in: up to WALK steps, which is every possible walk
for a <= WALK and, beyond, leaves a chance below 1 / a ** WALK.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.llm.textbytes import mix

ROUNDS = 4
WALK = 32


def _rounds(x: Column, a: Column, b: Column, key: Column) -> Column:
    keys = F.array(*[F.lit(i) for i in range(ROUNDS)])
    start = F.struct((x % a).alias("l"), F.call_function("div", x, a).alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, key), a), a)
        return F.struct(left.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(left, i + ROUNDS, key), b), b).alias("r"))

    return F.aggregate(keys, start, step, lambda s: s["r"] * a + s["l"])


def permute(index: Column, n: Column, key: Column) -> Column:
    """The place of index (long, in [0, n)) under the permutation of [0, n) that key selects."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    first = _rounds(index, a, b, key)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda y, _: F.when(y < n, y).otherwise(_rounds(y, a, b, key)))
    return F.when(first < n, first).otherwise(walked)


def permute_array(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """Places of indexes (in [0, n)) under a permutation of [0, n) that key selects; cycles are walked to their end.

    Another family than permute(): its round keys come from a digest of key, its round function is a 64-bit mixer.
    """
    a = math.isqrt(max(0, n - 1)) + 1
    b = -(-n // a) or 1
    words = np.frombuffer(hashlib.sha512(key.encode()).digest(), np.uint64)
    x, left_size, right_size = index.astype(np.uint64), np.uint64(a), np.uint64(b)

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x % left_size, x // left_size
        for i in range(ROUNDS):
            left = (left + mix(right ^ words[i]) % left_size) % left_size
            right = (right + mix(left ^ words[i + ROUNDS]) % right_size) % right_size
        return right * left_size + left

    x = rounds(x)
    out = np.flatnonzero(x >= n)
    while len(out):
        x[out] = rounds(x[out])
        out = out[x[out] >= n]
    return x.astype(np.int64)
