"""Numeric expressions of ranking, decay, cost and embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions.arrays import let
from evispark.functions.text import words

# --- fixed values: price per million tokens ---------------------------------
PRICES = {
    "us.anthropic.claude-sonnet-4-5-20250929-v1:0": (3.00, 15.00),
    "us.anthropic.claude-haiku-4-5-20251001-v1:0": (1.00, 5.00),
    "anthropic.claude-3-5-haiku-20241022-v1:0": (0.80, 4.00),
    "gpt-4o-mini": (0.15, 0.60),
    "mock": (0.0, 0.0),
}
# --- end of fixed values ----------------------------------------------------


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl)
    return tf * F.lit(k1 + 1.0) / (tf + norm)


def reciprocal_rank_term(rank: Column, k: float = 60.0) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def link_decay(score: Column, depth: int, decay: float = 0.35) -> Column:
    return F.greatest(F.lit(0.0), score) * F.lit(float(decay) ** depth)


def is_close(a: Column, b: Column, rel: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b))


def discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def usage_cost(model: Column, tokens_in: Column, tokens_out: Column, prices=None) -> Column:
    """Cost from token counts; an unknown model costs nothing."""
    cost = F.lit(0.0)
    for name, (p_in, p_out) in (prices or PRICES).items():
        one = tokens_in / F.lit(1e6) * F.lit(float(p_in)) + tokens_out / F.lit(1e6) * F.lit(float(p_out))
        cost = F.when(model == name, one).otherwise(cost)
    return cost


def md5_mod(text: Column, modulus: int) -> Column:
    """md5 of the text as a 128-bit number modulo ``modulus``, 32 bits at a time."""

    def fold(digest: Column) -> Column:
        acc = F.lit(0).cast("bigint")
        for i in range(4):
            part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
            acc = (acc * F.lit(1 << 32) + part) % F.lit(modulus)
        return acc.cast("int")

    return let(F.md5(text.cast("binary")), fold)


def hash_buckets(text: Column, dim: int = 384) -> Column:
    """Bucket of every white-space word of the lowered text."""
    return F.transform(words(F.lower(text)), lambda w: md5_mod(w, dim))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2_normalise(v: Column) -> Column:
    """Unit-length copy; the zero vector is returned as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(
        F.when(norm == 0, F.lit(1.0)).otherwise(norm), lambda n: F.transform(v, lambda x: x / n)
    )


def draw_index(n: Column, *key: Column) -> Column:
    """Deterministic draw in 0..n-1 from the md5 of the key parts."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n


# Fixed values of the 32-bit mixing step.
MIX_1, MIX_2, STRIDE = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B1


def _mix32(h):
    import numpy as np

    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(MIX_1)
    h = h ^ (h >> np.uint32(13))
    h = h * np.uint32(MIX_2)
    return h ^ (h >> np.uint32(16))


def stream(seed: int, repetition, part: int):
    """Start of the random numbers of one repetition (or an array of them) in one part of the data."""
    import numpy as np

    low = lambda x: (np.atleast_1d(np.asarray(x, dtype=np.int64)) & 0xFFFFFFFF).astype(np.uint32)
    return _mix32(_mix32(low(seed) + low(repetition) * np.uint32(STRIDE)) ^ low(part))


def draws(n: int, start, nth, count: int | None = None):
    """Numbers below ``n`` (at most 2 ** 32), the ``nth`` ones of their streams; with ``count`` so many from the ``nth`` on."""
    import numpy as np

    at = nth if count is None else np.arange(nth, nth + count)
    h = _mix32(start + (np.asarray(at) & 0xFFFFFFFF).astype(np.uint32) * np.uint32(STRIDE))
    return ((h.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def seed_count(top_k: int, fraction: float = 0.5) -> int:
    """Seeds kept for link expansion: ceil(k * fraction), between 1 and k."""
    import math

    return max(1, min(top_k, math.ceil(top_k * fraction)))
