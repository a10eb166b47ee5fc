"""Deterministic key hashing (F14, fixed scores, splits).

A value derived from ``md5(key || '|' || seed)`` depends only on the key, so it
is identical under any partitioning or row order and can be reproduced in
plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_POW_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_hash32(key, seed) -> Column:
    """First 8 hex digits of md5(key|seed) as an unsigned 32-bit integer."""
    digest = F.md5(F.concat(_col(key).cast("string"), F.lit("|"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def key_fraction(key, seed) -> Column:
    """Uniform-looking fraction in [0, 1) from the key."""
    return key_hash32(key, seed) / F.lit(TWO_POW_32)


def key_bit(key, seed) -> Column:
    """0/1 assignment from the key (treatment / control, 50/50)."""
    return (key_hash32(key, seed) % 2).cast("int")
