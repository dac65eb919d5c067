"""Seeded draws that any engine repeats: whole numbers from an MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*seed: Column | str) -> Column:
    """MD5, in hex, of the seed's parts joined by colons."""
    return F.md5(F.concat_ws(":", *[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in seed]))


def drawn(n: Column, *seed: Column | str) -> Column:
    """A whole number below n."""
    return F.pmod(F.conv(F.substring(digest(*seed), 1, 8), 16, 10).cast("long"), n)
