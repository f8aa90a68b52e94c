"""Keyed uniforms: randomness as a pure function of (tag, implicate, row id), the same in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(tag: str, *keys: str | Column) -> Column:
    """A uniform number in [0, 1) from the md5 of 'tag|key|...'."""
    text = F.concat_ws("|", F.lit(tag), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
