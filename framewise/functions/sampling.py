"""Draws that depend on the rows alone: the same rows are drawn however the table is partitioned or recomputed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.columns import q

CHUNK = 10_000  # copies of one row that a task makes at once


def numbered_copies(df: DataFrame, out: str, pieces: int | None = None) -> DataFrame:
    """The rows of ``df`` with ``out``, which tells equal rows apart (0 for the first, 1 for the next, ..).

    Equal rows are counted, combined before the shuffle, and made again in chunks that are dealt out: a row that a third of
    the table holds is one row of the count and many tasks afterwards. ``pieces``: their number of partitions; without it
    Spark may choose few, by the size of the counts."""
    parts, left = f"{out}_part", f"{out}_n"
    counts = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(left))
    chunks = counts.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col(left) - 1) / CHUNK))).alias(parts))
    keys = [*[q(c) for c in df.columns], F.col(parts)]
    dealt = chunks.repartition(pieces, *keys) if pieces else chunks.repartition(*keys)
    first = F.col(parts) * CHUNK
    upto = F.least(first + CHUNK, F.col(left)) - 1
    return dealt.select(*[q(c) for c in df.columns], F.explode(F.sequence(first, upto)).alias(out))


def draw(df: DataFrame, key: Sequence[str] | None, seed: int) -> tuple[DataFrame, Column, list[str]]:
    """``df`` with what is needed for a hash per row, that hash (a uniform 64-bit long), and the columns to drop afterwards.
    ``key``: columns that tell rows apart; without them equal rows are numbered."""
    if key:
        return df, F.xxhash64(*[q(c) for c in key], F.lit(seed)), []
    name = "_copy"
    while name in df.columns:
        name += "_"
    d = numbered_copies(df, name)
    return d, F.xxhash64(*[q(c) for c in d.columns], F.lit(seed)), [name]


def sample(df: DataFrame, n: int, key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if there are no more), those with the smallest hashes.

    Only hashes below a bound that some more than ``n`` rows are expected under are sorted, and the bound is raised in the
    rare case that fewer are there."""
    if n <= 0:
        return df.limit(0)
    total = df.count()
    if total <= n:
        return df
    d, h, extra = draw(df, key, seed)
    want = n + 6 * math.sqrt(n) + 10
    while True:
        bound = -(1 << 63) + min(1 << 64, int(want * (1 << 64) / total))
        near = d.where(h < F.lit(bound)) if bound < 1 << 63 else d
        if bound >= 1 << 63 or near.count() >= n:
            return near.orderBy(h, *[q(c) for c in extra]).limit(n).drop(*extra)
        want *= 2
