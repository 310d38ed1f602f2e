"""Exact k nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments; if two codes differ in at most ``segments * (r + 1) - 1`` bits, some segment
differs in at most r. So probing every segment with all values at distance 0, then 1, 2, .. finds all codes up to a
distance that is known after each step. A query is done when its k-th verified distance is within that distance. Each
step probes only the new radius and only for queries that are not done; equal codes are one entry with its smallest
ids, so copies neither multiply candidates nor get lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.session import cut_lineage

BITS = 64


def binary_codes(df: DataFrame, id_col: str, vec_col: str, seed: int = 5) -> DataFrame:
    """``(id, code)``: 64 signs of random projections of each vector, as a long. Vectors that are null, empty, or
    hold null or non-finite components have no code and are left out."""
    src = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            ids, codes = [], []
            for i, v in zip(b["id"], b["v"]):
                x = None if v is None else np.asarray(v, dtype=float)  # null components become NaN
                if x is None or not len(x) or not np.isfinite(x).all():
                    continue
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(seed).normal(size=(len(x), BITS))
                x = x / max(np.abs(x).max(), np.finfo(float).tiny)
                codes.append(int(np.packbits(x @ planes[len(x)] > 0, bitorder="little").view(np.int64)[0]))
                ids.append(i)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=b["id"].dtype), "code": np.array(codes, np.int64)})

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, code long")


def _flips(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for c in itertools.combinations(range(bits), radius)]


def search(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """``(query_id, rank, id, distance)``: for each row of ``queries`` the k rows of ``codes`` (both ``(id, code)``)
    nearest in Hamming distance, ties by smaller id, rows with the query's own id left out. Fewer rows if the table
    has fewer; none for an empty table. Rows with null ids or codes take no part. An id that occurs with several
    codes counts once per distinct code."""
    width = BITS // segments
    codes = codes.where(F.col("id").isNotNull() & F.col("code").isNotNull()).distinct()
    queries = cut_lineage(queries.where(F.col("id").isNotNull() & F.col("code").isNotNull()).distinct())
    need = k + 1  # a query's own row may be among them
    by = Window.partitionBy("code").orderBy("id")
    low = codes.withColumn("r", F.row_number().over(by)).where(F.col("r") <= need)
    classes = cut_lineage(low.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))

    def segment(c, s: int):
        return F.shiftright(c, s * width).bitwiseAND(F.lit((1 << width) - 1)) if s else c.bitwiseAND(F.lit((1 << width) - 1))

    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), segment(F.col("code"), s).alias("val")) for s in range(segments)]))
    index = cut_lineage(classes.select("code", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"), parts.alias("p"))
                        .select("p.seg", "p.val", "code", "n", "first"))
    # bound: no code farther than this can still be among a query's nearest
    active = cut_lineage(queries.select(F.col("code").alias("q"), F.lit(BITS).alias("bound")).distinct())
    best, finished = None, None
    rank = Window.partitionBy("q").orderBy("d", "first")
    for radius in range(width + 1):
        if active.isEmpty():
            break
        masks = F.explode(F.array(*[F.lit(m).cast("long") for m in _flips(width, radius)]))
        probes = active.select("q", "bound", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), segment(F.col("q"), s).alias("val"))
                                                        for s in range(segments)])).alias("p")).select(
            "q", "bound", "p.seg", F.col("p.val").alias("own"), masks.alias("m")).select(
            "q", "bound", "seg", F.col("own").bitwiseXOR(F.col("m")).alias("val"))
        far = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        meet = (probes["seg"] == index["seg"]) & (probes["val"] == index["val"]) & (far <= F.col("bound"))
        found = probes.join(index, meet).select("q", "code", "n", "first", far.alias("d")).distinct()
        if best is not None:
            found = found.unionByName(best.join(active, "q", "left_semi").select(*found.columns)).distinct()
        best = cut_lineage(found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= need).drop("r"))
        covered = segments * (radius + 1) - 1 if radius < width else BITS
        done = best.where(F.col("d") <= covered).groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") >= need).select("q")
        done = cut_lineage(done if radius < width else active)
        kept = best.join(done, "q", "left_semi")
        finished = kept if finished is None else finished.unionByName(kept)
        bounds = best.groupBy("q").agg(F.sum("n").alias("n"), F.max("d").alias("d")).where(F.col("n") >= need).select("q", "d")
        active = cut_lineage(active.join(done, "q", "left_anti").join(bounds, "q", "left").select(
            "q", F.coalesce("d", "bound").alias("bound")))
    if finished is None:
        finished = active.select("q", F.col("q").alias("code"), F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(0).alias("d")).limit(0)
    near = finished.select("q", "code", "d").join(classes, "code").select("q", "d", F.explode("ids").alias("hit"))
    named = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(near, "q").where(
        F.col("hit") != F.col("query_id"))
    order = Window.partitionBy("query_id", "q").orderBy("d", "hit")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("hit").alias("id"), F.col("d").alias("distance"))
